"""Conversations put in order: faults counted, the cheapest edits found that make the roles alternate, and made.

A row is brought down to one letter, its role's and its fault's; a run of rows of one conversation, a segment, to a
string of these. A conversation is one segment unless it is long or lies at the edge of a range of rows. Each
distinct string is solved once: for each state of the grammar before it and after it, the cheapest edits. Answers
are joined back to segments, and those of a conversation are put together in order. A long conversation is thus
solved in pieces on many machines; what one task gathers of it is its audit, which is one value of the result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallframe.llm.graph import checkpointed

#: Letters of roles (user, assistant, system, other) in rows without fault, cut short, blank and seen before; in a signature the last two are one letter.
WHOLE, CUT, BLANK, AGAIN = "uaso", "UASO", "1234", "5678"
#: Costs of the edits.
DELETE, REROLE, INSERT, KEPT_CUT = 4, 3, 3, 3
#: States: nothing yet, after the system's row, after the user's, after the assistant's; the next by role, and the role that is wanted.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ENDS = (0, 3)
#: Rows of a segment, which bounds the recursion, and bytes of its texts.
ROWS, BYTES = 200, 1 << 20
LETTERS = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (here: an empty row of no turn and no copies), 1 empties its text, 2 takes out full stops,
    exclamation and question marks, 3 repeats it, 4 gives it to the user. A null in any column reads as one space.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.col("_k")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_k"))
    text = F.when(k <= 1, F.lit("")).when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(k == 0, F.lit("")).when(k == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", F.when(k > 0, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def fault(text: Column, first: Column) -> Column:
    """0 to 3: none, cut short, blank, seen before."""
    last = F.regexp_extract(text, rf"({LETTERS})[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", 2).when(~first, 3).when(~last.isin(".", "!", "?"), 1).otherwise(0)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows ``c, conv_id, turn, role, text, copies, fault`` in ranges of conversation, turn, role and text, sorted in each.

    Equal rows are one with so many copies. Which row is the first of its role and text is the least turn of these; it
    is joined by the row's whole key, so that a text that a conversation repeats without end gathers nowhere.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    keyed = rows.select(space("conv_id").alias("c"), "conv_id", "turn", space("turn").alias("t"), "role", "text", F.sha2("text", 256).alias("digest"), "copies")
    keys = ["c", "t", "role", "digest"]
    distinct = keyed.groupBy(*keys).agg(F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    least = keyed.where("copies > 0").groupBy("c", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("least"))
    least = least.select("c", F.coalesce(F.col("least.turn").cast("string"), F.lit(" ")).alias("t"), "role", "digest", F.lit(True).alias("first"))
    told = distinct.join(least, keys, "left").select("c", "conv_id", "turn", "role", "text", "copies", fault(F.col("text"), F.coalesce("first", F.lit(False))).alias("fault"))
    tasks = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return told.repartitionByRange(tasks, "c", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64)).sortWithinPartitions("c", F.col("turn").asc_nulls_first(), "role", "text")


SEGMENT = pa.schema([("c", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seg", pa.int32()), ("codes", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
SEGMENT_SQL = "c string, conv_id bigint, part int, seg int, codes string, low bigint, high bigint, turns bigint, roles array<string>, texts array<string>"


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a conversation in this range of rows; roles and texts of rows that must go aren't kept."""
    part, seg, now, size, held, room = TaskContext.get().partitionId(), 0, None, 0, [], 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([s | {"codes": "".join(s["codes"])} for s in held], SEGMENT)
        held.clear()
        return out

    for batch in batches:
        for c, conv, turn, role, text, copies, kind in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            role_at = "uas".find(role[:1]) if role[:1] else 3
            letters = [(WHOLE, CUT, BLANK, AGAIN)[kind][role_at]]  # an initial that isn't found is at -1, the last
            letters += [(BLANK if kind == 2 else AGAIN)[role_at]]
            new_turn = turn is not None and copies
            for k in range(max(copies, 1)):
                if now is None or now["c"] != c or len(now["codes"]) >= ROWS or size >= BYTES:
                    room += size
                    if room > 4 * BYTES or len(held) >= 1000:
                        yield flush()
                        room = 0
                    now, size = {"c": c, "conv_id": conv, "part": part, "seg": seg, "codes": [], "low": None, "high": None, "turns": 0, "roles": [], "texts": []}, 0
                    held.append(now)
                    seg += 1
                if not copies:
                    break
                now["codes"].append(letters[k > 0])
                if new_turn:
                    now["turns"] += turn != now["high"]
                    now["low"] = turn if now["low"] is None else now["low"]
                    now["high"] = turn
                if k == 0 and kind < 2:
                    now["roles"].append(role)
                    now["texts"].append(text)
                    size += len(text)
    if held:
        yield flush()


def solve(signature: str) -> list[tuple[int, str] | None]:
    """For each state before and each state after (4 times 4), the cheapest edits of a signature and their cost; the ASCII-least of equally cheap ones."""

    @lru_cache(maxsize=None)
    def best(at: int, state: int, goal: int, inserted: int) -> tuple[int, str] | None:
        found = []

        def take(cost: int, edit: str, at: int, state: int, inserted: int = 0) -> None:
            rest = best(at, state, goal, inserted)
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1]))

        if at == len(signature):
            if state == goal:
                found.append((0, ""))
        else:
            c = signature[at]
            take(DELETE, "D", at + 1, state)
            if c != "x":
                cut = KEPT_CUT if c.isupper() else 0
                if c.lower() in NEXT[state]:
                    take(cut, "K", at + 1, NEXT[state][c.lower()])
                take(cut + REROLE, "R", at + 1, WANTED[state][1])
        if inserted < 2:  # a third would only come back to a state that was left
            take(INSERT, "I", at, WANTED[state][1], inserted + 1)
        return min(found, default=None)

    return [best(0, state, goal, 0) for state in range(4) for goal in range(4)]


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        answers = [solve(s) for s in batch.column(0).to_pylist()]
        costs = [[-1 if a is None else a[0] for a in row] for row in answers]
        audits = [["" if a is None else a[1] for a in row] for row in answers]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=["signature", "costs", "audits"])


def together(pieces: list[tuple[list[int], list[str]]]) -> tuple[int, str]:
    """Cost and audit of segments one after the other. What all ways share is set aside, so that long audits aren't copied again and again."""
    ways, shared = {0: (0, "")}, []
    for costs, audits in pieces:
        new: dict[int, tuple[int, str]] = {}
        for state, (cost, audit) in ways.items():
            for goal in range(4):
                if costs[4 * state + goal] >= 0:
                    way = (cost + costs[4 * state + goal], audit + audits[4 * state + goal])
                    new[goal] = min(new.get(goal, way), way)
        common = os.path.commonprefix([audit for _, audit in new.values()])
        shared.append(common)
        ways = {state: (cost, audit[len(common) :]) for state, (cost, audit) in new.items()}
    cost, audit = min(ways[s] for s in ENDS if s in ways)
    return cost, "".join(shared) + audit


def slices(audit: str, lengths: list[int]) -> list[str]:
    """The audit parted by segments of so many rows; what is inserted at an edge stands in the later one."""
    out, at = [], 0
    for k, rows in enumerate(lengths):
        start, stop = at, at
        while rows:
            rows -= audit[stop] != "I"
            stop += 1
        out.append((start, len(audit) if k == len(lengths) - 1 else stop))
        at = stop
    return [audit[a:b] for a, b in out]


RESULT_SQL = "c string, conv_id bigint, part int, seg int, segments int, state int, edits string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment with its edits; the first of a conversation has the conversation's counts, too."""
    names = [f.split()[0] for f in RESULT_SQL.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int32() if f.endswith(" int") else pa.int64() for f in RESULT_SQL.split(", ")]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    rows = (r for b in batches for at in range(0, b.num_rows, 500) for r in b.slice(at, 500).to_pylist())
    held: list[dict] = []
    for c, group in groupby(rows, lambda r: r["c"]):
        own = list(group)
        codes = "".join(r["codes"] for r in own)
        cost, audit = together([(r["costs"], r["audits"]) for r in own])
        known = [r for r in own if r["low"] is not None]
        turns = sum(r["turns"] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:], strict=False))
        initials = codes.translate(str.maketrans(WHOLE + CUT + BLANK + AGAIN, WHOLE * 4))
        counts = {"gaps": known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0, "cost": cost, "audit": audit}
        counts |= {name: sum(map(codes.count, letters)) for name, letters in (("blank", BLANK), ("duplicate", AGAIN), ("truncated", CUT))}
        counts["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        state = 0
        for k, (r, edits) in enumerate(zip(own, slices(audit, [len(r["codes"]) for r in own]), strict=True)):
            held.append({"c": c, "conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "segments": len(own), "state": state, "edits": edits} | (counts if k == 0 else {}))
            state = after(state, edits, r["codes"])
        if len(held) >= 1000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def after(state: int, edits: str, codes: str) -> int:
    """The state after the edits of rows of these codes."""
    own = iter(codes)
    for e in edits:
        c = next(own).lower() if e != "I" else ""
        if e == "K":
            state = NEXT[state][c]
        elif e != "D":
            state = WANTED[state][1]
    return state


def replay(state: int, edits: str, codes: str, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired rows as ``role:text``."""
    out, own, kept = [], iter(codes), iter(zip(roles, texts, strict=True))
    for e in edits:
        if e == "I":
            role, state = WANTED[state]
            out.append(f"{role}:")
            continue
        c = next(own)
        role, text = next(kept) if c in WHOLE + CUT else ("", "")
        if e == "K":
            state = NEXT[state][c.lower()]
            out.append(f"{role}:{text}")
        elif e == "R":
            role, state = WANTED[state]
            out.append(f"{role}:{text}")
    return out


def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, part, seg, sha256, chunk``: the hash of a conversation of one segment, else the repaired rows of this one (null if none are left)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            out = []
            for r in batch.slice(at, 200).to_pylist():
                lines = replay(r["state"], r["edits"], r["codes"], r["roles"], r["texts"])
                body = "\n".join(lines) if lines else None
                alone = r["segments"] == 1
                out.append({"c": r["c"], "part": r["part"], "seg": r["seg"], "sha256": hashlib.sha256((body or "").encode()).hexdigest() if alone else None, "chunk": None if alone else body, "alone": alone})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("c", pa.string()), ("part", pa.int32()), ("seg", pa.int32()), ("sha256", pa.string()), ("chunk", pa.string()), ("alone", pa.bool_())]))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``c, sha256`` of chunks in order; one chunk is held at a time."""
    rows = (r for b in batches for at in range(0, b.num_rows, 8) for r in b.slice(at, 8).to_pylist())
    for c, group in groupby(rows, lambda r: r["c"]):
        digest, empty = hashlib.sha256(), True
        for r in group:
            if r["chunk"] is not None:
                digest.update(("" if empty else "\n").encode() + r["chunk"].encode())
                empty = False
        yield pa.RecordBatch.from_pylist([{"c": c, "sha256": digest.hexdigest()}], pa.schema([("c", pa.string()), ("sha256", pa.string())]))


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``: a row for each conversation.

    ``rows``: ``conv_id, turn, role, text, copies``; other columns aren't read. Rows are taken by turn, nulls first, then by
    role and text, which settles ties; equal rows stand together, and all but the first of them are duplicates. A row of no
    copies stands for none but names its conversation, which has zeros, an empty audit and the hash of nothing if it has no
    other. A null conv_id is a conversation of its own. An empty table gives an empty one. Role and text mustn't be null.

    A row that must be told from others by more than its first letters (its role's initial, its fault) doesn't exist: rows of
    equal signatures are edited alike. The hash of a conversation of many segments is taken chunk by chunk in one task.
    """
    kept = checkpointed(ordered(rows).mapInArrow(segments, SEGMENT_SQL))
    signature = F.translate("codes", BLANK + AGAIN, "x" * 8)
    narrow = kept.select("c", "conv_id", "part", "seg", "codes", "low", "high", "turns", signature.alias("signature"))
    answers = narrow.select("signature").distinct().mapInArrow(solved, "signature string, costs array<bigint>, audits array<string>")
    tasks = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = narrow.join(answers, "signature").drop("signature").repartition(tasks, "c").sortWithinPartitions("c", "part", "seg").mapInArrow(joined, RESULT_SQL)
    told = checkpointed(told)
    edits = told.select("part", "seg", "segments", "state", "edits").join(kept.select("c", "part", "seg", "codes", "roles", "texts"), ["part", "seg"])
    made = edits.mapInArrow(repaired, "c string, part int, seg int, sha256 string, chunk string, alone boolean")
    long = made.where("not alone").select("c", "part", "seg", "chunk").repartition(tasks, "c").sortWithinPartitions("c", "part", "seg").mapInArrow(hashed, "c string, sha256 string")
    hashes = made.where("alone").select("c", "sha256").unionByName(long)
    whole = told.where("audit is not null").join(hashes, "c")
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
