"""Conversation repair against a search over all edits, and on odd rows."""

import hashlib
import re
from itertools import product

import numpy as np
import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from tallframe.llm import conversations
from tallframe.llm.conversations import damaged, repair, replay, slices, solve, together
from tallframe.llm.oracles import ORACLES

ENDS = conversations.ENDS


def brute(codes):
    """The cheapest edits of a signature: all edits of rows, up to two insertions in each gap."""
    best = None
    inserts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    choices = [[("D", None, 4)] if c == "x" else [("D", None, 4), ("K", c.lower(), 3 * c.isupper()), ("R", "u", 3 + 3 * c.isupper()), ("R", "a", 3 + 3 * c.isupper())] for c in codes]
    for edits in product(*choices):
        for gaps in product(inserts, repeat=len(codes) + 1):
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, gaps))
            if best is not None and cost > best[0]:
                continue
            roles, audit = list(gaps[0]), "I" * len(gaps[0])
            for e, g in zip(edits, gaps[1:], strict=True):
                roles += [e[1]] if e[1] else []
                roles += g
                audit += e[0] + "I" * len(g)
            if re.fullmatch("(s?(ua)+)?", "".join(roles)):
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def whole(codes):
    answers = solve(codes)
    return min(answers[s] for s in ENDS if answers[s] is not None)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_solutions_against_all_edits(n):
    codes = ["".join(c) for c in product("uasoUASOx", repeat=n)]
    for c in codes if n < 3 else np.random.default_rng(0).choice(codes, 60):
        assert whole(c) == brute(c), c


def test_pieces_join_to_the_whole():
    rng = np.random.default_rng(1)
    for _ in range(300):
        codes = "".join(rng.choice(list("uasoUASOx"), rng.integers(0, 14)))
        cuts = sorted(rng.integers(0, len(codes) + 1, 3).tolist())
        pieces = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)], strict=True)]
        solved = [([-1 if a is None else a[0] for a in solve(p)], ["" if a is None else a[1] for a in solve(p)]) for p in pieces]
        cost, audit = together(solved)
        assert (cost, audit) == whole(codes)
        parted = slices(audit, [len(p) for p in pieces])
        assert "".join(parted) == audit and all(len(a.replace("I", "")) == len(p) for a, p in zip(parted, pieces, strict=True))


ROWS = [
    (1, 0, "user", "hello there."), (1, 1, "assistant", "hi!"), (1, 1, "assistant", "hi!"), (1, 5, "user", "cut of"),
    (2, None, "system", "rules."), (2, None, "user", "q?"), (2, 3, "assistant", "a."), (2, 4, "tool", "x."),
    (None, 1, "user", "no id."), (None, None, None, None), (3, None, "user", None), (4, 7, "", ""), (5, 2, "assistant", "z. \t\n"), (5, 1, "user", " "),
    *((6, k, "user" if k % 2 else "assistant", f"turn {k}.") for k in range(700)),
    *((7, k, "user", "the same.") for k in range(300)), *((8, 1, "user", "one row.") for _ in range(450)),
    *((9, k, "usa"[k % 3], ("a" if k % 5 else "b c") + ".") for k in range(40)),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").withColumn("copies", F.lit("mine")).withColumn("c", F.lit(1)).repartition(5)


@pytest.mark.parametrize("size", [200, 7])
def test_odd_rows_as_sql(spark, rows, tmp_path, size, monkeypatch):
    monkeypatch.setattr(conversations, "ROWS", size)
    rows.drop("copies", "c").write.parquet(f"{tmp_path}/conversations.parquet")
    assert differences(repair(damaged(rows)), duck(str(tmp_path)), ORACLES["op11_conversations"]) == []


def test_empty_table_and_dropped_conversations(spark, rows):
    assert repair(damaged(rows.limit(0))).count() == 0
    gone = spark.createDataFrame([(k, t, "user", "hi.") for k in range(40) for t in range(1)], "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in repair(damaged(gone)).collect()}
    left = {r.conv_id for r in damaged(gone).where("copies > 0").collect()}
    assert set(found) == set(range(40)) and left < set(found)
    for k in set(found) - left:
        assert tuple(found[k])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_replay():
    lines = replay(0, "KRIDK", "uu5a", ["user", "user", "assistant"], ["q.", "r.", "a."])
    assert lines == ["user:q.", "assistant:r.", "user:", "assistant:a."]
