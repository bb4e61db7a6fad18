"""Scores of a hierarchical Pitman-Yor model of word pairs.

Each context word has a restaurant whose customers are the words that follow it; a table sends one customer
to the restaurant that all contexts share, whose own tables draw from the uniform distribution over the known
words and one unknown. Only how many tables serve a word matters for predictions. For each word of a restaurant
(a cell) the seating of its customers is redrawn given all else, by a Metropolis step inside Gibbs sampling:
customers are seated one after the other, new tables by their weight, and the seating is accepted by its ratio
of true weight and proposal. Predictive probabilities are averaged over the sweeps. Cells of a
restaurant are redrawn together, given the totals of the round before, so that they need not meet.

Texts are read once, into chunks of coded words. Chunks ask shards of words for ids and counts, and send their distinct
pairs to shards of cells, by context; contexts of many tokens are split further, by word. Shards of cells and of
words exchange tables and probabilities for some rounds; then cells answer each chunk's pairs with probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tallframe.llm.exchange import bounds, planes, unplanes
from tallframe.llm.text import coded_words, hashes, mix

END, START = hashes([b" end"])[0], (1 << 31) - 1
#: A context of this bit is split over several shards.
SPLIT = np.uint64(1 << 31)
CHUNK = pa.schema({"b": pa.int64(), "ids": pa.binary(), "held": pa.binary(), "lengths": pa.binary(), "keys": pa.binary(), "codes": pa.binary()})
NOTE = pa.schema({"b": pa.int64(), "s": pa.int64(), "kind": pa.int32(), "x": pa.binary(), "y": pa.binary(), "z": pa.binary(), "q": pa.binary()})
OUT = pa.schema({"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()})
WORDS, CELLS = 1, 2


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(a))


def unpacked(b: bytes, kind: type) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(b), kind)


def notes(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(NOTE), NOTE.types, strict=True)], schema=NOTE)


def seated(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, exact: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Seats the customers of each cell in turn: the tables, and the log of the ratio of true weight and proposal.

    ``c``: customers, in falling order; ``a``: the weight of a new table. Beyond ``exact`` customers they are
    seated in blocks of a sixteenth of those who sit.
    """
    t, log = np.ones(len(c)), np.zeros(len(c))
    i = 1
    while k := int(np.searchsorted(-c, -i, "left")):
        if i < exact:
            weight = a[:k] + i - d * t[:k]
            t[:k] += rng.random(k) * weight < a[:k]
            log[:k] += np.log(weight)
            i += 1
        else:
            n = np.minimum(i // 16, c[:k] - i)
            weight = a[:k] + i + (n - 1) / 2 - d * t[:k]
            t[:k] += rng.binomial(n.astype(np.int64), a[:k] / weight)
            log[:k] += n * np.log(weight)
            i += i // 16
    return t, log


def sampled(c: np.ndarray, a: np.ndarray, d: float, sweeps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each cell: the last sample, and the mean of the samples of all sweeps."""
    last = (c > 0).astype(np.float64)  # one customer sits at one table
    mean = last.copy()
    some = np.flatnonzero(c > 1)
    some = some[np.argsort(-c[some], kind="stable")]
    own, weight = c[some], np.maximum(a[some], 1e-12)
    t, log = seated(own, weight, d, rng)
    total = np.zeros(len(some))
    for _ in range(sweeps):
        new, log_new = seated(own, weight, d, rng)
        better = np.log(np.maximum(rng.random(len(some)), 1e-300)) < log_new - log
        t, log = np.where(better, new, t), np.where(better, log_new, log)
        total += t
    last[some], mean[some] = t, total / sweeps
    return last, mean


def discount(c: np.ndarray) -> tuple[float, float]:
    return float((c == 1).sum()), float((c == 2).sum())


def estimated(n1: float, n2: float) -> float:
    """The discount that counts of one and two customers suggest."""
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


class Chunk:
    """Coded words of some documents, with the ids and counts that the word shards gave their words."""

    def __init__(self, row: dict, answers: pa.Table, split: int, shards: int):
        self.docs, self.held = unpacked(row["ids"], np.int64), unpacked(row["held"], np.uint8)
        self.lengths, codes = unpacked(row["lengths"], np.int64), unpacked(row["codes"], np.uint32)
        parts = sorted((r for r in answers.to_pylist() if r["kind"] == WORDS), key=lambda r: r["s"])
        ids, counts = (np.concatenate([unpacked(r[c], np.uint64) for r in parts]) for c in "xy")
        sums = np.sum([np.frombuffer(r["q"]) for r in parts], axis=0)
        self.total, self.vocabulary = float(sums[0]), float(sums[1])
        self.counts = counts[codes]  # of each token
        self.start = np.cumsum(self.lengths) - self.lengths
        w = ids[codes]
        u, context = np.roll(w, 1), np.roll(self.counts, 1)
        u[self.start], context[self.start] = START, self.counts[self.start + self.lengths - 1]  # as many starts as ends
        parts_of = -(-context.astype(np.int64) // split)
        key = (np.where(parts_of > 1, u | SPLIT, u) << np.uint64(32)) | w
        pairs, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        u, w, many = u[first], w[first], np.maximum(parts_of[first], 1).astype(np.uint64)
        shard = mix(u * np.uint64(0x9E3779B97F4A7C15) + mix(w) % many) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        self.pairs, self.edge = pairs[order], np.searchsorted(shard[order], np.arange(shards + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place[inverse]  # of each token, that of its pair

    def learnt(self) -> np.ndarray:
        """How often each pair occurs in training."""
        return np.bincount(self.place[np.repeat(self.held == 0, self.lengths)], minlength=len(self.pairs))


class Cells:
    """The distinct pairs of a shard, with their customers."""

    def __init__(self, t: pa.Table):
        self.rows = [(r["b"], unpacked(r["x"], np.uint64), unpacked(r["y"], np.uint64), unpacked(r["z"], np.uint32)) for r in t.to_pylist()]
        self.vocabulary = float(np.frombuffer(t.column("q")[0].as_py())[0])
        keys = [(np.cumsum(x) << np.uint64(32)) | y for _, x, y, _ in self.rows]
        pairs, self.slot = np.unique(np.concatenate(keys), return_inverse=True)
        self.c = np.bincount(self.slot, np.concatenate([z for *_, z in self.rows]), len(pairs))
        self.contexts, self.u = np.unique(pairs >> np.uint64(32), return_inverse=True)
        self.words, self.w = np.unique(pairs & np.uint64(0xFFFFFFFF), return_inverse=True)
        self.split = np.flatnonzero(self.contexts & SPLIT)
        self.customers = np.bincount(self.u, self.c, len(self.contexts))
        self.outside = np.zeros(len(self.contexts))  # tables of a split context in other shards

    def tell(self, s: int, tables: np.ndarray, words: int) -> pa.Table:
        """What the word shards hear: tables that serve each word; tables and customers of split contexts; totals."""
        served, own = np.bincount(self.w, tables, len(self.words)), np.bincount(self.u, tables, len(self.contexts))
        totals = np.array([*discount(self.c), tables.sum(), self.vocabulary]).tobytes()
        rows = []
        to, of = self.words % np.uint64(words), (self.contexts[self.split] & ~SPLIT) % np.uint64(words)
        for k in range(words):
            i, j = np.flatnonzero(to == k), self.split[of == k]
            rows.append((s, k, CELLS, packed(np.diff(self.words[i], prepend=np.uint64(0))), packed(served[i].astype(np.uint64)), packed(np.concatenate([self.contexts[j].astype(np.float64), own[j], self.customers[j]])), totals))
        return notes(rows)

    def hear(self, answers: pa.Table, words: int, strength: float) -> None:
        """Takes the words' probabilities in the shared restaurant and the totals of split contexts."""
        value, q = np.zeros(len(self.words)), []
        to, of = self.words % np.uint64(words), (self.contexts[self.split] & ~SPLIT) % np.uint64(words)
        for r in answers.to_pylist():
            value[to == r["b"]] = unpacked(r["x"], np.float32)
            j = self.split[of == r["b"]]
            tables, customers = unpacked(r["z"], np.float64).reshape(2, -1)
            self.outside[j], self.customers[j] = tables, customers
            q.append(np.frombuffer(r["q"]))
        self.discount, shared = q[0][0], q[0][1]
        removed = sum(x[2] for x in q)
        self.p = (value + (strength + removed) / (self.vocabulary + 1)) / (strength + shared)

    def sample(self, strength: float, sweeps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each cell (the last sample) and the mean predictive probabilities."""
        d, p = self.discount, self.p[self.w]
        tables = np.bincount(self.u, self.c > 0, len(self.contexts))
        for _ in range(2):  # the totals first, then samples given these
            tables[self.split] = np.maximum(self.outside[self.split], tables[self.split])
            last, mean = sampled(self.c, (strength + d * tables[self.u]) * p, d, sweeps, rng)
            tables = np.bincount(self.u, mean, len(self.contexts))
        tables[self.split] = np.maximum(self.outside[self.split], tables[self.split])
        customers = self.customers[self.u]
        p = (self.c - d * mean + (strength + d * tables[self.u]) * p) / (strength + customers)
        return last, np.where(customers > 0, p, self.p[self.w])


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, rounds: int = 2, sweeps: int = 5, strength: float = 1.0, chunk_bytes: int = 6 << 20, split: int = 200_000) -> DataFrame:
    """Scores all texts with the model of those whose crc32 of the id as text isn't ``held`` modulo ``folds``.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end. Returns ``doc_id, held_out,
    n_tokens, n_known`` (tokens that occur in training), ``train_tokens, base_score`` (of counts plus a half) and ``score``
    (log10 of the model's probability of the text). A null text counts as empty and has its end alone. A null id isn't learnt
    from and ``held_out`` is null. Repeated rows are learnt from as often and score alike. An empty table gives
    no rows; other columns aren't read. Words' ids take 31 bits; a corpus of more distinct words raises an error.

    ``rounds``: exchanges between context and shared restaurants; ``sweeps``: samples in each, of which those
    of the last round are averaged; ``strength``: of all restaurants, whose discounts are estimated from how many
    cells have one and two customers; ``split``: tokens of a context that one shard takes.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(8, math.ceil(size / (4 * chunk_bytes)))
    words, shards = max(8, math.ceil(size / (4 * chunk_bytes))), max(16, math.ceil(size / (2 * chunk_bytes)))
    note = from_arrow_schema(NOTE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[int | None] = []
        codes_: list[np.ndarray] = []
        keys_: list[np.ndarray] = []
        lengths_: list[np.ndarray] = []
        at = 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, ids, codes_, keys_, lengths_, at
            keys, code = np.unique(np.concatenate(keys_), return_inverse=True)
            held_ = np.array([2 if x is None else crc32(str(x).encode()) % folds == held for x in ids], np.uint8)
            null = np.array([0 if x is None else x for x in ids], np.int64)
            row = (number, packed(null), packed(held_), packed(np.concatenate(lengths_)), packed(keys), packed(code[np.concatenate(codes_)].astype(np.uint32)))
            number, ids, codes_, keys_, lengths_, at = number + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, CHUNK.types, strict=True)], schema=CHUNK)

        filled = taken = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                distinct, codes, doc = coded_words(b.column(1))
                n = np.bincount(doc, minlength=b.num_rows)
                codes = np.insert(codes, np.cumsum(n), len(distinct))
                keys_.append(np.append(hashes(distinct), END))
                codes_.append(codes + at)
                lengths_.append(n + 1)
                at += len(distinct) + 1
                ids += b.column(0).to_pylist()
                filled += b.column(1).nbytes
                if filled >= chunk_bytes:
                    yield chunk()
                    filled = 0
        if ids:
            yield chunk()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                keys, codes = unpacked(row["keys"], np.uint64), unpacked(row["codes"], np.uint32)
                learnt = np.repeat(unpacked(row["held"], np.uint8) == 0, unpacked(row["lengths"], np.int64))
                counts, edge = np.bincount(codes[learnt], minlength=len(keys)), bounds(keys, words)
                yield from notes([(row["b"], s, WORDS, packed(keys[edge[s] : edge[s + 1]]), packed(counts[edge[s] : edge[s + 1]].astype(np.uint64)), None, None) for s in range(words)]).to_batches()

    def count(t: pa.Table) -> pa.Table:
        got = [(r["b"], unpacked(r["x"], np.uint64), unpacked(r["y"], np.uint64)) for r in t.to_pylist()]
        s = t.column("s")[0].as_py()
        keys, slot = np.unique(np.concatenate([x for _, x, _ in got]), return_inverse=True)
        counts = np.bincount(slot, np.concatenate([y for *_, y in got]), len(keys)).astype(np.uint64)
        ids = np.arange(len(keys), dtype=np.uint64) * np.uint64(words) + np.uint64(s)
        if len(ids) and ids[-1] >= START:
            raise ValueError("more distinct words than 31-bit ids")
        sums = np.array([counts.sum(), (counts > 0).sum()], np.float64).tobytes()
        slots = np.split(slot, np.cumsum([len(x) for _, x, _ in got])[:-1])
        return notes([(b, s, WORDS, packed(ids[k]), packed(counts[k]), None, sums) for (b, *_), k in zip(got, slots, strict=True)])

    def send(t: pa.Table, answers: pa.Table) -> pa.Table:
        rows_ = []
        for row in t.to_pylist():
            c = Chunk(row, answers, split, shards)
            n = c.learnt().astype(np.uint32)
            for s in np.flatnonzero(np.diff(c.edge)):
                own = c.pairs[c.edge[s] : c.edge[s + 1]]
                rows_.append((row["b"], s, CELLS, packed(np.diff(own >> np.uint64(32), prepend=np.uint64(0))), packed(own & np.uint64(0xFFFFFFFF)), packed(n[c.edge[s] : c.edge[s + 1]]), np.array([c.vocabulary]).tobytes()))
        return notes(rows_)

    def first(t: pa.Table) -> pa.Table:
        cells = Cells(t)
        return cells.tell(t.column("s")[0].as_py(), (cells.c > 0).astype(np.float64), words)

    def share(t: pa.Table) -> pa.Table:
        """In a word shard: seats what the contexts' tables send and answers with discounted customers."""
        got = [(r["b"], np.cumsum(unpacked(r["x"], np.uint64)), unpacked(r["y"], np.uint64), unpacked(r["z"], np.float64).reshape(3, -1)) for r in t.to_pylist()]
        s = t.column("s")[0].as_py()
        n1, n2, shared = np.sum([np.frombuffer(x)[:3] for x in t.column("q").to_pylist()], axis=0)
        vocabulary = float(np.frombuffer(t.column("q")[0].as_py())[3])
        keys, slot = np.unique(np.concatenate([x for _, x, *_ in got]), return_inverse=True)
        c = np.bincount(slot, np.concatenate([y for _, _, y, _ in got]), len(keys))
        d = estimated(*discount(c))
        mean = (c > 0).astype(np.float64)
        for k in range(2):
            tables = mean.sum() * vocabulary / max(1, (c > 0).sum())
            _, mean = sampled(c, np.full(len(c), (strength + d * tables) / (vocabulary + 1)), d, sweeps, np.random.default_rng([s, k]))
        value = (c - d * mean).astype(np.float32)
        contexts, of = np.unique(np.concatenate([z[0] for *_, z in got]), return_inverse=True)
        sums = [np.bincount(of, np.concatenate([z[k] for *_, z in got]), len(contexts)) for k in (1, 2)]
        q = np.array([estimated(n1, n2), shared, d * mean.sum()]).tobytes()
        slots = np.split(slot, np.cumsum([len(x) for _, x, *_ in got])[:-1])
        ofs = np.split(of, np.cumsum([z.shape[1] for *_, z in got])[:-1])
        return notes([(s, b, WORDS, packed(value[k]), None, packed(np.concatenate([x[j] for x in sums])), q) for (b, *_), k, j in zip(got, slots, ofs, strict=True)])

    def again(number: int, last: bool):
        def work(t: pa.Table, answers: pa.Table) -> pa.Table:
            if not t.num_rows:
                return notes([])
            cells, s = Cells(t), t.column("s")[0].as_py()
            cells.hear(answers, words, strength)
            tables, p = cells.sample(strength, sweeps, np.random.default_rng([s, number]))
            if not last:
                return cells.tell(s, tables, words)
            log = np.log10(p).astype(np.float32)
            slots = np.split(cells.slot, np.cumsum([len(x) for _, x, *_ in cells.rows])[:-1])
            return notes([(b, s, CELLS, packed(log[k]), None, None, None) for (b, *_), k in zip(cells.rows, slots, strict=True)])

        return work

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        done = []
        for row in t.to_pylist():
            c = Chunk(row, answers, split, shards)
            log = np.zeros(len(c.pairs))
            for r in answers.to_pylist():
                if r["kind"] == CELLS:
                    log[c.edge[r["s"]] : c.edge[r["s"] + 1]] = unpacked(r["x"], np.float32)
            base = np.log10((c.counts + 0.5) / (c.total + 0.5 * (c.vocabulary + 1)))
            sums = [np.add.reduceat(x, c.start) for x in ((c.counts > 0).astype(np.int64), base, log[c.place])]
            known = c.held < 2
            done.append(pa.table([pa.array(c.docs, mask=~known), pa.array(c.held == 1, mask=~known), pa.array(c.lengths), pa.array(sums[0]), pa.array(np.full(len(c.docs), int(c.total))), pa.array(sums[1]), pa.array(sums[2])], schema=OUT))
        return pa.concat_tables(done) if done else OUT.empty_table()

    chunks = rows.mapInArrow(read, from_arrow_schema(CHUNK)).repartition(tasks, "b")
    ids = chunks.mapInArrow(ask, note).groupBy("s").applyInArrow(count, note)
    pairs = chunks.groupBy("b").cogroup(ids.groupBy("b")).applyInArrow(send, note).repartition(shards, "s")
    told = pairs.groupBy("s").applyInArrow(first, note)
    for k in range(rounds):
        shared = told.groupBy("s").applyInArrow(share, note)
        told = pairs.groupBy("s").cogroup(shared.groupBy("s")).applyInArrow(again(k, k == rounds - 1), note)
    return chunks.groupBy("b").cogroup(ids.unionByName(told).groupBy("b")).applyInArrow(score, from_arrow_schema(OUT))
