"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector of
32-bit lanes and a document's fingerprint is the sum of those vectors modulo 2**32. So the order of
paragraphs doesn't matter, and paragraphs are inserted or deleted by adding or subtracting their
vectors. The first ``EXACT`` lanes are uniform words drawn from the hash of the whole paragraph and
serve equality; in the others each pair of neighbouring words of the paragraph adds +1 or -1 to one
lane, so the cosine of two sums estimates how much two documents have in common.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from xxhash import xxh3_64_intdigest

from tallframe.llm.text import MULT, hashes, mix

EXACT, SKETCH = 32, 512
_STEPS = mix(np.arange(1, EXACT // 2 + 1, dtype=np.uint64) * MULT)
OUT = pa.schema({"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()})
_START = np.uint64(0x5851F42D4C957F2D)


def vector(lines: list[bytes]) -> np.ndarray:
    """The sum of the vectors of the paragraphs, as ``EXACT + SKETCH`` unsigned 32-bit lanes."""
    own = np.fromiter(map(xxh3_64_intdigest, lines), np.uint64, len(lines))
    exact = mix(own[:, None] ^ _STEPS[None, :]).view(np.uint32).sum(axis=0, dtype=np.uint32) if len(lines) else np.zeros(EXACT, np.uint32)
    words = [x.split() for x in lines]
    h = hashes([w for x in words for w in x])
    before = np.empty_like(h)
    before[1:] = h[:-1]
    first = np.cumsum([0, *map(len, words)])[:-1]
    before[first[first < len(h)]] = _START
    g = mix(before * MULT + h)
    lane = (g % np.uint64(SKETCH)).astype(np.int64)
    sign = np.where(g >> np.uint64(63), 1.0, -1.0)
    sums = np.bincount(lane, sign, SKETCH).astype(np.int64).astype(np.uint32)
    return np.concatenate([exact, sums])


def fingerprint(text: str | None) -> np.ndarray:
    """The fingerprint of a text; null counts as empty, which is one empty paragraph."""
    return vector((text or "").encode("utf-8", "replace").split(b"\n"))


def replaced(fp: np.ndarray, old: str, new: str, same: int) -> np.ndarray:
    """The fingerprint of ``new`` from that of ``old``, of which the first ``same`` characters are equal: only paragraphs that change are hashed."""
    at = old.rfind("\n", 0, same) + 1
    return fp - vector(old[at:].encode("utf-8", "replace").split(b"\n")) + vector(new[at:].encode("utf-8", "replace").split(b"\n"))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, else the cosine of the sketch lanes, at least 0."""
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT:].view(np.int32).astype(np.float64) for v in (a, b))
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def encoded(fp: np.ndarray) -> str:
    """All lanes, little-endian, in base64."""
    return base64.b64encode(fp.astype("<u4").tobytes()).decode()


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike these are.

    The edited text has its last floor(n/4) of n characters replaced by the first as many (or all) of
    the next document by id; after the last comes the first. Returns ``doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next``. Null texts count as empty; a null id
    sorts before all others; rows of one id are ordered by text. An empty table gives no rows; other
    columns of ``docs`` aren't read.

    The rows are dealt once into ranges of ids. The first row of each range is also sent to the range
    before it, so that each range is read as a stream that knows every row's successor.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), key.alias("k"))
    ranges = max(4, 4 * docs.rdd.getNumPartitions())
    cuts = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    edges = spark.sparkContext.broadcast(np.unique(np.array(cuts or [], np.int64)))

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges.value, k.to_numpy(), "left").astype(np.int32))

    heads = sorted((r.p, r.k) for r in rows.select("k", range_of("k").alias("p")).groupBy("p").agg(F.min("k").alias("k")).collect())
    back = spark.sparkContext.broadcast({k: heads[i - 1][0] for i, (_, k) in enumerate(heads)})

    @F.pandas_udf("array<int>")
    def ranges_of(k: pd.Series) -> pd.Series:
        own = np.searchsorted(edges.value, k.to_numpy(), "left")
        return pd.Series([[p] if (q := back.value.get(x)) is None else [p, q] for p, x in zip(own.tolist(), k.tolist(), strict=True)])

    dealt = rows.withColumn("ps", ranges_of("k")).select("doc_id", "text", "k", F.posexplode("ps").alias("ahead", "p"))
    dealt = dealt.repartition(ranges, "p").sortWithinPartitions("p", "ahead", "k", "text")

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), OUT.types, strict=True)], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor comes next, with its range and fingerprint
        done: list[tuple] = []
        for b in batches:
            for doc, t, ahead, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ahead", "p")), strict=True):
                if ahead and (held is None or held[2] != p):
                    continue  # another row of the head's id; the successor is known
                fp = fingerprint(t)
                if held is not None and held[2] == p:
                    was, now, _, own = held
                    cut = len(now) // 4
                    new = now[: len(now) - cut] + t[:cut]
                    edited = replaced(own, now, new, len(now) - cut)
                    done.append((was, len(now), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), encoded(own), encoded(edited), likeness(own, edited), likeness(own, fp)))
                held = None if ahead else (doc, t, p, fp)
                if len(done) >= 500:
                    yield batch(done)
                    done = []
        if done:
            yield batch(done)

    return dealt.select("doc_id", "text", "ahead", "p").mapInArrow(run, from_arrow_schema(OUT))
