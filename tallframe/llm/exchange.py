"""Documents dealt into buckets, and messages between buckets and shards of a key space.

An operator that looks keys up over the whole corpus deals the documents once into buckets of bounded
text. A bucket sends its distinct keys, sorted, to the shards that own ranges of the hashed key space;
a shard answers each bucket in the order of what it sent. Keys are spread by their hash and each bucket
sends a key once, so a key that a third of all rows hold weighs no more in its shard than any other.
The bucketed documents are one exchange, which the plan uses again wherever buckets are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 6 << 20


def deal(docs: DataFrame, doc_id: str, text: str, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Documents as ``doc_id, text, b``, dealt into buckets of about so many bytes of text; the number of buckets."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(8, math.ceil(size / (4 * bucket_bytes)))
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * tasks)).cast("int")
    return rows.withColumn("b", bucket).repartition(tasks, "b"), 4 * tasks


def planes(a: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on, so that what compresses stands together."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, len(b) // size).T).view(kind).reshape(-1)


def bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the ranges of the shards begin and end in sorted 64-bit keys."""
    edges = (np.arange(1, shards, dtype=np.float64) * (2.0**64 / shards)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
