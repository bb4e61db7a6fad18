"""N-gram Jaccard join by MinHash banding.

Documents with equal sets of word n-grams form one class. The classes' MinHash signatures are cut into
bands; classes that share a band's hash become candidates. Candidates that hang together form a cluster,
whose classes are dealt into chunks of bounded size; every pair of chunks is one small group, in which
all pairs are verified on their full n-gram sets. Only counts and one link a class leave a group, so a
cluster of thousands costs comparisons, but neither rows nor memory of one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallframe.llm.exchange import planes, unplanes
from tallframe.llm.graph import checkpointed, components
from tallframe.llm.text import alnum_words, grams, hashes, map_batches, mix


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's n-grams of words; of fewer words, but some, one of all."""
    h = hashes(alnum_words(text))
    return np.unique(grams(h, min(n, len(h)))) if len(h) else np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit number."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def plan_bands(threshold: float, recall: float, most: int = 400) -> tuple[int, int]:
    """The bands and rows with the most rows (the fewest false candidates) that find a pair at the threshold with this probability, in at most so many hashes."""
    best = (1, 1)
    for rows in range(1, 65):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows > most:
            break
        best = (max(1, bands), rows)
    return best


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.Generator(np.random.PCG64(7))
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        self.step = mix(np.arange(1, rows + 1, dtype=np.uint64))
        self.base = mix(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(20))

    def keys(self, s: np.ndarray) -> list[int]:
        """A signed 64-bit key for each band."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 512):
            np.minimum(low, (self.a[:, None] * x[None, i : i + 512] + self.b[:, None]).min(axis=1), out=low)
        sums = (mix(low.astype(np.uint64).reshape(self.bands, self.rows) + self.step)).sum(axis=1, dtype=np.uint64)
        return mix(sums ^ self.base).view(np.int64).tolist()


def verified(keys: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sets on different sides (of any, if all are on one): how many links each has, and the least key that it hangs together with."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(n), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    many = np.diff(np.append(first, len(value)))
    shared = np.zeros((n, n), np.int32)
    for m in np.unique(many[many > 1]):  # n-grams by the number of sets that hold them
        at = first[many == m]
        for cut in range(0, len(at), max(1, 2_000_000 // (m * m))):
            own = doc[at[cut : cut + max(1, 2_000_000 // (m * m)), None] + np.arange(m)]
            flat = (own[:, :, None] * n + own[:, None, :]).reshape(-1)
            shared += np.bincount(flat, minlength=n * n).reshape(n, n).astype(np.int32)
    union = size[:, None] + size[None, :] - shared
    linked = shared >= threshold * union - 1e-9
    np.fill_diagonal(linked, False)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    root = keys.copy()
    while True:
        low = np.where(linked, root[None, :], root[:, None]).min(axis=1, initial=np.iinfo(np.int64).max)
        low = np.minimum(low, root)
        if np.array_equal(low, root):
            return linked.sum(axis=1), root
        root = low


def jaccard_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.995, chunk: int = 500) -> DataFrame:
    """The classes of near duplicates: documents whose sets of word n-grams have Jaccard similarity ``threshold`` or more.

    Returns for each row ``row`` (a hash of its id and text), ``doc_id, class_id`` (the least id among the
    documents that links and equal sets connect), ``n_links`` (how many different n-gram sets the
    document's own is linked with), ``copy_id`` (the least id with an equal set) and ``keeps`` (true for
    one document of each class). Words are ASCII letters, digits and all beyond ASCII, A-Z lower-cased.
    A text of fewer than ``n`` words is one n-gram; one without words (null and empty too) has no links and
    is a class of its own. Rows of equal id and text count as copies and have equal results. Null ids
    are less preferred than any other. An empty table gives no rows; other columns aren't read.

    ``recall``: the probability that a pair at the threshold meets in a band (one above it meets more
    surely); ``chunk``: about how many classes meet in one group, from each side.
    """
    rows = docs.select(F.xxhash64(doc_id, text).alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    hasher = MinHash(*plan_bands(threshold, recall))

    def sign(b: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t, n) for t in b["text"]]
        return {"set": [set_key(s) if len(s) else None for s in sets], "bands": [hasher.keys(s) if len(s) else [] for s in sets]}

    signed = checkpointed(map_batches(rows, {"set": "bigint", "bands": "array<bigint>"}, sign, read=["text"], keep=["row", "doc_id"]))
    classes = signed.where(F.col("set").isNotNull()).groupBy("set").agg(F.min("row").alias("row"), F.min("doc_id").alias("copy_id"), F.min("bands").alias("bands"))
    bands = classes.select("set", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("set").alias("hub"), F.count("*").alias("m")).where("m > 1").drop("m")
    clusters = components(bands.join(hubs, "band").select(F.col("set").alias("u"), F.col("hub").alias("v")))
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    wanted = clusters.join(sizes, "root").withColumnRenamed("id", "set").join(classes.select("set", "row"), "set")
    wanted = wanted.select("row", "set", "root", "chunks", F.expr("pmod(xxhash64(set), chunks)").cast("int").alias("own"))

    def fill(b: dict[str, list]) -> dict[str, list]:
        return {"grams": [planes(shingles(t, n)) for t in b["text"]]}

    texts = rows.select("row", "text").join(wanted, "row")
    sets = map_batches(texts, {"grams": "binary"}, fill, read=["text"], keep=["set", "root", "chunks", "own"], rows=200)
    cells = sets.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("root", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("k"), "own", "set", "grams")

    def compare(t: pa.Table) -> pa.Table:
        keys, at = np.unique(t.column("set").to_numpy(), return_index=True)
        grams_, own = t.column("grams").to_pylist(), t.column("own").to_numpy()[at]
        links, root = verified(keys, own, [unplanes(grams_[x], np.uint64) for x in at], threshold)
        if t.column("i")[0] != t.column("k")[0] and own.min() == own.max():  # the other chunk is empty
            links = links * 0
        some = links > 0
        return pa.table({"u": keys[some], "v": root[some], "links": links[some].astype(np.int64)})

    found = checkpointed(cells.groupBy("root", "i", "k").applyInArrow(compare, "u bigint, v bigint, links bigint"))
    linked = components(found.select("u", "v")).select(F.col("id").alias("set"), F.col("root").alias("class"))
    counts = found.groupBy(F.col("u").alias("set")).agg(F.sum("links").alias("n_links"))
    own = classes.select("set", "copy_id", "row").join(counts, "set", "left").join(linked, "set", "left").withColumn("class", F.coalesce("class", "set"))
    heads = own.groupBy("class").agg(F.min(F.struct(F.col("copy_id").isNull().alias("last"), "copy_id", "row")).alias("head"))
    own = own.join(heads, "class").select(F.col("set").alias("key"), "copy_id", F.col("head.copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("head.row").alias("head"))
    out = signed.select("row", "doc_id", "set", F.coalesce("set", "row").alias("key")).join(own, "key", "left")
    alone = F.col("set").isNull()
    return out.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        (alone | (F.col("row") == F.col("head"))).alias("keeps"),
    )


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with all their columns, one of each class of ``jaccard_classes``; of rows of equal id and text, one.

    Documents without words all stay, but for repeated rows.
    """
    kept = jaccard_classes(docs, doc_id=doc_id, text=text, **options).where("keeps").select(F.col("row").alias("_row")).distinct()
    return docs.withColumn("_row", F.xxhash64(doc_id, text)).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
