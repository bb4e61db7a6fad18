"""Benchmark decontamination by winnowing.

Both sides are reduced to winnowed fingerprints: of the hashes of all runs of ``gram`` words, the
least in each window of ``length - gram + 1`` consecutive ones is kept. A shared span of ``length``
words holds one such window, whose least hash is chosen on both sides, so each such span meets at
one fingerprint at least; a hit is then extended word by word to the whole window.

The items are a stated query set. They are taken in blocks of bounded bytes; the fingerprints of a
block are broadcast and every document is read against them, without a shuffle and whatever the
sizes of groups are. Further blocks are further narrow passes, which carry on what was found.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.llm.text import alnum_words, covered, grams, hashes, map_batches


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of the leftmost least hash of each window of consecutive hashes."""
    if len(g) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


class Fingerprints:
    """The items of one block: winnowed fingerprints and distinct windows of the long ones, whole hashes of the short.

    A window that many items or places hold is kept once, with its items, so that repeated words cost no more than others.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], length: int, gram: int):
        self.length, self.gram, self.window = length, gram, length - gram + 1
        self.ids: list[str | None] = []
        marks, words, keys, owners, at = [], [], [], [], 0
        short: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            h = hashes(alnum_words(text))
            if not len(h):
                continue
            if len(h) < length:
                short.setdefault(len(h), []).append((int(grams(h, len(h))[0]), len(self.ids)))
            else:
                g = grams(h, gram)
                marks.append(g[winnow(g, self.window)])
                key, first = np.unique(grams(h, length), return_index=True)
                keys.append(key)
                owners.append(np.stack([np.full(len(key), len(self.ids)), first + at]))
                words.append(h)
                at += len(h)
            self.ids.append(item_id)
        empty = np.empty(0, np.uint64)
        self.words = np.concatenate([*words, empty])
        self.marks = np.unique(np.concatenate([*marks, empty]))
        every, (owner, place) = np.concatenate([*keys, empty]), np.concatenate([*owners, np.empty((2, 0), np.int64)], axis=1)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.places, self.owners, self.ends = place[order][first], owner[order], np.append(first, len(every))
        self.short = {}
        for n, pairs in short.items():
            pairs.sort()
            self.short[n] = (np.array([p[0] for p in pairs], np.uint64), [p[1] for p in pairs])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which of the words are hit, and the numbers of the items that have an occurring window."""
        hit, found = np.zeros(len(h), bool), set()
        for n, (keys, numbers) in self.short.items():
            g = grams(h, n)
            first = np.searchsorted(keys, g, "left")
            last = np.searchsorted(keys, g, "right")
            at = np.flatnonzero(last > first)
            if len(at):
                hit |= covered(len(h), at, n)
                for i, j in np.unique(np.stack([first[at], last[at]]), axis=1).T:
                    found.update(numbers[i:j])
        if len(h) >= self.length and len(self.marks):
            g = grams(h, self.gram)
            chosen = winnow(g, self.window)
            k = np.minimum(np.searchsorted(self.marks, g[chosen]), len(self.marks) - 1)
            met = chosen[self.marks[k] == g[chosen]]
            if len(met):
                self._extend(h, met, hit, found)
        return hit, found

    def _extend(self, h: np.ndarray, met: np.ndarray, hit: np.ndarray, found: set[int]) -> None:
        """From places of fingerprints that items have too to equal windows that hold them."""
        d = np.unique(met[:, None] - np.arange(self.window))
        d = d[(d >= 0) & (d + self.length <= len(h))]
        key = grams(h, self.length)[d]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        same = self.keys[k] == key
        for j in range(self.length):
            d, k = d[same], k[same]
            same = h[d + j] == self.words[self.places[k] + j]
        d, k = d[same], k[same]
        if len(d):
            hit |= covered(len(h), d, self.length)
            for i in np.unique(k):
                found.update(self.owners[self.ends[i] : self.ends[i + 1]].tolist())


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 10, gram: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Marks the documents that share a window of ``length`` words with an item.

    Adds to all columns of ``docs``: ``n_words``, ``n_hit`` (words inside any occurrence of an item's
    window), ``n_items`` (items with an occurring window), ``items_sha256`` (hex; their ids, sorted as
    strings and joined by commas), ``contaminated`` and ``hit_words`` (bits of the hit words, packed, null
    if none). An item of fewer words is one window; one without words hits nothing. A null or empty
    text has no words. Rows of items that repeat an id count once; a null id hits but isn't listed.
    Columns of ``docs`` with these names are replaced. Empty tables give no rows or no hits.

    ``block_bytes``: bytes of item texts in a block, a bound for what the driver and each task hold.
    """
    spark: SparkSession = docs.sparkSession
    own = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    total = own.agg(F.sum(F.octet_length("t") + F.coalesce(F.octet_length("i"), F.lit(0)))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    out = docs
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(Fingerprints([(r.i, r.t) for r in rows], length, gram))
        out = _pass(out, text, shared, k == 0, k == blocks - 1)
    return out


def _pass(docs: DataFrame, text: str, shared, first: bool, last: bool) -> DataFrame:
    fields = {"hit_words": "binary"}
    if last:
        fields |= {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    else:
        fields |= {"hit_items": "array<string>"}

    def work(b: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in fields}
        for r, t in enumerate(b[text]):
            h = hashes(alnum_words(t))
            hit, numbers = shared.value.find(h)
            ids = {shared.value.ids[i] for i in numbers} - {None}
            if not first:
                if b["hit_words"][r] is not None:
                    hit |= np.unpackbits(np.frombuffer(b["hit_words"][r], np.uint8), count=len(h)).astype(bool)
                ids |= set(b["hit_items"][r])
            n = int(hit.sum())
            out["hit_words"].append(np.packbits(hit).tobytes() if n else None)
            if last:
                out["n_words"].append(len(h))
                out["n_hit"].append(n)
                out["n_items"].append(len(ids))
                out["items_sha256"].append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
                out["contaminated"].append(n > 0)
            else:
                out["hit_items"].append(sorted(ids))
        return out

    keep = None if first else [c for c in docs.columns if c not in ("hit_words", "hit_items")]
    return map_batches(docs, fields, work, read=[text] if first else [text, "hit_words", "hit_items"], keep=keep)
