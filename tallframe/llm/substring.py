"""Substring dedup by difference-cover anchors.

``COVER`` is a difference cover modulo ``PERIOD``: for any two positions some shift below the period
puts both on the cover. Hashes of ``length - PERIOD + 1`` words are taken only at positions on the
cover. So if two documents share a window of ``length`` words, wherever it lies in each, they share an
anchor inside it that both have hashed. A first exchange finds the anchors that occur in several
documents. Those are extended to the whole windows that hold them, and a second exchange finds the
least document of each such window. Buckets and shards are those of ``exchange``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallframe.llm.exchange import bounds, deal, planes, unplanes
from tallframe.llm.text import covered, grams, hashes, space_words

#: A perfect difference cover modulo 7: fixed values.
PERIOD, COVER = 7, (0, 1, 3)
LAST = np.iinfo(np.int64).max


class Bucket:
    """The documents of a bucket: word hashes, and the anchors with their places."""

    def __init__(self, table: pa.Table, length: int):
        self.length, self.span = length, length - PERIOD + 1
        self.ids = [LAST if x is None else x for x in table.column("doc_id").to_pylist()]
        self.words = [space_words(t) for t in table.column("text").to_pylist()]
        self.hashes = [hashes(w) for w in self.words]
        docs, places, keys = [], [], []
        for i, h in enumerate(self.hashes):
            at = np.arange(max(0, len(h) - self.span + 1))
            at = at[np.isin(at % PERIOD, COVER)] if len(h) >= length else at[:0]
            keys.append(grams(h, self.span)[at])
            places.append(at)
            docs.append(np.full(len(at), i))
        self.doc, self.place, key = (np.concatenate([*x, np.empty(0, k)]) for x, k in ((docs, np.int64), (places, np.int64), (keys, np.uint64)))
        self.keys, self.slot = np.unique(key, return_inverse=True)

    def several(self, slot: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Which of n slots have two documents of different ids or more."""
        ids = np.array(self.ids, np.int64)[doc]
        low, high = np.full(n, LAST), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, slot, ids)
        np.maximum.at(high, slot, ids)
        return low < high

    def windows(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows that hold a shared anchor: documents, starts, sorted distinct hashes and each one's slot in these."""
        docs, starts, keys = [], [], []
        on = shared[self.slot]
        doc, place = self.doc[on], self.place[on]
        cut = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        for i, h in enumerate(self.hashes):
            p = place[cut[i] : cut[i + 1]]
            if not len(p):
                continue
            near = covered(len(h), np.maximum(p - PERIOD + 1, 0), PERIOD)[: len(h) - self.length + 1]
            at = np.flatnonzero(near)
            docs.append(np.full(len(at), i))
            starts.append(at)
            keys.append(grams(h, self.length)[at])
        d, s, k = (np.concatenate([*x, np.empty(0, kind)]) for x, kind in ((docs, np.int64), (starts, np.int64), (keys, np.uint64)))
        keys_, slot = np.unique(k, return_inverse=True)
        return d, s, keys_, slot

    def least(self, d: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        low = np.full(n, LAST)
        np.minimum.at(low, slot, np.array(self.ids, np.int64)[d])
        return low


def messages(b: int, keys: np.ndarray, values: np.ndarray, shards: int) -> pa.Table:
    """What a bucket sends: to each shard with a key, the keys and a value for each."""
    edge = bounds(keys, shards)
    to = np.flatnonzero(edge[1:] > edge[:-1])
    return pa.table({"b": pa.array([b] * len(to), pa.int32()), "s": pa.array(to, pa.int32()), "keys": pa.array([planes(keys[edge[i] : edge[i + 1]]) for i in to], pa.binary()), "more": pa.array([planes(values[edge[i] : edge[i + 1]]) for i in to], pa.binary())})


def answers(table: pa.Table, flags: list[np.ndarray], kind: int) -> pa.Table:
    return pa.table({"b": table.column("b"), "s": table.column("s"), "kind": pa.array([kind] * table.num_rows, pa.int32()), "flags": pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())})


def received(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """All keys a shard got, which message each came with, the messages' values, and each key's slot."""
    keys = [unplanes(x, np.uint64) for x in table.column("keys").to_pylist()]
    sizes = np.array([len(k) for k in keys])
    _, slot = np.unique(np.concatenate(keys), return_inverse=True)
    return sizes, np.cumsum(sizes)[:-1], table.column("more").to_pylist(), slot


def flags_of(table: pa.Table, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    """The answers of one kind, in the order of the bucket's keys."""
    out, edge = np.zeros(len(keys), bool), bounds(keys, shards)
    for s, k, f in zip(*(table.column(c).to_pylist() for c in ("s", "kind", "flags")), strict=True):
        if k == kind:
            n = edge[s + 1] - edge[s]
            out[edge[s] : edge[s + 1]] = np.unpackbits(np.frombuffer(f, np.uint8), count=n)
    return out


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 13) -> DataFrame:
    """Removes words covered by a window of ``length`` words that also starts in a document of a smaller id.

    Windows are judged on the input. Returns ``doc_id, n_words, n_removed, kept`` (the kept words, joined
    by one space) for each row. A null or empty text has no words and ``kept`` is empty. A null id counts
    as larger than all others; rows of one id don't remove each other's words. An empty table gives no
    rows; other columns of ``docs`` aren't read. ``length`` must be at least ``2 * PERIOD - 1``.
    """
    if length < 2 * PERIOD - 1:
        raise ValueError(f"length must be at least {2 * PERIOD - 1}")
    dealt, buckets = deal(docs, doc_id, text)
    shards = max(4, buckets // 4)
    sent, answer = "b int, s int, keys binary, more binary", "b int, s int, kind int, flags binary"

    def anchors(t: pa.Table) -> pa.Table:
        own = Bucket(t, length)
        return messages(t.column("b")[0].as_py(), own.keys, own.several(own.slot, own.doc, len(own.keys)).view(np.uint8), shards)

    def shared(t: pa.Table) -> pa.Table:
        sizes, cuts, more, slot = received(t)
        weight = np.concatenate([unplanes(x, np.uint8) for x in more]) + 1
        return answers(t, np.split(np.bincount(slot, weight)[slot] > 1, cuts), 1)

    def windows(t: pa.Table, flags: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({c: pa.array([], k) for c, k in (("b", pa.int32()), ("s", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()))})
        own = Bucket(t, length)
        d, _, keys, slot = own.windows(flags_of(flags, 1, own.keys, shards))
        return messages(t.column("b")[0].as_py(), keys, own.least(d, slot, len(keys)), shards)

    def earlier(t: pa.Table) -> pa.Table:
        sizes, cuts, more, slot = received(t)
        own = np.concatenate([unplanes(x, np.int64) for x in more])
        low = np.full(slot.max() + 1, LAST)
        np.minimum.at(low, slot, own)
        return answers(t, np.split(low[slot] < own, cuts), 2)

    def remove(t: pa.Table, flags: pa.Table) -> pa.Table:
        own = Bucket(t, length) if t.num_rows else None
        rows: dict[str, list] = {"doc_id": t.column("doc_id").to_pylist(), "n_words": [], "n_removed": [], "kept": []}
        if own:
            d, start, keys, slot = own.windows(flags_of(flags, 1, own.keys, shards))
            gone = flags_of(flags, 2, keys, shards)[slot] | (own.least(d, slot, len(keys))[slot] < np.array(own.ids, np.int64)[d])
            d, start = d[gone], start[gone]
            cut = np.searchsorted(d, np.arange(len(own.ids) + 1))
            for i, w in enumerate(own.words):
                out = covered(len(w), start[cut[i] : cut[i + 1]], length)
                rows["n_words"].append(len(w))
                rows["n_removed"].append(int(out.sum()))
                rows["kept"].append(b" ".join([x for x, o in zip(w, out.tolist(), strict=True) if not o] if out.any() else w).decode())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(rows.items(), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    first = dealt.groupBy("b").applyInArrow(anchors, sent).groupBy("s").applyInArrow(shared, answer)
    second = dealt.groupBy("b").cogroup(first.groupBy("b")).applyInArrow(windows, sent).groupBy("s").applyInArrow(earlier, answer)
    both = first.unionByName(second)
    return dealt.groupBy("b").cogroup(both.groupBy("b")).applyInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
