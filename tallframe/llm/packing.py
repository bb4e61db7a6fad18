"""Packing of documents into token sequences by lexical retrieval.

Each task reads its documents into shards of bounded tokens and builds a BM25 inverted index of each
shard. A seed document opens a window; the index returns its neighbours that aren't used yet, best
first, and they fill the window. The one that doesn't fit is cut, and its rest is the next seed, so
every window of a shard but the last is full; the last is split into powers of two, which need no
padding. Nothing is shuffled but the document frequencies: counts in a fixed number of hashed terms
over the whole corpus, summed in a tree and broadcast (``TERMS`` numbers, whatever the corpus).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

TERMS, END = 1 << 18, 2
BATCH = 2000  # documents that are split into words at once
OUT = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary()})


#: Where ASCII letters meet ASCII punctuation other than the apostrophe, a word of the tokenizer ends.
EDGE = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[a-z])")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what it separates, so what stands between white
    space is encoded once and remembered (``most`` entries, then anew), and so are its parts between
    ``EDGE``. Parts of letters alone end in one token that closes a word, which tells them
    apart when many are encoded in one call.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words."""
        if len(self.known) > self.most:
            self.known.clear()
        ids = list(map(self.known.get, words))
        if None in ids:
            self.remember({w for w, x in zip(words, ids, strict=True) if x is None})
            ids = [self.known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return ids

    def remember(self, new: set[bytes]) -> None:
        known = self.known
        plain = {w for w in new if w.isalpha()}  # ASCII letters alone
        mixed = {w: self.split(w) for w in new - plain}
        parts = {p for x in mixed.values() for p in x if p not in known} - plain
        letters = {p for p in parts if p.decode().isalpha()}
        self.learn([*plain, *letters], list(parts - letters))
        known.update((w, known[x[0]] if len(x) == 1 else b"".join([known[p] for p in x])) for w, x in mixed.items())

    def learn(self, letters: list[bytes], other: list[bytes]) -> None:
        for at in range(0, len(letters), 1000):
            group = letters[at : at + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(group).decode(), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                other = other + group
                continue
            raw, ends = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((w, raw[i:j]) for w, i, j in zip(group, ends, ends[1:], strict=False))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(other, found, strict=True))

    @staticmethod
    def split(word: bytes) -> list[bytes]:
        return [word] if b"'" in word or b"<|" in word else EDGE.split(word)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it remembers outlasts a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Words:
    """The white-space separated words of a batch of texts, A-Z lower-cased, coded by the distinct ones."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))  # a special token's name has a case
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        _, offsets, raw = flat.dictionary.buffers()
        raw, ends = raw.to_pybytes() if raw else b"", np.frombuffer(offsets, np.int32)[: len(flat.dictionary) + 1].tolist()
        self.distinct: list[bytes] = [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        codes, self.n = flat.indices.to_numpy(), len(texts)
        doc = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
        if b"" in self.distinct:  # before leading white space and after trailing
            full = codes != self.distinct.index(b"")
            codes, doc = codes[full], doc[full]
        self.codes, self.doc = codes, doc
        self.cut = np.searchsorted(doc, np.arange(self.n + 1))

    def terms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashed terms of all texts, one text after the other; how often each occurs there; where each text's begin."""
        h = np.fromiter(map(crc32, self.distinct), np.int64, len(self.distinct)) & (TERMS - 1)
        key = np.sort(self.doc * TERMS + h[self.codes])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key = key[first]
        return (key % TERMS).astype(np.int32), np.diff(np.append(first, len(self.codes))), np.searchsorted(key, np.arange(self.n + 1) * TERMS)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int, float]:
    """In how many documents each hashed term occurs; the number of documents; their mean words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(TERMS, np.int64), 0, 0
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                words = Words(b.column(0).slice(at, BATCH))
                df += np.bincount(words.terms()[0], minlength=TERMS)
                n += words.n
                length += len(words.codes)
        if n:
            yield part(df, n, length)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(TERMS, np.int64), 0, 0
        for b in batches:
            for x in b.to_pylist():
                df += np.frombuffer(x["df"], np.int32 if len(x["df"]) == 4 * TERMS else np.int64)
                n += x["n"]
                length += x["length"]
        if n:
            yield part(df, n, length)

    def part(df: np.ndarray, n: int, length: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"df": pa.array([df.astype(np.int32 if n < 1 << 31 else np.int64).tobytes()], pa.binary()), "n": pa.array([n], pa.int64()), "length": pa.array([length], pa.int64())})

    schema = "df binary, n bigint, length bigint"
    parts = docs.select(text).mapInArrow(count, schema)
    width = docs.rdd.getNumPartitions()
    while width > 16:
        width = -(-width // 16)
        parts = parts.repartition(width).mapInArrow(add, schema)
    df, n, length = np.zeros(TERMS, np.int64), 0, 0
    for x in parts.toLocalIterator():
        df += np.frombuffer(x["df"], np.int32 if len(x["df"]) == 4 * TERMS else np.int64)
        n += x["n"]
        length += x["length"]
    return df, n, length / n if n else 0.0


class Shard:
    """Documents of one shard: their tokens and a BM25 inverted index."""

    def __init__(self, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.idf, self.mean, self.k1, self.b = idf, max(mean, 1.0), k1, b
        self.docs: list[tuple[int | None, bytes]] = []
        self.terms: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes, own: np.ndarray, tf: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.terms.append(own)
        self.tfs.append(tf)
        self.tokens += len(ids) // 4

    def index(self) -> None:
        counts = np.array([len(x) for x in self.terms])
        doc = np.repeat(np.arange(len(counts)), counts)
        term = np.concatenate([*self.terms, np.empty(0, np.int32)])
        tf = np.concatenate([*self.tfs, np.empty(0, np.int64)]).astype(np.float32)
        length = np.array([x.sum() for x in self.tfs], np.float32)
        weight = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[doc] / self.mean))
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.post_term, self.post_at = np.unique(term[order], return_index=True)
        self.post_end = np.append(self.post_at[1:], len(order))

    def neighbours(self, doc: int, used: np.ndarray) -> Iterator[int]:
        """The shard's unused documents by falling BM25 score for this document's terms, those with none last."""
        k = np.searchsorted(self.post_term, self.terms[doc])
        start, many = self.post_at[k], self.post_end[k] - self.post_at[k]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        score = -np.bincount(self.post_doc[at], self.post_weight[at], len(self.docs))
        left = np.flatnonzero(~used)
        while len(left):  # few are needed: sort the best 32, then the best of the rest
            best = left[np.argpartition(score[left], 31)[:32]] if len(left) > 64 else left
            yield from best[np.argsort(score[best], kind="stable")].tolist()
            left = np.setdiff1d(left, best, assume_unique=True)

    def pack(self, window: int) -> list[list[tuple[int, int, int]]]:
        """Sequences, each a list of pieces (document, start, length)."""
        self.index()
        size = [len(ids) // 4 for _, ids in self.docs]
        used = np.zeros(len(size), bool)
        out: list[list[tuple[int, int, int]]] = []
        pieces: list[tuple[int, int, int]] = []
        room = window

        def place(doc: int) -> None:
            nonlocal room, pieces
            used[doc] = True
            at = 0
            while at < size[doc]:
                n = min(room, size[doc] - at)
                pieces.append((doc, at, n))
                at += n
                room -= n
                if not room:
                    out.append(pieces)
                    pieces, room = [], window

        seed = 0
        while seed < len(size):
            if used[seed]:
                seed += 1
                continue
            if pieces:
                opened = pieces[0][0]  # the rest of the document that was cut is the seed
            else:
                place(seed)
                opened = seed
            before = len(out)
            for doc in self.neighbours(opened, used):
                if len(out) > before or not pieces:
                    break
                place(doc)
        while pieces:  # the last window, in powers of two
            n = 1 << ((window - room).bit_length() - 1)
            head, left = [], n
            while left:
                doc, at, length = pieces.pop(0)
                take = min(left, length)
                head.append((doc, at, take))
                left -= take
                if take < length:
                    pieces.insert(0, (doc, at + take, length - take))
            out.append(head)
            room += n
        return out


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", window: int = 4096, shard_tokens: int = 1 << 20) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens.

    A document's ids are those of the tokenizer file, then ``END``; a null text counts as empty, which
    is one id. Returns a row for each piece: ``doc_id, start`` (ids of the document before it),
    ``length, doc_tokens, sequence_id, offset`` (ids of the sequence before it) and ``ids`` (unsigned 32-bit,
    little-endian). Each id lies in one piece. Rows that repeat are packed as often. An empty table
    gives no rows; other columns of ``docs`` aren't read. ``shard_tokens`` bounds what a task holds.
    """
    df, n, mean = frequencies(docs, text)
    idf = docs.sparkSession.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), mean))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = encoder(tokenizer), TaskContext.get().partitionId() << 32
        end = np.array([END], "<u4").tobytes()
        shard = Shard(*idf.value)

        def flush() -> pa.RecordBatch:
            nonlocal number, shard
            rows = []
            for pieces in shard.pack(window):
                offset = 0
                for doc, at, length in pieces:
                    own, ids = shard.docs[doc]
                    rows.append((own, at, length, len(ids) // 4, number, offset, ids[4 * at : 4 * (at + length)]))
                    offset += length
                number += 1
            shard = Shard(*idf.value)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), OUT.types, strict=True)], schema=OUT)

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                words = Words(b.column(1))
                ids = encode(words.distinct)
                own, tf, cut = words.terms()
                for i, doc in enumerate(b.column(0).to_pylist()):
                    codes = words.codes[words.cut[i] : words.cut[i + 1]].tolist()
                    shard.add(doc, b"".join(map(ids.__getitem__, codes)) + end, own[cut[i] : cut[i + 1]], tf[cut[i] : cut[i + 1]])
                    if shard.tokens >= shard_tokens:
                        yield flush()
        if shard.docs:
            yield flush()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, from_arrow_schema(OUT))
