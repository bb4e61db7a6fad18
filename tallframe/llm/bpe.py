"""Byte-level BPE by the tiktoken library: texts to ids and ids to bytes, document by document, without a shuffle.

Long texts are parted where no match of the pattern can reach across, so that each part is encoded as it would be
inside the whole. A white space run longer than the library's matcher can hold is one match by the pattern's own
rules, and goes to the library as such.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tallframe.llm.text import map_batches

#: The characters with Unicode's White_Space property, as a class of a regular expression.
SPACES = r"\t-\r \x85\xa0  -     　"
#: A place between characters that no match spans, where a long text may be cut: before white space, or between ASCII letters, digits and signs.
SAFE = re.compile(rf"(?<=[^{SPACES}])(?=[{SPACES}])|(?<=[A-Za-z一-龥])(?=[0-9!-/:-@\[-`{{-~])|(?<=[0-9])(?=[A-Za-z一-龥!-/:-@\[-`{{-~])")
#: White space that is encoded by itself; the library's matcher overflows at some hundred thousand characters.
RUN = re.compile(rf"[{SPACES}]{{4096,}}")
#: Characters of a part of a long text, at least.
PART = 1 << 16


@lru_cache(maxsize=4)
def encoders(rank_file: str, pattern: str) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
    """The encoding of a file of ranks, and one of the same ranks that takes its whole input as one match."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tuple(tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("own", pattern), ("whole", r"(?s:.+)")))


def parts(text: str, part: int = PART) -> Iterator[tuple[bool, str]]:
    """The text in order, cut at safe places; whether each part is a single match of white space."""
    at, n = 0, len(text)
    while at < n:
        if n - at <= part:
            stop = n
        else:
            cut = SAFE.search(text, at + part)
            stop = cut.start() if cut else n
        own = at
        for run in RUN.finditer(text, at, stop):
            a, b = run.span()
            # all but the last of a run that something follows is one match; the last may belong to what follows
            b -= b < n
            if a > own:
                yield False, text[own:a]
            yield True, text[a:b]
            own = b
        if stop > own:
            yield False, text[own:stop]
        at = stop


def encoded(text: str, rank_file: str, pattern: str, part: int = PART) -> array:
    own, whole = encoders(rank_file, pattern)
    ids = array("I")
    for single, piece in parts(text, part):
        ids.extend((whole if single else own).encode_ordinary(piece))
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str, *, text: str = "text", part: int = PART) -> DataFrame:
    """Adds ``ids`` (binary: little-endian unsigned 32-bit ids) and ``n_tokens``; replaces columns of these names.

    Null and empty texts have no ids. Rows aren't compared, so repeated rows and ids, null ids and any other
    columns pass as they are; an empty table gives an empty one. ``rank_file`` is a file of base64 tokens and
    ranks that every executor can read at that path, or its name if it was sent with ``SparkContext.addFile``.
    """

    def work(b: dict[str, list]) -> dict[str, list]:
        path = local(rank_file)
        found = [encoded(t or "", path, pattern, part) for t in b[text]]
        return {"ids": [little_endian(x).tobytes() for x in found], "n_tokens": [len(x) for x in found]}

    return map_batches(docs, {"ids": "binary", "n_tokens": "bigint"}, work, read=[text], rows=64)


def decode(docs: DataFrame, rank_file: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of the ids in order; replaces a column of that name.

    Bytes stay raw: ids may end inside a character. Null gives null. Ids that the file lacks, or bytes that
    aren't whole ids, are an error.
    """

    def work(b: dict[str, list]) -> dict[str, list]:
        own = encoders(local(rank_file), pattern)[0]
        return {"decoded": [None if x is None else decoded(x, own) for x in b[ids]]}

    return map_batches(docs, {"decoded": "binary"}, work, read=[ids], rows=64)


def decoded(raw: bytes, own: tiktoken.Encoding, part: int = PART) -> bytes:
    ids = array("I")
    ids.frombytes(raw)
    ids = little_endian(ids)
    return b"".join(own.decode_bytes(ids[k : k + part].tolist()) for k in range(0, len(ids), part))


def little_endian(ids: array) -> array:
    """The ids with their bytes turned where the machine's order is another."""
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def local(rank_file: str) -> str:
    """The file's path on this executor."""
    return rank_file if "/" in rank_file else SparkFiles.get(rank_file)
