"""Words, hashes and Arrow plumbing that the corpus operators share.

Texts are handled as UTF-8 bytes: ``bytes`` methods know ASCII only, so folding A-Z and
splitting on ASCII white space leave every other character alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

#: Every byte that is no ASCII letter, digit or part of a multi-byte character becomes a space; A-Z become a-z.
ALNUM = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MULT = np.uint64(0x9E3779B97F4A7C15)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "replace").translate(ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, unchanged; none for null."""
    return (text or "").encode("utf-8", "replace").split()


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "replace").lower().split()


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased; each word's place among these, text after text; each word's text. Null has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = lists.flatten().dictionary_encode()
    _, offsets, raw = flat.dictionary.buffers()
    raw, ends = raw.to_pybytes() if raw else b"", np.frombuffer(offsets, np.int32)[: len(flat.dictionary) + 1].tolist() if offsets else [0]
    distinct = [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    codes = flat.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if b"" in distinct:  # before leading white space and after trailing
        k = distinct.index(b"")
        full = codes != k
        codes, doc = codes[full], doc[full]
        codes -= codes > k
        del distinct[k]
    return distinct, codes, doc


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values, so that all bits of the result depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes; empty if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * MULT + h[i : i + n]
    return mix(out)


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n positions lie in a run of ``length`` that begins at one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def map_batches(df: DataFrame, fields: dict[str, str], work: Callable[[dict[str, list]], dict[str, list]], *, read: list[str], keep: list[str] | None = None, rows: int = 500) -> DataFrame:
    """Adds columns that ``work`` makes from the columns in ``read``; batch by batch, no shuffle.

    ``fields`` maps new columns to SQL types. ``keep``: columns that are passed on (all, by default);
    one of the name of a new column is replaced. ``rows``: most rows that Python holds at a time.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in fields]
    added = [T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()]
    schema = T.StructType([*(df.schema[c] for c in keep), *added])
    kinds = {f.name: to_arrow_type(f.dataType) for f in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                out = work({c: b.column(c).to_pylist() for c in read})
                arrays = [b.column(c) for c in keep] + [pa.array(out[k], kinds[k]) for k in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds])

    return df.select(*dict.fromkeys([*keep, *read])).mapInArrow(run, schema)
