"""Long recordings as a data source: WAV files read and written in ranges of samples, as rows ``stim, n, x``.

    spark.dataSource.register(WavSource)
    samples = spark.read.format("wav").option("range", 1 << 20).load(folder)
    samples.write.format("wav").option("sr", 16000).mode("append").save(folder)

A file is read in ranges of its bytes, a task each, so that its length bounds nothing; of many short files or ranges, a
task reads several one after the other. A recording is written as files
of a range each, ``stim.wav`` or ``stim/00000000.wav`` and so on; they take their place when all tasks have ended.

The driver holds names and lengths of files as packed bytes, some tens a file, never an object for each.
"""

from __future__ import annotations

import pickle
import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "stim string, n bigint, x double"
ROWS = 1 << 16
#: Tasks of a read beyond which a task takes several ranges.
TASKS = 1024
#: Files whose headers are asked for at a time.
AHEAD = 4096


@dataclass
class Header:
    """Where a file's samples begin, and their kind."""

    start: int
    frames: int
    channels: int
    width: int
    rate: int


def system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_header(f: pa.NativeFile, name: str) -> Header:
    """Walks over a file's chunks up to its samples; what isn't PCM raises an error. A length of zero, or beyond the end, is the rest of the file."""
    riff = f.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError(f"{name} is no WAV file")
    kind, at, size = None, 12, f.size()
    while at + 8 <= size:
        f.seek(at)
        tag, length = struct.unpack("<4sI", f.read(8))
        if tag == b"fmt ":
            kind = struct.unpack("<HHIIHH", f.read(16))
            if kind[0] == 0xFFFE and length >= 40:  # the format proper stands in the extension
                f.seek(at + 8 + 24)
                kind = (struct.unpack("<H", f.read(2))[0], *kind[1:])
        elif tag == b"data":
            if kind is None or kind[0] != 1 or kind[5] not in (8, 16, 24, 32):
                raise ValueError(f"{name} doesn't hold PCM samples of 8 to 32 bits")
            length = min(length, size - at - 8) if length else size - at - 8
            return Header(at + 8, length // (kind[1] * (kind[5] // 8)), kind[1], kind[5] // 8, kind[2])
        at += 8 + length + length % 2
    raise ValueError(f"{name} has no samples")


def decoded(raw: bytes, h: Header, channels: str) -> np.ndarray:
    """Samples between -1 and 1: the mean of the channels, or the first."""
    x = np.frombuffer(raw, np.uint8).reshape(-1, h.channels, h.width)
    if h.width == 1:
        y = x[:, :, 0].astype(np.float64) / 128 - 1
    else:  # little-endian, signed: shifted to the top of 32 bits
        wide = np.zeros((len(x), h.channels, 4), np.uint8)
        wide[:, :, 4 - h.width :] = x
        y = wide.view("<i4")[:, :, 0] / 2.0**31
    return y[:, 0] if channels == "first" else y.mean(axis=1)


@dataclass
class Range:
    path: str
    stim: str
    header: Header
    offset: int
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """Ranges of a task, packed."""

    packed: bytes

    @property
    def each(self) -> list[Range]:
        return [Range(path, stim, Header(*kind), offset, first, last) for path, stim, kind, offset, first, last in pickle.loads(zlib.decompress(self.packed))]


def walked(store: fs.FileSystem, folder: str) -> Iterator[str]:
    """Files of recordings in the order of their paths, folder by folder."""
    found = store.get_file_info(fs.FileSelector(folder))
    inner = sorted(f.base_name + "/" * (f.type == fs.FileType.Directory) for f in found if f.base_name[0] not in "._")
    del found
    for name in inner:
        if name.endswith("/"):
            yield from walked(store, f"{folder.rstrip('/')}/{name[:-1]}")
        elif name.endswith(".wav"):
            yield f"{folder.rstrip('/')}/{name}"


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.range, self.channels = options["path"], int(options.get("range", 1 << 20)), options.get("channels", "mean")
        if self.range < 1 or self.channels not in ("mean", "first"):
            raise ValueError("range must be positive, channels mean or first")

    def partitions(self) -> list[Ranges]:
        """Ranges of all files, as many to a task; only their headers are read here. Files in a folder of a stimulus follow each other by name."""
        store, root = system(self.path)
        kind_of = store.get_file_info(root).type
        files = walked(store, root) if kind_of == fs.FileType.Directory else iter([root] if kind_of == fs.FileType.File and root.endswith(".wav") else [])

        def header(path: str) -> Header:
            with store.open_input_file(path) as f:
                return read_header(f, path)

        names, ends, frames, kind = bytearray(), array("q"), array("q"), array("i")
        kinds: dict[tuple[int, int, int, int], int] = {}
        with ThreadPoolExecutor(16) as pool:
            while some := list(islice(files, AHEAD)):
                for path, h in zip(some, pool.map(header, some), strict=True):
                    names += path.encode()
                    ends.append(len(names))
                    frames.append(h.frames)
                    kind.append(kinds.setdefault((h.start, h.channels, h.width, h.rate), len(kinds)))
        of = list(kinds)

        def ranges() -> Iterator[tuple]:
            upto: dict[str, int] = {}
            begin = 0
            for end, n, k in zip(ends, frames, kind, strict=True):
                path, begin = names[begin:end].decode(), end
                inner = posixpath.dirname(path[len(root) :].strip("/"))
                stim = posixpath.basename(inner) if inner else posixpath.basename(path)[:-4]
                start, channels, width, rate = of[k]
                offset = upto.get(stim, 0)
                for a in range(0, n, self.range):
                    yield path, stim, (start, n, channels, width, rate), offset, a, min(a + self.range, n)
                upto[stim] = offset + n

        each = -(-sum(-(-n // self.range) for n in frames) // TASKS) or 1
        rows, out = ranges(), []
        while part := list(islice(rows, each)):
            out.append(Ranges(zlib.compress(pickle.dumps(part))))
        return out

    def read(self, part: Ranges) -> Iterator[pa.RecordBatch]:
        for each in part.each:
            yield from self.samples(each)

    def samples(self, part: Range) -> Iterator[pa.RecordBatch]:
        h, size = part.header, part.header.channels * part.header.width
        store, _ = system(self.path)
        with store.open_input_file(part.path) as f:
            for a in range(part.first, part.last, ROWS):
                b = min(a + ROWS, part.last)
                f.seek(h.start + a * size)
                x = decoded(f.read((b - a) * size), h, self.channels)
                yield pa.RecordBatch.from_arrays([pa.array([part.stim] * (b - a)), pa.array(np.arange(part.offset + a, part.offset + b)), pa.array(x)], names=["stim", "n", "x"])


@dataclass
class Written(WriterCommitMessage):
    """Ranges that a task wrote: their final names, packed, in the order of their numbers in the task's folder."""

    task: str
    packed: bytes

    def names(self) -> list[str]:
        return zlib.decompress(self.packed).decode().split("\n")


def pcm(x: np.ndarray, sr: int, what: str, bits: int = 16) -> bytes:
    """A mono file of 16 or 32 bits; a sample beyond -1 to 1, or none, raises an error rather than clip."""
    if not (np.abs(x) <= 1).all():
        raise ValueError(f"{what} would clip")
    top, width = 1 << bits - 1, bits // 8
    body = np.clip(np.rint(x * top), -top, top - 1).astype(f"<i{width}").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, sr, width * sr, width, bits) + b"data" + struct.pack("<I", len(body)) + body


class WavWriter(DataSourceArrowWriter):
    """Each task writes whole ranges of samples under names that readers pass over; they are renamed when all tasks have ended."""

    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.sr, self.range, self.bits, self.overwrite = options["path"], int(options["sr"]), int(options.get("range", 1 << 20)), int(options.get("bits", 16)), overwrite
        if self.bits not in (16, 32):
            raise ValueError("bits must be 16 or 32")
        self.run = f"_{uuid.uuid4()}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = system(self.path)
        task = f"{root}/{self.run}/{uuid.uuid4()}"
        done: list[str] = []
        held: tuple[str, int] | None = None
        xs: list[float] = []

        def flush() -> None:
            if held is None:
                return
            if not done:
                store.create_dir(task)
            with store.open_output_stream(f"{task}/{len(done)}.wav") as f:
                f.write(pcm(np.asarray(xs, np.float64), self.sr, held[0], self.bits))
            done.append(f"{held[0]}/{held[1]:010d}.wav")

        for batch in batches:
            for stim, n, x in zip(*(batch.column(c).to_pylist() for c in ("stim", "n", "x")), strict=True):
                key = (stim, n // self.range)
                if key != held:
                    flush()
                    held, xs = key, []
                if n != key[1] * self.range + len(xs):
                    raise ValueError(f"sample {n} of {stim} is out of place; write what in_ranges() gives")
                xs.append(x)
        flush()
        return Written(task, zlib.compress("\n".join(done).encode()) if done else b"")

    def commit(self, messages: list[Written | None]) -> None:
        store, root = system(self.path)
        messages = [m for m in messages if m and m.packed]
        hashes = bytearray().join(blake2b(name.encode(), digest_size=16).digest() for m in messages for name in m.names())
        keys = np.frombuffer(hashes, [("a", "<u8"), ("b", "<u8")]) if hashes else np.empty(0)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("a range was written by several tasks; write what in_ranges() gives")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root)):
                if posixpath.basename(info.path) != self.run:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for m in messages:
            for k, name in enumerate(m.names()):
                store.create_dir(posixpath.dirname(f"{root}/{name}"))
                store.move(f"{m.task}/{k}.wav", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = system(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


class WavSource(DataSource):
    """Options: ``path``, ``range`` (samples of a task or of a written file), ``channels`` (mean or first); ``sr`` and ``bits`` (16 or 32) to write."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def in_ranges(samples: DataFrame, size: int = 1 << 20) -> DataFrame:
    """``stim, n, x`` dealt out and sorted as the writer takes it: each range of a stimulus's samples whole in one task, in order."""
    own = samples.select(F.col("stim").cast("string").alias("stim"), F.col("n").cast("bigint").alias("n"), F.col("x").cast("double").alias("x"))
    return own.withColumn("_range", F.floor(F.col("n") / size)).repartition("stim", "_range").sortWithinPartitions("stim", "n").drop("_range")
