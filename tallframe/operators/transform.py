"""Fourier transforms and convolutions of signals of any length, as tall tables ``stim, n, re, im``.

A transform of 2^b points is done in columns and rows of about 2^(b/2): samples meet by their number modulo the
number of columns, each column is transformed and turned, the results meet by row, each row is transformed. A task
holds a block of at most ``LINES`` columns or rows at a time, so one stimulus spreads over as many tasks as it has
blocks, and what a block of columns sends to a block of rows is one value of a shuffled row. A convolution stays in
this order: what comes out by row is multiplied there and goes back by column, three shuffles in all.

Transforms of any number of points, analytic signals and circular correlations are convolutions with kernels whose
values have a closed form (or are the signal's own), padded to a power of two, so that they are exact at every length.

Where the caller knows that no signal is longer than ``longest`` and a transform of that many points is one block both ways,
a signal is a row of bounded length, and a convolution is one shuffle that carries its samples alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallframe.operators.banks import Bank, lobe_columns
from tallframe.operators.grid import lengths

#: A kernel's value at offsets -(m - 1) to m - 1, given the offsets and m as arrays.
Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Columns or rows of a transform that a task holds together, and complex values that it transforms at a time.
LINES, CELLS = 64, 1 << 18


def chirp(j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """exp(i pi j^2 / m), the kernel of a transform of m points; the square is taken modulo 2 m, so that large offsets stay exact."""
    return np.exp(1j * np.pi * ((j * j) % (2 * m)) / m)


def hilbert(j: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The kernel of the analytic signal: one at zero, and i times 2 / m times the sum of sin(2 pi k j / m) over positive frequencies."""
    j = j % m
    half, top = np.pi * j / m, (m - 1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.sin(top * half) * np.sin((top + 1) * half) / np.sin(half)
    return np.where(j == 0, 1.0, 2j / m * np.where(j == 0, 0.0, total))


def padded_size(m: Column) -> Column:
    """The power of two from 2 m - 1."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2((2 * m - 1).cast("double")) - F.lit(1e-12)).cast("int"))


def longest(samples: DataFrame) -> int:
    """The samples of the longest signal; reads all of them."""
    return (samples.agg(F.max("n")).first()[0] or 0) + 1


def one_block(longest_: int | None) -> bool:
    """Whether transforms for signals of up to so many samples are a block of columns and a block of rows."""
    return longest_ is not None and 2 * longest_ - 1 <= LINES * LINES


def convolved(rows: DataFrame, keys: list[str], kernel: Kernel | None = None, longest: int | None = None, *, mirrored: bool = False) -> DataFrame:
    """``*keys, m, n, re, im``: each signal convolved with a kernel, at n from 0 to m - 1.

    ``rows`` has the keys, ``m`` (the signal's length, the same in all its rows), ``n`` (0 to m - 1), ``re`` and ``im``; a sample without
    a row is zero, but one whose ``n`` squared is below 4 m must have a row. Without a ``kernel``, rows have ``other`` too, the other
    signal's real value, at n from 0 to the size of the transform (``padded_size``) less one; offsets below zero count from its end.
    No m may be beyond ``longest``. With ``mirrored``, for whole signals alone, rows are real and have ``re`` only, and the other signal is the signal itself backwards, which wraps round.
    """
    if mirrored and not one_block(longest):
        raise ValueError("only whole signals are mirrored")
    values = ("re",) if mirrored else ("re", "im") if kernel else ("re", "im", "other")
    keyed = rows.select(*keys, F.col("m").cast("bigint").alias("m"), padded_size(F.col("m")).alias("size"), F.col("n").cast("bigint").alias("n"), *[F.col(c).cast("double").alias(c) for c in values])
    across = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.floor(F.round(F.log2("size")) / 2).cast("int"))
    own = [T.StructField(k, rows.schema[k].dataType) for k in keys] + [T.StructField("m", T.LongType()), T.StructField("size", T.LongType())]
    packed = T.StructType([*own, T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("part", T.BinaryType())])
    tall = T.StructType([*own, T.StructField("n", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    if one_block(longest):
        wholes = keyed.groupBy(*keys, "m", "size").agg(F.collect_list(F.struct("n", *values)).alias("v"))
        return wholes.mapInArrow(lambda b: blocks(b, keys, tall, Whole(kernel, mirrored)), tall).select(*keys, "m", "n", "re", "im")

    def met(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys, "m", "size", "block").agg(F.collect_list(F.struct("at", "part")).alias("v"))

    block = F.floor(F.pmod("n", across) / F.least(across, F.lit(LINES)))
    columns = keyed.groupBy(*keys, "m", "size", block.alias("block")).agg(F.collect_list(F.struct("n", *values)).alias("v"))
    down = columns.mapInArrow(lambda b: blocks(b, keys, packed, Columns(kernel)), packed)
    over = met(down).mapInArrow(lambda b: blocks(b, keys, packed, Rows()), packed)
    return met(over).mapInArrow(lambda b: blocks(b, keys, tall, Back()), tall).select(*keys, "m", "n", "re", "im")


def shape(size: int) -> tuple[int, int, int]:
    """Columns, rows, and lines of a block of a transform of so many points."""
    across = 1 << (size.bit_length() - 1) // 2
    return across, size // across, min(across, LINES)


def turns(block: np.ndarray, lines: int, long: int, size: int) -> np.ndarray:
    """exp(-2 pi i line * place / size) for the lines of blocks."""
    line = (block[:, None] * lines + np.arange(lines))[:, :, None]
    return np.exp(-2j * np.pi * ((line * np.arange(long)) % size) / size)


def cut(values: np.ndarray, lines: int) -> np.ndarray:
    """``block, other block, line, other line`` of blocks of lines: what each sends to blocks that are lines the other way."""
    n, own, long = values.shape
    return values.reshape(n, own, long // lines, lines).transpose(0, 2, 1, 3)


def assembled(v: pa.ListArray, lines: int, long: int, signals_: int) -> np.ndarray:
    """``signal, block, line, place``: blocks of lines put together from what the other way's blocks sent."""
    offsets, flat = v.offsets.to_numpy(), v.flatten()
    at, parts = flat.field("at").to_numpy(), flat.field("part").to_pylist()
    out = np.zeros((signals_, len(v), lines, long), complex)
    for row, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        for k in range(a - offsets[0], b - offsets[0]):
            sent = np.frombuffer(parts[k], complex).reshape(signals_, lines, lines)
            out[:, row, :, at[k] * lines : (at[k] + 1) * lines] = sent.transpose(0, 2, 1)
    return out


class Whole:
    """Whole signals of at most a block both ways: convolved in one step."""

    def __init__(self, kernel: Kernel | None, mirrored: bool) -> None:
        self.kernel, self.mirrored = kernel, mirrored

    def __call__(self, part: pa.RecordBatch, size: int) -> tuple[np.ndarray, list]:
        n, m, lists = part.num_rows, part.column("m").to_numpy(), part.column("v")
        flat = lists.flatten()
        if size > LINES * LINES:
            raise ValueError(f"a signal of {m.max()} samples is longer than was stated")
        row, place = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), flat.field("n").to_numpy()
        spot = row * size + place

        def line(c: str) -> np.ndarray:
            return np.bincount(spot, flat.field(c).to_numpy(), n * size).reshape(n, size)

        real = line("re")
        if self.mirrored:
            other = np.zeros((n, size))
            other[row, np.where(place == 0, 0, m[row] - place)] = other[row, (size - place) % size] = real[row, place]
            other = np.fft.fft(other, axis=1)
        elif self.kernel is None:
            other = np.fft.fft(line("other"), axis=1)
        else:
            lengths_, which = np.unique(m, return_inverse=True)  # a kernel for each length
            offset = np.arange(size) - np.where(np.arange(size) < lengths_[:, None], 0, size)
            other = np.where(np.abs(offset) < lengths_[:, None], self.kernel(offset, lengths_[:, None]), 0.0)
            other = np.fft.fft(other, axis=1)[which]
        found = np.fft.ifft(np.fft.fft(real if self.mirrored else real + 1j * line("im"), axis=1) * other, axis=1)
        row, place = np.nonzero(np.arange(size) < m[:, None])
        kept = found[row, place]
        return row, [pa.array(place), pa.array(kept.real), pa.array(kept.imag)]


class Columns:
    """Blocks of columns of both signals: transformed, turned and sent to rows."""

    def __init__(self, kernel: Kernel | None) -> None:
        self.kernel = kernel

    def __call__(self, part: pa.RecordBatch, size: int) -> tuple[np.ndarray, list]:
        across, long, lines = shape(size)
        n, block, m = part.num_rows, part.column("block").to_numpy(), part.column("m").to_numpy()
        flat, lists = part.column("v").flatten(), part.column("v")
        row, place = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), flat.field("n").to_numpy()
        spot = (row * lines + place % across - block[row] * lines) * long + place // across

        def grid(c: str) -> np.ndarray:
            return np.bincount(spot, flat.field(c).to_numpy(), n * lines * long).reshape(n, lines, long)

        if self.kernel is None:
            other = grid("other")
        else:
            offset = (block[:, None] * lines + np.arange(lines))[:, :, None] + across * np.arange(long)
            m = m[:, None, None]
            offset = np.where(offset < m, offset, offset - size)
            other = np.where(np.abs(offset) < m, self.kernel(offset, m), 0.0)
        turn = turns(block, lines, long, size)
        sent = np.stack([cut(np.fft.fft(x, axis=2) * turn, lines) for x in (grid("re") + 1j * grid("im"), other)], axis=2)
        return packed_parts(sent)


class Rows:
    """Blocks of rows of both signals: transformed, multiplied, transformed back, turned and sent to columns."""

    def __call__(self, part: pa.RecordBatch, size: int) -> tuple[np.ndarray, list]:
        across, _, lines = shape(size)
        a, b = np.fft.fft(assembled(part.column("v"), lines, across, 2), axis=3)
        back = np.fft.ifft(a * b, axis=2) * np.conj(turns(part.column("block").to_numpy(), lines, across, size))
        return packed_parts(cut(back, lines)[:, :, None])


class Back:
    """Blocks of columns of the product: transformed back to samples."""

    def __call__(self, part: pa.RecordBatch, size: int) -> tuple[np.ndarray, list]:
        across, long, lines = shape(size)
        found = np.fft.ifft(assembled(part.column("v"), lines, long, 1)[0], axis=2).reshape(-1)
        line = (part.column("block").to_numpy()[:, None] * lines + np.arange(lines))[:, :, None]
        place = (line + across * np.arange(long)).reshape(-1)
        row = np.repeat(np.arange(part.num_rows), lines * long)
        kept = place < part.column("m").to_numpy()[row]
        return row[kept], [pa.array(place[kept]), pa.array(found.real[kept]), pa.array(found.imag[kept])]


def packed_parts(sent: np.ndarray) -> tuple[np.ndarray, list]:
    """Rows of origin, and columns ``block`` (where a part goes), and the parts themselves."""
    n, many = sent.shape[:2]
    parts = [x.tobytes() for row in sent for x in row]
    return np.repeat(np.arange(n), many), [pa.array(np.tile(np.arange(many), n)), None, pa.array(parts, pa.binary())]


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], schema: T.StructType, step: Whole | Columns | Rows | Back) -> Iterator[pa.RecordBatch]:
    """Applies a step to blocks of lines of one size at a time, few enough to bound memory."""
    out_schema = to_arrow_schema(schema)
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            chosen = np.nonzero(sizes == size)[0]
            across, long, lines = shape(size)
            some = max(1, CELLS // (lines * max(across, long)))
            for k in range(0, len(chosen), some):
                part = batch.take(pa.array(chosen[k : k + some]))
                row, values = step(part, size)
                rows = pa.array(row)
                if values[1] is None:  # parts say which block they come from
                    values[1] = part.column("block").take(rows)
                arrays = [*(part.column(c).take(rows) for c in (*keys, "m", "size")), *values]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema, strict=True)], schema=out_schema)


def turned(rows: DataFrame, sign: int) -> DataFrame:
    """Values times exp(sign i pi n^2 / m)."""
    n, m = F.col("n"), F.col("m")
    angle = F.lit(sign * math.pi) * F.pmod(n * n, 2 * m) / m
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    return rows.withColumns({"re": re, "im": im})


def signals(samples: DataFrame) -> DataFrame:
    """``stim, m, n, re, im`` of ``stim, n, x``: samples are numbered from 0 without gaps; a null is zero."""
    own = samples.select("stim", F.col("n").cast("bigint").alias("n"), F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))
    return own.join(lengths(samples).withColumnRenamed("length", "m"), "stim")


def fourier(rows: DataFrame, keys: list[str] = ["stim"], longest: int | None = None) -> DataFrame:  # noqa: B006
    """``*keys, m, n, re, im``: the discrete transform of ``*keys, m, n, re, im``; n is then the number of the bin."""
    return turned(convolved(turned(rows, -1), keys, chirp, longest), -1)


def inverse_fourier(rows: DataFrame, keys: list[str] = ["stim"], longest: int | None = None) -> DataFrame:  # noqa: B006
    """The inverse of ``fourier``: the conjugate transform of the conjugate, over m."""
    back = turned(convolved(turned(rows.withColumn("im", -F.col("im")), -1), keys, chirp, longest), -1)
    return back.withColumns({"re": F.col("re") / F.col("m"), "im": -F.col("im") / F.col("m")})


def magnitudes(samples: DataFrame, longest: int | None = None) -> DataFrame:
    """``stim, bin, magnitude`` of the discrete transform of ``stim, n, x``."""
    return fourier(signals(samples), longest=longest).select("stim", F.col("n").alias("bin"), F.hypot("re", "im").alias("magnitude"))


def analytic(samples: DataFrame, longest: int | None = None) -> DataFrame:
    """``stim, n, re, im``: the analytic signal; its magnitude is the envelope."""
    return convolved(signals(samples), ["stim"], hilbert, longest).select("stim", "n", "re", "im")


def circular_autocorrelation(samples: DataFrame, longest: int | None = None) -> DataFrame:
    """``stim, lag, ac`` for lags from 0: the mean product of a stimulus and itself turned by the lag."""
    n, m, x = F.col("n"), F.col("m"), F.col("re")
    if one_block(longest):
        own = convolved(signals(samples).drop("im"), ["stim"], longest=longest, mirrored=True)
        return own.select("stim", n.alias("lag"), (x / m).alias("ac"))
    back = F.pmod(m - n, m)
    zero = F.lit(0.0)
    spots = F.array(F.struct(n.alias("n"), x.alias("re"), zero.alias("other")), F.struct(back.alias("n"), zero.alias("re"), x.alias("other")), F.struct((padded_size(m) + back - m).alias("n"), zero.alias("re"), F.when(back > 0, x).otherwise(zero).alias("other")))
    rows = signals(samples).select("stim", "m", F.explode(spots).alias("s")).select("stim", "m", "s.n", "s.re", F.lit(0.0).alias("im"), "s.other")
    return convolved(rows, ["stim"], longest=longest).select("stim", F.col("n").alias("lag"), (F.col("re") / F.col("m")).alias("ac"))


def subbands(samples: DataFrame, bank: Bank, sr: float, *, complex_: bool = False, longest: int | None = None) -> DataFrame:
    """``stim, channel, n, re, im``: each filter's output over whole stimuli; ``complex_`` gives analytic signals, whose magnitudes are envelopes.

    A filter multiplies the bins of the transform, so that it is as sharp at every length; only bins that it passes go on.
    """
    n, m = F.col("n"), F.col("m")
    below = F.least(n, m - n)  # a bin above the middle is the conjugate of its mirror image
    freq = below.cast("double") * F.lit(float(sr)) / m
    channels = F.array(*[h.alias("h") for h in lobe_columns(bank, freq)])
    rows = fourier(signals(samples), longest=longest).select("stim", "m", "n", "re", "im", F.posexplode(channels).alias("channel", "h"))
    if complex_:
        rows = rows.withColumn("h", F.col("h") * F.when((n == 0) | (2 * n == m), 1.0).when(2 * n < m, 2.0).otherwise(0.0))
    rows = rows.where((F.col("h") != 0) | (n * n < 4 * m)).select("stim", "channel", "m", "n", (F.col("re") * F.col("h")).alias("re"), (F.col("im") * F.col("h")).alias("im"))
    return inverse_fourier(rows, ["stim", "channel"], longest).select("stim", "channel", "n", "re", "im")


def collapsed(bands: DataFrame, bank: Bank, sr: float, longest: int | None = None) -> DataFrame:
    """``stim, n, x`` from ``stim, channel, n, x``: the bands, each filtered again, added up in the transform."""
    rows = bands.select("stim", "channel", F.col("n").cast("bigint").alias("n"), F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im"))
    rows = rows.join(lengths(bands).withColumnRenamed("length", "m"), "stim")
    n, m = F.col("n"), F.col("m")
    channels = F.array(*lobe_columns(bank, F.least(n, m - n).cast("double") * F.lit(float(sr)) / m))
    own = fourier(rows, ["stim", "channel"], longest).withColumn("h", F.get(channels, F.col("channel")))
    sums = own.groupBy("stim", "m", "n").agg(F.sum(F.col("re") * F.col("h")).alias("re"), F.sum(F.col("im") * F.col("h")).alias("im"))
    return inverse_fourier(sums, longest=longest).select("stim", "n", F.col("re").alias("x"))


def matched_noise(samples: DataFrame, seed: int = 0, longest: int | None = None) -> DataFrame:
    """``stim, n, x``: noise of each signal's own magnitudes; the phase of a bin comes of its stimulus, its number and ``seed``. The mean and the middle bin keep theirs."""
    n, m = F.col("n"), F.col("m")
    mirror = F.least(n, m - n)
    angle = F.pmod(F.xxhash64("stim", mirror, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) * (2 * math.pi)
    angle = F.when((n == 0) | (2 * n == m), 0.0).when(2 * n < m, angle).otherwise(-angle)
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    return inverse_fourier(fourier(signals(samples), longest=longest).withColumns({"re": re, "im": im}), longest=longest).select("stim", "n", F.col("re").alias("x"))
