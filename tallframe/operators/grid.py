"""The common time grid: padding, framing, overlap-add, alignment, gaps, shifts and autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallframe.operators.order import with_next
from tallframe.operators.resample import pchip


def lengths(samples: DataFrame) -> DataFrame:
    """``stim, length``: the samples of each stimulus, which are numbered from 0."""
    return samples.groupBy("stim").agg((F.max("n") + 1).alias("length"))


def padded(samples: DataFrame, before: int, after: int, *, value: float = 0.0) -> DataFrame:
    """``stim, n, x`` with so many samples of ``value`` before and after each stimulus."""
    if before < 0 or after < 0:
        raise ValueError("pads can't be negative")
    own = samples.select("stim", (F.col("n") + before).alias("n"), "x")
    places = F.concat(F.expr(f"sequence(0, {before})"), F.expr(f"transform(sequence(0, {after}), k -> k + length + {before} - 1)"))
    pads = lengths(samples).select("stim", "length", F.explode(places).alias("n"))
    pads = pads.where((F.col("n") < before) | (F.col("n") >= F.col("length") + before))
    return own.unionByName(pads.select("stim", F.col("n").cast("bigint"), F.lit(value).alias("x")))


def time_axis(samples: DataFrame, rate: float, start: float = 0.0) -> DataFrame:
    return samples.withColumn("t", F.col("n") / F.lit(float(rate)) + F.lit(start))


def frames(samples: DataFrame, kernel: int, stride: int, *, tail: bool = True) -> DataFrame:
    """``stim, frame, pos, x, size``: overlapping frames; a sample appears in each frame that holds it.

    A stimulus of at most ``kernel`` samples is one frame of its own size. Otherwise the last frame is
    filled with zeros (``tail``), which are not rows but count in ``size``, or frames that aren't full are left out.
    """
    if not 1 <= stride <= kernel:
        raise ValueError("the stride must be from 1 to the kernel")
    whole = F.ceil((F.col("length") - kernel) / stride) if tail else F.floor((F.col("length") - kernel) / stride)
    last = F.when(F.col("length") <= kernel, 0).otherwise(whole).cast("bigint")
    own = samples.join(lengths(samples), "stim").withColumn("last", last)
    low = F.greatest(F.lit(0), F.floor((F.col("n") - kernel) / stride) + 1).cast("bigint")
    high = F.least(F.floor(F.col("n") / stride), F.col("last")).cast("bigint")
    own = own.withColumn("low", low).withColumn("high", high).where("low <= high")
    out = own.withColumn("frame", F.explode(F.sequence("low", "high")))
    return out.select("stim", "frame", (F.col("n") - F.col("frame") * stride).alias("pos"), "x", F.least("length", F.lit(kernel)).cast("bigint").alias("size"), "last")


def overlap_add(values: DataFrame, kernel: int, stride: int, column: str = "x") -> DataFrame:
    """Joins frames ``stim, frame, pos, last`` back to ``stim, n, x``, fading from each frame to the next over their overlap."""
    rest = kernel - stride
    if rest > stride:
        raise ValueError("more than two frames overlap")
    i = F.when(F.col("pos") >= stride, F.col("pos") - stride).otherwise(F.col("pos"))

    def window(k):  # of 2 * rest points, zero at its ends
        return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * 3.141592653589793 / max(1, 2 * rest - 1)) * k)

    new = window(2 * i) / (window(2 * i) + window(2 * i + 1)) if rest > 1 else F.lit(0.5)
    fades_in = (F.col("pos") < rest) & (F.col("frame") > 0)
    fades_out = (F.col("pos") >= stride) & (F.col("frame") < F.col("last"))
    weight = F.when(fades_in, new).when(fades_out, 1 - new).otherwise(F.lit(1.0))
    return values.withColumn("n", F.col("frame") * stride + F.col("pos")).groupBy("stim", "n").agg(F.sum(weight * F.col(column)).alias("x"))


def buffered_frames(samples: DataFrame, target: int, front: int, back: int) -> DataFrame:
    """``stim, frame, pos, x``: frames of ``target`` samples with so many more in front and behind; beyond the stimulus is silence, which has no rows."""
    own = samples.join(lengths(samples), "stim")
    count = F.ceil(F.col("length") / target)
    low = F.greatest(F.lit(0), F.floor((F.col("n") - target - back) / target) + 1).cast("bigint")
    high = F.least(F.floor((F.col("n") + front) / target), count - 1).cast("bigint")
    out = own.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("frame", F.explode(F.sequence("low", "high")))
    return out.select("stim", "frame", (F.col("n") - F.col("frame") * target + front).alias("pos"), "x")


def combined(buffered: DataFrame, target: int, onset: int) -> DataFrame:
    """``stim, n, x`` of the ``target`` samples from ``onset`` of each frame, in order."""
    inside = buffered.where((F.col("pos") >= onset) & (F.col("pos") < onset + target))
    return inside.select("stim", (F.col("frame") * target + F.col("pos") - onset).alias("n"), "x")


def aligned(points: DataFrame, step: float, *, bucket: float, parts: int | None = None) -> DataFrame:
    """Values at ``stim, t`` brought to the grid ``frame * step`` by linear interpolation: ``stim, frame, x``.

    ``t`` is 0 or more and distinct in a stimulus. Before the first point its value holds; the grid ends
    with the last point. Each pair of neighbours fills its own part of the grid, so no range is joined.
    Buckets of points are dealt to ``parts``, as in ``with_next``.
    """
    nexts = with_next(points.select("stim", "t", "x"), ["stim"], F.floor(F.col("t") / bucket), ["t"], ["t", "x"], parts=parts)
    first = points.groupBy("stim").agg(F.min(F.struct("t", "x")).alias("first"))
    low, high = F.ceil(F.col("t") / step), F.when(F.col("next_t").isNull(), F.floor(F.col("t") / step)).otherwise(F.ceil(F.col("next_t") / step) - 1)
    inner = nexts.withColumn("low", low.cast("bigint")).withColumn("high", high.cast("bigint")).where("low <= high")
    inner = inner.withColumn("frame", F.explode(F.sequence("low", "high")))
    share = F.try_divide(F.col("frame") * F.lit(float(step)) - F.col("t"), F.col("next_t") - F.col("t"))
    inner = inner.select("stim", "frame", F.coalesce(F.col("x") + share * (F.col("next_x") - F.col("x")), F.col("x")).alias("x"))
    lead_in = first.where(F.ceil(F.col("first.t") / step) > 0)
    lead_in = lead_in.select("stim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("first.t") / step).cast("bigint") - 1)).alias("frame"), F.col("first.x").alias("x"))
    return inner.unionByName(lead_in)


def filled(samples: DataFrame, *, bucket: int = 4096, method: str = "linear") -> DataFrame:
    """``stim, n, x`` with missing values (null, NaN) interpolated from those on both sides. A stimulus without values has no rows.

    ``linear``: from the nearest ones; at the ends the nearest holds. ``pchip``: monotone cubic pieces, of which the first and the last carry on to the ends.
    """
    known = samples.where(F.col("x").isNotNull() & ~F.isnan(F.col("x").cast("double"))).select("stim", "n", "x")
    if method == "pchip":
        whole = lengths(samples).select("stim", F.lit(0).alias("low"), (F.col("length") - 1).alias("high"))
        return pchip(known, ["stim"], "n", "x", bucket=F.floor(F.col("n") / bucket), limits=whole).withColumnRenamed("k", "n")
    if method != "linear":
        raise ValueError(method)
    nexts = with_next(known, ["stim"], F.floor(F.col("n") / bucket), ["n"], ["n", "x"])
    ends = known.groupBy("stim").agg(F.min("n").alias("from_n"))
    own = nexts.join(lengths(samples), "stim").join(ends, "stim")
    low = F.when(F.col("n") == F.col("from_n"), 0).otherwise(F.col("n")).cast("bigint")
    high = F.coalesce(F.col("next_n"), F.col("length")) - 1
    out = own.withColumn("k", F.explode(F.sequence(low, high.cast("bigint"))))
    share = (F.col("k") - F.col("n")) / (F.col("next_n") - F.col("n"))
    value = F.when((F.col("k") <= F.col("n")) | F.col("next_n").isNull(), F.col("x")).otherwise(F.col("x") + share * (F.col("next_x") - F.col("x")))
    return out.select("stim", F.col("k").alias("n"), value.alias("x"))


def lagged(samples: DataFrame, lag: int) -> DataFrame:
    """``stim, n, x, lagged``: the value ``lag`` samples before (behind, if negative), zero beyond the ends. An equi-join on the sample's number."""
    other = samples.select("stim", (F.col("n") + lag).alias("n"), F.col("x").alias("lagged"))
    return samples.select("stim", "n", "x").join(other, ["stim", "n"], "left").withColumn("lagged", F.coalesce("lagged", F.lit(0.0)))


def autocorrelation(samples: DataFrame, lags: list[int]) -> DataFrame:
    """``stim, lag, ac``: the mean product of values a lag before and after each sample, over the variance; zero beyond the ends."""
    means = samples.groupBy("stim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"), F.count("*").alias("length"))
    y = samples.join(means, "stim").select("stim", "n", (F.col("x") - F.col("mean")).alias("x"))
    sums = products(y, 2 * max(lags)).where(F.col("lag").isin([2 * k for k in lags])).select("stim", (F.col("lag") / 2).cast("int").alias("lag"), "s")
    return sums.join(means, "stim").select("stim", "lag", F.try_divide(F.col("s") / F.col("length"), F.col("var")).alias("ac"))


def products(samples: DataFrame, most: int) -> DataFrame:
    """``stim, lag, s``: sums of x[n] x[n + lag] inside the stimulus, for lags from 0 to ``most``, by blocks of at least ``most`` samples.

    A block meets the next one's samples in one row of bounded length; its sums by lag are added up by a shuffle.
    """
    block = max(most, 256)
    own = F.floor(F.col("n") / block)
    spots = F.array(F.struct(own.alias("b")), F.struct((own - 1).alias("b")))
    rows = samples.select("stim", "n", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.explode(spots).alias("s"))
    rows = rows.select("stim", "n", "x", "s.b").where("b >= 0").groupBy("stim", "b").agg(F.collect_list(F.struct((F.col("n") - F.col("b") * block).alias("at"), "x")).alias("v"))
    kind = samples.schema["stim"].dataType
    schema = T.StructType([T.StructField("stim", kind), T.StructField("lag", T.LongType()), T.StructField("s", T.DoubleType())])
    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists, n = part.column("v"), part.num_rows
                flat = lists.flatten()
                wide = np.zeros((n, 2 * block))
                wide[np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), flat.field("at").to_numpy()] = flat.field("x").to_numpy()
                size = 1 << (3 * block - 1).bit_length()
                f = np.conj(np.fft.rfft(wide[:, :block], size, axis=1)) * np.fft.rfft(wide, size, axis=1)
                sums = np.fft.irfft(f, size, axis=1)[:, : most + 1]
                own = np.repeat(np.arange(n), most + 1)
                arrays = [part.column("stim").take(pa.array(own)), pa.array(np.tile(np.arange(most + 1), n)), pa.array(sums.reshape(-1))]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema, strict=True)], schema=out_schema)

    return rows.mapInArrow(run, schema).groupBy("stim", "lag").agg(F.sum("s").alias("s"))


def window_weight(window: str, share: Column) -> Column:
    """A window at ``share`` of its length."""
    turn = F.cos(F.lit(2 * math.pi) * share)
    weights = {"hanning": 0.5 - 0.5 * turn, "rect": F.lit(1.0), "hamming": 0.54 - 0.46 * turn, "soft": 0.6 - 0.4 * turn, "welch": F.sin(F.lit(math.pi) * share)}
    if window not in weights:
        raise ValueError(f"unknown window {window}; known are {', '.join(weights)}")
    return weights[window]


def windowed_autocorrelation(samples: DataFrame, lags: int, *, window: str = "hanning", undo: bool = False) -> DataFrame:
    """``stim, lag, ac`` for lags from 0: sums of products of windowed samples a lag apart between zeros, over twice the length; with ``undo`` over the window's own sums.

    Lags that a stimulus is too short for have no rows; where the window's own sum is zero, ``ac`` is null.
    """
    own = samples.join(lengths(samples), "stim")
    weighed = own.withColumn("w", window_weight(window, (F.col("n") + 1) / F.col("length")))
    sums = products(weighed.select("stim", "n", (F.col("x") * F.col("w")).alias("x")), lags).join(lengths(samples), "stim").where("lag < length")
    if not undo:
        return sums.select("stim", "lag", (F.col("s") / (2 * F.col("length"))).alias("ac"))
    windows = products(weighed.select("stim", "n", F.col("w").alias("x")), lags).withColumnRenamed("s", "own")
    return sums.join(windows, ["stim", "lag"]).select("stim", "lag", F.try_divide("s", "own").alias("ac"))
