"""Modulations of whole cochleagrams, tall ``stim, frame, k, x``: two-dimensional filters, the way back, and matching of what they pass.

A plane's transform is that of each channel over time and then of each frequency over channels, both by blocks, so that no task
holds a cochleagram. What is between is written to the shared folder, as it is read several times. Channels are numbered from 0 to ``channels`` less one, and every frame has them all.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallframe.operators.cochlea import wavelet_responses
from tallframe.operators.kernels import spectral_filter
from tallframe.operators.match import by_rank
from tallframe.operators.transform import fourier, inverse_fourier
from tallframe.session import checkpointed
from tallframe.sources.files import is_whole


@dataclass(frozen=True)
class Filters:
    """Filters ``rate, scale, sign``: of a rate over time (Hz), a scale over frequency (cycles an octave), both or one of them (the other None), moving one way.

    With both, and unless ``separable``, what moves the other way is left out.
    """

    channels: int
    each: tuple[tuple[float | None, float | None, int], ...]
    sr: float
    per_octave: float
    separable: bool = False
    causal: bool = True


def plane(cells: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """``*keys, frames, t, f, re, im``: the transform of ``*keys, frame, k, re, im`` over both axes."""
    ends = cells.groupBy(*keys).agg((F.max("frame") + 1).alias("m"))
    rows = cells.select(*keys, "k", F.col("frame").cast("bigint").alias("n"), "re", "im").join(ends, keys)
    over_time = checkpointed(fourier(rows, [*keys, "k"])).select(*keys, F.col("m").alias("frames"), F.col("n").alias("t"), F.lit(channels).cast("bigint").alias("m"), F.col("k").cast("bigint").alias("n"), "re", "im")
    return checkpointed(fourier(over_time, [*keys, "frames", "t"])).select(*keys, "frames", "t", F.col("n").alias("f"), "re", "im")


def inverse_plane(bins: DataFrame, keys: list[str], channels: int) -> DataFrame:
    """``*keys, frame, k, x``: the real part of the inverse of ``plane``."""
    rows = bins.select(*keys, "frames", "t", F.lit(channels).cast("bigint").alias("m"), F.col("f").alias("n"), "re", "im")
    over_frequency = checkpointed(inverse_fourier(rows, [*keys, "frames", "t"])).select(*keys, F.col("frames").alias("m"), F.col("t").alias("n"), F.col("n").cast("int").alias("k"), "re", "im")
    return inverse_fourier(over_frequency, [*keys, "k"]).select(*keys, F.col("n").alias("frame"), "k", F.col("re").alias("x"))


def direction(k: Column, n: Column) -> Column:
    """The sign of a bin's frequency; of zero and of the middle bin, zero."""
    return F.when((k == 0) | (2 * k == n), 0).when(2 * k < n, 1).otherwise(-1)


def responses(lengths_: DataFrame, s: Filters) -> DataFrame:
    """``frames, filter, t, f, hre, him``: the filters' transfer functions for planes of so many frames (``lengths_``: distinct ``m``)."""
    rates = sorted({abs(r) for r, _, _ in s.each if r is not None})
    table = []
    for number, (rate, scale, sign) in enumerate(s.each):
        h = np.ones(s.channels) if scale is None else spectral_filter(scale, s.channels, s.per_octave)
        directed = sign if rate is not None and scale is not None and not s.separable else 0
        table.append((number, -1 if rate is None else rates.index(abs(rate)), directed, h.tolist()))
    spark = lengths_.sparkSession
    each = F.broadcast(spark.createDataFrame(table, "filter int, rate int, directed int, h array<double>"))
    places = lengths_.select("m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / 4096))).alias("b"))
    flat = places.select("m", F.explode(F.sequence(F.col("b") * 4096, F.least(F.col("m"), (F.col("b") + 1) * 4096) - 1)).alias("n"))
    over_time = flat.select("m", F.lit(-1).alias("rate"), "n", F.lit(1.0).alias("hre"), F.lit(0.0).alias("him"))
    if rates:
        over_time = over_time.unionByName(wavelet_responses(lengths_, rates, s.sr, causal=s.causal).withColumnRenamed("filter", "rate"))
    cells = over_time.join(each, "rate").select("m", "filter", "n", "hre", "him", "directed", F.posexplode("h").alias("f", "h")).where("h <> 0")
    way = direction(F.col("n"), F.col("m")) * direction(F.col("f"), F.lit(s.channels))
    kept = cells.where((F.col("directed") == 0) | (way != -F.col("directed")))
    return kept.select(F.col("m").alias("frames"), "filter", F.col("n").alias("t"), F.col("f").cast("bigint").alias("f"), (F.col("hre") * F.col("h")).alias("hre"), (F.col("him") * F.col("h")).alias("him"))


def own_lengths(cells: DataFrame) -> DataFrame:
    return cells.groupBy("stim").agg((F.max("frame") + 1).alias("m")).select("m").distinct()


def filtered(coch: DataFrame, s: Filters) -> DataFrame:
    """``stim, filter, frame, k, x``: cochleagrams through each filter, round both ends."""
    bins = plane(coch.select("stim", "frame", "k", F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im")), ["stim"], s.channels)
    h = checkpointed(responses(own_lengths(coch), s))
    passed = bins.join(h, ["frames", "t", "f"])
    re, im = F.col("re") * F.col("hre") - F.col("im") * F.col("him"), F.col("re") * F.col("him") + F.col("im") * F.col("hre")
    own = passed.select("stim", "filter", "frames", "t", "f", re.alias("re"), im.alias("im"))
    # transforms need rows for their first places, which a filter may not pass
    ids = F.array(*[F.lit(k) for k in range(len(s.each))])
    firsts = bins.where((F.col("t") * F.col("t") < 4 * F.col("frames")) | (F.col("f") * F.col("f") < 4 * s.channels)).select("stim", F.explode(ids).alias("filter"), "frames", "t", "f", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    whole = own.unionByName(firsts).groupBy("stim", "filter", "frames", "t", "f").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return inverse_plane(whole, ["stim", "filter"], s.channels)


def put_together(bands: DataFrame, s: Filters, *, cancellation: bool = False, least: float = 1e-10) -> DataFrame:
    """``stim, frame, k, x``: the cochleagram whose filtered versions are nearest to ``stim, filter, frame, k, x``; what no filter passes is zero.

    Filters overlap, and bands that were changed may cancel where they do. With ``cancellation`` the magnitude that a bin loses so is added to it.
    """
    bins = plane(bands.select("stim", "filter", "frame", "k", F.col("x").cast("double").alias("re"), F.lit(0.0).alias("im")), ["stim", "filter"], s.channels)
    h = checkpointed(responses(own_lengths(bands), s))
    both = bins.join(h, ["frames", "filter", "t", "f"], "left").fillna(0.0, ["hre", "him"])
    re, im = F.col("re") * F.col("hre") + F.col("im") * F.col("him"), F.col("im") * F.col("hre") - F.col("re") * F.col("him")
    sums = both.groupBy("stim", "frames", "t", "f").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.sum(F.hypot(re, im)).alias("size"), F.sum(F.col("hre") * F.col("hre") + F.col("him") * F.col("him")).alias("power"))
    if cancellation:
        sums = sums.withColumn("re", F.col("re") + F.col("size") - F.hypot("re", "im"))
    share = lambda c: F.when(F.col("power") > least, F.col(c) / F.col("power")).otherwise(F.lit(0.0))
    return inverse_plane(sums.select("stim", "frames", "t", "f", share("re").alias("re"), share("im").alias("im")), ["stim"], s.channels)


def matched(synth: DataFrame, orig: DataFrame, s: Filters, *, width: float, cancellation: bool = False, buffer: int = 0) -> DataFrame:
    """``stim, frame, k, x``: a cochleagram each of whose filtered versions has taken on the values of the original's, channel by channel, put together again.

    ``buffer``: frames at either end whose values aren't matched and aren't matched to.
    """
    have, want = (filtered(df, s).withColumnRenamed("frame", "n") for df in (synth, orig))
    bands = inner_matched(have, want, ["stim", "filter", "k"], width, buffer).withColumnRenamed("n", "frame")
    return put_together(bands, s, cancellation=cancellation)


def inner_matched(have: DataFrame, want: DataFrame, keys: list[str], width: float, buffer: int) -> DataFrame:
    """``*keys, n, x`` with the values of ``want`` in the order of ``have``, but for ``buffer`` places at either end."""
    if not buffer:
        return by_rank(have, want, keys, width=width)

    def inside(df: DataFrame) -> DataFrame:
        ends = df.groupBy("stim").agg((F.max("n") - buffer).alias("_last"))
        return df.join(ends, "stim").withColumn("_in", (F.col("n") >= buffer) & (F.col("n") <= F.col("_last"))).drop("_last")

    both = inside(have)
    own = by_rank(both.where("_in").drop("_in"), inside(want).where("_in").drop("_in"), keys, width=width)
    return own.unionByName(both.where("not _in").drop("_in"))


def synthesise(start: DataFrame, target: DataFrame, s: Filters, folder: str, *, iterations: int, width: float, cancellation: bool = False, buffer: int = 0) -> DataFrame:
    """``stim, frame, k, x``: ``start`` after so many rounds, each of which gives its filtered versions and then its channels the target's values.

    ``buffer`` (frames) takes the place of padding in time: the ends, where filters wrap round, are left out of matching. Each round is Parquet below
    ``folder``; a later call with the same settings and inputs goes on from the last whole one, another has a folder of its own.
    """
    spark = start.sparkSession
    marks = [str(df.agg(F.sum(F.xxhash64("stim", "frame", "k", "x").cast("decimal(38,0)"))).first()[0]) for df in (start, target)]
    where = f"{folder}/{hashlib.sha256(json.dumps([str(s), width, cancellation, buffer, *marks]).encode()).hexdigest()[:16]}"
    done = next((k for k in range(iterations, 0, -1) if is_whole(spark, f"{where}/round={k}")), 0)
    now = spark.read.parquet(f"{where}/round={done}") if done else start.select("stim", "frame", "k", F.col("x").cast("double").alias("x"))
    want = target.select("stim", F.col("frame").alias("n"), "k", F.col("x").cast("double").alias("x"))
    for k in range(done + 1, iterations + 1):
        bands = matched(now, target, s, width=width, cancellation=cancellation, buffer=buffer).withColumnRenamed("frame", "n")
        inner_matched(bands, want, ["stim", "k"], width, buffer).select("stim", F.col("n").alias("frame"), "k", "x").write.mode("overwrite").parquet(f"{where}/round={k}")
        now = spark.read.parquet(f"{where}/round={k}")
    return now
