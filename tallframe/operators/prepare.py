"""Sounds and cochleagrams made ready: cut, brought to a rate and a level, padded, and cut back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallframe.operators.grid import lengths
from tallframe.operators.resample import resampled
from tallframe.operators.stats import scaled


def trimmed(samples: DataFrame, before: int, after: int) -> DataFrame:
    """``stim, n, x`` without so many samples at the beginning and the end; the numbers stay."""
    own = samples.join(lengths(samples), "stim")
    return own.where((F.col("n") >= before) & (F.col("n") < F.col("length") - after)).select("stim", "n", "x")


def formatted(samples: DataFrame, most: int, up: int, down: int, *, level: float = 0.01) -> DataFrame:
    """``stim, n, x``: at most the first ``most`` samples, at up / down times the rate, scaled to a root mean square of ``level``; silence stays."""
    return scaled(resampled(samples.where(F.col("n") < most), up, down), ["stim"], level)


def even_length(length: Column, factor: int, most: int | None = None) -> Column:
    """The longest length up to ``most`` (all, if none or longer) that is a multiple of twice ``factor``, so that envelopes at a rate so many times lower have an even length.

    A length is first made even by one sample of silence. ``most`` is rounded up where the sound is long enough, else down.
    """
    whole = length + F.pmod(length, F.lit(2))
    step = 2 * factor
    full = F.floor(whole / step) * step
    if most is None:
        return full.cast("bigint")
    above, below = -(-most // step) * step, most // step * step
    return F.when(F.lit(most) > whole, full).when(F.lit(above) > whole, F.lit(below)).otherwise(F.lit(above)).cast("bigint")


def measured_sound(samples: DataFrame, factor: int, *, most: int | None = None, level: float = 0.01) -> DataFrame:
    """``stim, n, x`` cut to ``even_length``, silence at an odd end included, scaled to a root mean square of ``level``."""
    sizes = lengths(samples).select("stim", "length", even_length(F.col("length"), factor, most).alias("_l"))
    end = sizes.where("length % 2 = 1 and _l > length").select("stim", F.col("length").alias("n"), F.lit(0.0).alias("x"))
    whole = samples.select("stim", "n", F.col("x").cast("double").alias("x")).join(sizes, "stim").where("n < _l").select("stim", "n", "x").unionByName(end)
    return scaled(whole, ["stim"], level)


def padded_plane(coch: DataFrame, frames: int, channels: int, *, value: float | None = None) -> DataFrame:
    """``stim, frame, k, x`` with so many frames before the first and channels below the lowest, of ``value`` or of the stimulus's mean.

    What was there moves up by these numbers; ``unpadded_plane`` moves it back. Pads are made from each stimulus's sizes, not from its cells.
    """
    own = coch.select("stim", (F.col("frame") + frames).cast("bigint").alias("frame"), (F.col("k") + channels).cast("int").alias("k"), F.col("x").cast("double").alias("x"))
    sizes = coch.groupBy("stim").agg((F.max("frame") + 1 + frames).alias("_t"), (F.max("k") + 1 + channels).alias("_c"), (F.avg("x") if value is None else F.lit(float(value))).alias("x"))
    parts = own
    if frames:
        early = sizes.select("stim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(frames - 1).cast("bigint"))).alias("frame"), "_c", "x")
        early = early.select("stim", "frame", F.explode(F.sequence(F.lit(0), (F.col("_c") - 1).cast("int"))).alias("k"), "x")
        parts = parts.unionByName(early)
    if channels:
        low = own.where(F.col("k") == channels).select("stim", "frame").join(sizes.select("stim", "x"), "stim")
        parts = parts.unionByName(low.select("stim", "frame", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("k"), "x"))
    return parts


def unpadded_plane(coch: DataFrame, frames: float, channels: int, *, most: float | None = None) -> DataFrame:
    """``stim, frame, k, x`` from the given frame (a fraction is rounded) and channel on, at most ``most`` frames; numbered from 0 again."""
    first = round(frames)
    own = coch.where((F.col("frame") >= first) & (F.col("k") >= channels)).withColumns({"frame": F.col("frame") - first, "k": (F.col("k") - channels).cast("int")})
    return (own if most is None else own.where(F.col("frame") < F.lit(int(most)))).select("stim", "frame", "k", "x")


def largest(df: DataFrame, keys: list[str], at: str, x: str = "x") -> DataFrame:
    """``*keys, at, x``: the largest value of each group and where it is, the least place if several; nulls and NaN aren't values."""
    value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x))
    best = df.where(value.isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col(x)).alias("x"), at)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{at}").alias(at), (-F.col("_b.x")).alias(x))


def energy(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """``*keys, energy``: the sum of squares."""
    return df.groupBy(*keys).agg(F.sum(F.col(x) * F.col(x)).alias("energy"))


def convergence(report: DataFrame, end_db: float, *, snr: str = "snr_db", **parameters: object) -> DataFrame:
    """``stim, snr_db, converged, parameters``: a row for each stimulus of a synthesis, with the least of its ratios; one without a number hasn't converged."""
    least = report.groupBy("stim").agg(F.min(F.nanvl(F.col(snr).cast("double"), F.lit(float("-inf")))).alias("snr_db"))
    settings = F.create_map(*[F.lit(v) for k, x in parameters.items() for v in (k, str(x))]) if parameters else F.create_map().cast("map<string,string>")
    return least.select("stim", "snr_db", F.coalesce(F.col("snr_db") >= end_db, F.lit(False)).alias("converged"), settings.alias("parameters"))
