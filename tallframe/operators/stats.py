"""Moments, histograms, divergences, correlations and ratios, as aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallframe.functions.columns import decibels


def moments(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Mean, variance (n - 1), skewness and kurtosis (of the population, not in excess of 3)."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def weighted_moments(df: DataFrame, keys: list[str], x: str, w: str) -> DataFrame:
    """Mean, variance, ``cv`` (standard deviation over mean), skewness and kurtosis under weights, which are scaled to sum to 1."""
    means = df.groupBy(*keys).agg(F.sum(w).alias("_w"), (F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("mean"))
    d = F.col(x) - F.col("mean")
    sums = df.join(means, keys).groupBy(*keys, "mean", "_w").agg(*[F.sum(F.col(w) * F.pow(d, F.lit(k))).alias(f"_{k}") for k in (2, 3, 4)])
    m = {k: F.col(f"_{k}") / F.col("_w") for k in (2, 3, 4)}
    return sums.select(*keys, "mean", m[2].alias("var"), F.try_divide(F.sqrt(m[2]), F.col("mean")).alias("cv"), F.try_divide(m[3], F.pow(m[2], F.lit(1.5))).alias("skew"), F.try_divide(m[4], m[2] * m[2]).alias("kurt"))


def root_mean_square(x: str = "x") -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))


def scaled(df: DataFrame, keys: list[str], target: float, x: str = "x") -> DataFrame:
    """Values of each group scaled to the root mean square ``target``; silence stays."""
    rms = df.groupBy(*keys).agg(root_mean_square(x).alias("_rms"))
    return df.join(rms, keys).withColumn(x, F.coalesce(F.try_divide(F.col(x) * F.lit(float(target)), F.col("_rms")), F.col(x))).drop("_rms")


def standardised(df: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(x - mean) / standard deviation (of the population) in each group; null where that is zero."""
    own = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.join(own, keys).withColumn(x, F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def baseline_percent(df: DataFrame, electrode: str, at: Column, window: int) -> DataFrame:
    """Percent change of ``x`` against the mean over ``-window <= at < 0``, taken in each stimulus and then over stimuli."""
    own = df.where((at >= -window) & (at < 0)).groupBy(electrode, "stim").agg(F.avg("x").alias("b"))
    base = own.groupBy(electrode).agg(F.avg("b").alias("_b"))
    return df.join(base, electrode).withColumn("x", F.try_divide(100 * (F.col("x") - F.col("_b")), F.col("_b"))).drop("_b")


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The nearest of ``bins`` evenly spaced centres from low to high; values beyond fall in the first or the last."""
    step = (high - low) / F.lit(bins - 1)
    k = F.floor(F.try_divide(x - low, step) + 0.5)
    return F.coalesce(F.least(F.greatest(k, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("bigint")


def histogram(df: DataFrame, keys: list[str], bins: int, low: Column, high: Column, x: str = "x") -> DataFrame:
    """``bin, n, p`` of each group: counts and shares; empty bins have no rows."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, bin_of(F.col(x), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    return counts.join(totals, keys).withColumn("p", F.col("n") / F.col("_n")).drop("_n")


def paired_histograms(a: DataFrame, b: DataFrame, keys: list[str], bins: int, x: str = "x") -> DataFrame:
    """``bin, p, q`` of both in bins of their common range; a missing bin is 0."""
    both = a.select(*keys, x).unionByName(b.select(*keys, x))
    limits = both.groupBy(*keys).agg(F.min(x).alias("_low"), F.max(x).alias("_high"))

    def one(df: DataFrame, name: str) -> DataFrame:
        own = df.join(limits, keys)
        return histogram(own, keys, bins, F.col("_low"), F.col("_high"), x).select(*keys, "bin", F.col("p").alias(name))

    return one(a, "p").join(one(b, "q"), [*keys, "bin"], "full").fillna(0.0, ["p", "q"])


def js_divergence(a: DataFrame, b: DataFrame, keys: list[str], bins: int, epsilon: float = 1e-6, x: str = "x") -> DataFrame:
    """Jensen-Shannon divergence in bits of histograms with ``epsilon / bins`` added to each bin."""
    pairs = paired_histograms(a, b, keys, bins, x)
    add, scale = F.lit(epsilon / bins), F.lit(1 + epsilon)
    p, q = (F.col("p") + add) / scale, (F.col("q") + add) / scale
    m = (p + q) / 2
    term = (p * F.log2(p / m) + q * F.log2(q / m)) / 2  # nothing for bins that are empty in both
    return pairs.groupBy(*keys).agg(F.sum(term).alias("jsd"))


def bhattacharyya(a: DataFrame, b: DataFrame, keys: list[str], bins: int, x: str = "x") -> DataFrame:
    return paired_histograms(a, b, keys, bins, x).groupBy(*keys).agg(F.sum(F.sqrt(F.col("p") * F.col("q"))).alias("bc"))


def correlation(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson's r that skips missing values, each column centred by its own mean, and its square with its sign."""
    means = df.groupBy(*keys).agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    da, db = F.col(a) - F.col("_a"), F.col(b) - F.col("_b")
    sums = df.join(means, keys).groupBy(*keys).agg(F.sum(da * db).alias("ab"), F.sum(da * da).alias("aa"), F.sum(db * db).alias("bb"))
    r = F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb")))
    return sums.select(*keys, r.alias("r"), (F.signum(r) * r * r).alias("r2"))


def level_ratio(original: Column, other: Column) -> Column:
    """20 log10 of a value over its error; null if either is zero."""
    return F.when((original != 0) & (other != original), 20 * F.log10(F.abs(original)) - 20 * F.log10(F.abs(other - original)))


def energy_ratio(df: DataFrame, keys: list[str], target: str, other: str) -> DataFrame:
    e = F.col(target) - F.col(other)
    sums = df.groupBy(*keys).agg(F.sum(F.col(target) * F.col(target)).alias("_t"), F.sum(e * e).alias("_e"))
    return sums.select(*keys, decibels(F.try_divide(F.col("_t"), F.col("_e"))).alias("snr_db"))


def significant(bands: DataFrame, cutoff: float) -> DataFrame:
    """Which bands' variances lie within ``cutoff`` dB of the largest; ``bands`` has a row for each band."""
    top = bands.agg(F.max("var").alias("_top"))
    below = 10 * F.log10(F.try_divide(F.col("_top"), F.col("var")))
    return bands.crossJoin(F.broadcast(top)).withColumn("significant", F.coalesce(below < cutoff, F.lit(False))).drop("_top")


def whole_features(features: DataFrame, v: str = "v") -> DataFrame:
    """``v`` alone, null rows left out; a null or NaN among a row's features is an error, as it has no place in a sum of products."""
    gap = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return features.where(F.col(v).isNotNull()).select(F.when(gap, F.raise_error(F.lit("a feature is missing (null or NaN) in a row"))).otherwise(F.col(v)).alias(v))


def outer_sums(features: DataFrame, v: str = "v") -> DataFrame:
    """``i, g, s, n, width``: each task's sums of feature i's products with all features and of itself, its number of frames and of features.

    All rows must have the same number of features: a task raises an error for its own rows, ``equal_width`` for those of different tasks.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, n = None, None, 0
        for f in frames:
            widths = f[v].map(len).unique()
            if len(widths) > 1 or (total is not None and len(widths) and widths[0] != len(total)):
                raise ValueError("rows have different numbers of features")
            x = np.asarray(f[v].tolist(), np.float64)
            if len(x):
                total, sums, n = (x.T @ x, x.sum(axis=0), len(x)) if total is None else (total + x.T @ x, sums + x.sum(axis=0), n + len(x))
        if n and len(total):
            yield pd.DataFrame({"i": range(len(total)), "g": list(total), "s": sums, "n": n, "width": len(total)})

    return whole_features(features, v).mapInPandas(add, "i int, g array<double>, s double, n bigint, width int")


def equal_width() -> Column:
    """For sums grouped by feature: the number of frames, or an error if tasks had different numbers of features."""
    return F.when(F.min("width") == F.max("width"), F.sum("n")).otherwise(F.raise_error(F.lit("rows have different numbers of features")).cast("bigint"))


def covariance(features: DataFrame, v: str = "v") -> DataFrame:
    """``i, j, cov`` for i <= j of array features: one matrix of sums of products a task, added up by a shuffle of its cells.

    Rows of different sizes and missing features raise an error.
    """
    return covariance_of(outer_sums(features, v))


def covariance_of(sums: DataFrame) -> DataFrame:
    """``i, j, cov`` for i <= j of sums ``i, g, s, n, width``, in any number of rows for each feature."""
    cells = sums.select("i", F.posexplode("g").alias("j", "x")).where("i <= j").groupBy("i", "j").agg(F.sum("x").alias("x"))
    means = sums.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("a"), equal_width().alias("n"))
    both = cells.join(means, "i").join(means.select(F.col("i").alias("j"), F.col("a").alias("b")), "j")
    return both.select("i", "j", (F.col("x") / F.col("n") - F.col("a") * F.col("b")).alias("cov"))


def channel_correlation(features: DataFrame, v: str = "v") -> DataFrame:
    """``i, j, r`` for i < j: correlations between channels, from their covariances."""
    cov = covariance(features, v)
    own = cov.where("i = j").select("i", F.sqrt("cov").alias("s"))
    left = own.select("i", F.col("s").alias("si"))
    right = own.select(F.col("i").alias("j"), F.col("s").alias("sj"))
    return cov.where("i < j").join(left, "i").join(right, "j").select("i", "j", F.try_divide(F.col("cov"), F.col("si") * F.col("sj")).alias("r"))


def morph(stats: DataFrame, keys: list[str], weight: str, value: str = "value") -> DataFrame:
    """Statistics of several files as one: their weighted mean for each key."""
    return stats.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias(value))


def outward(bands: DataFrame, k: str = "k", level: str = "level") -> DataFrame:
    """The order from the loudest band outward, at each distance first the band below: adds ``position`` from 0. One row a band."""
    top = bands.agg(F.max(F.struct(F.col(level), (-F.col(k)).alias("k"))).alias("_t")).select((-F.col("_t.k")).alias("_start"))
    far = bands.crossJoin(F.broadcast(top))
    order = Window.orderBy(F.abs(F.col(k) - F.col("_start")), F.col(k) > F.col("_start"))
    return far.withColumn("position", (F.row_number().over(order) - 1).cast("bigint")).drop("_start")


def windowed(length: int, rate: int, ramp: float = 0.5) -> list[float]:
    """A measurement window of ``length`` points: the sum of raised-cosine windows of a second, without ramps at the ends, scaled to sum to 1."""
    import math

    n = max(1, length // rate)
    out = []
    for i in range(length):
        seconds = i / rate
        total = 0.0
        for k in range(n):
            low, high = k, k + 1
            rise, fall = (seconds - low + ramp / 2) / ramp, (high + ramp / 2 - seconds) / ramp
            a = 1.0 if k == 0 else min(1.0, max(0.0, rise))
            b = 1.0 if k == n - 1 else min(1.0, max(0.0, fall))
            total += (0.5 - 0.5 * math.cos(math.pi * a)) * (0.5 - 0.5 * math.cos(math.pi * b))
        out.append(total)
    s = sum(out)
    return [x / s for x in out]
