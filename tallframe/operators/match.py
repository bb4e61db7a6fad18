"""Matching one signal's distribution to another's: by rank, by mean and variance, by cumulative distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallframe.operators.order import ranked
from tallframe.operators.stats import bin_of


def by_rank(synth: DataFrame, orig: DataFrame, keys: list[str], *, width: float, order: str = "n") -> DataFrame:
    """The i-th smallest value of ``synth`` becomes the i-th smallest of ``orig``, in each group; ties go by ``order``.

    Both are ranked in ranges of values of the given width, so a channel of any size is spread. Ranks that ``orig`` lacks keep their value.
    """

    def ranks(df: DataFrame) -> DataFrame:
        return ranked(df, keys, F.floor(F.col("x") / width), ["x", order], "rank")

    target = ranks(orig).select(*keys, "rank", F.col("x").alias("_to"))
    out = ranks(synth).join(target, [*keys, "rank"], "left")
    return out.withColumn("x", F.coalesce("_to", "x")).drop("_to", "rank")


def by_rank_in_segments(synth: DataFrame, orig: DataFrame, keys: list[str], length: int, *, width: float) -> DataFrame:
    """As ``by_rank``, in segments of ``length`` samples; the last may be shorter."""
    cut = F.floor(F.col("n") / length).alias("segment")
    return by_rank(synth.select("*", cut), orig.select("*", cut), [*keys, "segment"], width=width)


def by_mean_and_variance(synth: DataFrame, orig: DataFrame, keys: list[str]) -> DataFrame:
    """Values moved and scaled to the mean and standard deviation (n - 1) of ``orig``; a standard deviation of zero counts as one."""
    spread = F.coalesce(F.nullif(F.stddev_samp("x"), F.lit(0.0)), F.lit(1.0))
    own = synth.groupBy(*keys).agg(F.avg("x").alias("_m"), spread.alias("_s"))
    to = orig.groupBy(*keys).agg(F.avg("x").alias("_om"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("_os"))
    out = synth.join(own, keys).join(to, keys)
    return out.withColumn("x", (F.col("x") - F.col("_m")) / F.col("_s") * F.col("_os") + F.col("_om")).drop("_m", "_s", "_om", "_os")


def by_distribution(df: DataFrame, keys: list[str], target: list[tuple[float, float]], bins: int) -> DataFrame:
    """Values mapped so that their histogram becomes ``target``, pairs of rising bin edges' values and the cumulative share there.

    A value's share is the cumulative histogram of its group in ``bins`` bins, linear within a bin; the target's inverse is linear between its points.
    """
    limits = df.groupBy(*keys).agg(F.min("x").alias("_low"), F.max("x").alias("_high"))
    own = df.join(limits, keys).withColumn("_bin", bin_of(F.col("x"), F.col("_low"), F.col("_high"), bins))
    counts = own.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_bin")
    shares = counts.select(*keys, "_bin", "_n", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_all"))
    step = (F.col("_high") - F.col("_low")) / F.lit(bins - 1)
    inside = F.least(F.greatest(F.coalesce(F.try_divide(F.col("x") - F.col("_low"), step) - F.col("_bin") + 0.5, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    placed = own.join(shares, [*keys, "_bin"]).withColumn("_share", (F.col("_before") + inside * F.col("_n")) / F.col("_all"))
    value = F.lit(float(target[-1][0]))
    for (x0, c0), (x1, c1) in reversed(list(zip(target, target[1:], strict=False))):
        if c1 > c0:
            value = F.when(F.col("_share") <= c1, F.lit(float(x0)) + (F.col("_share") - F.lit(float(c0))) * F.lit((x1 - x0) / (c1 - c0))).otherwise(value)
    return placed.withColumn("x", value).drop("_low", "_high", "_bin", "_n", "_before", "_all", "_share")
