"""Exact order statistics of groups of any size: each round one histogram narrows the range that holds the wanted rank."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallframe.session import checkpointed

#: Values of a group that are sorted together at last, and bins of a round.
FEW, BINS = 4096, 1024


def present(x: Column | str) -> Column:
    """The value, or null for NaN."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x.cast("double")), x)


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys whose nulls are equal; ``b``'s keys go."""
    other = b.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, on, how).drop(*[f"_{k}" for k in keys])


def bin_in(x: Column, low: Column, high: Column, bins: int) -> Column:
    """The value's bin between two finite or infinite ends; the lower end is in the first, the upper in the last."""
    top = F.lit(sys.float_info.max)
    a, b, v = (F.least(F.greatest(c, -top), top) / 2 for c in (low, high, x))
    share = F.try_divide(v - a, b - a)
    return F.when(share.isNull(), F.when(x > low, bins - 1).otherwise(0)).when(x >= high, bins - 1).when(x <= low, 0).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int")


def median(df: DataFrame, keys: list[str], *, x: str = "x", few: int = FEW, bins: int = BINS) -> DataFrame:
    """``*keys, x``: the exact median (of an even number the mean of the middle two) of what is neither null nor NaN; null where nothing is.

    A group's range is cut into bins, whose counts combine before the shuffle; the bin that holds the middle rank is the next range, from its own least
    to its own greatest value. Once ``few`` values are left, or all are equal, they are sorted. No task sees a group; rounds end, as each leaves at
    least one distinct value out. Null keys are groups.
    """
    rows = df.select(*keys, present(F.col(x).cast("double")).alias("_x")).where("_x is not null")
    whole = df.groupBy(*keys).agg(F.lit(0).alias("_one"))
    start = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    state = start.select(*keys, F.explode(ranks).alias("_rank"), "_low", "_high", F.lit(0).cast("bigint").alias("_below"), "_n")
    wide = (F.col("_n") > few) & (F.col("_low") < F.col("_high"))
    inside = F.col("_x").between(F.col("_low"), F.col("_high"))
    while not state.where(wide).isEmpty():
        state = checkpointed(state)
        met = same(rows, state.where(wide), keys).where(inside)
        counts = met.groupBy(*keys, "_rank", "_below", bin_in(F.col("_x"), F.col("_low"), F.col("_high"), bins).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        before = F.sum("_n").over(Window.partitionBy(*keys, "_rank").orderBy("_bin")) - F.col("_n") + F.col("_below")
        narrowed = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_n")))
        state = state.where(~wide).unionByName(narrowed.select(*keys, "_rank", "_low", "_high", F.col("_before").alias("_below"), "_n"))
        state = checkpointed(state)
    equal = state.where("_low = _high").select(*keys, F.col("_low").alias("_x"))
    left = same(rows, state.where("_low < _high"), keys).where(inside)
    order = F.row_number().over(Window.partitionBy(*keys, "_rank").orderBy("_x")) - 1 + F.col("_below")
    found = left.withColumn("_at", order).where("_at = _rank").select(*keys, "_x").unionByName(equal)
    means = found.groupBy(*keys).agg(F.avg("_x").alias("_x"))
    return same(whole, means, keys, "left").select(*keys, F.col("_x").alias(x))
