"""Repeated measurements with missing values: a missing value is null or NaN, and aggregates leave it out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallframe.operators import grid, selection
from tallframe.operators.selection import present


def without_outliers(df: DataFrame, score: str = "score", *, x: str = "x", most: float = 0.1) -> DataFrame:
    """Values whose outlier score is above ``most`` or unknown (null, NaN) become null, and so does NaN."""
    return df.withColumn(x, F.when(F.col(score) <= most, present(x)))


def mean_of_repeats(df: DataFrame, keys: list[str], *, x: str = "x") -> DataFrame:
    """The mean of what isn't missing, and how many values that is; null where all are missing."""
    return df.groupBy(*keys).agg(F.avg(present(x)).alias(x), F.count(present(x)).alias("n_repeats"))


def median_of(df: DataFrame, keys: list[str], *, x: str = "x") -> DataFrame:
    """The exact median of what isn't missing, null where all are missing; groups may be of any size."""
    return selection.median(df, keys, x=x)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that miss none of the columns. Rows go whole, so that pairs stay pairs."""
    present: Column = F.lit(True)
    for c in columns:
        present &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(present)


def joined_runs(*runs: DataFrame) -> DataFrame:
    """Runs one after the other, with the number of each in ``run``."""
    out = runs[0].withColumn("run", F.lit(0))
    for k, r in enumerate(runs[1:], 1):
        out = out.unionByName(r.withColumn("run", F.lit(k)))
    return out


def envelopes(measured: DataFrame, *, most: float = 0.1, window: tuple[int, int] | None = None, method: str = "linear") -> DataFrame:
    """``stim, n, x`` from ``stim, rep, n, x, score``: outliers out, mean over repetitions, gaps filled (linear or pchip), cut to ``window``."""
    means = mean_of_repeats(without_outliers(measured, most=most), ["stim", "n"]).select("stim", "n", "x")
    whole = grid.filled(means, method=method)
    return whole if window is None else whole.where(F.col("n").between(*window)).withColumn("n", F.col("n") - window[0])
