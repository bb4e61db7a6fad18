"""Shapes of features: axes are index columns, so a reshape is arithmetic on them and moves no values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Time of the first output (s) and output rate (Hz) of each layer of three networks.
LAYERS = {
    "ast": ([0.01246875] + [0.08746875] * 13, [100.0] + [10.0] * 13),
    "cochdnn": ([0.025, 0.0325, 0.0475, 0.0475, 0.0475, 0.0475], [200.0, 200 / 3, 50 / 3, 25 / 3, 25 / 3, 25 / 3]),
    "cochresnet": ([0.025] * 6, [200.0, 100.0, 50.0, 25.0, 25 / 2, 25 / 4]),
}


def layers(spark: SparkSession, network: str) -> DataFrame:
    """``layer, t0, sr`` of a network."""
    return spark.createDataFrame([(k, t, r) for k, (t, r) in enumerate(zip(*LAYERS[network], strict=True))], "layer int, t0 double, sr double")


#: Sizes and strides of the convolutions that a speech network begins with, and its sampling rate.
SPEECH = ((10, 3, 3, 3, 3, 2, 2), (5, 2, 2, 2, 2, 2, 2), 16_000.0)


def layer_frames(stimuli: DataFrame, sizes: tuple[int, ...], strides: tuple[int, ...], sr: float, *, length: str = "length") -> DataFrame:
    """Adds ``layer, frames, t0, sr`` to each stimulus: how many outputs each layer of a stack of convolutions has, the time of the first and their rate.

    An output stands at the middle of what it sees. A stimulus that is shorter than that has no outputs in the layer and those above it.
    """
    left, start, made = F.col(length).cast("bigint"), 0.0, []
    for k, (size, stride) in enumerate(zip(sizes, strides, strict=True)):
        start, sr = start + (size - 1) / (2 * sr), sr / stride
        left = F.greatest(F.lit(0).cast("bigint"), F.floor((left - size) / stride) + 1)
        made.append(F.struct(F.lit(k).alias("layer"), left.alias("frames"), F.lit(start).alias("t0"), F.lit(sr).alias("sr")))
    return stimuli.withColumn("_l", F.explode(F.array(*made))).select(*stimuli.columns, "_l.*")


def flattened(df: DataFrame, axes: list[tuple[str, int]], *, name: str = "feature", order: str = "C") -> DataFrame:
    """The index columns ``axes`` (with their sizes) as one, the last running fastest (``C``) or the first (``F``)."""
    run = axes if order == "C" else axes[::-1]
    place = reduce(lambda at, a: at * a[1] + F.col(a[0]).cast("bigint"), run, F.lit(0).cast("bigint"))
    return df.withColumn(name, place).drop(*[a for a, _ in axes if a != name])


def unflattened(df: DataFrame, axes: list[tuple[str, int]], *, name: str = "feature", order: str = "C") -> DataFrame:
    """The opposite of ``flattened``."""
    left: Column = F.col(name)
    out = df
    for a, size in axes[::-1] if order == "C" else axes:
        out = out.withColumn(a, F.pmod(left, F.lit(size)))
        left = F.floor(left / size)
    return out.drop(name)


def all_but_last(df: DataFrame, axes: list[tuple[str, int]], *, name: str = "feature") -> DataFrame:
    """All axes but the last as one, the first running fastest."""
    return flattened(df, axes[:-1], name=name, order="F")


def expanded(df: DataFrame, *axes: str) -> DataFrame:
    """Adds axes of one place."""
    return df.withColumns({a: F.lit(0) for a in axes})


def squeezed(df: DataFrame, axis: str) -> DataFrame:
    """Leaves out an axis of one place; a second place raises an error where it is met."""
    one = F.when(F.col(axis) == 0, F.lit(0)).otherwise(F.raise_error(F.lit(f"axis {axis} has more than one place")))
    return df.where(one == 0).drop(axis)


def token_rows(tokens: DataFrame, *, skip: int = 2, bands: int = 12, steps: int = 101) -> DataFrame:
    """``stim, frame, v`` from the tokens ``stim, token, v`` of a grid of bands by steps after ``skip`` others: a step's bands, one after the other."""
    place = F.col("token") - skip
    rows = tokens.where((place >= 0) & (place < bands * steps)).select("stim", F.pmod(place, F.lit(steps)).alias("frame"), F.floor(place / steps).alias("band"), "v")
    listed = F.sort_array(F.collect_list(F.struct("band", "v")))  # as many as there are bands
    return rows.groupBy("stim", "frame").agg(F.flatten(F.transform(listed, lambda s: s["v"])).alias("v"))


def map_rows(maps: DataFrame, channels: int, frequencies: int) -> DataFrame:
    """``stim, frame, feature, x`` from the activations ``stim, c, f, t, x`` of a convolution."""
    return flattened(maps, [("c", channels), ("f", frequencies)]).withColumnRenamed("t", "frame")


def truncated(df: DataFrame, n: int, frame: str = "frame") -> DataFrame:
    """The first n frames."""
    return df.where(F.col(frame) < n)


def sizes(features: DataFrame) -> DataFrame:
    """``stim, frames, features`` of array features."""
    return features.groupBy("stim").agg((F.max("frame") + 1).alias("frames"), F.max(F.size("v")).alias("features"))


def require_equal_sizes(a: DataFrame, b: DataFrame) -> None:
    """Raises an error that names a stimulus whose sizes differ, or that one side lacks."""
    x, y = sizes(a), sizes(b).select("stim", F.col("frames").alias("f"), F.col("features").alias("v"))
    bad = x.join(y, "stim", "full").where(~(F.col("frames").eqNullSafe(F.col("f")) & F.col("features").eqNullSafe(F.col("v")))).limit(1).collect()
    if bad:
        raise ValueError(f"sizes of {bad[0].stim} differ: {bad[0].frames} x {bad[0].features} and {bad[0].f} x {bad[0].v}")


def mapped(df: DataFrame, columns: list[str], cases: dict[tuple, object], name: str) -> DataFrame:
    """Adds what the cases give for the values of the columns; rows of no case go."""
    spark = df.sparkSession
    kinds = {c: df.schema[c].dataType for c in columns}
    rows = spark.createDataFrame([(*k, v) for k, v in cases.items()], [*columns, name])
    return df.join(F.broadcast(rows.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns], name)), columns)


def named(df: DataFrame, names: DataFrame, key: str = "stim") -> DataFrame:
    """Features with their names: by key, never by position."""
    return df.join(names, key)


def constraint_name(sound: str, constraints: dict[str, int], *, average: str | None = None, weight: float | None = None) -> str:
    """The name of a synthesised sound: the sound's, or the average's, and a digit for each constraint in order."""
    digits = "_" + "".join(str(int(v)) for v in constraints.values())
    if average is None:
        return sound.removesuffix(".wav") + digits
    return f"AVG_{average}{digits}" if weight is None else f"MORPH_{average}_{weight:g}{digits}"
