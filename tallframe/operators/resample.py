"""Rates and gaps: rational resampling along any axis, and monotone cubic interpolation, both as joins and sums over tall tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallframe.operators.order import with_neighbours

#: Zero crossings of the filter on either side, and most rows of its taps that are broadcast.
CROSSINGS, FEW = 16, 1 << 18
#: Most places of a signal that is resampled as one row, most phases of its outputs, and weights that a task keeps.
SHORT, MOST_UP, KEPT = 512, 8, 1 << 21


def taps(up: int, down: int) -> list[tuple[int, int, int, float]]:
    """``residue, phase, shift, w`` of a windowed sinc that resamples by up / down: output ``up * b + phase`` is the sum of w times the samples ``down * b + shift``.

    The weights of a phase sum to one. ``residue`` is ``shift`` modulo ``down``: a sample meets the taps of its own.
    """
    cut = min(1.0, up / down)
    reach = math.ceil(CROSSINGS / cut)
    out = []
    for phase in range(up):
        base = phase * down // up
        own = []
        for o in range(-reach, reach + 1):
            u = ((phase * down) % up / up - o) * cut
            if abs(u) < CROSSINGS:
                own.append((base + o, (math.sin(math.pi * u) / (math.pi * u) if u else 1.0) * math.cos(math.pi * u / (2 * CROSSINGS)) ** 2))
        total = sum(w for _, w in own)
        out += [(shift % down, phase, shift, w / total) for shift, w in own]
    return out


def resampled(df: DataFrame, up: int, down: int, *, axis: str = "n", keys: list[str] = ["stim"], x: str = "x", longest: int | None = None) -> DataFrame:  # noqa: B006
    """``*keys, axis, x`` at up / down times the rate along ``axis``, whose places are numbered from 0; every other axis is a key.

    A group of m places gets ``floor(m * up / down + 1/2)``. Beyond its ends the first and the last value hold; missing samples (no row,
    null) are zero, so gaps are to be filled first. A sample is joined with the taps of its residue, each product belongs to
    one output, and products are summed where they are made before a shuffle: nothing gathers a signal. Where the caller knows that none
    has more than ``longest`` places and that is at most ``SHORT``, its samples are a row, and they alone are shuffled.
    """
    if up < 1 or down < 1:
        raise ValueError("rates must be positive")
    up, down = up // math.gcd(up, down), down // math.gcd(up, down)
    spark = df.sparkSession
    table = taps(up, down)
    if longest is not None and longest <= SHORT and up <= MOST_UP:
        return short_resampled(df, up, down, table, axis, keys, x)
    reach = math.ceil(CROSSINGS / min(1.0, up / down)) + 1
    small = spark.createDataFrame(table, "residue int, phase bigint, shift bigint, w double")
    small = F.broadcast(small) if len(table) <= FEW else small
    own = df.select(*keys, F.col(axis).cast("bigint").alias("n"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"))
    ends = own.groupBy(*keys).agg((F.max("n") + 1).alias("m"), F.min_by("x", "n").alias("first"), F.max_by("x", "n").alias("last"))
    places = F.expr(f"transform(sequence(1, {reach}), k -> CAST(k AS BIGINT))")
    sides = F.array(*[F.struct(sign.alias("n"), v.alias("x")) for sign, v in ((F.lit(True), F.col("first")), (F.lit(False), F.col("last")))])
    pads = ends.select(*keys, "m", F.explode(sides).alias("e")).select(*keys, "m", "e", F.explode(places).alias("k"))
    pads = pads.select(*keys, F.when(F.col("e.n"), -F.col("k")).otherwise(F.col("m") + F.col("k") - 1).alias("n"), F.col("e.x").alias("x"))
    met = own.unionByName(pads).withColumn("residue", F.pmod("n", F.lit(down)).cast("int")).join(small, "residue")
    place = F.lit(up) * F.floor((F.col("n") - F.col("shift")) / down) + F.col("phase")
    sums = met.select(*keys, place.cast("bigint").alias("_place"), (F.col("x") * F.col("w")).alias("_y")).where("_place >= 0").groupBy(*keys, "_place").agg(F.sum("_y").alias(x))
    out = sums.join(ends.select(*keys, F.floor(F.col("m") * up / down + 0.5).alias("_points")), keys).where("_place < _points")
    return out.select(*keys, F.col("_place").alias(axis), x)


def short_resampled(df: DataFrame, up: int, down: int, table: list[tuple[int, int, int, float]], axis: str, keys: list[str], x: str) -> DataFrame:
    """``resampled`` for signals of at most ``SHORT`` places: a matrix for each length."""
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField(axis, T.LongType()), T.StructField(x, T.DoubleType())])
    out_schema = to_arrow_schema(schema)
    own = df.select(*keys, F.col(axis).cast("bigint").alias("n"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("x"))
    rows = own.groupBy(*keys).agg(F.collect_list(F.struct("n", "x")).alias("v"), F.max("n").alias("last"), F.min_by("x", "n").alias("first"))
    phases = [(np.array([s for _, p, s, _ in table if p == phase]), np.array([w for _, p, _, w in table if p == phase])) for phase in range(up)]

    def weights(m: int) -> np.ndarray:
        """Of each place for each output; a last column is for what lies before the first."""
        points = math.floor(m * up / down + 0.5)
        out = np.zeros((points, m + 1))
        for k in range(points):
            shift, w = phases[k % up]
            at = down * (k // up) + shift
            np.add.at(out[k], np.where(at < 0, m, np.minimum(at, m - 1)), w)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("last").to_numpy() + 1
            for m in np.unique(lengths).tolist():
                if m > SHORT:
                    raise ValueError(f"a signal of {m} places is longer than was stated")
                chosen = np.nonzero(lengths == m)[0]
                if m not in known:
                    if sum(w.size for w in known.values()) > KEPT:
                        known.clear()
                    known[m] = weights(m)
                some = max(1, (1 << 18) // (m + 1))
                for k in range(0, len(chosen), some):
                    part = batch.take(pa.array(chosen[k : k + some]))
                    lists, flat = part.column("v"), part.column("v").flatten()
                    spot = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())) * (m + 1) + flat.field("n").to_numpy()
                    wide = np.bincount(spot, flat.field("x").to_numpy(), part.num_rows * (m + 1)).reshape(part.num_rows, m + 1)
                    wide[:, m] = part.column("first").to_numpy()
                    found = wide @ known[m].T
                    which = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1]))
                    arrays = [*(part.column(c).take(which) for c in keys), pa.array(np.tile(np.arange(found.shape[1]), part.num_rows)), pa.array(found.reshape(-1))]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out_schema, strict=True)], schema=out_schema)

    return rows.mapInArrow(run, schema)


def inner_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """The slope at a point between pieces of widths h and slopes d: their weighted harmonic mean, zero where they don't agree in sign."""
    a, b = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 > 0, F.try_divide(a + b, F.try_divide(a, d0) + F.try_divide(b, d1))).otherwise(F.lit(0.0))


def end_slope(h0: Column, d0: Column, h1: Column, d1: Column) -> Column:
    """The slope at an end whose own piece is h0, d0: of the parabola through three points, held to the piece's sign and to three times its slope."""
    e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(e) != F.signum(d0), F.lit(0.0)).when((F.signum(d0) != F.signum(d1)) & (F.abs(e) > 3 * F.abs(d0)), 3 * d0).otherwise(e)


def pchip(points: DataFrame, keys: list[str], at: str, x: str, *, start: float = 0.0, step: float = 1.0, bucket: Column | None, limits: DataFrame | None = None, targets: list[float] | None = None) -> DataFrame:
    """``*keys, k, x``: monotone cubic interpolation of points at ``at`` (distinct in a group) on the grid ``start + k * step``, or at few ``targets``, numbered k.

    Nulls and NaN aren't points. Each piece between neighbours fills its own part of the grid from the slopes at its ends, which need one point
    more on either side. The grid goes from the first to the last point or, with ``limits`` (``*keys, low, high`` in numbers k, a row a
    group), from low to high, where the end pieces carry on. They do so to targets, too. Of one point alone the value holds over the limits, or at all targets.
    ``at`` must rise with ``bucket``; without one (None), a group must be few points, which are sorted together.
    """
    known = points.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*keys, F.col(at).cast("double").alias("p"), F.col(x).cast("double").alias("y"), *([] if bucket is None else [bucket.alias("_own")]))
    if bucket is None:
        order = Window.partitionBy(*keys).orderBy("p")
        near = [("before1", F.lag, 1), ("after1", F.lead, 1), ("after2", F.lead, 2)]
        rows = known.select("*", *[move(c, k).over(order).alias(f"{name}_{c}") for name, move, k in near for c in ("p", "y")])
    else:
        rows = with_neighbours(known, keys, F.col("_own"), ["p"], ["p", "y"], back=1, ahead=2).drop("_own")
    p, q = F.col("p"), F.col("after1_p")
    h = {-1: p - F.col("before1_p"), 0: q - p, 1: F.col("after2_p") - q}
    d = {-1: (F.col("y") - F.col("before1_y")) / h[-1], 0: (F.col("after1_y") - F.col("y")) / h[0], 1: (F.col("after2_y") - F.col("after1_y")) / h[1]}
    no_back, no_ahead = F.col("before1_p").isNull(), F.col("after2_p").isNull()
    left = F.when(no_back & no_ahead, d[0]).when(no_back, end_slope(h[0], d[0], h[1], d[1])).otherwise(inner_slope(h[-1], d[-1], h[0], d[0]))
    right = F.when(no_back & no_ahead, d[0]).when(no_ahead, end_slope(h[0], d[0], h[-1], d[-1])).otherwise(inner_slope(h[0], d[0], h[1], d[1]))
    alone = no_back & q.isNull()
    slopes = {"h": h[0], "a": left, "b": right}
    if targets is not None:
        spots = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(float(v)).alias("at")) for k, v in enumerate(targets)])
        mine = F.filter(spots, lambda s: alone | (q.isNotNull() & (no_back | (s["at"] >= p)) & (no_ahead | (s["at"] < q))))
        out = rows.select(*keys, "p", "y", "after1_y", *[c.alias(name) for name, c in slopes.items()], F.explode(mine).alias("s"))
        return out.select(*keys, "s.k", piece_value(F.col("s.at") - p).alias(x))
    first, last = F.ceil((p - start) / step), F.when(q.isNull(), F.floor((p - start) / step)).otherwise(F.ceil((q - start) / step) - 1)
    if limits is not None:
        rows = rows.join(limits.select(*keys, "low", "high"), keys)
        first = F.when(no_back, F.col("low")).otherwise(first)
        last = F.when(alone | (q.isNotNull() & no_ahead), F.col("high")).when(q.isNull(), first - 1).otherwise(last)
    pieces = rows.select(*keys, "p", "y", "after1_y", *[c.alias(name) for name, c in slopes.items()], first.cast("bigint").alias("first"), last.cast("bigint").alias("last")).where("first <= last")
    out = pieces.withColumn("k", F.explode(F.sequence("first", "last")))
    return out.select(*keys, "k", piece_value(F.col("k") * F.lit(float(step)) + F.lit(float(start)) - p).alias(x))


def piece_value(beyond: Column) -> Column:
    """The cubic of a piece ``y, after1_y, h, a, b`` so far behind its first point; of a point alone its value."""
    h, t = F.col("h"), beyond / F.col("h")
    value = F.col("y") * (1 + 2 * t) * (1 - t) * (1 - t) + h * F.col("a") * t * (1 - t) * (1 - t) + F.col("after1_y") * t * t * (3 - 2 * t) + h * F.col("b") * t * t * (t - 1)
    return F.when(h.isNull(), F.col("y")).otherwise(value)
