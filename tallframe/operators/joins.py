"""Lookups between tables: exactly one match, existence, tolerance, nearest element, intervals and grids of parameters."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallframe.functions.columns import expanded


#: Elements of labels' vectors up to which they are broadcast.
CELLS = 1 << 21


def exactly_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Joins each row with its one row on the right; a key with none or several raises an error."""
    counted = right.groupBy(on).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in right.columns if c != on])).alias("_r"))
    out = left.join(counted, on, "left")
    fault = F.raise_error(F.concat(F.lit(f"not one row for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(fault)
    return out.withColumn("_r", checked).select(*left.columns, "_r.*")


def within(left: DataFrame, right: DataFrame, x: str, y: str, tolerance: float) -> DataFrame:
    """The rows on the left whose ``x`` is less than ``tolerance`` from some ``y``: an equi-join on cells of that width and their neighbours."""
    cell = F.floor(F.col(y) / tolerance)
    near = right.select(F.col(y).alias("_y"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell")).distinct()
    own = left.withColumn("_cell", F.floor(F.col(x) / tolerance))
    hit = (own["_cell"] == near["_cell"]) & (F.abs(own[x] - near["_y"]) < tolerance)
    return own.join(near, hit, "left_semi").drop("_cell")


def nearest(queries: DataFrame, targets: DataFrame, x: str, y: str, number: str, *, bucket_rows: int = 100_000) -> DataFrame:
    """For each ``x``, the ``y`` and ``number`` of the nearest target (the least number, if several are); null where x is null or there are no targets.

    Distinct values of both sides stand in one order, cut into buckets of about ``bucket_rows``. In a bucket the last target before and the first
    behind a value are taken; only buckets' first and last targets are ordered across buckets. Rows find their value's answer by an equi-join.
    """
    ys = targets.where(F.col(y).isNotNull()).groupBy(F.col(y).cast("double").alias("_v")).agg(F.min(F.struct(F.col(number), F.col(y))).alias("_t"))
    xs = queries.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_v")).distinct().withColumn("_q", F.lit(True))
    both = ys.join(xs, "_v", "full")
    count = both.count()
    cuts = max(0, count // bucket_rows)
    if cuts:
        found = both.agg(F.percentile_approx("_v", [k / (cuts + 1) for k in range(1, cuts + 1)], 20 * cuts + 1000)).first()[0]
        edges = F.array(*[F.lit(float(v)) for v in found])
        both = both.withColumn("_bucket", F.size(F.filter(edges, lambda e: e < F.col("_v"))))
    else:
        both = both.withColumn("_bucket", F.lit(0))
    target = F.when(F.col("_t").isNotNull(), F.struct("_v", F.col(f"_t.{number}").alias("i"), F.col(f"_t.{y}").alias("y")))
    both = both.withColumn("_t", target)
    ends = both.groupBy("_bucket").agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col("_v"))).alias("_first"), F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("_v"))).alias("_last"))
    up, down = (Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1) for b in (F.asc("_bucket"), F.desc("_bucket")))
    ends = ends.select("_bucket", F.last("_last", ignorenulls=True).over(up).alias("_low"), F.last("_first", ignorenulls=True).over(down).alias("_high"))  # a row a bucket
    # both frames end at the row and grow by it; one that begins there is counted anew for each row
    so_far = [Window.partitionBy("_bucket").orderBy(v).rowsBetween(Window.unboundedPreceding, 0) for v in (F.asc("_v"), F.desc("_v"))]
    before, behind = (F.coalesce(F.last("_t", ignorenulls=True).over(w), F.col(end)) for w, end in zip(so_far, ("_low", "_high"), strict=True))
    sided = both.join(ends, "_bucket").select("_v", "_q", before.alias("_a"), behind.alias("_b")).where("_q")
    near = F.array_min(F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}._v") - F.col("_v")).alias("d"), F.col(f"{c}.i").alias("i"), F.col(f"{c}.y").alias("y"))) for c in ("_a", "_b")]), lambda t: t.isNotNull()))
    answers = sided.select("_v", near.alias("_near"))
    return queries.join(answers, F.col(x).cast("double") == F.col("_v"), "left").select(*queries.columns, F.col("_near.y").alias("nearest"), F.col("_near.i").alias("nearest_number"))


def value_grid(most: int = 1_000_000, **columns: DataFrame) -> DataFrame:
    """All combinations of the distinct values of one-column tables, which must be few: more than ``most`` combinations raise an error."""
    grids = {name: df.toDF(name).where(F.col(name).isNotNull()).distinct() for name, df in columns.items()}
    if math.prod(g.count() for g in grids.values()) > most:
        raise ValueError(f"more than {most} combinations")
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), grids.values())


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few parameters' values."""
    grid = spark.range(1)
    for name, own in values.items():
        kinds = "bigint" if all(isinstance(v, int) for v in own) else "double" if all(isinstance(v, (int, float)) for v in own) else "string"
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kinds) for v in own])))
    return grid.drop("id")


def occupied(intervals: DataFrame, rate: float, *, onset_only: bool = False) -> DataFrame:
    """``stim, frame, label``: the frames from ``bround(onset * rate)`` up to ``bround(offset * rate)``, one at least; or that of the onset alone.

    Each interval makes its own frames, so no range is joined; frames that several intervals share appear once.
    """
    start = F.bround(F.col("onset") * rate).cast("bigint")
    if onset_only:
        return intervals.select("stim", start.alias("frame"), "label").distinct()
    end = F.greatest(start, F.bround(F.col("offset") * rate).cast("bigint") - 1)
    return intervals.select("stim", F.explode(F.sequence(start, end)).alias("frame"), "label").distinct()


def one_hot(cells: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each frame with a column of 0 or 1 for each label of a stated vocabulary; other labels give no column."""
    hits = [F.max((F.col("label") == k).cast("int")).alias(k) for k in labels]
    return cells.groupBy("stim", "frame").agg(*hits)


def embedded(intervals: DataFrame, vectors: DataFrame, rate: float, *, contractions: bool = False) -> DataFrame:
    """``stim, frame, k, x``: the mean vector of the words that sound in each frame, of equal intervals each.

    A label of several words (at spaces or hyphens; with ``contractions``, of the words these stand for, in lower case) has the mean of its
    words' vectors; words without one count for nothing.
    """
    label = expanded(F.col("label")) if contractions else F.col("label")
    words = intervals.select("label").distinct().select("label", F.explode(F.split(label, "[ -]+")).alias("word"))
    found = words.join(vectors.select(F.col("label").alias("word"), "v"), "word").select("label", F.posexplode("v").alias("k", "x"))
    means = found.groupBy("label", "k").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    if (means.agg(F.sum(F.size("v"))).first()[0] or 0) <= CELLS:
        means = F.broadcast(means)
    start = F.bround(F.col("onset") * rate).cast("bigint")
    end = F.greatest(start, F.bround(F.col("offset") * rate).cast("bigint") - 1)
    # frames are dealt out once, by themselves: labels are counted, vectors met and added up where they are
    flat = intervals.select("stim", F.explode(F.sequence(start, end)).alias("frame"), "label").repartition("stim", "frame")
    counted = flat.groupBy("stim", "frame", "label").agg(F.count("*").alias("many"))
    met = counted.join(means, "label").select("stim", "frame", "many", F.inline("v"))
    return met.groupBy("stim", "frame", "k").agg((F.sum(F.col("many") * F.col("x")) / F.sum("many")).alias("x"))
