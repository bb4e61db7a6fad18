"""Order within groups without gathering a group: rows are ordered in buckets, and buckets by their counts.

A bucket is a range of the order (a day, a range of values), so one group of any size is spread over
as many tasks as it has buckets; only a count or an edge row of each bucket is ordered across buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """Numbers the rows of each group from 0 in ``order``, which must rise with ``bucket``."""
    binned = df.withColumn("_bucket", bucket)
    counts = binned.groupBy(*keys, "_bucket").agg(F.count("*").alias("_m"))
    before = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_m")
    starts = counts.select(*keys, "_bucket", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    return binned.withColumn("_own", own).join(starts, [*keys, "_bucket"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_bucket", "_own", "_before")


def with_next(df: DataFrame, keys: list[str], bucket: Column, order: list[str], columns: list[str], prefix: str = "next_", parts: int | None = None) -> DataFrame:
    """Adds columns of the following row of the group, null in the last; ``order`` must rise with ``bucket``.

    Buckets are dealt to so many ``parts`` where the caller knows how many keep a task small; else Spark's settings say how many.
    """
    binned = df.withColumn("_bucket", bucket)
    if parts:
        binned = binned.repartition(parts, *keys, "_bucket")
    heads = binned.groupBy(*keys, "_bucket").agg(F.min(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in columns])).alias("_head"))
    heads = heads.select(*keys, "_bucket", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_after"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    out = binned.withColumn("_last", F.lead(F.lit(1)).over(inside).isNull())
    for c in columns:
        out = out.withColumn(f"_n_{c}", F.lead(c).over(inside))
    out = out.join(heads, [*keys, "_bucket"])
    for c in columns:
        out = out.withColumn(prefix + c, F.when(F.col("_last"), F.col("_after")[f"_{c}"]).otherwise(F.col(f"_n_{c}")))
    return out.drop("_bucket", "_last", "_after", *[f"_n_{c}" for c in columns])


def with_neighbours(df: DataFrame, keys: list[str], bucket: Column, order: list[str], columns: list[str], *, back: int = 0, ahead: int = 0) -> DataFrame:
    """Adds ``before1_c``, ``after1_c`` and so on: columns of the rows so far before and after in the group, null beyond its ends.

    ``order`` must rise with ``bucket``. Neighbours inside a bucket are taken there; only the first and last rows of buckets, as many
    as the widest distance, are ordered across buckets, and between two of them that are neighbours there is no other row.
    """
    reach = max(back, ahead)
    inside = Window.partitionBy(*keys, "_bucket")
    ranked_ = df.withColumn("_bucket", bucket).withColumn("_rank", F.row_number().over(inside.orderBy(*order))).withColumn("_left", F.count(F.lit(1)).over(inside) - F.col("_rank"))
    edge = (F.col("_rank") <= reach) | (F.col("_left") < reach)

    far = [(f"before{k}_{c}", F.lag(c, k), F.col("_rank") > k) for k in range(1, back + 1) for c in columns] + [(f"after{k}_{c}", F.lead(c, k), F.col("_left") >= k) for k in range(1, ahead + 1) for c in columns]
    near = ranked_.withColumns({name: value.over(inside.orderBy(*order)) for name, value, _ in far})
    across = Window.partitionBy(*keys).orderBy("_bucket", *order)
    edges = near.where(edge).withColumns({f"_{name}": value.over(across) for name, value, _ in far})
    edges = edges.withColumns({name: F.when(own, F.col(name)).otherwise(F.col(f"_{name}")) for name, _, own in far}).drop(*[f"_{name}" for name, _, _ in far])
    return near.where(~edge).unionByName(edges).drop("_bucket", "_rank", "_left")
