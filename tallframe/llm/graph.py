"""Connected components by alternating stars, checkpoints in the shared folder, and shuffles that don't outlive their action."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: So many links' ids are broadcast; of more links, only ids that one link in ``HUB`` touches, of which there are at most twice as many.
FEW, HUB = 300_000, 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only on a single machine where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    named = named or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as Parquet, which takes a fraction of a checkpoint's room."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, what an action shuffled is deleted when it ends; else it takes disk until the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def least_neighbours(links: DataFrame, low: DataFrame, many: int) -> DataFrame:
    """Links ``u, v`` with the least neighbour ``m`` of ``u``; the links of a hub stay where they are."""
    if many <= FEW:
        return links.join(F.broadcast(low), "u")
    hubs = F.broadcast(low.where(F.col("n") * HUB > many))
    return links.join(hubs, "u").unionByName(links.join(hubs, "u", "left_anti").join(low, "u"))


def components(edges: DataFrame) -> DataFrame:
    """From links ``u, v`` (bigint, any order, repeats and self links allowed) to ``id, root``: the least id that each id is connected with.

    Only ids with a link to another appear, the root itself included. Large-star and small-star rounds
    alternate until nothing changes; each keeps at most one link an id and neighbour, and a hub's links
    are joined to its least neighbour by broadcast, never gathered. No links give no rows.
    """

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = least_neighbours(both.where("v > u"), low, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = least_neighbours(large, least, seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, seen = seen, mark(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
