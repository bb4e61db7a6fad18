"""A session with the settings that the library expects, and checkpoints in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tallframe", **settings: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split, Arrow; ``settings`` override by underscored name."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    conf |= {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all machines see. One machine may do without the setting; a cluster may not."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again; what made them is forgotten."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as Parquet, which takes a fraction of a checkpoint's room."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
