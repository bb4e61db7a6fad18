"""Tables of a folder, and how events stand for stimuli, samples and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators.order import ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples without their numbers, ``stim, us, event_id, label, x``: users are stimuli. No shuffle."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stim"), micros("ts").alias("us"), "event_id", F.col("event_type").alias("label"), F.col("value").alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``signals`` with ``n``, which numbers a user's events in time from 0.

    Events are numbered within days, and the counts of the days before are added: no stimulus is one group.
    """
    own = ranked(signals(spark, sf_dir), ["stim"], F.floor(F.col("us") / 86_400_000_000), ["us", "event_id"], "n")
    return own.select("stim", "n", "us", "event_id", "label", "x")
