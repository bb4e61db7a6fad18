"""Frames with buffers over a stream of events, the same as over a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def framed(events: DataFrame, *, target: float = 10.0, front: float = 2.0, back: float = 0.5, late: str = "10 minutes") -> DataFrame:
    """``stim, start, n, mean`` of events ``stim, ts, x`` in frames of ``target`` seconds with buffers in front and behind.

    ``ts`` is a timestamp. On a stream, frames are final once the watermark has passed them; events later than ``late`` are left out.
    """
    micro = 1_000_000
    length, step, start = (round(x * micro) for x in (target + front + back, target, target - front))
    window = F.window("ts", f"{length} microseconds", f"{step} microseconds", f"{start % step} microseconds")
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy("stim", window.alias("w")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return out.select("stim", F.col("w.start").alias("start"), "n", "mean")
