"""Statistics that grow with a stream of features: sums of products are kept as state, and covariances are read from them at any time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallframe.operators.stats import covariance_of, outer_sums

SUMS = "i int, g array<double>, s double, n bigint, width int"


def running_sums(features: DataFrame, v: str = "v") -> DataFrame:
    """``i, g, s, n, width`` of all rows of a stream so far, a row for each feature that a batch adds to.

    A batch's tasks make a matrix each, whose rows meet by feature and are added to the feature's state: its sums of products with
    all features. State is as large as the features' matrix, however long the stream. Features' numbers mustn't change.
    """

    def add(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        g, s, n = (np.frombuffer(state.get[0]), *state.get[1:]) if state.exists else (None, 0.0, 0)
        for f in frames:
            for own, part, count in zip(f["g"], f["s"], f["n"], strict=True):
                if g is not None and len(g) != len(own):
                    raise ValueError("rows have different numbers of features")
                g, s, n = np.asarray(own) if g is None else g + own, s + float(part), n + int(count)
        state.update((np.ascontiguousarray(g, np.float64).tobytes(), s, n))
        yield pd.DataFrame({"i": [key[0]], "g": [g.tolist()], "s": [s], "n": [n], "width": [len(g)]})

    return outer_sums(features, v).groupBy("i").applyInPandasWithState(add, SUMS, "g binary, s double, n bigint", "update", GroupStateTimeout.NoTimeout)


def keep_sums(features: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts a stream of features whose running sums are stored below ``path``, each batch's by its number.

    A batch that is run again after a failure writes the same folder again; state and place in the stream are those of the last batch that ended.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream = running_sums(features).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()


def covariance_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``i, j, cov`` for i <= j, from the newest sums of each feature."""
    newest = spark.read.parquet(path).groupBy("i").agg(F.max(F.struct("batch", "g", "s", "n", "width")).alias("r"))
    return covariance_of(newest.select("i", "r.g", "r.s", "r.n", "r.width"))
