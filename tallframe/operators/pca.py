"""Principal components from distributed covariances; fitted on one collection, applied to another."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators.stats import whole_features

#: Most features: their matrix, and the model that ``project`` broadcasts, take 8 bytes a pair.
MOST = 10_000

MODEL = "k int, value double, weights array<double>, mean array<double>, scale array<double>"


def gram(features: DataFrame, v: str = "v") -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of outer products, sum, and count of array features, in one pass: one matrix a task, added up in chunks of features.

    The driver gets one matrix of features by features, whatever the number of frames; more than ``MOST`` features raise an error (``fit_leading`` takes any number).
    """

    def work(x: np.ndarray) -> np.ndarray:
        if x.shape[1] > MOST:
            raise ValueError(f"more than {MOST} features: their matrix is too large for the driver")
        return np.concatenate([x.T @ x, x.sum(axis=0)[:, None], np.full((x.shape[1], 1), float(len(x)))], axis=1)

    flat = summed(features, v, work)
    if not flat.size:
        return np.zeros((0, 0)), np.zeros(0), 0
    size = round(math.sqrt(flat.size + 1) - 1)  # size * (size + 2) values
    whole = flat.reshape(size, size + 2)
    if (whole[:, -1] != whole[0, -1]).any():
        raise ValueError("rows have different numbers of features")
    return whole[:, :-2], whole[:, -2], int(whole[0, -1])


def fit(features: DataFrame, *, demean: bool = True, standardise: bool = False, v: str = "v") -> DataFrame:
    """The model table ``k, value, weights, mean, scale``: components by falling eigenvalue, the largest loading of each positive."""
    g, total, n = gram(features, v)
    spark: SparkSession = features.sparkSession
    if not n:
        return spark.createDataFrame([], MODEL)
    mean = total / n
    c = g / n
    scale = np.sqrt(np.maximum(np.diag(c) - mean**2, 0)) if standardise else np.ones(len(mean))
    scale[scale == 0] = 1
    if demean:
        c = c - np.outer(mean, mean)
    else:
        mean = np.zeros_like(mean)
    values, vectors = np.linalg.eigh(c / np.outer(scale, scale))
    order = np.argsort(-values, kind="stable")
    rows = []
    for k, i in enumerate(order):
        w = vectors[:, i]
        w = w * np.sign(w[np.abs(w).argmax()])
        rows.append((k, float(values[i]), w.tolist(), mean.tolist(), scale.tolist()))
    return spark.createDataFrame(rows, MODEL)


def project(features: DataFrame, model: DataFrame, k: int | None = None, *, v: str = "v") -> DataFrame:
    """Replaces ``v`` by its first k scores; the model is one row for each component and is broadcast."""
    one = model.where(F.col("k") < k) if k is not None else model
    packed = one.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "weights"))), lambda s: s["weights"]).alias("_w"), F.first("mean").alias("_m"), F.first("scale").alias("_s"))
    centred = F.transform(F.arrays_zip(F.col(v).alias("x"), F.col("_m").alias("m"), F.col("_s").alias("s")), lambda z: (z["x"].cast("double") - z["m"]) / z["s"])
    scores = F.transform("_w", lambda w: F.aggregate(F.zip_with(w, F.col("_c"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
    return features.crossJoin(F.broadcast(packed)).withColumn("_c", centred).withColumn(v, scores).drop("_w", "_m", "_s", "_c")


def reconstruct(scores: DataFrame, model: DataFrame, *, v: str = "v", add_mean: bool = True) -> DataFrame:
    """Features from scores: the weighted components, with the mean or without."""
    packed = model.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "weights"))), lambda s: s["weights"]).alias("_w"), F.first("mean").alias("_m"), F.first("scale").alias("_s"))
    sums = F.aggregate(F.zip_with(F.slice("_w", F.lit(1), F.size(v)), F.col(v), lambda w, a: F.transform(w, lambda x: x * a)), F.transform("_m", lambda _: F.lit(0.0)), lambda t, x: F.zip_with(t, x, lambda p, q: p + q))
    scaled = F.zip_with(sums, F.col("_s"), lambda a, b: a * b)
    out = F.zip_with(scaled, F.col("_m"), lambda a, b: a + b) if add_mean else scaled
    return scores.crossJoin(F.broadcast(packed)).withColumn(v, out).drop("_w", "_m", "_s")


#: Features that one row of a sum over tasks holds.
CHUNK = 4096


def added_up(parts: DataFrame) -> np.ndarray:
    """The sum of arrays that tasks made in chunks ``i, part`` (binary float64): chunks of one place are added where they meet, and the driver gets one of each."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for i, part in zip(f["i"], f["part"], strict=True):
                x = np.frombuffer(part)
                sums[i] = sums[i] + x if i in sums else x
        yield pd.DataFrame({"i": list(sums), "part": [x.tobytes() for x in sums.values()]})

    found = parts.repartition("i").mapInPandas(add, "i int, part binary").orderBy("i").toPandas()
    return np.concatenate([np.frombuffer(x) for x in found["part"]]) if len(found) else np.zeros(0)


def summed(features: DataFrame, v: str, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``work`` makes of a batch of rows: a matrix with a row for each feature."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            widths = f[v].map(len).unique()
            if len(widths) > 1 or (total is not None and len(widths) and len(total) != widths[0]):
                raise ValueError("rows have different numbers of features")
            if len(f):
                made = work(np.asarray(f[v].tolist(), np.float64))
                total = made if total is None else total + made
        if total is not None:
            at = range(0, len(total), CHUNK)
            yield pd.DataFrame({"i": [k // CHUNK for k in at], "part": [total[k : k + CHUNK].tobytes() for k in at]})

    return added_up(whole_features(features, v).mapInPandas(run, "i int, part binary"))


def orthonormal(x: np.ndarray, against: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Columns that span what of x isn't in the span of ``against``."""
    size = np.linalg.norm(x, axis=0).max(initial=0.0)
    for _ in range(2):
        x = x - against @ (against.T @ x)
        q, r = np.linalg.qr(x)
        x = q[:, np.abs(np.diag(r)) > least * max(size, 1e-300)]
        size = 1.0
    return x


def fit_leading(features: DataFrame, k: int, *, demean: bool = True, over: int = 8, tolerance: float = 1e-9, rounds: int = 100, seed: int = 0, v: str = "v") -> DataFrame:
    """The first k components of any number of features: the model table of ``fit``, of unscaled features, without their covariances.

    From random directions on, each round is one pass: a task multiplies its rows by the newest directions and back, a matrix of features by
    ``k + over``, and these are added up in chunks of features. What the covariances make of the directions, less what is known, are the next ones;
    the components are the best combinations of all, until no residual is above ``tolerance`` times the largest eigenvalue. When directions are
    many, the best combinations take their place. The driver and each task hold a few matrices of features by ``k + over``, never one of features by features.
    """
    spark = features.sparkSession
    packed = summed(features, v, lambda x: np.concatenate([x.sum(axis=0)[:, None], np.full((x.shape[1], 1), len(x))], axis=1)).reshape(-1, 2)
    if not len(packed):
        return spark.createDataFrame([], MODEL)
    counts = packed[:, 1]
    if (counts != counts[0]).any():
        raise ValueError("rows have different numbers of features")
    n, size = counts[0], len(packed)
    mean = packed[:, 0] / n if demean else np.zeros(size)
    wide = min(size, k + over)
    new = orthonormal(np.random.default_rng(seed).normal(size=(size, wide)), np.zeros((size, 0)))
    basis, image = np.zeros((size, 0)), np.zeros((size, 0))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((new, mean))
        made = summed(features, v, lambda x, sent=sent: (y := x - sent.value[1]).T @ (y @ sent.value[0])).reshape(size, -1) / n
        sent.unpersist()
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, made], axis=1)
        values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        best = np.argsort(-values, kind="stable")[:wide]
        values, turn = values[best], turn[:, best]
        rest = image @ turn - (basis @ turn) * values
        if basis.shape[1] == size or np.linalg.norm(rest[:, :k], axis=0).max(initial=0.0) <= tolerance * max(values[0], 1e-300):
            break
        if basis.shape[1] > 8 * wide:
            basis, image, turn = basis @ turn, image @ turn, np.eye(len(best))
        new = orthonormal(rest, basis)
        if not new.shape[1]:
            break
    else:
        raise ValueError(f"{k} components aren't found in {rounds} rounds")
    rows = []
    for j in range(min(k, len(values))):
        w = basis @ turn[:, j]
        rows.append((j, float(values[j]), (w * np.sign(w[np.abs(w).argmax()])).tolist(), mean.tolist(), np.ones(size).tolist()))
    return spark.createDataFrame(rows, MODEL)
