"""Synthesis: noise takes on a target's statistics step by step; each step is written, so a broken run carries on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import kernels
from tallframe.operators.spectral import filter_grid, modulation


def synthesise(target: DataFrame, folder: str, *, rates: list[float], scales: list[float], sr: float, per_octave: float, iterations: int = 10, end_db: float = 30.0, kind: str = "spectempmod", seed: int = 0) -> DataFrame:
    """Noise cochleagrams whose filtered versions take on the histograms of the target's: ``stim, frame, v, snr_db``.

    ``target``: ``stim, frame, v``. Stops when every stimulus has ``end_db`` (of the moments of its bands) or after
    ``iterations``. Steps are Parquet below ``folder``, shared by the cluster; a later call goes on from the last.
    """
    spark: SparkSession = target.sparkSession
    stim = target.schema["stim"].dataType.simpleString()
    schema = f"stim {stim}, frame bigint, v array<double>, snr_db double"
    first = target.withColumn("v", F.transform("v", lambda x, i: F.pmod(F.xxhash64("stim", "frame", i, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)))).withColumn("snr_db", F.lit(-1e9))

    def step(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        want, have = (np.array(x.sort_values("frame")["v"].tolist()) for x in (t, s))
        filters = [modulation(r, c, want.shape, sr, per_octave, sign, kind) for r, c, sign in filter_grid(kind, rates, scales)]
        pairs = list(zip(kernels.modulated(have, filters), kernels.modulated(want, filters), strict=True))
        passed = sum(np.abs(h) ** 2 for h in filters) > 1e-10
        matched = kernels.demodulated([kernels.rank_matched(a, b) for a, b in pairs], filters)
        rest = np.fft.ifft2(np.where(passed, 0, np.fft.fft2(have))).real
        out = kernels.rank_matched(matched + rest, want)
        after = kernels.modulated(out, filters)
        energy = sum(float((b.std(axis=0) ** 2).sum()) for _, b in pairs)
        error = sum(float(((a.std(axis=0) - b.std(axis=0)) ** 2).sum()) for a, (_, b) in zip(after, pairs, strict=True))
        snr = 10 * np.log10(max(energy, 1e-30) / max(error, 1e-30))
        return pd.DataFrame({"stim": t["stim"].iloc[0], "frame": range(len(out)), "v": list(out), "snr_db": snr})

    now, done = first, 0
    for k in range(iterations, 0, -1):
        try:
            now, done = spark.read.schema(schema).parquet(f"{folder}/step={k}"), k
            break
        except AnalysisException:
            continue
    while done < iterations:
        if done and now.agg(F.min("snr_db")).first()[0] >= end_db:
            break
        done += 1
        target.groupBy("stim").cogroup(now.groupBy("stim")).applyInPandas(step, schema).write.mode("overwrite").parquet(f"{folder}/step={done}")
        now = spark.read.schema(schema).parquet(f"{folder}/step={done}")
    return now


def impose_moments(waves: DataFrame, targets: DataFrame, *, steps: int = 60) -> DataFrame:
    """``stim, samples`` moved by conjugate gradients until mean, variance, skewness and kurtosis are the targets' (``stim, mean, var, skew, kurt``)."""

    def run(frames):
        for f in frames:
            out = []
            for row in f.itertuples():
                want = np.array([row.mean, row.var, row.skew, row.kurt])
                out.append(kernels.minimised(lambda x, want=want: kernels.moment_cost(x, want), np.asarray(row.samples, float), steps).tolist())
            yield pd.DataFrame({"stim": f["stim"], "samples": out})

    kind = waves.schema["stim"].dataType.simpleString()
    return waves.join(targets, "stim").select("stim", "samples", "mean", "var", "skew", "kurt").mapInPandas(run, f"stim {kind}, samples array<double>")
