"""Filterbanks of half-cosine lobes on a warped frequency axis, as small lists that numpy or Spark evaluates.

A lobe rises from ``low`` to its peak at ``mid`` and falls to ``high``, all on the bank's scale. Banks of
neighbours that overlap by half have squares that sum to one; complements at both ends make that hold everywhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.functions.columns import FERRET_POWER, FERRET_SLOPE, erb, hz_of_erb, hz_to_erb, hz_to_erb_ferret


@dataclass(frozen=True)
class Bank:
    """``lobes``: low, mid, high; ``below`` and ``above``: lobes whose complement is passed at the low and the high end."""

    scale: str
    lobes: list[tuple[float, float, float]]
    below: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    gain: float = 1.0


def warp(scale: str, f: np.ndarray) -> np.ndarray:
    if scale == "erb":
        return 9.265 * np.log1p(f / (24.7 * 9.265))
    if scale == "ferret":
        return (f / 1000) ** (1 - FERRET_POWER) / (FERRET_SLOPE * (1 - FERRET_POWER))
    if scale == "octave":
        return np.log2(np.maximum(f, 1e-12))
    return np.asarray(f, float)


def warp_column(scale: str, f: Column) -> Column:
    if scale == "erb":
        return hz_to_erb(f)
    if scale == "ferret":
        return hz_to_erb_ferret(f)
    if scale == "octave":
        return F.log2(F.greatest(f, F.lit(1e-12)))
    return f


def even_bank(scale: str, n: int, low: float, high: float, over: int = 1) -> Bank:
    """``over`` times as many lobes (less one each time) as n that overlap by half, evenly spaced on the scale, with complements at both ends."""
    a, b = float(warp(scale, np.array(low))), float(warp(scale, np.array(high)))
    many = over * (n + 1) - 1
    step = (b - a) / (many + 1)
    mids = [a + step * (k + 1) for k in range(many)]
    lobes = [(m - over * step, m, m + over * step) for m in mids]
    ends = min(over, many)
    return Bank(scale, lobes, list(range(ends)), list(range(many - ends, many)), 1 / math.sqrt(over))


def erb_bank(n: int, low: float, high: float, over: int = 1, animal: str = "human") -> Bank:
    return even_bank("erb" if animal == "human" else "ferret", n, low, high, over)


def linear_bank(n: int, low: float, high: float, over: int = 1) -> Bank:
    return even_bank("linear", n, low, high, over)


def octave_bank(low: float, high: float) -> Bank:
    """Lobes an octave apart, two octaves wide, below ``high``."""
    mids = []
    f = high / 2
    while f > low:
        mids.append(math.log2(f))
        f /= 2
    return Bank("octave", [(m - 1, m + 0.5, m + 2) for m in reversed(mids)])


def constant_q_bank(n: int, low: float, high: float, q: float) -> Bank:
    """Lobes whose width is a share 1/q of their peak's frequency; ``responses`` scales their squares to a mean of one between the fourth peak and the fourth last."""
    mids = np.exp2(np.linspace(math.log2(low), math.log2(high), n)).tolist()
    return Bank("linear", [(m - m / q, m, m + m / q) for m in mids], gain=0.0)


def linear_control_bank(n: int, low: float, high: float, q: float) -> Bank:
    """Evenly spaced lobes that overlap as those of ``constant_q_bank`` do on average."""
    c = np.exp2(np.linspace(math.log2(low), math.log2(high), n))[4:6]
    width = c / q
    overlap = (c[0] + width[0] / 2) - (c[1] - width[1] / 2)
    share = (overlap / width[0] + overlap / width[1]) / 2
    step = (high - low) / (n - 1)
    bw = step / (1 - share)
    return Bank("linear", [(max(0.0, low + step * k - bw), low + step * k, low + step * k + bw) for k in range(n)], gain=0.0)


def linear_octave_control_bank(n: int, low: float, high: float) -> Bank:
    """As many evenly spaced lobes as an octave bank has; the first reaches down to zero."""
    cuts = [0.0, *np.linspace(low, high, n + 1).tolist()]
    lobes = [(cuts[k], cuts[1] if k == 0 else (cuts[k] + cuts[k + 2]) / 2, cuts[k + 2]) for k in range(n)]
    return Bank("linear", lobes)


def frequencies(n: int, sr: float) -> np.ndarray:
    """Those of the bins of a real transform of n points."""
    return np.arange(n // 2 + 1) * (sr / n)


def responses(bank: Bank, n: int, sr: float) -> np.ndarray:
    """A row for each filter, complements first and last, and a column for each bin."""
    f = frequencies(n, sr)
    w = warp(bank.scale, f)
    low, mid, high = (np.array(x)[:, None] for x in zip(*bank.lobes, strict=True))
    half = np.where(w < mid, mid - low, high - mid)
    lobes = np.where((w > low) & (w < high), np.cos((w - mid) / half * (np.pi / 2)), 0.0)
    first = [np.where(w < mid[k], np.sqrt(np.maximum(0, 1 - lobes[k] ** 2)), 0.0) for k in bank.below]
    last = [np.where(w > mid[k], np.sqrt(np.maximum(0, 1 - lobes[k] ** 2)), 0.0) for k in reversed(bank.above)]
    out = np.array([*first, *lobes, *reversed(last)])
    if bank.gain:
        return out * bank.gain
    inner = (f >= bank.lobes[3][1]) & (f <= bank.lobes[-4][1])
    return out / math.sqrt(np.mean((out**2).sum(axis=0)[inner]))


def lobe_columns(bank: Bank, freq: Column) -> list[Column]:
    """The rows of ``responses`` at a frequency, as columns, for banks of a set gain."""
    if not bank.gain:
        raise ValueError("a bank whose gain is the mean of its squares needs all bins")
    w = warp_column(bank.scale, freq)

    def lobe(low: float, mid: float, high: float) -> Column:
        half = F.when(w < mid, F.lit(mid - low)).otherwise(F.lit(high - mid))
        return F.when((w > low) & (w < high), F.cos((w - F.lit(mid)) / half * F.lit(math.pi / 2))).otherwise(F.lit(0.0))

    def rest(k: int, beyond: Column) -> Column:
        h = lobe(*bank.lobes[k])
        return F.when(beyond, F.sqrt(F.greatest(F.lit(0.0), 1 - h * h))).otherwise(F.lit(0.0))

    first = [rest(k, w < bank.lobes[k][1]) for k in bank.below]
    last = [rest(k, w > bank.lobes[k][1]) for k in bank.above]
    return [h * F.lit(bank.gain) for h in (*first, *(lobe(*x) for x in bank.lobes), *last)]


def lobes_at(df: DataFrame, bank: Bank, freq: Column) -> DataFrame:
    """Adds ``filter, h`` to each row: the lobes whose frequencies hold the row's, by built-in functions; a row that no lobe holds has none."""
    w = warp_column(bank.scale, freq)
    lobes = F.array(*[F.struct(F.lit(k).alias("filter"), *[F.lit(float(v)).alias(c) for c, v in zip(("low", "mid", "high"), x, strict=True)]) for k, x in enumerate(bank.lobes)])
    met = df.withColumn("_w", w).withColumn("_f", F.explode(F.filter(lobes, lambda f: (F.col("_w") > f["low"]) & (F.col("_w") < f["high"]))))
    low, mid, high = (F.col(f"_f.{c}") for c in ("low", "mid", "high"))
    h = F.cos((F.col("_w") - mid) / F.when(F.col("_w") < mid, mid - low).otherwise(high - mid) * F.lit(math.pi / 2)) * F.lit(bank.gain or 1.0)
    return met.select(*df.columns, F.col("_f.filter").alias("filter"), h.alias("h"))


def bank_table(spark: SparkSession, bank: Bank, n: int, sr: float) -> DataFrame:
    """``filter, bin, freq, h`` of the lobes alone, by built-in functions; bins outside a lobe have no row."""
    lobes = spark.createDataFrame([(k, *x) for k, x in enumerate(bank.lobes)], "filter int, low double, mid double, high double")
    grid = spark.range(n // 2 + 1).select(F.col("id").alias("bin"), (F.col("id") * F.lit(sr / n)).alias("freq"))
    w = warp_column(bank.scale, F.col("freq"))
    cells = F.broadcast(lobes).crossJoin(grid).withColumn("w", w).where("w > low and w < high")
    half = F.when(F.col("w") < F.col("mid"), F.col("mid") - F.col("low")).otherwise(F.col("high") - F.col("mid"))
    h = F.cos((F.col("w") - F.col("mid")) / half * F.lit(math.pi / 2)) * F.lit(bank.gain or 1.0)
    return cells.select("filter", "bin", "freq", h.alias("h"))


def default_filters(low: float, high: float) -> int:
    """As many ERB filters as fit at the density of human hearing."""
    return round((erb(high) - erb(low)) / 1.3581)


def centres(bank: Bank) -> np.ndarray:
    """The peaks in Hz, complements included, of an ERB or linear bank."""
    step = bank.lobes[1][1] - bank.lobes[0][1] if len(bank.lobes) > 1 else 0.0
    over = len(bank.below)
    mids = [*(bank.lobes[k][1] - step * over for k in bank.below), *(x[1] for x in bank.lobes), *(bank.lobes[k][1] + step * over for k in bank.above)]
    return np.array([hz_of_erb(m) if bank.scale == "erb" else m for m in mids])


def lag_lowpass(n: int, sr: float, lags_ms: list[float]) -> np.ndarray:
    """For each lag a low-pass that falls, as a quarter cosine, over the octave below a quarter of the inverse of the step from the lag before."""
    f = frequencies(n, sr)
    out = []
    for step in np.diff([0.0, *lags_ms]):
        cut = 1000 / (4 * step)
        inside = (f > cut / 2) & (f < cut)
        h = np.where(f <= cut / 2, 1.0, 0.0)
        if cut > sr / 2:
            h = np.ones_like(f)
        elif inside.sum() > 1:
            g = f[inside]
            h[inside] = np.cos((g - g[0]) / (g[-1] - g[0]) * (np.pi / 2))
        out.append(h)
    return np.array(out)
