"""Cochleagrams of whole recordings and the way back, and wavelets, as tall tables over ``operators.transform``.

Nothing gathers a stimulus: envelopes are transforms' results, time is resampled by taps, frequency by pieces between channels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallframe.functions.columns import gammatone
from tallframe.operators.banks import Bank, centres
from tallframe.operators.resample import pchip, resampled
from tallframe.operators.transform import collapsed, fourier, inverse_fourier, signals, subbands

#: A channel's place in octaves; of two at the same place the first counts.
LEAST_STEP = 1e-9


def places(bank: Bank) -> list[tuple[int, float]]:
    """Channels by rising centre: number and octaves above 1 Hz."""
    octaves = np.log2(np.maximum(centres(bank), 1.0))
    order = np.argsort(octaves, kind="stable")
    return [(int(k), float(octaves[k])) for j, k in enumerate(order) if j == 0 or octaves[k] - octaves[order[j - 1]] > LEAST_STEP]


def envelopes(samples: DataFrame, bank: Bank, sr: float, *, power: float = 0.3, longest: int | None = None) -> DataFrame:
    """``stim, channel, n, x, phase``: compressed envelopes of the subbands, and what compression leaves out."""
    bands = subbands(samples, bank, sr, complex_=True, longest=longest)
    return bands.select("stim", "channel", "n", F.pow(F.hypot("re", "im"), F.lit(power)).alias("x"), F.atan2("im", "re").alias("phase"))


def positive(x: str) -> Column:
    return F.greatest(F.col(x), F.lit(0.0))


def cochleagram(envelopes_: DataFrame, bank: Bank, up: int, down: int, *, spacing: float = 1 / 24, longest: int | None = None) -> DataFrame:
    """``stim, frame, k, x``: envelopes at up / down times the rate, on frequencies ``spacing`` octaves apart from the lowest channel's to the highest's."""
    slow = resampled(envelopes_, up, down, keys=["stim", "channel"], longest=longest).withColumn("x", positive("x"))
    own = places(bank)
    octave = F.element_at(F.create_map(*[F.lit(v) for pair in own for v in pair]), F.col("channel"))
    points = slow.where(F.col("channel").isin([k for k, _ in own])).select("stim", F.col("n").alias("frame"), octave.alias("octave"), "x")
    return pchip(points, ["stim", "frame"], "octave", "x", start=own[0][1], step=spacing, bucket=None).withColumn("x", positive("x"))


def widened(coch: DataFrame, bank: Bank, up: int, down: int, *, spacing: float = 1 / 24, longest: int | None = None) -> DataFrame:
    """``stim, channel, n, x``: a cochleagram brought back to the channels' frequencies and the samples' rate."""
    own = places(bank)
    points = coch.withColumn("octave", F.col("k") * F.lit(spacing) + F.lit(own[0][1]))
    back = pchip(points, ["stim", "frame"], "octave", "x", bucket=None, targets=[v for _, v in own])
    channel = F.get(F.array(*[F.lit(k) for k, _ in own]), F.col("k").cast("int"))
    back = back.select("stim", channel.alias("channel"), F.col("frame").alias("n"), positive("x").alias("x"))
    frames = longest and longest * up // down + 1
    return resampled(back, down, up, keys=["stim", "channel"], longest=frames).withColumn("x", positive("x"))


def with_rest(envelopes_: DataFrame, coch: DataFrame, bank: Bank, up: int, down: int, *, spacing: float = 1 / 24, longest: int | None = None) -> DataFrame:
    """``stim, channel, n, phase, error``: what a cochleagram leaves out, for ``waveform``; a table to be stored beside it."""
    wide = widened(coch, bank, up, down, spacing=spacing, longest=longest).withColumnRenamed("x", "wide")
    both = envelopes_.join(wide, ["stim", "channel", "n"], "left")
    return both.select("stim", "channel", "n", "phase", (F.col("x") - F.coalesce("wide", F.lit(0.0))).alias("error"))


def waveform(coch: DataFrame, rest: DataFrame, bank: Bank, sr: float, up: int, down: int, *, power: float = 0.3, spacing: float = 1 / 24, longest: int | None = None) -> DataFrame:
    """``stim, n, x``: the inverse of ``cochleagram``, from the phases and errors kept beside it; exact for a cochleagram that wasn't changed."""
    wide = widened(coch, bank, up, down, spacing=spacing, longest=longest)
    both = rest.join(wide, ["stim", "channel", "n"], "left")
    level = F.greatest(F.coalesce("x", F.lit(0.0)) + F.col("error"), F.lit(0.0))
    bands = both.select("stim", "channel", "n", (F.pow(level, F.lit(1 / power)) * F.cos("phase")).alias("x"))
    return collapsed(bands, bank, sr, longest)


def wavelet_responses(lengths_: DataFrame, rates: list[float], sr: float, *, causal: bool = False, longest: int | None = None) -> DataFrame:
    """``m, filter, n, hre, him``: transfer functions of gammatones of the given rates, centred unless ``causal``, for signals of m samples (``lengths_``: distinct ``m``).

    The largest magnitude of each is one; rate zero passes the mean alone. Wavelets are made in blocks of their samples, not in one row.
    """
    block = 4096
    own = F.array(*[F.struct(F.lit(k).alias("filter"), F.lit(float(r)).alias("rate")) for k, r in enumerate(rates) if r != 0])
    blocks = lengths_.select("m", F.explode(own).alias("w")).select("m", "w.filter", "w.rate").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("m") - 1) / block))))
    rows = blocks.repartition("m", "filter", "b").withColumn("n", F.explode(F.sequence(F.col("b") * block, F.least(F.col("m"), (F.col("b") + 1) * block) - 1)))
    shift = F.lit(0.0) if causal else F.round(F.lit(2 / 3.5 * sr) / F.col("rate"))
    g = gammatone(F.pmod(F.col("n") + shift, F.col("m")) / F.lit(float(sr)), F.col("rate"))
    spectrum = fourier(rows.select(F.col("m").alias("length"), "filter", "m", "n", g.alias("re"), F.lit(0.0).alias("im")), ["length", "filter"], longest)
    top = spectrum.groupBy("length", "filter").agg(F.max(F.hypot("re", "im")).alias("top"))
    out = spectrum.join(top, ["length", "filter"]).select("m", "filter", "n", (F.col("re") / F.col("top")).alias("hre"), (F.col("im") / F.col("top")).alias("him"))
    flat = [k for k, r in enumerate(rates) if r == 0]
    if flat:
        means = lengths_.select("m", F.explode(F.array(*map(F.lit, flat))).alias("filter"), F.lit(0).cast("bigint").alias("n"), F.lit(1.0).alias("hre"), F.lit(0.0).alias("him"))
        out = out.unionByName(means)
    return out


def wavelets(samples: DataFrame, rates: list[float], sr: float, longest: int | None = None) -> DataFrame:
    """``stim, filter, m, n, x``: each wavelet's output over whole signals, which wrap round."""
    spectrum = fourier(signals(samples), longest=longest)
    h = wavelet_responses(signals(samples).select("m").distinct(), rates, sr, longest=longest)
    re, im = F.col("re") * F.col("hre") - F.col("im") * F.col("him"), F.col("re") * F.col("him") + F.col("im") * F.col("hre")
    bands = spectrum.join(h, ["m", "n"]).select("stim", "filter", "m", "n", re.alias("re"), im.alias("im"))
    flat = [k for k, r in enumerate(rates) if r == 0]
    if flat:  # these have one bin; a transform needs rows for the first ones
        rest = spectrum.where((F.col("n") > 0) & (F.col("n") * F.col("n") < 4 * F.col("m"))).select("stim", F.explode(F.array(*map(F.lit, flat))).alias("filter"), "m", "n", F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        bands = bands.unionByName(rest)
    return inverse_fourier(bands, ["stim", "filter"], longest).select("stim", "filter", "m", "n", F.col("re").alias("x"))


def from_wavelets(bands: DataFrame, rates: list[float], sr: float, *, least: float = 1e-10, longest: int | None = None) -> DataFrame:
    """``stim, n, x``: the signal whose wavelet outputs are nearest to ``stim, filter, m, n, x``; a frequency that no wavelet passes is zero."""
    rows = bands.select("stim", "filter", "m", "n", F.col("x").alias("re"), F.lit(0.0).alias("im"))
    h = wavelet_responses(bands.select("m").distinct(), rates, sr, longest=longest)
    both = fourier(rows, ["stim", "filter"], longest).join(h, ["m", "filter", "n"], "left").fillna(0.0, ["hre", "him"])
    re, im = F.col("re") * F.col("hre") + F.col("im") * F.col("him"), F.col("im") * F.col("hre") - F.col("re") * F.col("him")
    sums = both.groupBy("stim", "m", "n").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.sum(F.col("hre") * F.col("hre") + F.col("him") * F.col("him")).alias("power"))
    share = lambda c: F.when(F.col("power") > least, F.col(c) / F.col("power")).otherwise(F.lit(0.0))
    return inverse_fourier(sums.select("stim", "m", "n", share("re").alias("re"), share("im").alias("im")), longest=longest).select("stim", "n", F.col("re").alias("x"))
