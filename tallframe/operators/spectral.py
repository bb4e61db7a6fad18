"""Kernels applied to stimuli by Spark: each stimulus (or frame of a long one) is one row with its samples.

Waveforms are array rows, so kernels need no shuffle; long recordings are framed first (``grid.buffered_frames``), which bounds a row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallframe.operators import kernels
from tallframe.operators.banks import Bank, centres, responses


def arrays(samples: DataFrame, keys: list[str] = ["stim"], order: str = "n") -> DataFrame:  # noqa: B006
    """Tall samples as one array for each key, in order."""
    listed = F.sort_array(F.collect_list(F.struct(order, F.col("x").cast("double").alias("x"))))
    return samples.groupBy(*keys).agg(F.transform(listed, lambda s: s["x"]).alias("samples"))


def per_stimulus(waves: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], fields: str) -> DataFrame:
    """``stim`` and the fields of the rows that the kernel makes of each stimulus's samples; an empty one makes none."""
    names = [f.split()[0] for f in fields.split(", ")]
    kind = waves.schema["stim"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for stim, x in zip(f["stim"], f["samples"], strict=True):
                rows = kernel(np.asarray(x, np.float64)) if x is not None and len(x) else []
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, "stim", stim)
                yield out

    return waves.select("stim", "samples").mapInPandas(run, f"stim {kind}, {fields}")


def magnitudes(waves: DataFrame) -> DataFrame:
    """``stim, bin, magnitude`` of the discrete Fourier transform."""
    return per_stimulus(waves, lambda x: [(k, float(m)) for k, m in enumerate(np.abs(np.fft.fft(x)))], "bin bigint, magnitude double")


def subbands(waves: DataFrame, bank: Bank, sr: float) -> DataFrame:
    """``stim, channel, v``: each filter's output."""
    return per_stimulus(waves, lambda x: [(k, b.tolist()) for k, b in enumerate(kernels.filtered(x, responses(bank, len(x), sr)))], "channel int, v array<double>")


def collapse(bands: DataFrame, bank: Bank, sr: float) -> DataFrame:
    """``stim, samples`` from ``stim, channel, v``."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v = np.array(f.sort_values("channel")["v"].tolist())
        return pd.DataFrame({"stim": [f["stim"].iloc[0]], "samples": [kernels.collapsed(v, responses(bank, v.shape[1], sr)).tolist()]})

    return bands.groupBy("stim").applyInPandas(run, f"stim {bands.schema['stim'].dataType.simpleString()}, samples array<double>")


def envelope(waves: DataFrame) -> DataFrame:
    """``stim, n, x``: the magnitude of the analytic signal."""
    return per_stimulus(waves, lambda x: [(n, float(v)) for n, v in enumerate(np.abs(kernels.analytic(x)))], "n bigint, x double")


def circular_autocorrelation(waves: DataFrame) -> DataFrame:
    """``stim, lag, ac`` for lags from 0."""
    return per_stimulus(waves, lambda x: [(k, float(v)) for k, v in enumerate(np.fft.ifft(np.abs(np.fft.fft(x)) ** 2).real / len(x))], "lag bigint, ac double")


def cochleagrams(waves: DataFrame, bank: Bank, sr: float, env_sr: float, *, power: float = 0.3, spacing: float = 1 / 24) -> DataFrame:
    """``stim, frame, v``: compressed envelopes on log-spaced frequencies."""

    def one(x: np.ndarray) -> list[tuple]:
        coch, _, _ = kernels.cochleagram(x, responses(bank, len(x), sr), centres(bank), sr, env_sr, power=power, spacing=spacing)
        return [(k, row.tolist()) for k, row in enumerate(coch)]

    return per_stimulus(waves, one, "frame bigint, v array<double>")


#: What each type of modulation filters: rates over time, scales over frequency, directions.
TYPES = {"specmod": (False, True, False), "tempmod": (True, False, False), "spectempmod": (True, True, True), "spectempmod_separable": (True, True, False)}


def filter_grid(kind: str, rates: list[float], scales: list[float]) -> list[tuple[float | None, float | None, int]]:
    """Rates, scales and signs of a type's filters."""
    over_time, over_frequency, directed = TYPES[kind]
    return [(r, s, sign) for s in (scales if over_frequency else [None]) for r in (rates if over_time else [None]) for sign in ((1, -1) if directed else (1,))]


def modulations(features: DataFrame, kind: str, rates: list[float], scales: list[float], sr: float, per_octave: float, *, nonlinearity: str = "real", pad: int = 0) -> DataFrame:
    """``stim, frame, filter, part, v``: cochleagrams ``stim, frame, v`` through all filters of a type.

    ``nonlinearity``: real, modulus (of the analytic signal) or rect (positive and negative parts, 0 and 1). ``pad``: frames of the
    mean before the first, and as many zeros above the highest frequency unless time alone is filtered.
    """
    if nonlinearity not in ("real", "modulus", "rect"):
        raise ValueError(nonlinearity)
    stim = features.schema["stim"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        coch = np.array(f.sort_values("frame")["v"].tolist())
        t, c = coch.shape
        top = pad if kind != "tempmod" else 0
        wide = np.zeros((t + pad, c + top))
        wide[:pad, :c], wide[pad:, :c] = coch.mean(axis=0), coch
        filters = [modulation(r, s, wide.shape, sr, per_octave, sign, kind) for r, s, sign in filter_grid(kind, rates, scales)]
        rows = []
        for k, band in enumerate(kernels.modulated(wide, filters, complex_=nonlinearity == "modulus")):
            own = band[pad:, :c]
            parts = [np.abs(own)] if nonlinearity == "modulus" else [np.maximum(own, 0), np.maximum(-own, 0)] if nonlinearity == "rect" else [own]
            rows += [(f["stim"].iloc[0], n, k, p, row.tolist()) for p, part in enumerate(parts) for n, row in enumerate(part)]
        return pd.DataFrame(rows, columns=["stim", "frame", "filter", "part", "v"])

    return features.groupBy("stim").applyInPandas(run, f"stim {stim}, frame bigint, filter int, part int, v array<double>")


def modulation(rate: float | None, scale: float | None, shape: tuple[int, int], sr: float, per_octave: float, sign: int, kind: str) -> np.ndarray:
    return kernels.modulation_filter(rate, scale, shape, sr, per_octave, sign=sign, separable=not TYPES[kind][2])


def round_trip(features: DataFrame, kind: str, rates: list[float], scales: list[float], sr: float, per_octave: float) -> DataFrame:
    """``stim, frame, v``: cochleagrams filtered and put together again."""
    stim = features.schema["stim"].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        coch = np.array(f.sort_values("frame")["v"].tolist())
        filters = [modulation(r, s, coch.shape, sr, per_octave, sign, kind) for r, s, sign in filter_grid(kind, rates, scales)]
        back = kernels.demodulated(kernels.modulated(coch, filters), filters)
        return pd.DataFrame({"stim": f["stim"].iloc[0], "frame": range(len(back)), "v": list(back)})

    return features.groupBy("stim").applyInPandas(run, f"stim {stim}, frame bigint, v array<double>")


def mel_spectrograms(waves: DataFrame, sr: float, rate: float, bands: int = 80, points: int = 512) -> DataFrame:
    return per_stimulus(waves, lambda x: [(k, row.tolist()) for k, row in enumerate(kernels.mel_spectrogram(x, sr, 1 / rate, bands, points))], "frame bigint, v array<double>")


def texture_statistics(waves: DataFrame, bank: Bank, mod_bank: Bank, sr: float, env_sr: float, lags: list[int], *, power: float = 0.3) -> DataFrame:
    """``stim, stat, channel, k, value`` of the compressed envelopes of each subband."""

    def one(x: np.ndarray) -> list[tuple]:
        bands = kernels.filtered(x, responses(bank, len(x), sr))
        env = np.maximum(kernels.resampled(np.abs(kernels.analytic(bands)) ** power, env_sr, sr), 0)
        return kernels.texture(env, responses(mod_bank, env.shape[1], env_sr), lags)

    return per_stimulus(waves, one, "stat string, channel int, k int, value double")


def activations(waves: DataFrame, *, kernels_: tuple[int, ...] = (10, 3, 3, 3, 3, 2, 2), strides: tuple[int, ...] = (5, 2, 2, 2, 2, 2, 2), width: int = 8, seed: int = 0) -> DataFrame:
    """``stim, layer, frame, v``: a stand-in for a pretrained network, a stack of strided random projections that rectifies.

    One model is made in each task's worker and used for all its rows, as a pretrained one would be.
    """
    kind = waves.schema["stim"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        sizes = [1] + [width] * (len(kernels_) - 1)
        layers = [rng.normal(0, 1 / math.sqrt(k * n), (k * n, width)) for k, n in zip(kernels_, sizes, strict=True)]
        for f in frames:
            for stim, x in zip(f["stim"], f["samples"], strict=True):
                h = np.asarray(x, np.float64)[:, None]
                rows = []
                for layer, (w, k, s) in enumerate(zip(layers, kernels_, strides, strict=True)):
                    if len(h) < k:
                        break
                    at = np.arange(0, len(h) - k + 1, s)
                    h = np.maximum(h[at[:, None] + np.arange(k)].reshape(len(at), -1) @ w, 0)
                    rows += [(stim, layer, n, v.tolist()) for n, v in enumerate(h)]
                yield pd.DataFrame(rows, columns=["stim", "layer", "frame", "v"])

    return waves.select("stim", "samples").mapInPandas(run, f"stim {kind}, layer int, frame bigint, v array<double>")


def layer_times(kernels_: tuple[int, ...], strides: tuple[int, ...], start: float, sr: float) -> list[tuple[int, float, float]]:
    """For each layer the time of its first output and its rate, from the receptive fields."""
    out = []
    for k, (size, stride) in enumerate(zip(kernels_, strides, strict=True)):
        start, sr = start + (size - 1) / (2 * sr), sr / stride
        out.append((k, start, sr))
    return out


def seed_of(*parts: object) -> int:
    """A seed from values of any kind, the same on every machine."""
    return zlib.crc32(repr(parts).encode())


def matched_noise(waves: DataFrame, seed: int = 0) -> DataFrame:
    """``stim, samples``: noise of each waveform's own magnitudes and random phases, which its name and ``seed`` give."""
    kind = waves.schema["stim"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for stim, x in zip(f["stim"], f["samples"], strict=True):
                spectrum = np.fft.rfft(np.asarray(x, np.float64))
                turn = np.exp(2j * np.pi * np.random.Generator(np.random.PCG64(seed_of(str(stim), seed))).random(len(spectrum)))
                turn[0] = 1
                if len(x) % 2 == 0:
                    turn[-1] = 1  # the middle bin is real
                out.append(np.fft.irfft(spectrum * turn, len(x)).tolist() if len(x) else [])
            yield pd.DataFrame({"stim": f["stim"], "samples": out})

    return waves.select("stim", "samples").mapInPandas(run, f"stim {kind}, samples array<double>")
