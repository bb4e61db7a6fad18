"""Numpy kernels over one stimulus: transforms, envelopes, resampling, modulation filters and texture statistics."""

from __future__ import annotations

import numpy as np


def analytic(x: np.ndarray, axis: int = -1, sign: int = 1) -> np.ndarray:
    """The signal of the frequencies of one sign, doubled; those of the other are zero, zero and Nyquist stay."""
    n = x.shape[axis]
    weight = np.zeros(n)
    weight[0] = 1
    if n % 2 == 0:
        weight[n // 2] = 1
    half = np.arange(1, (n + 1) // 2)
    weight[half if sign > 0 else n - half] = 2
    shape = [1] * x.ndim
    shape[axis] = n
    return np.fft.ifft(np.fft.fft(x, axis=axis) * weight.reshape(shape), axis=axis)


def filtered(x: np.ndarray, h: np.ndarray, *, pad: bool = False) -> np.ndarray:
    """One signal through each row of ``h`` (over the bins of a real transform), or row by row; ``pad`` avoids wrapping round by zeros."""
    n = x.shape[-1]
    if not pad:
        return np.fft.irfft(np.fft.rfft(x) * h, n)
    taps = np.fft.irfft(h, n)
    m = 2 * n
    wide = np.zeros((*taps.shape[:-1], m))
    wide[..., : (n + 1) // 2], wide[..., m - n // 2 :] = taps[..., : (n + 1) // 2], taps[..., (n + 1) // 2 :]
    return np.fft.irfft(np.fft.rfft(x, m) * np.fft.rfft(wide), m)[..., :n]


def collapsed(bands: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The sum of the bands, each filtered again."""
    return np.fft.irfft((np.fft.rfft(bands) * h).sum(axis=0), bands.shape[-1])


def resampled(x: np.ndarray, new: float, old: float) -> np.ndarray:
    """Band-limited resampling of the last axis by a windowed sinc of 16 zero crossings; ``round(n * new / old)`` points."""
    n = x.shape[-1]
    m = int(np.floor(n * new / old + 0.5))
    if new == old:
        return x.copy()
    cut = min(1.0, new / old)
    at = np.arange(m) * (old / new)
    reach = int(np.ceil(16 / cut))
    k = np.arange(-reach, reach + 1)
    place = np.floor(at)[:, None].astype(int) + k
    u = (at[:, None] - place) * cut
    w = np.where(np.abs(u) < 16, np.sinc(u) * np.cos(np.pi * u / 32) ** 2, 0.0)
    w /= w.sum(axis=1, keepdims=True)
    return (x[..., np.clip(place, 0, n - 1)] * w).sum(axis=-1)


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation over the last axis of ``y``, whose end pieces carry on beyond the ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(y.shape)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = (w1 + w2) / (w1 / d[..., :-1] + w2 / d[..., 1:])
    m[..., 1:-1] = np.where(d[..., :-1] * d[..., 1:] > 0, mean, 0.0)
    for end, (a, b) in ((0, (0, 1)), (-1, (-1, -2))):
        if len(h) == 1:
            m[..., end] = d[..., 0]
            continue
        e = ((2 * h[a] + h[b]) * d[..., a] - h[a] * d[..., b]) / (h[a] + h[b])
        e = np.where(np.sign(e) != np.sign(d[..., a]), 0.0, e)
        m[..., end] = np.where((np.sign(d[..., a]) != np.sign(d[..., b])) & (np.abs(e) > 3 * np.abs(d[..., a])), 3 * d[..., a], e)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return y[..., k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * m[..., k] * t * (1 - t) ** 2 + y[..., k + 1] * t * t * (3 - 2 * t) + h[k] * m[..., k + 1] * t * t * (t - 1)


def cochleagram(x: np.ndarray, h: np.ndarray, centres: np.ndarray, sr: float, env_sr: float, *, power: float = 0.3, spacing: float = 1 / 24) -> tuple[np.ndarray, np.ndarray, dict]:
    """Frames by log-spaced frequencies of compressed envelopes; the frequencies; and what the inverse needs (phases and the error of going there and back)."""
    bands = analytic(filtered(x, h))
    envelopes = np.abs(bands) ** power
    low = np.maximum(resampled(envelopes, env_sr, sr), 0)
    order = np.argsort(centres)
    log_f = np.log2(np.maximum(centres[order], 1.0))
    keep = np.append(True, np.diff(log_f) > 1e-9)
    order, log_f = order[keep], log_f[keep]
    f = np.arange(log_f[0], log_f[-1] + spacing, spacing)
    coch = np.maximum(pchip(log_f, low[order].T, f), 0)
    back = np.maximum(pchip(f, coch, log_f), 0).T
    wide = np.zeros_like(envelopes)
    wide[order] = np.maximum(resampled(back, sr, env_sr), 0)[:, : x.shape[-1]] if len(back) else 0
    rest = {"phase": np.angle(bands), "error": envelopes - wide, "order": order, "log_f": log_f, "f": f}
    return coch, 2**f, rest


def waveform(coch: np.ndarray, rest: dict, h: np.ndarray, sr: float, env_sr: float, *, power: float = 0.3) -> np.ndarray:
    """The inverse of ``cochleagram``, from the phases and errors it kept."""
    back = np.maximum(pchip(rest["f"], coch, rest["log_f"]), 0).T
    wide = np.zeros_like(rest["error"])
    wide[rest["order"]] = np.maximum(resampled(back, sr, env_sr), 0)[:, : wide.shape[1]]
    envelopes = np.maximum(wide + rest["error"], 0) ** (1 / power)
    return collapsed(envelopes * np.cos(rest["phase"]), h)


def temporal_filter(fc: float, n: int, sr: float, *, lowpass: bool = False, causal: bool = True) -> np.ndarray:
    """The transfer function of a gammatone of the given rate, its largest magnitude one; rate zero passes the mean alone."""
    if fc == 0:
        return (np.arange(n) == 0).astype(complex)
    t = np.arange(n) / sr
    g = (fc * t) ** 2 * np.exp(-3.5 * fc * t) * (1 if lowpass else np.sin(2 * np.pi * fc * t))
    if not causal:
        g = np.roll(g, -int(round(2 / (3.5 * fc) * sr)))
    f = np.fft.fft(g)
    return f / np.abs(f).max()


def spectral_filter(fc: float, n: int, per_octave: float, *, lowpass: bool = False) -> np.ndarray:
    """The transfer function of a Mexican hat of so many cycles an octave, its maximum one; zero passes the mean alone."""
    if fc > per_octave / 2:
        raise ValueError("beyond the Nyquist frequency")
    f = np.abs(np.fft.fftfreq(n, 1 / per_octave))
    if fc == 0:
        return (f == 0).astype(float)
    if lowpass:
        return np.exp(-((np.pi * f / (2 * fc)) ** 2))
    g = (f / fc) ** 2
    out = g * np.exp(-g)
    return out / out.max()


def modulation_filter(rate: float | None, scale: float | None, shape: tuple[int, int], sr: float, per_octave: float, *, sign: int = 1, separable: bool = False, causal: bool = True) -> np.ndarray:
    """A two-dimensional transfer function over time and frequency; an axis without a rate is passed whole.

    Unless separable, the two quadrants that move in the other direction are zero.
    """
    ht = np.ones(shape[0]) if rate is None else temporal_filter(abs(rate), shape[0], sr, causal=causal)
    hs = np.ones(shape[1]) if scale is None else spectral_filter(scale, shape[1], per_octave)
    h = ht[:, None] * hs[None, :]
    if rate is not None and scale is not None and not separable:
        st, ss = (np.sign(np.fft.fftfreq(m)) for m in shape)
        for m, s in zip(shape, (st, ss), strict=True):
            if m % 2 == 0:
                s[m // 2] = 0
        h = np.where(st[:, None] * ss[None, :] == -sign, 0, h)
    return h


def modulated(coch: np.ndarray, filters: list[np.ndarray], *, complex_: bool = False) -> list[np.ndarray]:
    """A cochleagram through each filter; one transform serves all."""
    f = np.fft.fft2(coch)
    out = [np.fft.ifft2(f * h) for h in filters]
    return [analytic(x.real, 0) for x in out] if complex_ else [x.real for x in out]


def demodulated(bands: list[np.ndarray], filters: list[np.ndarray], least: float = 1e-10) -> np.ndarray:
    """The cochleagram whose filtered versions are nearest to the bands; what no filter passes is zero."""
    top = sum(np.fft.fft2(b) * np.conj(h) for b, h in zip(bands, filters, strict=True))
    power = sum(np.abs(h) ** 2 for h in filters)
    return np.fft.ifft2(np.where(power > least, top / np.maximum(power, least), 0)).real


def rank_matched(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Columns of x with the sorted values of the target's columns in their own order."""
    out = np.empty_like(x)
    np.put_along_axis(out, np.argsort(x, axis=0, kind="stable"), np.sort(target, axis=0), 0)
    return out


def mean_variance_matched(x: np.ndarray, target: np.ndarray) -> np.ndarray:
    s = x.std(axis=0, ddof=1)
    return (x - x.mean(axis=0)) / np.where(s == 0, 1, s) * target.std(axis=0, ddof=1) + target.mean(axis=0)


def circular_autocorrelation(x: np.ndarray) -> np.ndarray:
    """Over the last axis, lag zero in the middle, over the number of points."""
    f = np.fft.fft(x)
    return np.fft.fftshift(np.fft.ifft(f * np.conj(f)).real, axes=-1) / x.shape[-1]


def padded_autocorrelation(x: np.ndarray, window: str = "hanning", undo: bool = False) -> np.ndarray:
    """As above, windowed and between as many zeros; ``undo`` divides by the window's own."""
    n = x.shape[-1]
    t = np.arange(1, n + 1) / n
    w = {"hanning": 0.5 - 0.5 * np.cos(2 * np.pi * t), "rect": np.ones(n), "hamming": 0.54 - 0.46 * np.cos(2 * np.pi * t), "soft": 0.6 - 0.4 * np.cos(2 * np.pi * t), "welch": np.sin(np.pi * t)}[window]
    side = n // 2

    def wide(a: np.ndarray) -> np.ndarray:
        return circular_autocorrelation(np.concatenate([np.zeros((*a.shape[:-1], side)), a, np.zeros((*a.shape[:-1], n - side))], axis=-1))

    ac = wide(x * w)
    if undo:
        ac = ac / wide(w)
    return ac[..., n - side : 2 * n - side]


def mel_spectrogram(x: np.ndarray, sr: float, step: float, bands: int = 80, points: int = 512) -> np.ndarray:
    """Frames by mel bands of log power."""
    hop = max(1, int(round(step * sr)))
    starts = np.arange(0, max(1, len(x)), hop)
    wide = np.concatenate([np.zeros(points // 2), x, np.zeros(points)])
    power = np.abs(np.fft.rfft(wide[starts[:, None] + np.arange(points)] * np.hanning(points))) ** 2
    mel = 2595 * np.log10(1 + np.fft.rfftfreq(points, 1 / sr) / 700)
    cuts = np.linspace(0, mel[-1], bands + 2)
    step_ = cuts[1]
    triangles = np.maximum(0, 1 - np.abs(mel[None, :] - cuts[1:-1, None]) / step_)
    return np.log10(power @ triangles.T + 1e-10)


def texture(envelopes: np.ndarray, h: np.ndarray, lags: list[int], window: np.ndarray | None = None) -> list[tuple[str, int, int, float]]:
    """Statistics of channels by time: ``stat, channel, k, value``.

    Weighted mean, cv, skewness and kurtosis; correlations with the channels above; the share of variance in each
    modulation band; autocorrelation at lags; and the phase-adjusted correlation of each band with the next octave.
    """
    n = envelopes.shape[1]
    w = np.full(n, 1 / n) if window is None else window / window.sum()
    mean = envelopes @ w
    d = envelopes - mean[:, None]
    var = (d**2) @ w
    safe = np.where(var > 0, var, 1)
    out: list[tuple[str, int, int, float]] = []

    def put(stat: str, values: np.ndarray, k: int = 0) -> None:
        out.extend((stat, c, k, float(v)) for c, v in enumerate(values))

    put("mean", mean)
    put("cv", np.sqrt(var) / np.where(mean == 0, 1, mean))
    put("skew", (d**3) @ w / safe**1.5)
    put("kurt", (d**4) @ w / safe**2)
    sd = envelopes.std(axis=1)
    flat = envelopes - envelopes.mean(axis=1, keepdims=True)
    corr = (flat * w) @ flat.T / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)
    out.extend(("corr", i, j, float(corr[i, j])) for i in range(len(corr)) for j in range(i + 1, len(corr)))
    bands = np.array([filtered(flat, row) for row in h])
    for k, b in enumerate(bands):
        put("mod_power", (b**2) @ w / safe, k)
    for k in lags:
        a, b = flat[:, 2 * k :], flat[:, : n - 2 * k]
        put("ac", (a * b) @ w[k : n - k] / np.where(sd > 0, sd**2, 1), k)
    whole = [analytic(b) for b in bands]
    for k, (a, b) in enumerate(zip(whole, whole[1:], strict=False)):
        c = a**2 / np.maximum(np.abs(a), 1e-12)
        sc, sb = np.sqrt((np.abs(c) ** 2) @ w), np.sqrt((np.abs(b) ** 2) @ w)
        r = ((np.conj(c) * b) @ w) / np.where(sc * sb > 0, sc * sb, 1)
        put("c2_real", r.real, k)
        put("c2_imag", r.imag, k)
    return out


def minimised(f, x: np.ndarray, steps: int = 50) -> np.ndarray:
    """Conjugate gradients (Polak-Ribiere) with a line search that halves until the value falls; ``f`` gives value and gradient."""
    value, g = f(x)
    d, rate = -g, 1.0 / max(1e-12, float(np.abs(g).max()))
    for _ in range(steps):
        slope = float((g * d).sum())
        if slope >= 0:
            d, slope = -g, -float((g * g).sum())
        if slope > -1e-20:
            break
        step = rate
        for _ in range(30):
            v, h = f(x + step * d)
            if v <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        x, rate = x + step * d, 2 * step
        beta = max(0.0, float((h * (h - g)).sum() / max(1e-30, (g * g).sum())))
        value, g, d = v, h, -h + beta * d
    return x


def moment_cost(x: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the squared distance of mean, variance, skewness and kurtosis of x from the target, and its gradient."""
    n = len(x)
    m = x.mean()
    d = x - m
    m2, m3, m4 = ((d**k).mean() for k in (2, 3, 4))
    m2 = max(m2, 1e-12)
    have = np.array([m, m2, m3 / m2**1.5, m4 / m2**2])
    g1 = np.full(n, 1 / n)
    g2 = 2 * d / n
    g3 = 3 * (d**2 - m2) / n
    g4 = 4 * (d**3 - m3) / n
    grads = np.array([g1, g2, g3 / m2**1.5 - 1.5 * m3 / m2**2.5 * g2, g4 / m2**2 - 2 * m4 / m2**3 * g2])
    e = have - target
    return 0.5 * float(e @ e), e @ grads
