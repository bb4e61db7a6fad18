"""Envelopes that take on a texture's statistics, by conjugate gradients over blocks of long signals.

All statistics are functions of a few sums over time: powers of envelopes, products of channels, products a lag
apart, and energies and products of modulation bands. Blocks with a margin from their neighbours make their part of
the sums, which Spark adds up by stimulus; what the cost owes to each sum goes back to the blocks, which make their part of the
gradient from it. No task sees a stimulus. A step's blocks are a table, so that a run that broke goes on from the last one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.sources.files import is_whole

#: Steps tried along a direction, as multiples of the last one that was taken; zero keeps a stimulus where it is.
TRIALS = (0.0, 0.05, 0.2, 0.5, 0.8, 1.0, 1.25, 1.6, 2.2, 3.5, 8.0, 20.0)
#: The least value of an envelope.
LEAST = 1e-6


@dataclass(frozen=True)
class Texture:
    """Which statistics: lags of the autocorrelation, offsets of correlated channels, rates of modulation bands (cycles a sample, each about twice the one before) and their length."""

    channels: int
    lags: tuple[int, ...] = (1, 2)
    offsets: tuple[int, ...] = (1,)
    rates: tuple[float, ...] = (0.05, 0.1, 0.2)
    reach: int = 8
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def margin(self) -> int:
        """Samples that a block needs on either side."""
        return max((*self.lags, 2 * self.reach if self.rates else 0, 1))

    def bands(self) -> np.ndarray:
        """Complex wavelets under a raised cosine, without a mean: a row for each rate."""
        t = np.arange(-self.reach, self.reach + 1)
        w = 0.5 + 0.5 * np.cos(np.pi * t / (self.reach + 1))
        g = np.array([w * np.exp(2j * np.pi * r * t) for r in self.rates]).reshape(len(self.rates), len(t))
        g = g - w * (g.sum(axis=1) / w.sum())[:, None] if len(g) else g
        return g / np.sqrt((np.abs(g) ** 2).sum(axis=1))[:, None] if len(g) else g

    def pairs(self) -> list[tuple[int, int]]:
        return [(i, i + o) for o in self.offsets for i in range(self.channels - o)]


def unpacked(sums: np.ndarray, s: Texture) -> dict[str, np.ndarray]:
    c, k = s.channels, len(s.rates)
    sizes = {"power": (4, c), "product": (c, c), "lag": (len(s.lags), c), "energy": (k, c), "real": (max(k - 1, 0), c), "imag": (max(k - 1, 0), c)}
    out, at = {}, 0
    for name, shape in sizes.items():
        out[name] = sums[at : at + shape[0] * shape[1]].reshape(shape)
        at += shape[0] * shape[1]
    return out


def packed(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.asarray(parts[k], float).reshape(-1) for k in ("power", "product", "lag", "energy", "real", "imag")])


def filtered(wide: np.ndarray, g: np.ndarray) -> np.ndarray:
    """``band, time, channel``: sums of g[o] x[n - o]; the ends, where taps are missing, are left out."""
    n = len(wide) - g.shape[1] + 1
    return np.array([sum(row[o] * wide[g.shape[1] - 1 - o : g.shape[1] - 1 - o + n] for o in range(g.shape[1])) for row in g]).reshape(len(g), n, wide.shape[1])


def sums_of(wide: np.ndarray, s: Texture) -> np.ndarray:
    """A block's part of all sums; ``wide`` has the margin on either side."""
    h, x = s.margin, wide[s.margin : len(wide) - s.margin]
    parts = {"power": np.array([(x**k).sum(axis=0) for k in (1, 2, 3, 4)]), "product": x.T @ x}
    parts["lag"] = np.array([(x * wide[h + k : h + k + len(x)]).sum(axis=0) for k in s.lags])
    a = filtered(wide[h - s.reach : len(wide) - h + s.reach], s.bands()) if s.rates else np.zeros((0, len(x), s.channels), complex)
    c = a * a / np.maximum(np.abs(a), 1e-12)
    cross = (np.conj(c[:-1]) * a[1:]).sum(axis=1)
    return packed(parts | {"energy": (np.abs(a) ** 2).sum(axis=1), "real": cross.real, "imag": cross.imag})


def moments(p: dict[str, np.ndarray], n: float) -> tuple[np.ndarray, ...]:
    m, q2, q3, q4 = p["power"] / n
    v = np.maximum(q2 - m * m, 1e-12)
    return m, v, q3 - 3 * m * q2 + 2 * m**3, q4 - 4 * m * q3 + 6 * m * m * q2 - 3 * m**4


def statistics(sums: np.ndarray, n: float, s: Texture) -> dict[str, np.ndarray]:
    """Mean, squared coefficient of variation, skewness, kurtosis, correlations, autocorrelations, modulation power, and correlations of neighbouring bands."""
    p = unpacked(sums, s)
    m, v, m3, m4 = moments(p, n)
    r = (p["product"] / n - np.outer(m, m)) / np.sqrt(np.outer(v, v))
    both = np.sqrt(np.maximum(p["energy"][:-1] * p["energy"][1:], 1e-24))
    out = {"mean": m, "cv2": v / (m * m), "skew": m3 / v**1.5, "kurt": m4 / v**2, "corr": np.array([r[i, j] for i, j in s.pairs()])}
    return out | {"ac": (p["lag"] / n - m * m) / v, "mod": p["energy"] / (n * v), "c2_real": p["real"] / both, "c2_imag": p["imag"] / both}


def weighted(have: dict[str, np.ndarray], want: dict[str, np.ndarray], s: Texture) -> tuple[float, dict[str, np.ndarray]]:
    """Half the sum over classes of statistics of the squared error over the wanted energy, classes weighed, and its derivatives by statistic."""
    error = {k: s.weights.get(k, 1.0) / max(float((want[k] ** 2).sum()), 1e-12) * (have[k] - want[k]) for k in have}
    return 0.5 * sum(float(((have[k] - want[k]) * e).sum()) for k, e in error.items()), error


def owed(sums: np.ndarray, n: float, e: dict[str, np.ndarray], s: Texture) -> np.ndarray:
    """The cost's derivatives by the sums, from those by the statistics."""
    p = unpacked(sums, s)
    m, v, m3, m4 = moments(p, n)
    q2, q3 = p["power"][1] / n, p["power"][2] / n
    r = (p["product"] / n - np.outer(m, m)) / np.sqrt(np.outer(v, v))
    pair = np.zeros((s.channels, s.channels))
    for k, (i, j) in enumerate(s.pairs()):
        pair[i, j] = e["corr"][k]
    over = pair / np.sqrt(np.outer(v, v))
    ac, mod = (p["lag"] / n - m * m) / v, p["energy"] / (n * v)
    gm = e["mean"] - 2 * e["cv2"] * v / m**3 - over @ m - over.T @ m - 2 * m / v * e["ac"].sum(axis=0)
    gv = e["cv2"] / (m * m) - 1.5 * e["skew"] * m3 / v**2.5 - 2 * e["kurt"] * m4 / v**3
    gv = gv - ((pair + pair.T) * r).sum(axis=1) / (2 * v) - (e["ac"] * ac).sum(axis=0) / v - (e["mod"] * mod).sum(axis=0) / v
    g3, g4 = e["skew"] / v**1.5, e["kurt"] / v**2
    gm = gm - 2 * m * gv + g3 * (6 * m * m - 3 * q2) + g4 * (12 * m * q2 - 4 * q3 - 12 * m**3)
    power = np.array([gm, gv - 3 * m * g3 + 6 * m * m * g4, g3 - 4 * m * g4, g4]) / n
    both = np.sqrt(np.maximum(p["energy"][:-1] * p["energy"][1:], 1e-24))
    share = (e["c2_real"] * p["real"] + e["c2_imag"] * p["imag"]) / both / 2
    energy = e["mod"] / (n * v)
    energy[:-1] -= share / np.maximum(p["energy"][:-1], 1e-12)
    energy[1:] -= share / np.maximum(p["energy"][1:], 1e-12)
    return packed({"power": power, "product": over / n, "lag": e["ac"] / (n * v), "energy": energy, "real": e["c2_real"] / both, "imag": e["c2_imag"] / both})


def gradient_of(wide: np.ndarray, by_sum: np.ndarray, s: Texture) -> np.ndarray:
    """A block's part of the gradient: ``time, channel`` of its own samples."""
    g, h = unpacked(by_sum, s), s.margin
    n = len(wide) - 2 * h
    x = wide[h : h + n]
    out = g["power"][0] + 2 * x * g["power"][1] + 3 * x**2 * g["power"][2] + 4 * x**3 * g["power"][3] + x @ (g["product"] + g["product"].T)
    for k, lag in enumerate(s.lags):
        out = out + g["lag"][k] * (wide[h + lag : h + lag + n] + wide[h - lag : h - lag + n])
    if s.rates:
        taps = s.bands()
        a = filtered(wide[h - 2 * s.reach : len(wide) - h + 2 * s.reach], taps)
        u = a / np.maximum(np.abs(a), 1e-12)
        c, by = a * u, 2 * g["energy"][:, None] * np.conj(a)
        w = (g["real"] + 1j * g["imag"])[:, None]
        by[:-1] += 1.5 * w * np.conj(a[1:]) * u[:-1] - 0.5 * np.conj(w) * a[1:] * np.conj(u[:-1]) ** 3
        by[1:] += np.conj(w) * np.conj(c[:-1])
        out = out + sum(filtered(b, row[None, ::-1])[0] for b, row in zip(by, taps, strict=True)).real
    return out


BLOCK = "block bigint, blocks bigint, n bigint, x binary"


def in_blocks(envelopes: DataFrame, s: Texture, block: int = 4096) -> DataFrame:
    """``stim, block, blocks, n, x`` (binary: the block's samples by channels) from ``stim, channel, n, x``; channels are numbered from 0 and whole."""
    size = max(block, s.margin)
    m = envelopes.groupBy("stim").agg((F.max("n") + 1).alias("m"))
    own = envelopes.join(m, "stim").withColumn("blocks", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("m") / size)))
    own = own.withColumn("block", F.floor((F.col("n") * F.col("blocks") + F.col("blocks") - 1) / F.col("m")).cast("bigint"))
    own = own.withColumn("block", F.least(F.col("block"), F.col("blocks") - 1))
    listed = F.sort_array(F.collect_list(F.struct("n", "channel", F.col("x").cast("double").alias("x"))))
    rows = own.groupBy("stim", "block", "blocks", F.col("m").alias("n")).agg(F.transform(listed, lambda r: r["x"]).alias("_x"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in f["_x"]:
                if len(x) % s.channels:
                    raise ValueError(f"not {s.channels} channels at every time")
            yield f.assign(x=[np.asarray(x, float).tobytes() for x in f["_x"]]).drop(columns="_x")

    kind = envelopes.schema["stim"].dataType.simpleString()
    return rows.mapInPandas(run, f"stim {kind}, {BLOCK}")


def met(blocks: DataFrame, s: Texture, columns: list[str]) -> DataFrame:
    """Blocks with the margins of their neighbours, round the ends: ``stim, block, v`` of role (-1, 0, 1) and what each sent."""
    kind = blocks.schema["stim"].dataType.simpleString()
    sent = ", ".join(f"{c} binary" for c in columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                whole = [np.frombuffer(getattr(r, c)).reshape(-1, s.channels) for c in columns]
                rows.append((r.stim, r.block, r.n, 0, *[x.tobytes() for x in whole]))
                at = np.arange(-s.margin, 0) % len(whole[0])
                rows.append((r.stim, (r.block + 1) % r.blocks, r.n, -1, *[x[at].tobytes() for x in whole]))
                at = np.arange(s.margin) % len(whole[0])
                rows.append((r.stim, (r.block - 1) % r.blocks, r.n, 1, *[x[at].tobytes() for x in whole]))
            yield pd.DataFrame(rows, columns=["stim", "block", "n", "role", *columns])

    parts = blocks.select("stim", "block", "blocks", "n", *columns).mapInPandas(run, f"stim {kind}, block bigint, n bigint, role int, {sent}")
    return parts.groupBy("stim", "block", "n").agg(F.sort_array(F.collect_list(F.struct("role", *columns))).alias("v"))


def widened(v: list, column: str, channels: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(p[column]).reshape(-1, channels) for p in sorted(v, key=lambda p: p["role"])])


def added(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Binary vectors added up by key, first in tasks and then by a shuffle: ``*keys, sums`` as an array."""
    kind = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = f.groupby(keys, sort=False, dropna=False)[column].agg(lambda x: sum(np.frombuffer(b) for b in x)).reset_index()
            yield own.assign(**{column: [x.tolist() for x in own[column]]})

    parts = rows.select(*keys, column).mapInPandas(run, f"{kind}, {column} array<double>")
    cells = parts.select(*keys, F.posexplode(column).alias("_k", "_v")).groupBy(*keys, "_k").agg(F.sum("_v").alias("_v"))
    return cells.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_v"))), lambda r: r["_v"]).alias("sums"))


def measured(blocks: DataFrame, s: Texture) -> DataFrame:
    """``stim, n, sums`` of blocks' envelopes; ``statistics`` makes the texture's statistics of them."""
    kind = blocks.schema["stim"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"stim": f["stim"], "n": f["n"], "part": [sums_of(widened(v, "x", s.channels), s).tobytes() for v in f["v"]]})

    return added(met(blocks, s, ["x"]).mapInPandas(run, f"stim {kind}, n bigint, part binary"), ["stim", "n"], "part")


def snr_db(want: dict[str, np.ndarray], have: dict[str, np.ndarray]) -> float:
    """One over the mean, over classes of statistics, of the squared error over the wanted energy, in dB."""
    shares = [float(((want[k] - have[k]) ** 2).sum()) / max(float((want[k] ** 2).sum()), 1e-12) for k in want if want[k].size]
    return float(-10 * np.log10(max(np.mean(shares), 1e-30)))


def table(measured_: DataFrame, s: Texture) -> DataFrame:
    """``stim, stat, channel, k, value``: the statistics as rows; k is the other channel, the lag, or the number of the band."""
    kind = measured_.schema["stim"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                for name, values in statistics(np.asarray(r.sums), r.n, s).items():
                    if name == "corr":
                        rows += [(r.stim, name, i, j, float(v)) for (i, j), v in zip(s.pairs(), values, strict=True)]
                    else:
                        at = s.lags if name == "ac" else range(len(np.atleast_2d(values)))
                        rows += [(r.stim, name, c, k, float(v)) for k, row in zip(at, np.atleast_2d(values), strict=True) for c, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=["stim", "stat", "channel", "k", "value"])

    return measured_.select("stim", "n", "sums").mapInPandas(run, f"stim {kind}, stat string, channel int, k int, value double")


def impose(start: DataFrame, target: DataFrame, s: Texture, folder: str, *, steps: int = 60, end_db: float = 30.0, block: int = 4096) -> DataFrame:
    """``stim, channel, n, x, snr_db``: positive envelopes ``start`` (``stim, channel, n, x``) moved until their statistics are those that ``target`` (``stim, n, sums``) has.

    First each channel gets the target's mean and variance, which leave most of the others alone. Stops when each stimulus has ``end_db``, or after ``steps``. Each step is Parquet below ``folder``, which a later call
    with the same texture and targets goes on from; of others it makes a folder of its own. A stimulus without a target is left out.
    """
    spark: SparkSession = start.sparkSession
    kind = start.schema["stim"].dataType.simpleString()
    mark = target.agg(F.sum(F.xxhash64("stim", "n", "sums").cast("decimal(38,0)"))).first()[0]
    where = f"{folder}/{hashlib.sha256(json.dumps([str(s), str(mark), block]).encode()).hexdigest()[:16]}"
    state = f"stim {kind}, {BLOCK}, d binary, g binary, step double, cost double, snr_db double, want array<double>, wn bigint, have array<double>"

    def put(df: DataFrame, k: int) -> DataFrame:
        df.select(*[f.split()[0] for f in state.split(", ")]).write.mode("overwrite").parquet(f"{where}/step={k}")
        return spark.read.schema(state).parquet(f"{where}/step={k}")

    def levelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = []
            for r in f.itertuples(index=False):
                m, v, *_ = moments(unpacked(np.asarray(r.have), s), r.n)
                want_m, want_v, *_ = moments(unpacked(np.asarray(r.want), s), r.wn)
                xs.append(np.maximum((np.frombuffer(r.x).reshape(-1, s.channels) - m) * np.sqrt(want_v / v) + want_m, LEAST).tobytes())
            yield f[["stim", "block", "blocks", "n"]].assign(x=xs)

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                want, have = statistics(np.asarray(r.want), r.wn, s), statistics(np.asarray(r.have), r.n, s)
                rows.append((r.stim, weighted(have, want, s)[0], snr_db(want, have)))
            yield pd.DataFrame(rows, columns=["stim", "cost", "snr_db"])

    done = next((k for k in range(steps, -1, -1) if is_whole(spark, f"{where}/step={k}")), -1)
    if done < 0:
        blocks = in_blocks(start, s, block)
        wants = target.select("stim", F.col("n").alias("wn"), F.col("sums").alias("want"))
        level = measured(blocks, s).withColumnRenamed("sums", "have").join(wants, "stim")
        blocks = blocks.join(level.drop("n"), "stim").mapInPandas(levelled, f"stim {kind}, {BLOCK}")
        own = measured(blocks, s).withColumnRenamed("sums", "have").join(wants, "stim")
        scores = own.mapInPandas(judged, f"stim {kind}, cost double, snr_db double")
        first = blocks.join(own.drop("n"), "stim").join(scores, "stim")
        now, done = put(first.withColumns({"d": F.lit(None).cast("binary"), "g": F.lit(None).cast("binary"), "step": F.lit(0.0)}), 0), 0
    else:
        now = spark.read.schema(state).parquet(f"{where}/step={done}")
    while done < steps and now.where(F.col("snr_db") < end_db).select("stim").limit(1).count():
        now, done = put(one_step(now, s, f"{where}/gradient={done}"), done + 1), done + 1

    def tall(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                x = np.frombuffer(r.x).reshape(-1, s.channels)
                first = (r.block * r.n) // r.blocks
                t, c = np.divmod(np.arange(x.size), s.channels)
                yield pd.DataFrame({"stim": r.stim, "channel": c, "n": first + t, "x": x.reshape(-1), "snr_db": r.snr_db})

    return now.select("stim", "block", "blocks", "n", "x", "snr_db").mapInPandas(tall, f"stim {kind}, channel int, n bigint, x double, snr_db double")


def one_step(now: DataFrame, s: Texture, folder: str) -> DataFrame:
    """A step of conjugate gradients (Polak-Ribiere): gradients of blocks, a direction for each stimulus, the best of several lengths along it."""
    spark, kind = now.sparkSession, now.schema["stim"].dataType.simpleString()

    def gradients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples(index=False):
                error = weighted(statistics(np.asarray(r.have), r.n, s), statistics(np.asarray(r.want), r.wn, s), s)[1]
                new = gradient_of(widened(r.v, "x", s.channels), owed(np.asarray(r.have), r.n, error, s), s).reshape(-1)
                old = np.frombuffer(r.g) if r.g is not None else np.zeros_like(new)
                d = np.frombuffer(r.d) if r.d is not None else np.zeros_like(new)
                dots = np.array([new @ (new - old), old @ old, new @ new, new @ d])
                rows.append((r.stim, r.block, new.tobytes(), dots.tobytes()))
            yield pd.DataFrame(rows, columns=["stim", "block", "new", "dots"])

    met_x = met(now, s, ["x"]).drop("n").join(now.select("stim", "block", "n", "d", "g", "want", "wn", "have"), ["stim", "block"])
    made = met_x.mapInPandas(gradients, f"stim {kind}, block bigint, new binary, dots binary")
    made.write.mode("overwrite").parquet(folder)
    made = spark.read.parquet(folder)
    sums = added(made, ["stim"], "dots").select("stim", F.col("sums").alias("dots"))
    rows = now.drop("g").join(made.drop("dots"), ["stim", "block"]).join(sums, "stim")

    def directed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ds, steps = [], []
            for r in f.itertuples(index=False):
                change, old, size, slope = r.dots
                beta = max(0.0, change / old) if old > 0 else 0.0
                if beta * slope >= 0.9 * size:  # no way down
                    beta = 0.0
                new = np.frombuffer(r.new)
                ds.append((-new + (beta * np.frombuffer(r.d) if r.d is not None and beta else 0.0)).tobytes())
                steps.append(r.step if r.step > 0 else min(1e6, 2 * r.cost / max(size, 1e-300)))
            yield f[["stim", "block", "blocks", "n", "x", "cost", "wn", "want"]].assign(d=ds, g=f["new"], step=steps)

    fields = f"stim {kind}, {BLOCK}, cost double, wn bigint, want array<double>, d binary, g binary, step double"
    ahead = rows.mapInPandas(directed, fields)

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                x, d = widened(r.v, "x", s.channels), widened(r.v, "d", s.channels)
                out += [(r.stim, k, sums_of(np.maximum(x + share * r.step * d, LEAST), s).tobytes()) for k, share in enumerate(TRIALS)]
            yield pd.DataFrame(out, columns=["stim", "trial", "part"])

    trials = met(ahead, s, ["x", "d"]).join(ahead.select("stim", "block", "step"), ["stim", "block"])
    found = added(trials.mapInPandas(tried, f"stim {kind}, trial int, part binary"), ["stim", "trial"], "part")

    def chosen(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        want = statistics(np.asarray(f["want"].iloc[0]), f["wn"].iloc[0], s)
        best = None
        for trial, sums in zip(f["trial"], f["sums"], strict=True):
            have = statistics(np.asarray(sums), f["n"].iloc[0], s)
            cost = weighted(have, want, s)[0]
            if np.isfinite(cost) and (best is None or (cost, trial) < best[:2]):
                best = (cost, trial, sums, snr_db(want, have))
        return pd.DataFrame({"stim": [key[0]], "share": [TRIALS[best[1]]], "cost": [best[0]], "have": [list(best[2])], "snr_db": [best[3]]})

    heads = ahead.where("block = 0").select("stim", "n", "wn", "want")
    best = found.join(heads, "stim").groupBy("stim").applyInPandas(chosen, f"stim {kind}, share double, cost double, have array<double>, snr_db double")

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            xs = [np.maximum(np.frombuffer(x) + share * step * np.frombuffer(d), LEAST).tobytes() for x, d, share, step in zip(f["x"], f["d"], f["share"], f["step"], strict=True)]
            # a direction that led nowhere is forgotten, and shorter steps are tried
            stuck = f["share"] == 0
            yield f.assign(x=xs, step=np.where(stuck, f["step"] * 0.01, f["share"] * f["step"]), d=[None if b else d for b, d in zip(stuck, f["d"], strict=True)], g=[None if b else g for b, g in zip(stuck, f["g"], strict=True)]).drop(columns="share")

    moved_fields = f"stim {kind}, {BLOCK}, wn bigint, want array<double>, d binary, g binary, step double, cost double, have array<double>, snr_db double"
    names = [c.split()[0] for c in f"stim {kind}, {BLOCK}, wn bigint, want array<double>, d binary, g binary, step double, cost double, have array<double>, snr_db double, share double".split(", ")]
    return ahead.drop("cost").join(best, "stim").select(*names).mapInPandas(moved, moved_fields)
