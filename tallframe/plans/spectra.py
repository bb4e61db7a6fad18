"""Queries on scales, filterbanks, transforms, texture and models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.functions import columns as C
from tallframe.operators import banks, grid, spectral
from tallframe.plans.common import SAMPLES, Query, rounded
from tallframe.sources.tables import micros, samples, signals, table
from tallframe.streaming.frames import framed



def erb_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values, in tens of Hz, on two ERB scales and back."""
    f = signals(spark, sf_dir).select("event_id", (F.col("x") * 10.0).alias("hz"))
    e, p = C.hz_to_erb(F.col("hz")), C.hz_to_erb_ferret(F.col("hz"))
    return f.select("event_id", rounded(e).alias("erb"), rounded(C.erb_to_hz(e), 4).alias("back"), rounded(p).alias("erb_ferret"), rounded(C.erb_to_hz_ferret(p), 4).alias("back_ferret"))


def log_freq_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", rounded(C.log_frequency(F.col("p_size"), 50.0, 24.0), 4).alias("hz"))


def fft_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of each stimulus's transform: frequencies, and places when they ascend."""
    s = samples(spark, sf_dir)
    k = s.join(grid.lengths(s), "stim")
    return k.select("stim", "n", rounded(C.frequency_bin(F.col("n"), F.col("length"), 100.0)).alias("hz"), C.shifted_bin(F.col("n"), F.col("length")).alias("place"))


def bank(spark: SparkSession, sf_dir: str, b: banks.Bank) -> DataFrame:
    """What each filter passes of each event, whose value stands for about an eighth of a frequency."""
    return banks.lobes_at(signals(spark, sf_dir).select("event_id", (F.col("x") * 8.0 + 0.001).alias("hz")), b, F.col("hz")).select("event_id", "filter", rounded("h").alias("h"))


def erb_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir, banks.erb_bank(12, 50.0, 3900.0))


def erb_filterbank_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir, banks.erb_bank(12, 50.0, 3900.0, 2))


def lin_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir, banks.linear_bank(12, 50.0, 3900.0))


def octave_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir, banks.octave_bank(50.0, 3900.0))


def constq_filterbank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank(spark, sf_dir, banks.constant_q_bank(12, 100.0, 3000.0, 2.0))


def gammatone_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples under a gammatone of 4 Hz that begins with the stimulus."""
    return samples(spark, sf_dir).select("stim", "n", rounded(F.col("x") * C.gammatone(F.col("n") / 200.0, F.lit(4.0)), 6).alias("g"))


def mexican_hat_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra of up to 12 cycles an octave, through a Mexican hat of 2."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return e.select("vec_id", "k", rounded(F.col("x").cast("double") * C.mexican_hat(F.col("k") * (12.0 / 64), 2.0)).alias("h"))


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimuli cut into frames of 64 samples, the last filled with zeros."""
    f = grid.frames(samples(spark, sf_dir), 64, 64)
    own = spectral.arrays(f.select(F.format_string("%d-%d", "stim", "frame").alias("stim"), F.col("pos").alias("n"), "x"))
    return own.select("stim", F.concat("samples", F.array_repeat(F.lit(0.0), F.lit(64) - F.size("samples"))).alias("samples"))


FRAME_BANK = banks.linear_bank(4, 4.0, 28.0)


def subband_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis and synthesis: the frames again."""
    back = spectral.collapse(spectral.subbands(short(spark, sf_dir), FRAME_BANK, 64.0), FRAME_BANK, 64.0)
    return back.select("stim", F.posexplode("samples").alias("n", "x")).select("stim", "n", (rounded("x", 4) + 0.0).alias("x"))


def texture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.texture_statistics(short(spark, sf_dir), FRAME_BANK, banks.octave_bank(0.5, 7.9), 64.0, 16.0, [1, 2])
    return out.select("stim", "stat", "channel", "k", rounded("value", 5).alias("value"))


def mel_spectrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.mel_spectrograms(short(spark, sf_dir), 64.0, 4.0, 10, 32).select("stim", "frame", F.posexplode("v").alias("k", "x")).select("stim", "frame", "k", rounded("x", 5).alias("x"))


def model_infer_standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations of a stand-in network with the time of each, from its layers' receptive fields."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("stim"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    sizes, strides = (4, 3, 2), (2, 2, 2)
    times = spark.createDataFrame(spectral.layer_times(sizes, strides, 0.0, 16.0), "layer int, start double, rate double")
    out = spectral.activations(e, kernels_=sizes, strides=strides, width=4).join(F.broadcast(times), "layer")
    return out.select("stim", "layer", "frame", (F.col("start") + F.col("frame") / F.col("rate")).alias("t"), F.posexplode("v").alias("k", "x")).withColumn("x", rounded("x", 5))


def windowed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of six hours with two hours in front and one behind; the batch twin of the stream."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("stim"), "ts", F.col("value").alias("x"))
    out = framed(events, target=6 * 3600.0, front=2 * 3600.0, back=3600.0)
    return out.select("stim", micros("start").alias("start_us"), "n", rounded("mean").alias("mean"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (erb_scale, log_freq_axis, fft_freqs, erb_filterbank, erb_filterbank_double, lin_filterbank, octave_filterbank, constq_filterbank, gammatone_ir, mexican_hat_tf, subband_collapse, texture_stats, mel_spectrogram, model_infer_standin, windowed_frames)}

ERB = "(9.265 * ln(1 + (%s) / (24.7 * 9.265)))"
FERRET = "(((%s) / 1000.0) ** (1 - 0.533) / (0.31 * (1 - 0.533)))"


def bank_sql(lobes: str, warp: str, gain: str = "1") -> str:
    """``lobes``: a query of filter, low, mid, high."""
    return f"""WITH f AS ({lobes}), g AS (SELECT event_id, {warp} AS w FROM (SELECT event_id, value * 8.0 + 0.001 AS hz FROM events)),
c AS (SELECT event_id, filter, cos((w - mid) / (CASE WHEN w < mid THEN mid - low ELSE high - mid END) * pi() / 2) * {gain} AS h FROM f, g WHERE w > low AND w < high)
SELECT event_id, filter, round(h, 6) AS h FROM c"""


def even(n: int, over: int, scale: str) -> str:
    many = over * (n + 1) - 1
    a, b = scale % "50.0", scale % "3900.0"
    return f"SELECT CAST(k AS INTEGER) AS filter, a + st * (k + 1 - {over}) AS low, a + st * (k + 1) AS mid, a + st * (k + 1 + {over}) AS high FROM (SELECT {a} AS a, ({b} - {a}) / {many + 1} AS st, unnest(range({many})) AS k)"


N67 = f"{SAMPLES}, c AS (SELECT stim, count(*) AS m FROM s GROUP BY stim), t AS (SELECT s.stim, s.n, s.x, c.m FROM s JOIN c USING (stim))"
ORACLES = {
    "erb_scale": f"SELECT event_id, round(e, 6) AS erb, round(24.7 * 9.265 * (exp(e / 9.265) - 1), 4) AS back, round(p, 6) AS erb_ferret, round((p * 0.31 * (1 - 0.533)) ** (1 / (1 - 0.533)) * 1000, 4) AS back_ferret FROM (SELECT event_id, {ERB % 'hz'} AS e, {FERRET % 'hz'} AS p FROM (SELECT event_id, value * 10.0 AS hz FROM events))",
    "log_freq_axis": "SELECT p_partkey, round(pow(2, log2(50) + p_size / 24.0), 4) AS hz FROM part",
    "fft_freqs": f"WITH {N67} SELECT stim, n, round((CASE WHEN n <= m // 2 THEN n ELSE n - m END) * CAST(100 AS DOUBLE) / m, 6) AS hz, (n + (m - 1) // 2) % m AS place FROM t",
    "erb_filterbank": bank_sql(even(12, 1, ERB), ERB % "hz"),
    "erb_filterbank_double": bank_sql(even(12, 2, ERB), ERB % "hz", "sqrt(0.5)"),
    "lin_filterbank": bank_sql(even(12, 1, "(%s)::DOUBLE"), "hz"),
    "octave_filterbank": bank_sql("SELECT CAST(row_number() OVER (ORDER BY m) - 1 AS INTEGER) AS filter, m - 1 AS low, m + 0.5 AS mid, m + 2 AS high FROM (SELECT log2(3900.0 / 2 ** unnest(range(1, 21))) AS m) WHERE m > log2(50.0)", "log2(greatest(hz, 1e-12))"),
    "constq_filterbank": bank_sql("SELECT CAST(k AS INTEGER) AS filter, c / 2 AS low, c AS mid, c * 1.5 AS high FROM (SELECT k, 2 ** (log2(100.0) + k * (log2(3000.0) - log2(100.0)) / 11) AS c FROM (SELECT unnest(range(12)) AS k))", "hz"),
    "gammatone_ir": f"WITH {SAMPLES} SELECT stim, n, round(x * sin(8 * pi() * t) * (4 * t) ** 2 * exp(-14 * t), 6) AS g FROM (SELECT *, n / 200.0 AS t FROM s)",
    "mexican_hat_tf": "SELECT vec_id, CAST(k AS INTEGER) AS k, round(x * g * exp(1 - g), 6) AS h FROM (SELECT vec_id, k, x, (k * 0.1875 / 2) ** 2 AS g FROM (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings))",
    "subband_collapse": f"""WITH {N67}, g AS (SELECT DISTINCT stim, m, unnest(range(CASE WHEN m <= 64 THEN 1 ELSE CAST(ceil((m - 64) / 64.0) AS BIGINT) + 1 END)) AS frame FROM c), p AS (SELECT *, unnest(range(64)) AS n FROM g)
SELECT p.stim || '-' || frame AS stim, CAST(p.n AS INTEGER) AS n, round(coalesce(s.x, 0), 4) + 0.0 AS x FROM p LEFT JOIN s ON s.stim = p.stim AND s.n = frame * 64 + p.n""",
    "mel_spectrogram": f"""WITH {N67}, g AS (SELECT DISTINCT stim, unnest(range(CASE WHEN m <= 64 THEN 1 ELSE CAST(ceil((m - 64) / 64.0) AS BIGINT) + 1 END)) AS part FROM c),
f AS (SELECT stim, part, frame, j, part * 64 + frame * 16 + j - 16 AS n, frame * 16 + j - 16 AS own FROM g, (SELECT unnest(range(4)) AS frame), (SELECT unnest(range(32)) AS j)),
w AS (SELECT f.stim, part, frame, j, CASE WHEN own BETWEEN 0 AND 63 THEN coalesce(s.x, 0) ELSE 0 END * (0.5 - 0.5 * cos(2 * pi() * j / 31)) AS x FROM f LEFT JOIN s ON s.stim = f.stim AND s.n = f.n),
d AS (SELECT stim, part, frame, k, sum(x * cos(2 * pi() * ((j * k) % 32) / 32)) ** 2 + sum(x * sin(2 * pi() * ((j * k) % 32) / 32)) ** 2 AS p FROM w, (SELECT unnest(range(17)) AS k) GROUP BY stim, part, frame, k),
tri AS (SELECT k, b, greatest(0, 1 - abs(2595 * log10(1 + 2 * k / 700.0) - (b + 1) * st) / st) AS h FROM (SELECT unnest(range(17)) AS k), (SELECT unnest(range(10)) AS b), (SELECT 2595 * log10(1 + 32 / 700.0) / 11 AS st))
SELECT stim || '-' || part AS stim, frame, CAST(b AS INTEGER) AS k, round(log10(sum(p * h) + 1e-10), 5) AS x FROM d JOIN tri USING (k) GROUP BY stim, part, frame, b""",
    "windowed_frames": """WITH e AS (SELECT user_id AS stim, epoch_us(ts) AS us, value AS x FROM events), k AS (SELECT unnest([0, 1]) AS k),
f AS (SELECT stim, us, x, ((us - 14400000000) // 21600000000 - k) * 21600000000 + 14400000000 AS start_us FROM e, k)
SELECT stim, start_us, count(*) AS n, round(avg(x), 6) AS mean FROM f WHERE us < start_us + 32400000000 GROUP BY stim, start_us""",
}
