"""Queries on whole signals: transforms, subbands, cochleagrams, wavelets, resampling, gaps and exact medians, none of which gathers a stimulus."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import banks, cochlea, grid, modulation, pca, prepare, repeats, resample, selection, texture, transform
from tallframe.operators.kernels import spectral_filter
from tallframe.plans.common import SAMPLES, Query, rounded, values
from tallframe.session import checkpointed, shared_folder, stored
from tallframe.sources import wav
from tallframe.sources.tables import micros, samples, signals, table
from tallframe.streaming.statistics import covariance_so_far, keep_sums

SR, ENV_SR, SPACING, POWER = 64.0, 16.0, 0.25, 0.3
BANK = banks.linear_bank(4, 4.0, 28.0)
RATES, WAVELET_SR = [0.0, 2.0, 4.0, 8.0, 16.0, 32.0], 100.0
LAGS = 8


def measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``samples``, and how many the longest stimulus has, counted without numbering them."""
    counts = signals(spark, sf_dir).groupBy("stim").agg(F.count("*").alias("m"))
    return samples(spark, sf_dir), counts.agg(F.max("m")).first()[0] or 0


def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    return transform.magnitudes(own, longest).select("stim", "bin", rounded("magnitude", 4).alias("magnitude"))


def circular_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    return transform.circular_autocorrelation(own, longest).select("stim", "lag", rounded("ac", 4).alias("ac"))


def hilbert_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    return transform.analytic(own, longest).select("stim", "n", rounded(F.hypot("re", "im"), 4).alias("x"))


def noise_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The magnitudes of spectrally matched noise, which are those of the stimulus."""
    own, longest = measured(spark, sf_dir)
    return transform.magnitudes(transform.matched_noise(own, longest=longest), longest).select("stim", "bin", rounded("magnitude", 4).alias("magnitude"))


def subband_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    return transform.subbands(own, BANK, SR, longest=longest).select("stim", "channel", "n", rounded("re", 4).alias("x"))


def band_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis and synthesis of whole stimuli: the samples again."""
    own, longest = measured(spark, sf_dir)
    bands = transform.subbands(own, BANK, SR, longest=longest).select("stim", "channel", "n", F.col("re").alias("x"))
    return transform.collapsed(bands, BANK, SR, longest).select("stim", "n", rounded("x", 4).alias("x"))


def cochleagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    env = cochlea.envelopes(own, BANK, SR, power=POWER, longest=longest)
    return cochlea.cochleagram(env, BANK, 1, 4, spacing=SPACING, longest=longest).select("stim", "frame", "k", rounded("x", 5).alias("x"))


def coch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cochleagram turned back into sound with the phases and errors kept beside it."""
    own, longest = measured(spark, sf_dir)
    env = stored(cochlea.envelopes(own, BANK, SR, power=POWER, longest=longest))
    coch = stored(cochlea.cochleagram(env, BANK, 1, 4, spacing=SPACING, longest=longest))
    rest = cochlea.with_rest(env, coch, BANK, 1, 4, spacing=SPACING, longest=longest)
    back = cochlea.waveform(coch, rest, BANK, SR, 1, 4, power=POWER, spacing=SPACING, longest=longest)
    return back.select("stim", "n", rounded("x", 4).alias("x"))


def wavelet_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    return cochlea.wavelets(own, RATES, WAVELET_SR, longest).select("stim", "filter", "n", rounded("x", 4).alias("x"))


def wavelet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    bands = cochlea.wavelets(own, RATES, WAVELET_SR, longest)
    return cochlea.from_wavelets(bands, RATES, WAVELET_SR, longest=longest).select("stim", "n", rounded("x", 4).alias("x"))


def resample_rational(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, longest = measured(spark, sf_dir)
    return resample.resampled(own, 3, 2, longest=longest).select("stim", "n", rounded("x", 5).alias("x"))


def resample_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as frames by features, at half the rate along features and three quarters along frames."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("feature", "x"))
    half = resample.resampled(cells, 1, 2, axis="feature", keys=["frame"])
    return resample.resampled(half, 3, 4, axis="frame", keys=["feature"]).select("frame", "feature", rounded("x", 5).alias("x"))


def pchip_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, null or NaN, filled by monotone cubic pieces."""
    x = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("x"))
    return grid.filled(samples(spark, sf_dir).withColumn("x", x), method="pchip", bucket=16).select("stim", "n", rounded("x", 5).alias("x"))


def pchip_log_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as spectra of 64 even frequencies, brought to a quarter of an octave."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "x")).withColumn("octave", F.log2(F.col("feature") + 1.0))
    out = resample.pchip(cells, ["vec_id"], "octave", "x", step=SPACING, bucket=None)
    return out.select("vec_id", "k", rounded("x", 5).alias("x"))


def windowed_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Autocorrelation between zeros under a window, with the window's own divided out."""
    return grid.windowed_autocorrelation(samples(spark, sf_dir), LAGS, window="hamming", undo=True).select("stim", "lag", rounded("ac", 4).alias("ac"))


def nan_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, counts and medians over a user's days of values of which some are NaN, some null."""
    x = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 != 0, F.col("x"))
    own = samples(spark, sf_dir).select("label", (F.col("us") / 86_400_000_000).cast("int").alias("day"), x.alias("x"))
    means = repeats.mean_of_repeats(own, ["label", "day"]).select("label", "day", rounded("x").alias("mean"), "n_repeats")
    return means.join(repeats.median_of(own, ["label", "day"]).select("label", "day", rounded("x").alias("median")), ["label", "day"])


def event_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of groups that are far larger than what is sorted together."""
    return selection.median(samples(spark, sf_dir), ["label"], few=64).select("label", rounded("x").alias("x"))


def pca_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first components of embeddings, found without their covariances: eigenvalues and the share of all variance."""
    e = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return pca.fit_leading(e, 5).select("k", rounded("value", 5).alias("value"))


def event_features(events: DataFrame) -> DataFrame:
    """``v``: an event's value, hour and day."""
    us = micros("ts")
    return events.select(F.array(F.col("value"), F.floor(us / 3_600_000_000) % 24, F.floor(us / 86_400_000_000) - 19_723).cast("array<double>").alias("v"))


def stream_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances that a stream of events leaves, read to its end."""
    path, folder = f"{sf_dir}/events.parquet", f"{shared_folder(spark)}/stream_covariance-{uuid.uuid4()}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(f"{path}*")
    keep_sums(event_features(events), f"{folder}/sums", f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return covariance_so_far(spark, f"{folder}/sums").select("i", "j", rounded("cov", 4).alias("cov"))


def wav_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as recordings in ranges and read back in ranges of another size, in 512ths of 16 bits; values beyond 512 take more, so files have 32."""
    spark.dataSource.register(wav.WavSource)
    folder = f"{shared_folder(spark)}/wav_ranges-{uuid.uuid4()}"
    scaled = samples(spark, sf_dir).select("stim", "n", (F.col("x") / (512 << 16)).alias("x"))
    wav.in_ranges(scaled, 50).write.format("wav").option("sr", 100).option("bits", 32).option("range", 50).mode("append").save(folder.removeprefix("file://"))
    back = spark.read.format("wav").option("range", 32).load(folder.removeprefix("file://"))
    return back.select(F.col("stim").cast("bigint").alias("stim"), "n", (F.col("x") * (1 << 31)).cast("bigint").alias("level"))


TEXTURE = texture.Texture(4, lags=(1, 2), offsets=(1, 2), rates=(0.06, 0.12, 0.24), reach=5)


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as envelopes ``stim, channel, n, x``: groups of users by their numbers, in bins of eight hours, with the values of each 160 minutes as channels."""
    third = F.floor((F.col("us") - 1_704_067_200_000_000) / 7_200_000_000)
    cells = signals(spark, sf_dir).select(F.pmod("stim", F.lit(8)).alias("stim"), F.pmod(third, F.lit(4)).cast("int").alias("channel"), F.floor(third / 4).alias("n"), "x")
    sums = cells.groupBy("stim", "channel", "n").agg((F.sum("x") / 100).alias("x"))
    ends = sums.agg(F.max("n").alias("last"))
    grid_ = sums.select("stim").distinct().crossJoin(F.broadcast(ends)).select("stim", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("n"), F.explode(F.array(*map(F.lit, range(4)))).alias("channel"))
    return grid_.join(sums, ["stim", "channel", "n"], "left").select("stim", "channel", "n", (F.coalesce("x", F.lit(0.0)) + 0.5).alias("x"))


def texture_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of envelopes in blocks: moments, correlations, autocorrelations, modulation power and correlations of bands."""
    found = texture.table(texture.measured(texture.in_blocks(shifts(spark, sf_dir), TEXTURE, 24), TEXTURE), TEXTURE)
    return found.select("stim", "stat", "channel", "k", rounded("value", 5).alias("value"))


def texture_imposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' envelopes moved towards the statistics of the next group's, a few steps: whether each came nearer."""
    start = shifts(spark, sf_dir)
    sums = checkpointed(texture.measured(texture.in_blocks(start, TEXTURE, 24), TEXTURE))
    target = sums.withColumn("stim", F.pmod(F.col("stim") + 1, F.lit(8)))
    folder = f"{shared_folder(spark)}/texture_imposed-{uuid.uuid4()}"
    before = texture.impose(start, target, TEXTURE, folder, steps=0, block=24).groupBy("stim").agg(F.max("snr_db").alias("before"))
    after = texture.impose(start, target, TEXTURE, folder, steps=3, block=24).groupBy("stim").agg(F.max("snr_db").alias("after"), F.count("*").alias("cells"))
    return before.join(after, "stim").select("stim", "cells", (F.col("after") > F.col("before")).alias("nearer"))


FILTERED = modulation.Filters(4, ((0.0, 0.0, 1), (2.0, 1.0, 1), (2.0, 1.0, -1), (4.0, None, 1)), 16.0, 4.0)
COVERING = modulation.Filters(4, tuple((r, c, sign) for c in (0.0, 0.5, 1.0) for r in (0.0, 1.0, 2.0, 4.0) for sign in (1, -1)), 16.0, 4.0)


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelopes of ``shifts`` as cochleagrams."""
    return shifts(spark, sf_dir).select("stim", F.col("n").alias("frame"), F.col("channel").alias("k"), "x")


def modulation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modulation.filtered(planes(spark, sf_dir), FILTERED).select("stim", "filter", "frame", "k", (rounded("x", 5) + 0.0).alias("x"))


def filter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = modulation.filtered(planes(spark, sf_dir), COVERING)
    return modulation.put_together(bands, COVERING).select("stim", "frame", "k", rounded("x", 4).alias("x"))


def modulation_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of synthesis: cochleagrams whose filtered versions have taken on the values of the next group's, with what cancels given back."""
    own = planes(spark, sf_dir)
    other = own.withColumn("stim", F.pmod(F.col("stim") + 1, F.lit(8)))
    return modulation.matched(own, other, FILTERED, width=1.0, cancellation=True).select("stim", "frame", "k", rounded("x", 4).alias("x"))


def formatted_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimuli cut to 60 samples, at two thirds of the rate and a root mean square of 0.01."""
    return prepare.formatted(samples(spark, sf_dir), 60, 2, 3).select("stim", "n", rounded("x", 7).alias("x"))


def measured_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stimuli cut to multiples of eight samples, 50 at most."""
    return prepare.measured_sound(samples(spark, sf_dir), 4, most=50).select("stim", "n", rounded("x", 7).alias("x"))


def padded_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.padded_plane(planes(spark, sf_dir), 3, 2).select("stim", "frame", "k", rounded("x", 5).alias("x"))


def unpadded_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = prepare.padded_plane(planes(spark, sf_dir), 3, 2, value=0.0)
    return prepare.unpadded_plane(padded, 2.8, 2, most=40.5).select("stim", "frame", "k", rounded("x", 5).alias("x"))


def loudest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day of the largest sum of values."""
    days = signals(spark, sf_dir).groupBy("stim", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg(rounded(F.sum("x"), 2).alias("x"))
    return prepare.largest(days, ["stim"], "day")


def converged_stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether moments of two halves of a supplier's quantities are as near as 25 dB."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stim"), "l_returnflag", "l_quantity")
    means = line.groupBy("stim", "l_returnflag").agg(F.avg("l_quantity").alias("x"))
    whole = line.groupBy("stim").agg(F.avg("l_quantity").alias("all"))
    ratio = means.join(whole, "stim").select("stim", (-20 * F.log10(F.abs(F.col("x") - F.col("all")) / F.col("all") + 1e-9)).alias("snr_db"))
    return prepare.convergence(ratio, 25.0, flag="l_returnflag").select("stim", rounded("snr_db", 4).alias("snr_db"), "converged")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (dft_magnitude, circular_autocorr, hilbert_envelope, noise_spectrum, subband_filter, band_collapse, cochleagram, coch_roundtrip, wavelet_bands, wavelet_roundtrip, resample_rational, resample_axes, pchip_gap, pchip_log_axis, windowed_autocorr, nan_repeats, event_median, pca_leading, stream_covariance, wav_ranges, texture_sums, texture_imposed, modulation_filter, filter_roundtrip, modulation_matched, formatted_waves, measured_sounds, padded_planes, unpadded_planes, loudest_days, converged_stimuli)
}

TIMES = f"{SAMPLES}, c AS (SELECT stim, count(*) AS m FROM s GROUP BY stim), t AS (SELECT s.stim, s.n, s.x, c.m FROM s JOIN c USING (stim))"
DFT = f"{TIMES}, d AS (SELECT a.stim, b.n AS k, any_value(a.m) AS m, sum(a.x * cos(2 * pi() * ((a.n * b.n) % a.m) / a.m)) AS re, -sum(a.x * sin(2 * pi() * ((a.n * b.n) % a.m) / a.m)) AS im FROM t a JOIN t b ON a.stim = b.stim GROUP BY a.stim, b.n)"
#: The bank's rows: its lobes, and the complements of the first and the last.
LOBES = values([(0, 1, *BANK.lobes[0]), *((k + 1, 0, *x) for k, x in enumerate(BANK.lobes)), (len(BANK.lobes) + 1, 2, *BANK.lobes[-1])], "channel, side, low, mid, high")
HALF = "CASE WHEN f < mid THEN mid - low ELSE high - mid END"
RESPONSES = f"""b AS (SELECT * FROM {LOBES}),
q AS (SELECT d.*, b.*, least(k, m - k) * {SR} / m AS f FROM d, b),
p AS (SELECT *, CASE WHEN f > low AND f < high THEN cos((f - mid) / ({HALF}) * pi() / 2) ELSE 0 END AS lobe FROM q),
h AS (SELECT stim, channel, k, m, re, im, CASE WHEN side = 0 THEN lobe WHEN (side = 1 AND f < mid) OR (side = 2 AND f > mid) THEN sqrt(greatest(0, 1 - lobe * lobe)) ELSE 0 END AS h FROM p)"""
TURN = "2 * pi() * ((h.k * t.n) % t.m) / t.m"
WEIGHT = "CASE WHEN h.k = 0 OR 2 * h.k = h.m THEN 1 WHEN 2 * h.k < h.m THEN 2 ELSE 0 END"
ANALYTIC = f"""y AS (SELECT t.stim, channel, t.n, any_value(t.m) AS m, sum({WEIGHT} * h * (re * cos({TURN}) - im * sin({TURN}))) / any_value(t.m) AS re, sum({WEIGHT} * h * (re * sin({TURN}) + im * cos({TURN}))) / any_value(t.m) AS im
      FROM t JOIN h USING (stim) GROUP BY t.stim, channel, t.n)"""


def taps_sql(up: int, down: int) -> str:
    """``phase, shift, w`` of the windowed sinc, in SQL's own arithmetic."""
    cut = min(1.0, up / down)
    reach = math.ceil(16 / cut)
    return f"""(SELECT phase, shift, w / sum(w) OVER (PARTITION BY phase) AS w FROM (SELECT phase, phase * {down} // {up} + o AS shift,
CASE WHEN abs(u) >= 16 THEN 0 WHEN u = 0 THEN 1 ELSE sin(pi() * u) / (pi() * u) * cos(pi() * u / 32) ** 2 END AS w
FROM (SELECT phase, o, (phase * {down} % {up} / {float(up)} - o) * {cut} AS u FROM (SELECT unnest(range({up})) AS phase), (SELECT unnest(range({-reach}, {reach + 1})) AS o))))"""


def resample_sql(source: str, keys: str, axis: str, up: int, down: int) -> str:
    """A query of ``keys, axis, x`` at another rate."""
    on = " AND ".join(f"v.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {', '.join('g.' + k.strip() for k in keys.split(','))}, g.j AS {axis}, sum(v.x * w) AS x
FROM (SELECT {keys}, m, unnest(range(CAST(floor(m * {up} / {float(down)} + 0.5) AS BIGINT))) AS j FROM (SELECT {keys}, max({axis}) + 1 AS m FROM {source} GROUP BY {keys})) g
JOIN {taps_sql(up, down)} a ON a.phase = g.j % {up} JOIN {source} v ON {on} AND v.{axis} = greatest(0, least(m - 1, {down} * (g.j // {up}) + shift)) GROUP BY {', '.join('g.' + k.strip() for k in keys.split(','))}, g.j"""


def pchip_sql(points: str, keys: str, grid_: str, limits: bool = False) -> str:
    """A query of ``keys, k, x``: ``points`` has keys, p, y; ``grid_`` is keys, k, g (the place of k)."""
    w = f"(PARTITION BY {keys} ORDER BY p)"
    inner = "CASE WHEN {d0} * {d1} > 0 THEN (3 * {h0} + 3 * {h1}) / ((2 * {h1} + {h0}) / {d0} + ({h1} + 2 * {h0}) / {d1}) ELSE 0 END"
    end = "CASE WHEN sign({e}) <> sign({d0}) THEN 0 WHEN sign({d0}) <> sign({d1}) AND abs({e}) > 3 * abs({d0}) THEN 3 * {d0} ELSE {e} END"
    e = "(((2 * {h0} + {h1}) * {d0} - {h0} * {d1}) / ({h0} + {h1}))"

    def ended(h0: str, d0: str, h1: str, d1: str) -> str:
        names = {"h0": h0, "d0": d0, "h1": h1, "d1": d1}
        return end.format(e=e.format(**names), **names)

    def mid(h0: str, d0: str, h1: str, d1: str) -> str:
        return inner.format(h0=h0, d0=d0, h1=h1, d1=d1)

    key = keys.split(", ")
    on = " AND ".join(f"g.{c} = i.{c}" for c in key)
    last = "q IS NULL AND g.g = p" if not limits else "false"
    return f"""SELECT {keys}, k, CASE WHEN h IS NULL THEN y ELSE y * (1 + 2 * t) * (1 - t) ** 2 + h * a * t * (1 - t) ** 2 + y1 * t * t * (3 - 2 * t) + h * b * t * t * (t - 1) END AS x
FROM (SELECT g.*, i.* EXCLUDE ({keys}), (g.g - i.p) / i.h AS t FROM ({grid_}) g JOIN (
  SELECT {keys}, p, q, y, y1, h, CASE WHEN d0 IS NULL AND d2 IS NULL THEN d WHEN d0 IS NULL THEN {ended('h', 'd', 'h2', 'd2')} ELSE {mid('h0', 'd0', 'h', 'd')} END AS a,
         CASE WHEN d0 IS NULL AND d2 IS NULL THEN d WHEN d2 IS NULL THEN {ended('h', 'd', 'h0', 'd0')} ELSE {mid('h', 'd', 'h2', 'd2')} END AS b, h0, h2
  FROM (SELECT *, lag(h) OVER {w} AS h0, lag(d) OVER {w} AS d0, lead(h) OVER {w} AS h2, lead(d) OVER {w} AS d2
        FROM (SELECT {keys}, p, y, lead(p) OVER {w} AS q, lead(y) OVER {w} AS y1, lead(p) OVER {w} - p AS h, (lead(y) OVER {w} - y) / (lead(p) OVER {w} - p) AS d FROM ({points})))) i
  ON {on} AND (({'h0 IS NULL OR ' if limits else ''}g.g >= p) AND ({'h2 IS NULL OR ' if limits else ''}g.g < q) AND q IS NOT NULL OR {last if not limits else 'h0 IS NULL AND q IS NULL'}))"""


OWN = cochlea.places(BANK)
CENTRES = values([(k, v) for k, v in OWN], "channel, octave")
COCH = f"""WITH {DFT}, {RESPONSES}, {ANALYTIC}, v AS (SELECT stim, channel, n, sqrt(re * re + im * im) ** {POWER} AS x FROM y),
r AS ({resample_sql('v', 'stim, channel', 'n', 1, 4)}), g AS (SELECT DISTINCT stim, n AS frame FROM r), o AS (SELECT * FROM {CENTRES}),
z AS ({pchip_sql("SELECT stim, n AS frame, octave AS p, greatest(x, 0) AS y FROM r JOIN o USING (channel)", "stim, frame", f"SELECT stim, frame, k, {OWN[0][1]!r} + k * {SPACING} AS g FROM g, (SELECT unnest(range({math.floor((OWN[-1][1] - OWN[0][1]) / SPACING) + 1})) AS k)")})
SELECT stim, frame, k, round(greatest(x, 0), 5) AS x FROM z"""
WAVES = values([(k, r) for k, r in enumerate(RATES)], "filter, rate")
WAVELETS = f"""WITH {TIMES}, w AS (SELECT * FROM {WAVES}), l AS (SELECT DISTINCT m FROM t), a AS (SELECT m, filter, rate, unnest(range(m)) AS j FROM l, w WHERE rate > 0),
u AS (SELECT m, filter, j, (CAST(j + round(2 / 3.5 * {WAVELET_SR} / rate) AS BIGINT) % m) / {WAVELET_SR} * rate AS t FROM a), g AS (SELECT m, filter, j, t * t * exp(-3.5 * t) * sin(2 * pi() * t) AS g FROM u),
f AS (SELECT a.m, a.filter, b.j AS k, sqrt(sum(a.g * cos(2 * pi() * ((a.j * b.j) % a.m) / a.m)) ** 2 + sum(a.g * sin(2 * pi() * ((a.j * b.j) % a.m) / a.m)) ** 2) AS f FROM g a JOIN g b USING (m, filter) GROUP BY a.m, a.filter, b.j),
p AS (SELECT m, filter, max(f) AS top FROM f GROUP BY m, filter)
SELECT a.stim, g.filter, a.n, round(sum(b.x * g.g / top), 4) AS x FROM t a JOIN t b ON a.stim = b.stim JOIN g ON g.m = a.m AND g.j = (a.n - b.n + a.m) % a.m JOIN p ON p.m = g.m AND p.filter = g.filter GROUP BY a.stim, g.filter, a.n
UNION ALL SELECT stim, 0, n, round(avg(x) OVER (PARTITION BY stim), 4) FROM t"""
SAME = f"WITH {SAMPLES} SELECT stim, n, round(x, 4) AS x FROM s"
GAPS = f"{SAMPLES}, v AS (SELECT stim, n, x FROM s WHERE event_id % 17 <> 0 AND event_id % 19 <> 0)"
TAPS = values([(k, o, float(g.real), float(g.imag)) for k, row in enumerate(TEXTURE.bands()) for o, g in zip(range(-TEXTURE.reach, TEXTURE.reach + 1), row, strict=True)], "k, o, gr, gi")
SHIFTS = f"""{SAMPLES}, u AS (SELECT stim % 8 AS stim, (us - 1704067200000000) // 7200000000 AS q, x FROM s), v AS (SELECT stim, CAST(q % 4 AS INTEGER) AS channel, q // 4 AS n, sum(x) / 100 AS x FROM u GROUP BY 1, 2, 3),
e AS (SELECT g.stim, g.channel, g.n, g.m, coalesce(v.x, 0) + 0.5 AS x FROM (SELECT stim, m, unnest(range(m)) AS n, channel FROM (SELECT DISTINCT stim FROM v), (SELECT max(n) + 1 AS m FROM v), (SELECT unnest([0, 1, 2, 3]) AS channel)) g LEFT JOIN v ON v.stim = g.stim AND v.channel = g.channel AND v.n = g.n)"""
MOD_RATES = values([(0, 2.0), (1, 4.0)], "rate, hz")
#: Each filter's rate (-2 passes the mean alone, -1 all) and direction, and what it passes of each frequency over channels.
MOD_FILTERS = values([(k, -1 if r is None else -2 if r == 0 else [2.0, 4.0].index(r), sign if r is not None and c is not None else 0, f, float(h)) for k, (r, c, sign) in enumerate(FILTERED.each) for f, h in enumerate(spectral_filter(c, 4, 4.0) if c is not None else [1.0] * 4)], "filter, rate, directed, f, h")
ANGLE = "2 * pi() * (((e.n * b.t) % e.m) / CAST(e.m AS DOUBLE) + ((e.channel * b.f) % 4) / 4.0)"
def levelled_sql(source: str, level: float = 0.01) -> str:
    return f"SELECT stim, n, round(x * {level} / nullif(sqrt(avg(x * x) OVER (PARTITION BY stim)), 0), 7) AS x FROM ({source})"


PADDED = f"""{SHIFTS}, a AS (SELECT stim, any_value(m) AS m, avg(x) AS a FROM e GROUP BY stim),
p AS (SELECT g.stim, g.frame, g.k, e.x, a FROM (SELECT stim, a, frame, unnest(range(6)) AS k FROM (SELECT stim, a, unnest(range(m + 3)) AS frame FROM a)) g LEFT JOIN e ON e.stim = g.stim AND e.n = g.frame - 3 AND e.channel = g.k - 2)"""
ORACLES = {
    "formatted_waves": f"WITH {SAMPLES}, v AS (SELECT stim, n, x FROM s WHERE n < 60) {levelled_sql(resample_sql('v', 'stim', 'n', 2, 3))}",
    "measured_sounds": f"""WITH {TIMES}, l AS (SELECT stim, m, m + m % 2 AS w FROM c), k AS (SELECT stim, m, CASE WHEN 50 > w THEN w // 8 * 8 WHEN 56 > w THEN 48 ELSE 56 END AS l FROM l)
{levelled_sql("SELECT k.stim, g.n, coalesce(s.x, 0) AS x FROM (SELECT stim, unnest(range(l)) AS n FROM k) g JOIN k USING (stim) LEFT JOIN s ON s.stim = g.stim AND s.n = g.n")}""",
    "padded_planes": f"WITH {PADDED} SELECT stim, frame, CAST(k AS INTEGER) AS k, round(coalesce(x, a), 5) AS x FROM p",
    "unpadded_planes": f"WITH {SHIFTS} SELECT stim, n AS frame, channel AS k, round(x, 5) AS x FROM e WHERE n < 40",
    "loudest_days": """WITH d AS (SELECT user_id AS stim, epoch_us(ts) // 86400000000 AS day, round(sum(value), 2) AS x FROM events GROUP BY 1, 2)
SELECT stim, day, x FROM (SELECT *, row_number() OVER (PARTITION BY stim ORDER BY x DESC, day) AS r FROM d) WHERE r = 1""",
    "converged_stimuli": """WITH m AS (SELECT l_suppkey AS stim, l_returnflag, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), w AS (SELECT l_suppkey AS stim, avg(l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT stim, round(min(-20 * log10(abs(x - a) / a + 1e-9)), 4) AS snr_db, min(-20 * log10(abs(x - a) / a + 1e-9)) >= 25 AS converged FROM m JOIN w USING (stim) GROUP BY stim""",
    "modulation_filter": f"""WITH {SHIFTS}, b AS (SELECT m, t, f FROM (SELECT m, unnest(range(m)) AS t FROM (SELECT DISTINCT m FROM e)), (SELECT unnest([0, 1, 2, 3]) AS f)),
d AS (SELECT e.stim, b.t, b.f, sum(x * cos({ANGLE})) AS re, -sum(x * sin({ANGLE})) AS im FROM e JOIN b ON b.m = e.m GROUP BY e.stim, b.t, b.f),
a AS (SELECT rate, m, t AS j, t / 16.0 * hz AS u FROM b, (SELECT * FROM {MOD_RATES}) WHERE f = 0), g AS (SELECT rate, m, j, u * u * exp(-3.5 * u) * sin(2 * pi() * u) AS g FROM a),
q AS (SELECT p.rate, r.j AS t, sum(p.g * cos(2 * pi() * ((p.j * r.j) % p.m) / p.m)) AS re, -sum(p.g * sin(2 * pi() * ((p.j * r.j) % p.m) / p.m)) AS im FROM g p JOIN g r ON p.rate = r.rate GROUP BY p.rate, r.j),
o AS (SELECT rate, max(sqrt(re * re + im * im)) AS o FROM q GROUP BY rate),
w AS (SELECT rate, t, re / o AS hre, im / o AS him FROM q JOIN o USING (rate) UNION ALL SELECT -1, t, 1, 0 FROM b WHERE f = 0 UNION ALL SELECT -2, 0, 1, 0),
h AS (SELECT filter, w.t, x.f, hre * h AS hre, him * h AS him FROM w JOIN (SELECT * FROM {MOD_FILTERS}) x ON x.rate = w.rate, (SELECT DISTINCT m FROM e) k
      WHERE directed = 0 OR (CASE WHEN w.t = 0 OR 2 * w.t = m THEN 0 WHEN 2 * w.t < m THEN 1 ELSE -1 END) * (CASE x.f WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) <> -directed),
b2 AS (SELECT stim, filter, d.t, d.f, re * hre - im * him AS re, re * him + im * hre AS im FROM d JOIN h ON h.t = d.t AND h.f = d.f)
SELECT e.stim, b.filter, e.n AS frame, e.channel AS k, round(sum(re * cos({ANGLE}) - im * sin({ANGLE})) / any_value(e.m * 4), 5) + 0.0 AS x FROM e JOIN b2 b ON b.stim = e.stim GROUP BY e.stim, b.filter, e.n, e.channel""",
    "filter_roundtrip": f"WITH {SHIFTS} SELECT stim, n AS frame, channel AS k, round(x, 4) AS x FROM e",
    "texture_imposed": f"WITH {SHIFTS} SELECT stim, count(*) AS cells, true AS nearer FROM e GROUP BY stim",
    "texture_sums": f"""WITH {SHIFTS}, p AS (SELECT stim, channel, any_value(m) AS m, avg(x) AS a, var_pop(x) AS v FROM e GROUP BY stim, channel), d AS (SELECT e.*, x - a AS d, a, v FROM e JOIN p USING (stim, channel)),
b AS (SELECT e.stim, e.channel, k, e.n, sum(gr * f.x) AS ar, sum(gi * f.x) AS ai FROM e, (SELECT * FROM {TAPS}), e f WHERE f.stim = e.stim AND f.channel = e.channel AND f.n = (e.n - o + e.m) % e.m GROUP BY e.stim, e.channel, k, e.n),
c AS (SELECT *, sqrt(ar * ar + ai * ai) AS r FROM b), w AS (SELECT stim, channel, k, sum(r * r) AS w FROM c GROUP BY stim, channel, k),
z AS (SELECT c.stim, c.channel, c.k, sum(((c.ar * c.ar - c.ai * c.ai) * n.ar + 2 * c.ar * c.ai * n.ai) / greatest(c.r, 1e-12)) AS re, sum(((c.ar * c.ar - c.ai * c.ai) * n.ai - 2 * c.ar * c.ai * n.ar) / greatest(c.r, 1e-12)) AS im FROM c JOIN c n ON n.stim = c.stim AND n.channel = c.channel AND n.n = c.n AND n.k = c.k + 1 GROUP BY c.stim, c.channel, c.k),
y AS (SELECT z.stim, z.channel, z.k, re / sqrt(w.w * x.w) AS re, im / sqrt(w.w * x.w) AS im FROM z JOIN w ON w.stim = z.stim AND w.channel = z.channel AND w.k = z.k JOIN w x ON x.stim = z.stim AND x.channel = z.channel AND x.k = z.k + 1),
r AS (SELECT stim, 'mean' AS stat, channel, 0 AS k, a AS value FROM p UNION ALL SELECT stim, 'cv2', channel, 0, v / (a * a) FROM p
UNION ALL SELECT stim, 'skew', channel, 0, avg(d ** 3) / any_value(v) ** 1.5 FROM d GROUP BY stim, channel UNION ALL SELECT stim, 'kurt', channel, 0, avg(d ** 4) / any_value(v) ** 2 FROM d GROUP BY stim, channel
UNION ALL SELECT a.stim, 'corr', a.channel, b.channel, corr(a.x, b.x) FROM d a JOIN d b ON a.stim = b.stim AND a.n = b.n AND b.channel - a.channel IN (1, 2) GROUP BY a.stim, a.channel, b.channel
UNION ALL SELECT a.stim, 'ac', a.channel, l, avg(a.d * b.d) / any_value(a.v) FROM d a, (SELECT unnest([1, 2]) AS l), d b WHERE a.stim = b.stim AND a.channel = b.channel AND b.n = (a.n + l) % a.m GROUP BY a.stim, a.channel, l
UNION ALL SELECT w.stim, 'mod', w.channel, w.k, w / (m * v) FROM w JOIN p USING (stim, channel) UNION ALL SELECT stim, 'c2_real', channel, k, re FROM y UNION ALL SELECT stim, 'c2_imag', channel, k, im FROM y)
SELECT stim, stat, CAST(channel AS INTEGER) AS channel, CAST(k AS INTEGER) AS k, round(value, 5) AS value FROM r""",
    "stream_covariance": """WITH e AS (SELECT unnest([0, 1, 2]) AS k, unnest([value, (epoch_us(ts) // 3600000000) % 24, epoch_us(ts) // 86400000000 - 19723]) AS x, event_id FROM events)
SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(covar_pop(a.x, b.x), 4) AS cov FROM e a JOIN e b USING (event_id) WHERE a.k <= b.k GROUP BY a.k, b.k""",
    "wav_ranges": f"WITH {SAMPLES} SELECT stim, n, CAST(round_even(x / 512 * 32768, 0) AS BIGINT) AS level FROM s",
    "nan_repeats": f"""WITH {SAMPLES} SELECT label, CAST(us // 86400000000 AS INTEGER) AS day, round(avg(x) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0), 6) AS mean, count(*) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0) AS n_repeats,
round(median(x) FILTER (event_id % 11 <> 0 AND event_id % 13 <> 0), 6) AS median FROM s GROUP BY 1, 2""",
    "event_median": "SELECT event_type AS label, round(median(value), 6) AS x FROM events GROUP BY event_type",
    "dft_magnitude": f"WITH {DFT} SELECT stim, k AS bin, round(sqrt(re * re + im * im), 4) AS magnitude FROM d",
    "noise_spectrum": f"WITH {DFT} SELECT stim, k AS bin, round(sqrt(re * re + im * im), 4) AS magnitude FROM d",
    "circular_autocorr": f"WITH {TIMES} SELECT a.stim, (a.n - b.n + a.m) % a.m AS lag, round(sum(a.x * b.x) / any_value(a.m), 4) AS ac FROM t a JOIN t b ON a.stim = b.stim GROUP BY 1, 2",
    "hilbert_envelope": f"""WITH {DFT}, w AS (SELECT stim, k, m, re, im, CASE WHEN k = 0 OR 2 * k = m THEN 1 WHEN 2 * k < m THEN 2 ELSE 0 END AS w FROM d),
a AS (SELECT t.stim, t.n, sum(w * (re * cos(2 * pi() * ((k * t.n) % t.m) / t.m) - im * sin(2 * pi() * ((k * t.n) % t.m) / t.m))) / any_value(t.m) AS re, sum(w * (re * sin(2 * pi() * ((k * t.n) % t.m) / t.m) + im * cos(2 * pi() * ((k * t.n) % t.m) / t.m))) / any_value(t.m) AS im FROM t JOIN w USING (stim) GROUP BY t.stim, t.n)
SELECT stim, n, round(sqrt(re * re + im * im), 4) AS x FROM a""",
    "subband_filter": f"WITH {DFT}, {RESPONSES} SELECT t.stim, channel, t.n, round(sum(h * (re * cos({TURN}) - im * sin({TURN}))) / any_value(t.m), 4) AS x FROM t JOIN h USING (stim) GROUP BY t.stim, channel, t.n",
    "band_collapse": SAME,
    "cochleagram": COCH,
    "coch_roundtrip": SAME,
    "wavelet_bands": WAVELETS,
    "wavelet_roundtrip": SAME,
    "resample_rational": f"WITH {SAMPLES} SELECT stim, n, round(x, 5) AS x FROM ({resample_sql('s', 'stim', 'n', 3, 2)})",
    "resample_axes": f"""WITH e AS (SELECT vec_id AS frame, unnest(range(len(embedding))) AS feature, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS ({resample_sql('e', 'frame', 'feature', 1, 2)}),
b AS ({resample_sql('a', 'feature', 'frame', 3, 4)}) SELECT frame, feature, round(x, 5) AS x FROM b""",
    "pchip_gap": f"""WITH {GAPS}, z AS ({pchip_sql("SELECT stim, n AS p, x AS y FROM v", "stim", "SELECT stim, n AS k, n AS g FROM s", True)}) SELECT stim, k AS n, round(x, 5) AS x FROM z""",
    "pchip_log_axis": f"""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS feature, unnest(embedding)::DOUBLE AS y FROM embeddings),
z AS ({pchip_sql("SELECT vec_id, log2(feature + 1) AS p, y FROM e", "vec_id", f"SELECT vec_id, k, k * {SPACING} AS g FROM (SELECT DISTINCT vec_id FROM e), (SELECT unnest(range(25)) AS k)")}) SELECT vec_id, k, round(x, 5) AS x FROM z""",
    "windowed_autocorr": f"""WITH {TIMES}, w AS (SELECT stim, n, m, x, 0.54 - 0.46 * cos(2 * pi() * (n + 1) / m) AS w FROM t), k AS (SELECT unnest(range({LAGS + 1})) AS lag)
SELECT a.stim, lag, round(sum(a.x * a.w * b.x * b.w) / sum(a.w * b.w), 4) AS ac FROM w a, k, w b WHERE a.stim = b.stim AND b.n = a.n + lag GROUP BY a.stim, lag""",
}
