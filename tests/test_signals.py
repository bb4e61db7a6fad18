"""Transforms, resampling, interpolation, selection and neighbours against numpy, at lengths and buckets that cross every edge."""

import glob
import os
import pickle
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallframe.operators import banks, cochlea, features, grid, kernels, order, pca, repeats, resample, selection, stats, transform
from tallframe.plans import signals
from tallframe.sources import files, wav
from tallframe.streaming import statistics

LENGTHS = [1, 2, 3, 4, 5, 7, 16, 31, 64, 97, 200, 20_001]


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(0)
    return {k: rng.normal(size=m) for k, m in enumerate(LENGTHS)}


@pytest.fixture(scope="module")
def tall(spark, waves):
    return spark.createDataFrame([(k, i, float(v)) for k, x in waves.items() for i, v in enumerate(x)], "stim int, n bigint, x double").repartition(5).cache()


def arrays(df, value, at="n", keys=("stim",)):
    out = {}
    for r in df.select(*keys, at, F.expr(value).alias("_v")).collect():
        out.setdefault(tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]], {})[r[at]] = r["_v"]
    assert all(sorted(v) == list(range(len(v))) for v in out.values())
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def test_transforms_of_any_length(tall, waves):
    mags, env, ac = arrays(transform.magnitudes(tall), "magnitude", "bin"), arrays(transform.analytic(tall), "hypot(re, im)"), arrays(transform.circular_autocorrelation(tall), "ac", "lag")
    for k, x in waves.items():
        assert np.allclose(mags[k], np.abs(np.fft.fft(x)), atol=1e-9)
        assert np.allclose(env[k], np.abs(kernels.analytic(x)), atol=1e-9)
        assert np.allclose(ac[k], np.fft.ifft(np.abs(np.fft.fft(x)) ** 2).real / len(x), atol=1e-9)


def test_transform_spreads_a_signal_over_blocks(spark, tall, waves):
    """No step gathers more than a block of lines of the long signal."""
    rows = transform.signals(tall.where("stim = 11"))
    across, long, lines = transform.shape(1 << 16)
    assert across // lines > 1 and lines * long < len(waves[11])
    back = transform.inverse_fourier(transform.fourier(rows))
    got = arrays(back, "re")
    assert np.allclose(got[11], waves[11], atol=1e-9)


def test_subbands_and_their_sum(tall, waves):
    bank = banks.linear_bank(4, 4.0, 28.0)
    some = tall.where("stim < 11")
    bands = transform.subbands(some, bank, 64.0)
    got, env = arrays(bands, "re", keys=("stim", "channel")), arrays(transform.subbands(some, bank, 64.0, complex_=True), "hypot(re, im)", keys=("stim", "channel"))
    for k in range(11):
        want = kernels.filtered(waves[k], banks.responses(bank, len(waves[k]), 64.0))
        for c in range(6):
            assert np.allclose(got[k, c], want[c], atol=1e-9) and np.allclose(env[k, c], np.abs(kernels.analytic(want[c])), atol=1e-9)
    back = arrays(transform.collapsed(bands.withColumn("x", F.col("re")), bank, 64.0), "x")
    assert all(np.allclose(back[k], waves[k], atol=1e-9) for k in range(11))


def test_noise_keeps_magnitudes_and_depends_on_the_seed(tall, waves):
    some = tall.where("stim between 5 and 10")
    one, two, again = (arrays(transform.matched_noise(some, s), "x") for s in (1, 2, 1))
    for k, x in ((k, waves[k]) for k in range(5, 11)):
        assert np.allclose(np.abs(np.fft.fft(one[k])), np.abs(np.fft.fft(x)), atol=1e-8)
        assert np.array_equal(one[k], again[k]) and (len(x) < 3 or not np.allclose(one[k], two[k]))


@pytest.mark.parametrize("up,down", [(3, 2), (1, 4), (5, 7), (4, 1), (6, 4)])
def test_resampling(tall, waves, up, down):
    got = arrays(resample.resampled(tall, up, down), "x")
    for k, x in waves.items():
        points = int(np.floor(len(x) * up / down + 0.5))
        assert len(got.get(k, [])) == points
        assert not points or np.allclose(got[k], kernels.resampled(x, up, down), atol=1e-9)


def test_resampling_another_axis(spark):
    x = np.random.default_rng(1).normal(size=(5, 12))
    df = spark.createDataFrame([(f, c, float(x[f, c])) for f in range(5) for c in range(12)], "frame bigint, channel bigint, x double")
    got = {(r.frame, r.channel): r.x for r in resample.resampled(df, 1, 2, axis="channel", keys=["frame"]).collect()}
    assert len(got) == 30 and all(np.isclose(got[f, c], kernels.resampled(x[f], 1, 2)[c]) for f in range(5) for c in range(6))
    got = {(r.frame, r.channel): r.x for r in resample.resampled(df, 2, 1, axis="frame", keys=["channel"]).collect()}
    assert len(got) == 120 and all(np.isclose(got[f, c], kernels.resampled(x[:, c], 2, 1)[f]) for f in range(10) for c in range(12))


@pytest.mark.parametrize("bucket", [3, 8, 10_000])
def test_gaps_by_cubic_pieces(spark, tall, waves, bucket):
    known = (F.col("n") % 5 != 2) & (F.col("n") % 7 < 5) & (F.col("n") > 1)
    gaps = tall.where("stim < 11").withColumn("x", F.when(known, F.col("x")).when(F.col("n") == 1, float("nan")))
    got = arrays(grid.filled(gaps, method="pchip", bucket=bucket), "x")
    for k in range(11):
        n = np.arange(LENGTHS[k])
        ok = (n % 5 != 2) & (n % 7 < 5) & (n > 1)
        if ok.sum() > 1:
            assert np.allclose(got[k], kernels.pchip(n[ok].astype(float), waves[k][ok], n.astype(float)))
        elif ok.any():
            assert np.allclose(got[k], waves[k][ok][0])
        else:
            assert k not in got


def test_few_targets(spark):
    p, y = np.array([0.0, 0.3, 1.0, 2.5]), np.array([1.0, 4.0, 2.0, 2.5])
    df = spark.createDataFrame([("a", *map(float, r)) for r in zip(p, y)] + [("b", 1.0, 7.0)], "k0 string, p double, y double")
    targets = [-0.5, 0.0, 0.2, 1.7, 2.5, 3.0]
    got = resample.pchip(df, ["k0"], "p", "y", bucket=F.lit(0), targets=targets).collect()
    a = {r.k: r.y for r in got if r.k0 == "a"}
    assert np.allclose([a[k] for k in range(6)], kernels.pchip(p, y, np.array(targets)))
    assert [r.y for r in got if r.k0 == "b"] == [7.0] * 6


@pytest.mark.parametrize("bucket", [1, 4, 100])
def test_neighbours(spark, bucket):
    rows = [(g, n, n * 10) for g, m in ((0, 23), (1, 1), (2, 2)) for n in range(0, m * 3, 3)]
    df = spark.createDataFrame(rows, "g int, n int, x int").repartition(4)
    got = order.with_neighbours(df, ["g"], F.floor(F.col("n") / bucket), ["n"], ["x"], back=2, ahead=3).collect()
    assert len(got) == len(rows)
    have = {(g, n): x for g, n, x in rows}
    for r in got:
        assert (r.before1_x, r.before2_x, r.after1_x, r.after2_x, r.after3_x) == tuple(have.get((r.g, r.n + 3 * k)) for k in (-1, -2, 1, 2, 3))


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_median_by_rounds(spark, few):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501), "b": rng.integers(0, 5, 400).astype(float), "c": np.exp(rng.normal(0, 40, 300)), "d": np.array([float("inf"), float("-inf"), 1.0, 2.0] * 9), "e": np.array([3.0] * 50), None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("f", None), ("g", float("nan"))]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    got = {r.k: r.x for r in selection.median(df, ["k"], few=few, bins=8).collect()}
    assert got.pop("f") is None and got.pop("g") is None
    assert set(got) == set(groups) and all(np.isclose(got[k], np.median(x)) for k, x in groups.items())


def test_products_meet_across_blocks(spark, tall, waves):
    got = arrays(grid.products(tall, 9), "s", "lag")
    for k, x in waves.items():
        assert np.allclose(got[k], [x[: len(x) - lag] @ x[lag:] if lag < len(x) else 0 for lag in range(10)])
    whole = tall.where("stim = 10")
    for window in ("hanning", "rect", "hamming", "soft", "welch"):
        for undo in (False, True):
            ac = arrays(grid.windowed_autocorrelation(whole, 9, window=window, undo=undo), "ac", "lag")[10]
            assert np.allclose(ac, kernels.padded_autocorrelation(waves[10], window, undo)[100:110])


def test_cochleagram_and_back(tall, waves):
    bank = banks.linear_bank(4, 4.0, 28.0)
    some = tall.where("stim between 6 and 10").cache()
    env = cochlea.envelopes(some, bank, 64.0).cache()
    coch = cochlea.cochleagram(env, bank, 1, 4, spacing=0.25).cache()
    got = arrays(coch, "x", "k", ("stim", "frame"))
    for k in (6, 8, 10):
        want, _, _ = kernels.cochleagram(waves[k], banks.responses(bank, len(waves[k]), 64.0), banks.centres(bank), 64.0, 16.0, spacing=0.25)
        for f, row in enumerate(want):
            assert np.allclose(got[k, f], row[: len(got[k, f])])
    rest = cochlea.with_rest(env, coch, bank, 1, 4, spacing=0.25)
    back = arrays(cochlea.waveform(coch, rest, bank, 64.0, 1, 4, spacing=0.25), "x")
    assert all(np.allclose(back[k], waves[k], atol=1e-6) for k in range(6, 11))


def test_missing_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", nan, 0.0), ("a", 1.0, 0.0), ("a", 2.0, 0.0), ("b", nan, 0.0), ("c", 5.0, nan)], "k string, x double, score double")
    assert {r.k: (r.x, r.n_repeats) for r in repeats.mean_of_repeats(df, ["k"]).collect()} == {"a": (1.5, 2), "b": (None, 0), "c": (5.0, 1)}
    assert {r.k: r.x for r in repeats.median_of(df, ["k"]).collect()} == {"a": 1.5, "b": None, "c": 5.0}
    assert {(r.k, r.x) for r in repeats.without_outliers(df).collect()} == {("a", None), ("a", 1.0), ("a", 2.0), ("b", None), ("c", None)}
    gap = spark.createDataFrame([("s", 0, 0, 1.0, 0.0), ("s", 0, 1, nan, 0.0), ("s", 0, 2, 3.0, 0.0)], "stim string, rep int, n bigint, x double, score double")
    assert [r.x for r in repeats.envelopes(gap).orderBy("n").collect()] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("rows", [[[1.0], [2.0, 3.0]], [[1.0, None], [2.0, 3.0]], [[1.0, float("nan")], [2.0, 3.0]]])
def test_ragged_and_missing_features_are_errors(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    for parts in (1, 2):
        with pytest.raises(Exception, match="different numbers of features|is missing"):
            stats.covariance(df.repartition(parts)).collect()


def test_stored_features_follow_their_settings(spark, tmp_path):
    calls = []

    def make(spark, s):
        calls.append(s.nfilts)
        return spark.createDataFrame([("a", k, [float(k * s.nfilts), 1.0 + k % 3]) for k in range(9)], "stim string, frame bigint, v array<double>")

    s = features.settings(overrides=["feature=coch", f"root={tmp_path}", "pc=2", "nfilts=3"])
    features.compute(spark, s, {"coch": make})
    other = features.replace(s, nfilts=5)
    assert features.compute(spark, other, {"coch": make}).where("frame = 1").first().v[0] == 5.0 and calls == [3, 5]
    assert spark.read.parquet(f"{tmp_path}/metadata/feature=coch/variant=original").first().parameters["nfilts"] == "5"
    features.compute(spark, other, {"coch": make})
    assert calls == [3, 5]
    with pytest.raises(ValueError, match="these settings"):
        features.compute(spark, features.replace(s, compute_original=False), {"coch": make})
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        features.compute(spark, features.replace(other, pca_weights_from=f"{tmp_path}/nowhere"), {"coch": make})

    def fail(spark, s):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        features.compute(spark, features.replace(other, overwrite=True), {"coch": fail})
    assert files.read_features(spark, str(tmp_path), "coch").count() == 9

    def late(spark, s):
        return make(spark, s).withColumn("v", F.when(F.col("frame") < 20, F.raise_error(F.lit("late"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="late"):
        features.compute(spark, features.replace(other, overwrite=True), {"coch": late})
    assert files.read_features(spark, str(tmp_path), "coch").count() == 9


def test_leading_components_are_the_exact_ones(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("embedding").cast("array<double>").alias("v")).repartition(7)
    x = np.array([r.v for r in e.collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    got = pca.fit_leading(e, 6).orderBy("k").collect()
    for r, value, w in zip(got, values[::-1], vectors.T[::-1], strict=False):
        assert np.isclose(r.value, value, rtol=1e-9) and np.isclose(abs(np.dot(r.weights, w)), 1, atol=1e-9) and np.abs(np.array(r.weights) - w * np.sign(np.dot(r.weights, w))).max() < 1e-6
    assert pca.fit_leading(e.limit(0), 3).count() == 0
    raw = pca.fit_leading(e, 2, demean=False).orderBy("k").collect()
    assert np.allclose([r.value for r in raw], np.linalg.eigvalsh(x.T @ x / len(x))[::-1][:2])


def test_leading_components_of_more_features_than_rows_and_restarts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 9000)) * np.exp(-np.arange(40) / 4)[:, None]
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    got = pca.fit_leading(df, 3, over=1).orderBy("k").collect()
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose([r.value for r in got], s[:3] ** 2 / 40, rtol=1e-8)
    assert all(np.isclose(abs(np.dot(r.weights, w)), 1, atol=1e-8) for r, w in zip(got, vt, strict=False))
    constant = spark.createDataFrame([([1.0, 2.0, 3.0],)] * 4, "v array<double>")
    assert all(abs(r.value) < 1e-12 for r in pca.fit_leading(constant, 2).collect())


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))

    def put(k):
        spark.createDataFrame([(r.tolist(),) for r in x[k * 30 : k * 30 + 30]], "v array<double>").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("v array<double>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        statistics.keep_sums(stream, f"{tmp_path}/sums", f"{tmp_path}/checkpoint", availableNow=True).awaitTermination()
        return {(r.i, r.j): r.cov for r in statistics.covariance_so_far(spark, f"{tmp_path}/sums").collect()}

    for k in range(3):
        put(k)
        want = np.cov(x[: k * 30 + 30].T, bias=True)
        got = run()
        assert len(got) == 10 and all(np.isclose(v, want[i, j]) for (i, j), v in got.items())


def test_recordings_in_ranges(spark, tmp_path):
    spark.dataSource.register(wav.WavSource)
    rng = np.random.default_rng(6)
    waves = {"a": rng.uniform(-1, 1, 1000), "b": rng.uniform(-1, 1, 30), "c": np.array([-1.0, 1.0])}
    df = spark.createDataFrame([(k, n, float(v)) for k, x in waves.items() for n, v in enumerate(x)], "stim string, n bigint, x double").repartition(5)
    path = str(tmp_path / "out")
    wav.in_ranges(df, 64).write.format("wav").option("sr", 8000).option("range", 64).mode("append").save(path)
    back = spark.read.format("wav").option("range", 50).load(path)
    assert back.rdd.getNumPartitions() > 20
    got = arrays(back, "x")
    for k, x in waves.items():
        assert np.allclose(got[k], np.minimum(x, 32767 / 32768), atol=1 / 65536 + 1e-12)
    assert {os.path.basename(p)[0] for p in glob.glob(f"{path}/*")} == set("abc")
    wav.in_ranges(df.where("stim = 'b'"), 64).write.format("wav").option("sr", 8000).option("range", 64).mode("overwrite").save(path)
    assert set(arrays(spark.read.format("wav").load(path), "x")) == {"b"}
    loud = df.withColumn("x", F.col("x") * 2)
    with pytest.raises(Exception, match="would clip"):
        wav.in_ranges(loud, 64).write.format("wav").option("sr", 8000).option("range", 64).mode("append").save(path)
    with pytest.raises(Exception, match="out of place|several tasks"):
        df.repartition(3).write.format("wav").option("sr", 8000).option("range", 64).mode("append").save(path)
    assert set(arrays(spark.read.format("wav").load(path), "x")) == {"b"} and not glob.glob(f"{path}/_*")


@pytest.mark.parametrize("width,channels", [(1, 1), (2, 2), (3, 1), (4, 3)])
def test_kinds_of_files(spark, tmp_path, width, channels):
    spark.dataSource.register(wav.WavSource)
    raw = np.random.default_rng(7).integers(0, 256, (37, channels, width), dtype=np.uint8)
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setparams((channels, width, 100, 0, "NONE", ""))
        w.writeframes(raw.tobytes())
    for kind in ("mean", "first"):
        got = arrays(spark.read.format("wav").option("range", 10).option("channels", kind).load(str(tmp_path)), "x")["x"]
        want = files.read_wav(spark, str(tmp_path), channels=kind).first().samples
        assert np.array_equal(got, want)
    (tmp_path / "y.wav").write_bytes(b"RIFFxxxxJUNK")
    with pytest.raises(Exception, match="no WAV file"):
        spark.read.format("wav").load(str(tmp_path)).collect()


def test_recordings_of_32_bits_and_of_many_files(spark, tmp_path, monkeypatch):
    """Values beyond 512 don't clip the query's files, and many short files are few tasks."""
    events = spark.createDataFrame([(k, k % 3, float(v)) for k, v in enumerate([560.21, 0.0, 512.0, -700.5, 29.27, 3e7])], "event_id bigint, user_id bigint, value double")
    events = events.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, event_id)")).withColumn("event_type", F.lit("view"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.stim, r.n): r.level for r in signals.wav_ranges(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 35853, (1, 0): 0, (2, 0): 32768, (0, 1): -44832, (1, 1): 1873, (2, 1): 1920000000}
    monkeypatch.setattr(wav, "TASKS", 3)
    path = str(tmp_path / "out")
    x = spark.range(1000).select(F.lpad((F.col("id") % 50).cast("string"), 2, "0").alias("stim"), F.floor(F.col("id") / 50).alias("n"), (F.col("id") / 1024).alias("x"))
    wav.in_ranges(x, 8).write.format("wav").option("sr", 100).option("bits", 32).option("range", 8).mode("append").save(path)
    parts = wav.WavReader({"path": path, "range": "5"}).partitions()
    assert len(parts) == 3 and sum(r.last - r.first for p in parts for r in p.each) == 1000
    assert spark.read.format("wav").option("range", 5).load(path).exceptAll(x.select("stim", "n", "x")).count() == 0


def test_short_signals_are_shuffled_once(spark, tall, waves):
    """Where the longest signal is known to be short, a convolution or a change of rate is one shuffle of samples, with the same values."""
    some = tall.where("stim < 11")

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    rows = transform.signals(some).withColumn("other", F.lit(0.0))
    assert shuffles(transform.convolved(rows, ["stim"], transform.chirp, 200)) == shuffles(transform.convolved(rows, ["stim"], transform.chirp)) - 2
    mags, env, ac = arrays(transform.magnitudes(some, 200), "magnitude", "bin"), arrays(transform.analytic(some, 200), "hypot(re, im)"), arrays(transform.circular_autocorrelation(some, 200), "ac", "lag")
    for k in range(11):
        assert np.allclose(mags[k], np.abs(np.fft.fft(waves[k])), atol=1e-9) and np.allclose(env[k], np.abs(kernels.analytic(waves[k])), atol=1e-9)
        assert np.allclose(ac[k], np.fft.ifft(np.abs(np.fft.fft(waves[k])) ** 2).real / len(waves[k]), atol=1e-9)
    for up, down in ((3, 2), (1, 4), (4, 1)):
        short = resample.resampled(some, up, down, longest=200)
        got = arrays(short, "x")
        assert shuffles(short) == 1
        for k in range(11):
            want = kernels.resampled(waves[k], up, down)[: int(np.floor(len(waves[k]) * up / down + 0.5))]
            assert len(got.get(k, [])) == len(want) and (not len(want) or np.allclose(got[k], want, atol=1e-9))
    with pytest.raises(Exception, match="longer than was stated"):
        transform.magnitudes(tall, 200).collect()


def test_short_signals_meet_themselves_without_copies(spark):
    """The circular autocorrelation of short signals takes a row for each sample, not three, at every small length."""
    rng = np.random.default_rng(4)
    waves = {m: rng.normal(size=m) for m in (1, 2, 3, 4, 5, 8, 9, 33)}
    rows = spark.createDataFrame([(m, n, float(x)) for m, w in waves.items() for n, x in enumerate(w)], "stim bigint, n bigint, x double")
    found = transform.circular_autocorrelation(rows, 33)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = arrays(found, "ac", "lag")
    for m, w in waves.items():
        assert np.allclose(got[m], [np.dot(w, np.roll(w, -k)) / m for k in range(m)], atol=1e-9)
    with pytest.raises(ValueError, match="whole signals"):
        transform.convolved(transform.signals(rows), ["stim"], mirrored=True)


def test_the_driver_holds_few_bytes_a_recording(spark, tmp_path):
    """Of many short files, what tasks send to the driver, and it to them, is some bytes a file."""
    path = str(tmp_path / "out")
    writer = wav.WavWriter({"path": path, "sr": "100", "range": "5"}, False)
    stim = [f"recording-{k}" for k in range(2000) for _ in range(10)]
    batch = pa.RecordBatch.from_arrays([pa.array(stim), pa.array([n for _ in range(2000) for n in range(10)]), pa.array([0.5] * 20000)], names=["stim", "n", "x"])
    message = writer.write(iter([batch]))
    assert len(pickle.dumps(message)) < 20 * 4000
    with pytest.raises(ValueError, match="by several tasks"):
        writer.commit([message, message])
    writer.commit([message, None])
    parts = wav.WavReader({"path": path, "range": "5"}).partitions()
    assert sum(len(pickle.dumps(p)) for p in parts) < 120 * 4000
    assert len(parts) == 1000 and sum(r.last - r.first for p in parts for r in p.each) == 20000
    assert {(r.stim, r.offset) for p in parts for r in p.each} == {(f"recording-{k}", o) for k in range(2000) for o in (0, 5)}
