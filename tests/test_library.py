"""Files, order, joins, annotation, synthesis and streams on small inputs."""

import io
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallframe.operators import annotate, grid, joins, order, pca, spectral, stats, synth
from tallframe.session import session
from tallframe.sources import files
from tallframe.streaming.frames import framed


def ramp(spark, n, stim="a"):
    return spark.range(n).select(F.lit(stim).alias("stim"), F.col("id").alias("n"), F.col("id").cast("double").alias("x"))


def test_waveforms_come_back(spark, tmp_path):
    x = np.round(np.sin(np.arange(100)) * 16000) / 32768
    df = spark.createDataFrame([("tone", 8000, x.tolist())], "stim string, sr int, samples array<double>")
    (tmp_path / "tone.wav").write_bytes(bytes(files.encode_wav(df).first().wav))
    with io.BytesIO() as b:
        with wave.open(b, "wb") as w:
            w.setparams((2, 2, 8000, 0, "NONE", ""))
            w.writeframes(np.array([[100, 300], [-100, -300]], "<i2").tobytes())
        (tmp_path / "stereo.wav").write_bytes(b.getvalue())
    got = {r.stim: r for r in files.read_wav(spark, str(tmp_path)).collect()}
    np.testing.assert_allclose(got["tone"].samples, x)
    np.testing.assert_allclose(got["stereo"].samples, np.array([200, -200]) / 32768)
    first = {r.stim: r for r in files.read_wav(spark, str(tmp_path), channels="first").collect()}
    np.testing.assert_allclose(first["stereo"].samples, np.array([100, -100]) / 32768)
    with pytest.raises(PySparkException):
        files.encode_wav(df.withColumn("samples", F.array(F.lit(1.5)))).collect()
    assert [r.stim for r in files.listing(spark, str(tmp_path), select=r"\.wav$", remove="^st").collect()] == ["tone"]


def test_csv_and_features(spark, tmp_path):
    (tmp_path / "meta.csv").write_text("a note\nTarget_path,Origin_path\nx,y\nz,w\n")
    rows = files.read_csv(spark, str(tmp_path / "meta.csv"), "target string, origin string", header_line=1)
    assert [tuple(r) for r in rows.collect()] == [("x", "y"), ("z", "w")]
    (tmp_path / "ann").mkdir()
    (tmp_path / "ann" / "s1.csv").write_text("label,onset,duration\nAA1,0.5,0.25\nspn,1,1\n")
    events = files.read_annotations(spark, str(tmp_path / "ann"))
    assert [tuple(r) for r in annotate.cleaned(events).collect()] == [("s1", "AA", 0.5, 0.75)]
    files.write_features(ramp(spark, 5), str(tmp_path / "store"), feature="ramp")
    assert files.read_features(spark, str(tmp_path / "store"), "ramp").count() == 5
    assert files.pca_variant("original", 100) == "pc100" and files.pca_variant("m", 5) == "m_pc5"
    assert files.describe(spark, "f", "original", window=(-1, 1), dimensions="time feature", sampling_rate=100, k=3).first().parameters == {"k": "3"}


@pytest.mark.parametrize("size", [1, 7, 8, 9, 100])
def test_overlap_add_gives_the_signal_back(spark, size):
    f = grid.frames(ramp(spark, size), 8, 5)
    out = {r.n: r.x for r in grid.overlap_add(f, 8, 5).collect()}
    assert {n: pytest.approx(float(n)) for n in range(size)} == {n: out[n] for n in range(size)}


def test_frames_refuse_a_stride_of_zero(spark):
    with pytest.raises(ValueError):
        grid.frames(ramp(spark, 10), 4, 0)


def test_ranks_and_neighbours_across_buckets(spark):
    df = spark.createDataFrame([(k, float(v)) for k in (1, 2) for v in (5, 3, 3, 11, 27, 1)], "k int, v double")
    df = df.withColumn("i", F.monotonically_increasing_id())
    got = order.ranked(df, ["k"], F.floor(F.col("v") / 4), ["v", "i"], "r").orderBy("k", "r").collect()
    assert [(r.k, r.v) for r in got] == [(k, float(v)) for k in (1, 2) for v in (1, 3, 3, 5, 11, 27)]
    nexts = order.with_next(df, ["k"], F.floor(F.col("v") / 4), ["v", "i"], ["v"]).where("k = 1").orderBy("v", "i").collect()
    assert [r.next_v for r in nexts] == [3, 3, 5, 11, 27, None]


def test_exactly_one_raises(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert joins.exactly_one(left.where("k = 2"), right, "k").first().v == "c"
    with pytest.raises(PySparkException):
        joins.exactly_one(left, right, "k").collect()


def test_annotation_options_exclude_each_other():
    annotate.encode_options(least=10)
    with pytest.raises(ValueError):
        annotate.encode_options(least=10, attribute=True)
    assert len(annotate.PHONEMES) == 39


def test_projection_is_that_of_the_singular_vectors(spark):
    x = np.random.default_rng(0).normal(size=(200, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    model = pca.fit(df)
    got = np.array([r.v for r in pca.project(df, model, 3).orderBy("i").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:3].T), atol=1e-8)
    back = np.array([r.v for r in pca.reconstruct(pca.project(df, model), model).orderBy("i").collect()])
    np.testing.assert_allclose(back, x, atol=1e-8)
    assert pca.fit(df.where("false")).count() == 0


def test_empty_tables(spark):
    none = ramp(spark, 0)
    assert grid.filled(none).count() == grid.padded(none, 2, 2).count() == grid.frames(none, 4, 2).count() == 0
    assert stats.moments(none, ["stim"]).count() == 0
    assert spectral.magnitudes(spectral.arrays(none)).count() == 0


def test_synthesis_carries_on_and_converges(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("a", k, rng.gamma(2, size=8).tolist()) for k in range(32)]
    target = spark.createDataFrame(rows, "stim string, frame bigint, v array<double>")
    run = lambda n: synth.synthesise(target, str(tmp_path), rates=[2.0, 8.0], scales=[0.5], sr=100, per_octave=4, iterations=n)
    first = run(1).first().snr_db
    assert run(4).first().snr_db >= first
    assert sorted(p.name for p in tmp_path.iterdir())[0] == "step=1"


def test_moments_are_imposed(spark):
    x = np.random.default_rng(2).normal(size=100).tolist()
    waves = spark.createDataFrame([("a", x)], "stim string, samples array<double>")
    want = spark.createDataFrame([("a", 1.0, 2.0, 0.3, 3.0)], "stim string, mean double, var double, skew double, kurt double")
    y = np.array(synth.impose_moments(waves, want).first().samples)
    assert y.mean() == pytest.approx(1, abs=1e-4) and y.var() == pytest.approx(2, abs=1e-3)


def test_stream_gives_the_frames_of_the_table(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src).select(F.col("user_id").alias("stim"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))
    batch.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = framed(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), target=6 * 3600.0, front=3600.0, back=1800.0, late="60 days")
    query = stream.writeStream.format("memory").queryName("frames").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.stim, r.start): (r.n, round(r.mean, 6)) for r in spark.table("frames").collect()}
    want = {(r.stim, r.start): (r.n, round(r.mean, 6)) for r in framed(batch, target=6 * 3600.0, front=3600.0, back=1800.0).collect()}
    assert got == want


def test_session_is_utc(spark):
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"
    assert sum(stats.windowed(300, 100)) == pytest.approx(1)


def test_tasks_of_alignment_are_bounded_by_samples(spark, monkeypatch):
    """More samples are more tasks, not larger ones, and the values are the same."""
    from tallframe.plans import grid as plans

    folder = "/root/testdata/sf0.001"
    want = {(r.stim, r.frame): r.x for r in plans.align_linear(spark, folder).collect()}
    monkeypatch.setattr(plans, "TASK", 50)
    found = plans.align_linear(spark, folder)
    parts = -(-spark.read.parquet(f"{folder}/events.parquet").count() // 50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert parts > 8 and plan.count(f", {parts}), REPARTITION_BY_NUM") >= 2
    assert {(r.stim, r.frame): r.x for r in found.collect()} == want and want
