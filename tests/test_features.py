"""Settings, dispatch and reuse of stored features, stored components, frames as files, annotation sets."""

import io
import wave

import numpy as np
import pytest

from tallframe.operators import annotate, compare, features, grid, repeats, shapes, spectral
from tallframe.sources import files


@pytest.fixture
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(s, k, rng.normal(size=4).tolist()) for s in ("a", "b") for k in range(30)]
    return spark.createDataFrame(rows, "stim string, frame bigint, v array<double>")


def test_settings(tmp_path):
    path = tmp_path / "env.toml"
    path.write_text('feature = "coch"\nout_sr = 25\n')
    s = features.settings("toy", str(path), overrides=["pc=3", "overwrite=true", "nonlin=rect"])
    assert (s.feature, s.out_sr, s.pc, s.overwrite, s.nonlin, s.nfilts) == ("coch", 25.0, 3, True, "rect", 10)
    for bad in (["colour=1"], ["pc=1.5"], ["overwrite=1"], ["out_sr=true"]):
        with pytest.raises(ValueError):
            features.settings(overrides=bad)
    with pytest.raises(ValueError):
        features.settings("none")


def test_compute_stores_reuses_and_overwrites(spark, tmp_path, vectors):
    calls = []

    def make(spark, s):
        calls.append(s.feature)
        return vectors

    s = features.settings(overrides=["feature=coch", f"root={tmp_path}", "pc=2"])
    first = features.compute(spark, s, {"coch": make})
    assert first.count() == 60 and calls == ["coch"]
    scores = files.read_features(spark, str(tmp_path), "coch", "pc2")
    assert scores.count() == 60 and {len(r.v) for r in scores.collect()} == {2}
    features.compute(spark, s, {"coch": make})
    assert len(calls) == 1
    features.compute(spark, features.replace(s, overwrite=True), {"coch": make})
    assert len(calls) == 2
    kept = features.compute(spark, features.replace(s, compute_original=False, pca_weights_from=f"{tmp_path}/weights/feature=coch/variant=original"), {"coch": make})
    assert kept.count() == 60 and len(calls) == 2
    meta = features.replace(s, variant="other", meta_only=True)
    assert features.compute(spark, meta, {"coch": make}) is None and features.stored(spark, str(tmp_path), "coch", "other") is None
    assert spark.read.parquet(f"{tmp_path}/metadata/feature=coch/variant=other").count() == 1
    with pytest.raises(ValueError, match="unknown feature"):
        features.compute(spark, features.replace(s, feature="x"), {"coch": make})
    with pytest.raises(ValueError, match="isn't stored"):
        features.compute(spark, features.replace(s, variant="new", compute_original=False), {"coch": make})
    assert features.of_stimulus(files.read_features(spark, str(tmp_path), "coch", "pc2"), "a").count() == 30


def test_components_of_some_stimuli_and_layers(spark, tmp_path, vectors):
    model = features.fit_components(vectors, str(tmp_path / "m"), stimuli=["a"], frames=20, standardise=True)
    x = np.array([r.v for r in vectors.where("stim = 'a' and frame < 20").orderBy("frame").collect()])
    assert np.allclose([r.value for r in model.orderBy("k").collect()], np.linalg.eigvalsh(np.corrcoef(x.T))[::-1])
    assert features.load_components(spark, str(tmp_path / "m"), 2).count() == 2
    out = features.layered(vectors, str(tmp_path / "layers"), [(lambda d: d, 3), (lambda d: d, 2)])
    assert {len(r.v) for r in out.collect()} == {2}


def test_sizes_must_agree(spark, vectors):
    shapes.require_equal_sizes(vectors, vectors)
    with pytest.raises(ValueError, match="sizes of a differ"):
        shapes.require_equal_sizes(vectors, vectors.where("stim = 'b' or frame < 5"))
    with pytest.raises(Exception, match="more than one place"):
        shapes.squeezed(vectors, "frame").collect()


def test_names():
    assert shapes.constraint_name("x.wav", {"a": 1, "b": 0}) == "x_10"
    assert shapes.constraint_name("x", {"a": 1}, average="m") == "AVG_m_1"
    assert shapes.constraint_name("x", {"a": 3}, average="m", weight=0.5) == "MORPH_m_0.5_3"


def test_frames_as_files(spark, tmp_path):
    rows = [("a", n, n / 100) for n in range(25)]
    samples = spark.createDataFrame(rows, "stim string, n bigint, x double")
    buffered = grid.buffered_frames(samples, 10, 4, 2)
    wavs, times = files.framed_wav(buffered, grid.lengths(samples), sr=100, target=10, front=4, back=2)
    got = {r.frame: bytes(r.wav) for r in wavs.collect()}
    assert sorted(got) == [0, 1, 2]
    with wave.open(io.BytesIO(got[1])) as w:
        x = np.frombuffer(w.readframes(99), "<i2") / 32768
    assert len(x) == 16 and np.allclose(x, np.arange(6, 22) / 100, atol=1e-4)
    assert [(r.frame, r.start, r.end) for r in times.orderBy("frame").collect()] == [(0, -0.04, 0.12), (1, 0.06, 0.22), (2, 0.16, 0.32)]
    files.write_combined(buffered, str(tmp_path), feature="w", target=10, onset=4)
    assert sorted((r.stim, r.n, r.x) for r in files.read_features(spark, str(tmp_path), "w").collect()) == rows


def test_catalog_ends_at_the_first_gap(spark):
    rows = [("a", f) for f in (0, 1, 2, 4)] + [("b", 1)] + [("c", f) for f in range(3)]
    got = files.frame_catalog(spark.createDataFrame(rows, "stim string, frame bigint")).collect()
    assert {r.stim: r.frames for r in got} == {"a": 3, "b": 0, "c": 3}


def test_listing_by_name(spark, tmp_path):
    for name in ("b.wav", "a.wav", "c.wav"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.stim for r in files.listed(spark, "c.wav, a", str(tmp_path)).collect()] == ["c", "a"]
    assert [r.stim for r in files.listed(spark, None, str(tmp_path)).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="no such stimulus"):
        files.listed(spark, "d", str(tmp_path))


def test_annotation_options_exclude_each_other(spark):
    events = spark.createDataFrame([("s", "dog", 0.0, 0.1), ("s", "dog", 0.5, 0.6), ("s", "cat", 0.2, 0.3)], "stim string, label string, onset double, offset double")
    with pytest.raises(ValueError):
        annotate.encoded(events, 10, ["dog"], least=2, merge=["cat"])
    got = annotate.words(events, 10, 2)
    assert got.columns == ["stim", "frame", "dog", "LOWPROB"]
    assert {r.frame: (r.dog, r.LOWPROB) for r in got.collect()} == {0: (1, 0), 5: (1, 0), 2: (0, 1)}
    with pytest.raises(ValueError, match="more than 0"):
        annotate.words(events, 10, 2, most=0)


def test_repeats(spark):
    rows = [("a", r, n, float(n), 0.0) for r in range(2) for n in range(5)] + [("a", 2, 1, 99.0, 0.5), ("a", 2, 2, None, None)]
    measured = spark.createDataFrame(rows, "stim string, rep bigint, n bigint, x double, score double")
    got = repeats.envelopes(measured, window=(1, 3)).orderBy("n").collect()
    assert [(r.n, r.x) for r in got] == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_noise_has_the_magnitudes_of_the_sound_alone(spark):
    rng = np.random.default_rng(1)
    waves = spark.createDataFrame([("a", rng.normal(size=64).tolist()), ("b", rng.normal(size=33).tolist())], "stim string, samples array<double>")
    one, two, again = ({r.stim: np.array(r.samples) for r in spectral.matched_noise(waves, s).collect()} for s in (1, 2, 1))
    for r in waves.collect():
        assert np.allclose(np.abs(np.fft.fft(one[r.stim])), np.abs(np.fft.fft(r.samples)))
        assert not np.allclose(one[r.stim], two[r.stim]) and np.array_equal(one[r.stim], again[r.stim])
    assert spectral.seed_of("a", 1) == spectral.seed_of("a", 1) != spectral.seed_of("a", 2)


def test_similarity_of_equal_distributions(spark):
    a = spark.createDataFrame([(k % 2, float(k)) for k in range(100)], "filter int, x double")
    assert all(abs(r.jsd) < 1e-9 and abs(r.bc - 1) < 1e-9 for r in compare.similarities(a, a, ["filter"]).collect())
