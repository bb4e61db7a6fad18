"""Sounds and planes made ready, the largest of a group, and settings of groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallframe.operators import features, prepare

NAN = float("nan")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_lengths_for_slower_envelopes(spark):
    lengths = [0, 1, 7, 8, 15, 16, 49, 50, 55, 56, 57, 200]
    df = spark.createDataFrame([(n,) for n in lengths], "n bigint")

    def want(n, most):
        n += n % 2
        if most is None or most > n:
            return n // 8 * 8
        up = -(-most // 8) * 8
        return most // 8 * 8 if up > n else up

    for most in (None, 50, 48):
        got = {r.n: r.l for r in df.select("n", prepare.even_length(F.col("n"), 4, most).alias("l")).collect()}
        assert got == {n: want(n, most) for n in lengths}


def test_sounds(spark):
    df = spark.createDataFrame([("a", n, 1.0 + n) for n in range(15)] + [("b", n, 0.0) for n in range(8)] + [("c", 0, 5.0)], "stim string, n bigint, x double")
    got = prepare.measured_sound(df, 4, level=0.5).collect()
    a = np.array([r.x for r in sorted(got, key=lambda r: r.n) if r.stim == "a"])
    assert len(a) == 16 and a[-1] == 0 and np.isclose(np.sqrt(np.mean(a**2)), 0.5)
    assert [r.x for r in got if r.stim == "b"] == [0.0] * 8 and not [r for r in got if r.stim == "c"]
    assert rows(prepare.trimmed(df, 3, 10), "stim", "n") == [("a", 3), ("a", 4)]


def test_planes(spark):
    x = np.random.default_rng(0).normal(size=(4, 3))
    df = spark.createDataFrame([("a", t, k, float(x[t, k])) for t in range(4) for k in range(3)], "stim string, frame bigint, k int, x double")
    for value in (None, -1.0):
        got = {(r.frame, r.k): r.x for r in prepare.padded_plane(df, 2, 1, value=value).collect()}
        want = np.full((6, 4), x.mean() if value is None else value)
        want[2:, 1:] = x
        assert len(got) == 24 and all(np.isclose(got[t, k], want[t, k]) for t in range(6) for k in range(4))
    back = prepare.unpadded_plane(prepare.padded_plane(df, 2, 1), 2.2, 1)
    assert {(r.frame, r.k): r.x for r in back.collect()} == {(t, k): float(x[t, k]) for t in range(4) for k in range(3)}
    assert rows(prepare.padded_plane(df, 0, 0), "frame", "k", "x") == rows(df, "frame", "k", "x")
    assert prepare.padded_plane(df.limit(0), 2, 2).count() == 0


def test_largest(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 5, 3.0), ("a", 2, 3.0), ("a", 9, NAN), ("a", 7, None), ("b", 1, NAN), (None, 4, -1.0)], "g string, at int, x double")
    assert rows(prepare.largest(df, ["g"], "at"), "g", "at", "x") == [("a", 2, 3.0), (None, 4, -1.0)]


def test_report(spark):
    df = spark.createDataFrame([("a", 31.0), ("a", 40.0), ("b", 29.0), ("c", NAN), ("d", None)], "stim string, snr_db double")
    got = {r.stim: r.converged for r in prepare.convergence(df, 30.0, steps=60).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False}
    assert prepare.convergence(df, 30.0, steps=60).first().parameters == {"steps": "60"}


def test_groups_of_settings(tmp_path):
    for name, text in {"env/slow": 'out_sr = 25\nvariant = "slow"', "env/fast": "out_sr = 200", "model/small": "nfilts = 8\npc = 3", "conf": 'defaults = ["env/slow", "model/small"]\npc = 4\nfeature = "coch"'}.items():
        path = tmp_path / f"{name}.toml"
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    conf = str(tmp_path / "conf.toml")
    s = features.settings("default", conf)
    assert (s.out_sr, s.variant, s.nfilts, s.pc, s.feature) == (25.0, "slow", 8, 4, "coch")
    s = features.settings("default", conf, overrides=["env=fast", "pc=7"])
    assert (s.out_sr, s.variant, s.nfilts, s.pc) == (200.0, "original", 8, 7)
    with pytest.raises(OSError):
        features.settings("default", conf, overrides=["env=none"])
    with pytest.raises(ValueError, match="unknown setting"):
        features.settings("default", conf, overrides=["colour=1"])
