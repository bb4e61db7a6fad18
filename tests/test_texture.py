"""Texture statistics by blocks, their gradients by finite differences, and envelopes that take them on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallframe.operators import texture as T

SPEC = T.Texture(3, lags=(1, 3), offsets=(1, 2), rates=(0.06, 0.12, 0.24), reach=6)


def envelope(seed, n):
    z = np.random.default_rng(seed).normal(size=(n, 3))
    z[:, 1] += 0.5 * z[:, 0]
    return np.exp(0.35 * (z + 0.6 * np.roll(z, 1, 0)))


def rough(seed, n):
    return np.abs(np.random.default_rng(seed + 50).normal(size=(n, 3))) * 0.3 + 0.8


def wide(x, s=SPEC):
    return x[np.arange(-s.margin, len(x) + s.margin) % len(x)]


def tall(spark, make, sizes):
    return spark.createDataFrame([(k, c, i, float(v)) for k, n in enumerate(sizes) for i, row in enumerate(make(k, n)) for c, v in enumerate(row)], "stim int, channel int, n bigint, x double").repartition(4)


def test_gradient_against_differences():
    x, n = rough(0, 60), 60
    want = T.statistics(T.sums_of(wide(envelope(1, n)), SPEC), n, SPEC)
    cost = lambda a: T.weighted(T.statistics(T.sums_of(wide(a), SPEC), n, SPEC), want, SPEC)[0]
    sums = T.sums_of(wide(x), SPEC)
    have = T.statistics(sums, n, SPEC)
    for only in (None, *have):
        s = SPEC if only is None else T.Texture(3, lags=(1, 3), offsets=(1, 2), rates=(0.06, 0.12, 0.24), reach=6, weights={k: float(k == only) for k in have})
        g = T.gradient_of(wide(x), T.owed(sums, n, T.weighted(have, want, s)[1], s), s)
        cost = lambda a, s=s: T.weighted(T.statistics(T.sums_of(wide(a), SPEC), n, SPEC), want, s)[0]
        for i, c in ((0, 0), (7, 1), (31, 2), (59, 1)):
            up, down = x.copy(), x.copy()
            up[i, c] += 1e-6
            down[i, c] -= 1e-6
            assert np.isclose((cost(up) - cost(down)) / 2e-6, g[i, c], rtol=1e-4, atol=1e-6 * np.abs(g).max()), only


@pytest.mark.parametrize("block", [20, 64, 10_000])
def test_blocks_give_the_sums_of_the_whole(spark, block):
    sizes = (150, 12, 61)
    found = {r.stim: (r.n, np.array(r.sums)) for r in T.measured(T.in_blocks(tall(spark, envelope, sizes), SPEC, block), SPEC).collect()}
    for k, n in enumerate(sizes):
        assert found[k][0] == n and np.allclose(found[k][1], T.sums_of(wide(envelope(k, n)), SPEC))


def test_envelopes_take_on_statistics_and_go_on(spark, tmp_path):
    sizes = (300, 260)
    target = T.measured(T.in_blocks(tall(spark, envelope, sizes), SPEC, 100), SPEC)
    start, folder = tall(spark, rough, sizes), str(tmp_path)
    first = T.impose(start, target, SPEC, folder, steps=4, block=100).groupBy("stim").agg(F.first("snr_db").alias("snr"))
    assert min(r.snr for r in first.collect()) > 5
    out = T.impose(start, target, SPEC, folder, steps=60, end_db=18, block=100)
    rows = out.collect()
    assert len(rows) == 3 * sum(sizes) and min(r.snr_db for r in rows) >= 18
    x = np.zeros((sizes[0], 3))
    for r in rows:
        if r.stim == 0:
            x[r.n, r.channel] = r.x
    want = T.statistics(np.array(target.where("stim = 0").first().sums), sizes[0], SPEC)
    assert T.snr_db(want, T.statistics(T.sums_of(wide(x), SPEC), sizes[0], SPEC)) >= 18 and (x > 0).all()
    other = T.Texture(3, lags=(1,), offsets=(1,), rates=())
    sums = T.measured(T.in_blocks(tall(spark, envelope, sizes), other, 100), other)
    assert T.impose(start, sums, other, folder, steps=1, block=100).count() == 3 * sum(sizes)
    assert len(list(tmp_path.iterdir())) == 2


def test_missing_channels_are_an_error(spark):
    with pytest.raises(Exception, match="not 3 channels"):
        T.in_blocks(tall(spark, envelope, (30,)).where("channel < 2 or n > 3"), SPEC).collect()
