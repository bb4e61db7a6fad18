"""Filters of whole cochleagrams, their sums and matching, against two-dimensional transforms in numpy."""

import numpy as np
import pytest

from tallframe.functions.columns import expanded
from tallframe.operators import annotate, joins, kernels
from tallframe.operators import modulation as M

CHANNELS = 6
EACH = ((0.0, 0.0, 1), (2.0, None, 1), (None, 0.5, 1), (2.0, 0.5, 1), (2.0, 0.5, -1), (0.0, 0.5, 1))
FILTERS = M.Filters(CHANNELS, EACH, 16.0, 4.0)


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(0)
    return [{k: scale * rng.normal(size=(13 + k, CHANNELS)) for k in range(2)} for scale in (1, 2)]


def tall(spark, planes):
    return spark.createDataFrame([(s, t, k, float(v)) for s, x in planes.items() for t, row in enumerate(x) for k, v in enumerate(row)], "stim int, frame bigint, k int, x double").repartition(3)


def grids(df, keys):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r.frame, r.k] = r.x
    return {k: np.array([[v[t, c] for c in range(CHANNELS)] for t in range(len(v) // CHANNELS)]) for k, v in out.items()}


def transfer(n):
    return [kernels.modulation_filter(rate, scale, (n, CHANNELS), 16.0, 4.0, sign=sign) for rate, scale, sign in EACH]


def test_filters_and_the_way_back(spark, planes):
    bands = M.filtered(tall(spark, planes[0]), FILTERS).cache()
    got, back = grids(bands, ("stim", "filter")), grids(M.put_together(bands, FILTERS), ("stim",))
    for k, x in planes[0].items():
        want = kernels.modulated(x, transfer(len(x)))
        assert all(np.allclose(got[k, i], b, atol=1e-9) for i, b in enumerate(want))
        assert np.allclose(back[k,], kernels.demodulated(want, transfer(len(x))), atol=1e-9)


def test_matching_with_what_cancels(spark, planes):
    got = grids(M.matched(tall(spark, planes[0]), tall(spark, planes[1]), FILTERS, width=0.5, cancellation=True), ("stim",))
    for k, x in planes[0].items():
        h = transfer(len(x))
        bands = [kernels.rank_matched(a, b) for a, b in zip(kernels.modulated(x, h), kernels.modulated(planes[1][k], h), strict=True)]
        each = [np.fft.fft2(b) * np.conj(q) for b, q in zip(bands, h, strict=True)]
        lost = sum(np.abs(e) for e in each) - np.abs(sum(each))
        power = sum(np.abs(q) ** 2 for q in h)
        want = np.fft.ifft2(np.where(power > 1e-10, (sum(each) + lost) / np.maximum(power, 1e-10), 0)).real
        assert np.allclose(got[k,], want, atol=1e-9)


def test_rounds_of_synthesis(spark, planes, tmp_path):
    start, target = (tall(spark, {0: p[0]}) for p in planes)
    few = M.Filters(CHANNELS, ((0.0, 0.0, 1), (2.0, None, 1), (None, 0.5, 1)), 16.0, 4.0)
    got = grids(M.synthesise(start, target, few, str(tmp_path), iterations=1, width=0.5, buffer=2), ("stim",))[0,]
    x, y = planes[0][0], planes[1][0]
    h = [kernels.modulation_filter(rate, scale, x.shape, 16.0, 4.0, sign=sign) for rate, scale, sign in few.each]

    def matched(a, b):
        a = a.copy()
        a[2:-2] = kernels.rank_matched(a[2:-2], b[2:-2])
        return a

    want = kernels.demodulated([matched(a, b) for a, b in zip(kernels.modulated(x, h), kernels.modulated(y, h), strict=True)], h)
    want = matched(want, y)
    assert np.allclose(got, want, atol=1e-9)
    before = sorted(tmp_path.rglob("*.parquet"))
    assert M.synthesise(start, target, few, str(tmp_path), iterations=1, width=0.5, buffer=2).count() == x.size
    assert sorted(tmp_path.rglob("*.parquet")) == before


def test_contractions(spark):
    pairs = {"can't've": "cannot have", "Y'ALL'D'VE": "you all would have", "won't": "will not", "he’s": "he is", "girl's": "girl", "how'd'y": "how do you", "where'd": "where did", "shouldn't've": "should not have", "o'clock": "of the clock", "so's": "so as", "plain words": "plain words", "it's they're": "it is they are", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in pairs], "label string")
    assert {r.label: r.e for r in df.select("label", expanded(df.label).alias("e")).collect()} == pairs
    vectors = spark.createDataFrame([("do", [1.0]), ("not", [3.0]), ("go", [5.0])], "label string, v array<double>")
    events = spark.createDataFrame([("s", "Don't", 0.0, 0.1), ("s", "go", 0.0, 0.1), ("s", "go", 0.0, 0.1)], "stim string, label string, onset double, offset double")
    assert [(r.frame, r.x) for r in joins.embedded(events, vectors, 10, contractions=True).collect()] == [(0, 4.0)]


def test_nearest_across_buckets(spark):
    rng = np.random.default_rng(1)
    ys = np.round(rng.normal(size=500), 2)
    xs = [*np.round(rng.normal(size=300), 3).tolist(), -50.0, 50.0, None, *[0.25] * 200]
    targets = spark.createDataFrame([(k, float(y)) for k, y in enumerate(ys)] + [(999, None)], "i int, y double").repartition(5)
    queries = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "q int, x double").repartition(5)
    for rows in (40, 1_000_000):
        got = {r.q: (r.nearest, r.nearest_number) for r in joins.nearest(queries, targets, "x", "y", "i", bucket_rows=rows).collect()}
        for k, x in enumerate(xs):
            want = (None, None) if x is None else min(((abs(y - x), i, y) for i, y in enumerate(ys)))[2:0:-1]
            assert got[k] == want, (x, got[k], want)
    assert joins.nearest(queries, targets.limit(0), "x", "y", "i").where("nearest is not null").count() == 0


def test_combined_sets_keep_their_nulls(spark):
    a = spark.createDataFrame([("s", 0, None, "n"), ("s", 1, 2.0, None)], "stim string, frame int, a double, name string")
    b = spark.createDataFrame([("s", 1, 7), ("s", 2, 8)], "stim string, frame int, b int")
    assert {(r.frame, r.a, r.name, r.b) for r in annotate.combined(a, b).collect()} == {(0, None, "n", 0), (1, 2.0, None, 7), (2, 0.0, None, 8)}


def test_nearest_counts_no_row_twice(spark):
    """No window begins at its row: Spark adds such a frame up anew for each row, which is quadratic in a bucket."""
    own = spark.range(500).selectExpr("id as i", "cast(id * 7 % 500 as double) as y")
    found = joins.nearest(own.selectExpr("y + 0.4 as x"), own, "x", "y", "i")
    plan = found._jdf.queryExecution().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert all(abs(r.nearest + 0.4 - r.x) < 1e-9 for r in found.collect())


def test_embedded_deals_frames_out_once(spark):
    """Vectors' elements are added up where their frames lie: none is shuffled by its number."""
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 5.0])], "label string, v array<double>")
    events = spark.createDataFrame([("s", "a b", 0.0, 0.2), ("s", "a", 0.1, 0.2), ("s", "a", 0.1, 0.2), ("s", "c", 0.1, 0.2), ("s", None, 0.0, 0.1)], "stim string, label string, onset double, offset double")
    found = joins.embedded(events, vectors, 10)
    assert {(r.frame, r.k): round(r.x, 9) for r in found.collect()} == {(0, 0): 2.0, (0, 1): 3.5, (1, 0): round(4 / 3, 9), (1, 1): 2.5}
    assert "hashpartitioning(stim" in (plan := found._jdf.queryExecution().toString()) and not [x for x in plan.splitlines() if "Exchange hashpartitioning(stim" in x and ", k#" in x]
