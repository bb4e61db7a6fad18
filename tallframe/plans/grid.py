"""Queries on the time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import grid, prepare, stats
from tallframe.plans.common import SAMPLES, Query, rounded
from tallframe.sources.tables import samples, signals

KERNEL, STRIDE = 16, 10
HOURS6 = 21600.0
#: Samples of a task, and tasks at least, where points are put in order.
TASK, TASKS = 250_000, 8


def stim_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signals(spark, sf_dir).groupBy("stim").agg(F.count("*").alias("n_samples"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return own.orderBy("stim")


def pad_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.time_axis(grid.padded(samples(spark, sf_dir), 5, 3), 100.0, -0.05)
    return out.select("stim", "n", rounded("t").alias("t"), "x")


def frame_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = grid.frames(samples(spark, sf_dir), KERNEL, STRIDE)
    return f.groupBy("stim", "frame").agg(rounded(F.sum("x") / F.max("size")).alias("mean"))


def frame_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = grid.frames(samples(spark, sf_dir), KERNEL, STRIDE, tail=False)
    return f.where(F.col("pos") < STRIDE).groupBy("stim", "frame").agg(rounded(F.avg("x")).alias("mean"), F.count("*").alias("n"))


def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = grid.frames(samples(spark, sf_dir), KERNEL, STRIDE).withColumn("x", F.col("x") * (F.col("frame") + 1))
    return grid.overlap_add(f, KERNEL, STRIDE).select("stim", "n", rounded("x", 4).alias("x"))


def buffered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = grid.buffered_frames(samples(spark, sf_dir), 20, 4, 1)
    return f.groupBy("stim", "frame").agg(F.count("*").alias("n_in"), rounded(F.sum("x") / 25).alias("mean"))


def combine_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.combined(grid.buffered_frames(samples(spark, sf_dir), 20, 4, 1), 20, 4).select("stim", "n", "x")


def points(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """Samples at seconds since the stimulus's first, and 100 s before it; stimuli are dealt to ``parts``."""
    s = signals(spark, sf_dir)
    start = s.groupBy("stim").agg(F.min("us").alias("us0"))
    return s.select("stim", "us", "x").repartition(parts, "stim").join(start, "stim").groupBy("stim", ((F.col("us") - F.col("us0")) / 1e6 + 100).alias("t")).agg(F.min("x").alias("x"))


def align_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = max(TASKS, -(-signals(spark, sf_dir).count() // TASK))
    return grid.aligned(points(spark, sf_dir, parts), HOURS6, bucket=86400.0, parts=parts).select("stim", "frame", rounded("x").alias("x"))


def interp_null_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("x", F.when(F.col("event_id") % 17 != 0, F.col("x")))
    return grid.filled(s).select("stim", "n", rounded("x").alias("x"))


def lag_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    ahead = grid.lagged(s, -2).select("stim", "n", F.col("lagged").alias("lead2"))
    return grid.lagged(s, 3).withColumnRenamed("lagged", "lag3").join(ahead, ["stim", "n"])


def autocorr_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.autocorrelation(samples(spark, sf_dir), [0, 1, 2, 4, 8]).select("stim", "lag", rounded("ac").alias("ac"))


def trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples without the first ten and the last ten."""
    return prepare.trimmed(samples(spark, sf_dir), 10, 10)


def baseline_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.baseline_percent(samples(spark, sf_dir), "label", F.col("n") - 10, 8)
    return out.select("event_id", "label", rounded("x").alias("psc"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (stim_catalog, pad_grid, frame_mean, frame_whole, overlap_add, buffered_frames, combine_frames, align_linear, interp_null_gap, lag_shift, autocorr_lags, trimmed, baseline_percent)}

LENGTHS = "l AS (SELECT stim, max(n) + 1 AS length FROM s GROUP BY stim)"
FRAMES = f"""{SAMPLES}, {LENGTHS},
c AS (SELECT stim, length, CASE WHEN length <= {KERNEL} THEN 0 ELSE CAST(ceil((length - {KERNEL}) / {STRIDE}.0) AS BIGINT) END AS last FROM l),
g AS (SELECT stim, length, last, unnest(range(last + 1)) AS frame FROM c),
f AS (SELECT g.stim, g.frame, g.last, least(g.length, {KERNEL}) AS size, s.n - g.frame * {STRIDE} AS pos, s.x FROM g JOIN s ON s.stim = g.stim AND s.n >= g.frame * {STRIDE} AND s.n < g.frame * {STRIDE} + {KERNEL})"""
REST = KERNEL - STRIDE
HANN = f"(0.5 - 0.5 * cos(2 * pi() / {2 * REST - 1} * %s))"
ORACLES = {
    "stim_catalog": "SELECT user_id AS stim, count(*) AS n_samples, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY user_id ORDER BY stim",
    "pad_grid": f"""WITH {SAMPLES}, {LENGTHS}, g AS (SELECT stim, unnest(range(length + 8)) AS n FROM l)
SELECT g.stim, g.n, round(g.n / 100.0 - 0.05, 6) AS t, coalesce(s.x, 0.0) AS x FROM g LEFT JOIN s ON s.stim = g.stim AND s.n = g.n - 5""",
    "frame_mean": f"WITH {FRAMES} SELECT stim, frame, round(sum(x) / max(size), 6) AS mean FROM f GROUP BY stim, frame",
    "frame_whole": f"""WITH {SAMPLES}, {LENGTHS}, g AS (SELECT stim, unnest(range(CASE WHEN length <= {KERNEL} THEN 1 ELSE (length - {KERNEL}) // {STRIDE} + 1 END)) AS frame FROM l)
SELECT g.stim, g.frame, round(avg(x), 6) AS mean, count(*) AS n FROM g JOIN s ON s.stim = g.stim AND s.n >= frame * {STRIDE} AND s.n < (frame + 1) * {STRIDE} GROUP BY g.stim, g.frame""",
    "overlap_add": f"""WITH {FRAMES},
i AS (SELECT *, frame * {STRIDE} + pos AS n, CASE WHEN pos >= {STRIDE} THEN pos - {STRIDE} ELSE pos END AS k FROM f),
w AS (SELECT *, {HANN % "(2 * k)"} / ({HANN % "(2 * k)"} + {HANN % "(2 * k + 1)"}) AS w FROM i)
SELECT stim, n, round(sum(x * (frame + 1) * CASE WHEN pos < {REST} AND frame > 0 THEN w WHEN pos >= {STRIDE} AND frame < last THEN 1 - w ELSE 1 END), 4) AS x FROM w GROUP BY stim, n""",
    "buffered_frames": f"""WITH {SAMPLES}, {LENGTHS}, g AS (SELECT stim, unnest(range(CAST(ceil(length / 20.0) AS BIGINT))) AS frame FROM l)
SELECT g.stim, g.frame, count(*) AS n_in, round(sum(x) / 25, 6) AS mean FROM g JOIN s ON s.stim = g.stim AND s.n >= frame * 20 - 4 AND s.n < frame * 20 + 21 GROUP BY g.stim, g.frame""",
    "combine_frames": f"WITH {SAMPLES} SELECT stim, n, x FROM s",
    "align_linear": f"""WITH {SAMPLES}, z AS (SELECT stim, (us - min(us) OVER (PARTITION BY stim)) / 1e6 + 100 AS t, x FROM s),
p AS (SELECT stim, t, min(x) AS x FROM z GROUP BY stim, t),
q AS (SELECT *, lead(t) OVER w AS t1, lead(x) OVER w AS x1 FROM p WINDOW w AS (PARTITION BY stim ORDER BY t)),
g AS (SELECT stim, unnest(range(CAST(floor(max(t) / {HOURS6}) AS BIGINT) + 1)) AS frame FROM p GROUP BY stim),
h AS (SELECT g.stim, g.frame, q.t, q.x, q.t1, q.x1 FROM g ASOF LEFT JOIN q ON q.stim = g.stim AND q.t <= g.frame * {HOURS6}),
o AS (SELECT stim, arg_min(x, t) AS x0 FROM p GROUP BY stim)
SELECT h.stim, h.frame, round(CASE WHEN t IS NULL THEN x0 WHEN t1 IS NULL THEN x ELSE x + (frame * {HOURS6} - t) / (t1 - t) * (x1 - x) END, 6) AS x FROM h JOIN o USING (stim)""",
    "interp_null_gap": f"""WITH {SAMPLES}, v AS (SELECT stim, n, CASE WHEN event_id % 17 <> 0 THEN x END AS x FROM s),
e AS (SELECT stim, n, x, max(CASE WHEN x IS NOT NULL THEN n END) OVER (PARTITION BY stim ORDER BY n) AS a, min(CASE WHEN x IS NOT NULL THEN n END) OVER (PARTITION BY stim ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM v)
SELECT e.stim, e.n, round(CASE WHEN e.x IS NOT NULL THEN e.x WHEN a IS NULL THEN y.x WHEN b IS NULL THEN z.x ELSE z.x + (e.n - a) / CAST(b - a AS DOUBLE) * (y.x - z.x) END, 6) AS x
FROM e LEFT JOIN v z ON z.stim = e.stim AND z.n = a LEFT JOIN v y ON y.stim = e.stim AND y.n = b""",
    "lag_shift": f"WITH {SAMPLES} SELECT stim, n, x, coalesce(lag(x, 3) OVER w, 0.0) AS lag3, coalesce(lead(x, 2) OVER w, 0.0) AS lead2 FROM s WINDOW w AS (PARTITION BY stim ORDER BY n)",
    "autocorr_lags": f"""WITH {SAMPLES}, m AS (SELECT stim, avg(x) AS m, var_pop(x) AS v, count(*) AS c FROM s GROUP BY stim), y AS (SELECT stim, n, x - m AS y FROM s JOIN m USING (stim)),
k AS (SELECT unnest([0, 1, 2, 4, 8]) AS lag), p AS (SELECT a.stim, lag, sum(a.y * b.y) AS p FROM k, y a JOIN y b ON a.stim = b.stim AND a.n = b.n + 2 * lag GROUP BY a.stim, lag)
SELECT m.stim, k.lag, round(coalesce(p, 0.0) / c / nullif(v, 0), 6) AS ac FROM m CROSS JOIN k LEFT JOIN p ON p.stim = m.stim AND p.lag = k.lag""",
    "trimmed": f"WITH {SAMPLES}, {LENGTHS} SELECT stim, n, x FROM s JOIN l USING (stim) WHERE n >= 10 AND n < length - 10",
    "baseline_percent": f"""WITH {SAMPLES}, b AS (SELECT label, stim, avg(x) AS b FROM s WHERE n - 10 >= -8 AND n - 10 < 0 GROUP BY label, stim), c AS (SELECT label, avg(b) AS b FROM b GROUP BY label)
SELECT event_id, label, round(100 * (x - b) / nullif(b, 0), 6) AS psc FROM s JOIN c USING (label)""",
}
