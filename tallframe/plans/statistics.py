"""Queries on moments, histograms, correlations, matching and principal components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import match, pca, stats
from tallframe.plans.common import SAMPLES, Query, rounded
from tallframe.sources.tables import signals, table

#: A target distribution: values and the cumulative share there.
TARGET = [(0.0, 0.0), (10.0, 0.25), (20.0, 0.75), (40.0, 1.0)]


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples of even users as originals and of odd users as synthetic, by label as the channel, numbered by event."""
    s = signals(spark, sf_dir).select(F.col("label").alias("channel"), "stim", F.col("event_id").alias("n"), "x")
    return s.where("stim % 2 = 0"), s.where("stim % 2 = 1")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("label").alias("stim"), F.col("embedding").alias("v"))


def stim_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.moments(signals(spark, sf_dir), ["stim"])
    return m.select("stim", *[rounded(c).alias(c) for c in ("mean", "var", "skew", "kurt")])


def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.weighted_moments(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_quantity")
    return m.select("l_returnflag", "l_linestatus", rounded("mean", 4).alias("mean"), *[rounded(c).alias(c) for c in ("cv", "skew", "kurt")])


def rms_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scaled(signals(spark, sf_dir), ["stim"], 0.01).select("event_id", rounded("x", 8).alias("x"))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardised(signals(spark, sf_dir), ["stim"]).select("event_id", rounded("x").alias("x"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(signals(spark, sf_dir), ["label"], 20, F.lit(0.0), F.lit(500.0)).select("label", "bin", "n", rounded("p").alias("p"))


def js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.js_divergence(*halves(spark, sf_dir), ["channel"], 20).select("channel", rounded("jsd").alias("jsd"))


def bhatt_coef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bhattacharyya(*halves(spark, sf_dir), ["channel"], 50).select("channel", rounded("bc").alias("bc"))


def nan_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_extendedprice")).alias("b"))
    return stats.correlation(lines, ["l_returnflag"], "a", "b").select("l_returnflag", rounded("r").alias("r"), rounded("r2").alias("r2"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of both halves by channel: ``channel, moment, o, s``."""
    names = ("mean", "var", "skew", "kurt")

    def tall(df: DataFrame, name: str) -> DataFrame:
        m = stats.moments(df, ["channel"])
        return m.select("channel", F.inline(F.array(*[F.struct(F.lit(k).alias("moment"), F.col(k).alias(name)) for k in names])))

    o, s = halves(spark, sf_dir)
    return tall(o, "o").join(tall(s, "s"), ["channel", "moment"])


def moment_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    snr = pairs(spark, sf_dir).withColumn("snr", stats.level_ratio(F.col("o"), F.col("s")))
    return snr.groupBy("moment").agg(rounded(F.percentile("snr", 0.5), 4).alias("snr_db"))


def energy_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.energy_ratio(pairs(spark, sf_dir), ["moment"], "o", "s").select("moment", rounded("snr_db", 4).alias("snr_db"))


def significant_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = signals(spark, sf_dir).groupBy("stim").agg(F.var_pop("x").alias("var"))
    return stats.significant(bands, 1.5).select("stim", "significant")


def channel_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.channel_correlation(features(spark, sf_dir)).select("i", "j", rounded("r").alias("r"))


def feature_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.covariance(features(spark, sf_dir)).select("i", "j", rounded("cov", 8).alias("cov"))


def stat_morph(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select("l_returnflag", "l_shipdate", F.when(F.col("l_linenumber") == 1, 0.3).otherwise(0.7).alias("w"), F.col("l_extendedprice").alias("value"))
    return stats.morph(lines, ["l_returnflag"], "w").select("l_returnflag", rounded("value", 4).alias("value"))


def hist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = halves(spark, sf_dir)
    return match.by_rank(s, o, ["channel"], width=25.0).select("channel", "n", "x")


def hist_match_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = halves(spark, sf_dir)
    return match.by_rank_in_segments(s, o, ["channel"], 500, width=100.0).select("channel", "n", "x")


def mean_var_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, s = halves(spark, sf_dir)
    return match.by_mean_and_variance(s, o, ["channel"]).select("channel", "n", rounded("x").alias("x"))


def cdf_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = halves(spark, sf_dir)[1]
    return match.by_distribution(s, ["channel"], TARGET, 30).select("channel", "n", rounded("x").alias("x"))


def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = features(spark, sf_dir)
    return pca.project(own, pca.fit(own), 10).select("vec_id", F.posexplode("v").alias("k", "x")).select("vec_id", "k", rounded("x").alias("x"))


def pca_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on stimuli of even labels, standardised, and applied to the others."""
    own = features(spark, sf_dir)
    model = pca.fit(own.where("stim % 2 = 0"), standardise=True)
    return pca.project(own.where("stim % 2 = 1"), model, 5).select("vec_id", F.posexplode("v").alias("k", "x")).select("vec_id", "k", rounded("x").alias("x"))


def pca_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all components: the features again."""
    own = features(spark, sf_dir)
    model = pca.fit(own)
    return pca.reconstruct(pca.project(own, model), model).select("vec_id", F.posexplode("v").alias("k", "x")).select("vec_id", "k", (rounded("x", 4) + 0.0).alias("x"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (stim_moments, weighted_moments, rms_norm, zscore, histogram, js_divergence, bhatt_coef, nan_corr, moment_snr, energy_snr, significant_band, channel_corr, feature_covariance, stat_morph, hist_match, hist_match_segments, mean_var_match, cdf_match, pca_project, pca_transfer, pca_reconstruct)}

HALVES = f"{SAMPLES}, o AS (SELECT label AS channel, event_id AS n, x FROM s WHERE stim % 2 = 0), y AS (SELECT label AS channel, event_id AS n, x FROM s WHERE stim % 2 = 1)"


def power_moments(source: str, key: str) -> str:
    return f"""(SELECT {key}, m AS mean, m2 * c / nullif(c - 1, 0) AS var, m3 / nullif(m2, 0) ** 1.5 AS skew, m4 / nullif(m2, 0) ** 2 AS kurt FROM
(SELECT {key}, any_value(m) AS m, count(*) AS c, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM (SELECT {key}, x, avg(x) OVER (PARTITION BY {key}) AS m FROM {source}) GROUP BY {key}))"""


def bins(n: int) -> str:
    return f"""b AS (SELECT channel, min(x) AS lo, max(x) AS hi FROM (SELECT channel, x FROM o UNION ALL SELECT channel, x FROM y) GROUP BY channel),
p AS (SELECT channel, bin, count(*) / sum(count(*)) OVER (PARTITION BY channel) AS p FROM (SELECT channel, least(greatest(floor((x - lo) / ((hi - lo) / {n - 1}) + 0.5), 0), {n - 1}) AS bin FROM o JOIN b USING (channel)) GROUP BY channel, bin),
q AS (SELECT channel, bin, count(*) / sum(count(*)) OVER (PARTITION BY channel) AS q FROM (SELECT channel, least(greatest(floor((x - lo) / ((hi - lo) / {n - 1}) + 0.5), 0), {n - 1}) AS bin FROM y JOIN b USING (channel)) GROUP BY channel, bin),
j AS (SELECT channel, bin, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (channel, bin))"""


PAIRS = f"""{HALVES}, mo AS (SELECT * FROM {power_moments("o", "channel")}), ms AS (SELECT * FROM {power_moments("y", "channel")}),
r AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS moment, mo.{k} AS o, ms.{k} AS s FROM mo JOIN ms USING (channel)" for k in ("mean", "var", "skew", "kurt")) + ")"
FEATURES = "e AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings)"
COVARIANCE = f"{FEATURES}, c AS (SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, avg(a.v * b.v) - avg(a.v) * avg(b.v) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i)"


def rank_match(keys: str) -> str:
    return f"""WITH {HALVES}, a AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, n) AS r FROM y), t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x, n) AS r FROM o)
SELECT a.channel, a.n, coalesce(t.x, a.x) AS x FROM a LEFT JOIN t ON {" AND ".join(f"a.{k} = t.{k}" if k == "channel" else "a.n // 500 = t.n // 500" for k in keys.split(", "))} AND a.r = t.r"""


ORACLES = {
    "stim_moments": f"WITH {SAMPLES} SELECT stim, round(mean, 6) AS mean, round(var, 6) AS var, round(skew, 6) AS skew, round(kurt, 6) AS kurt FROM {power_moments('s', 'stim')}",
    "weighted_moments": """WITH m AS (SELECT *, sum(l_quantity) OVER w AS sw, sum(l_quantity * l_extendedprice) OVER w / sum(l_quantity) OVER w AS m FROM lineitem WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)),
c AS (SELECT l_returnflag, l_linestatus, any_value(m) AS m, sum(l_quantity * (l_extendedprice - m) ** 2) / any_value(sw) AS m2, sum(l_quantity * (l_extendedprice - m) ** 3) / any_value(sw) AS m3, sum(l_quantity * (l_extendedprice - m) ** 4) / any_value(sw) AS m4 FROM m GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(m, 4) AS mean, round(sqrt(m2) / m, 6) AS cv, round(m3 / m2 ** 1.5, 6) AS skew, round(m4 / m2 ** 2, 6) AS kurt FROM c""",
    "rms_norm": f"WITH {SAMPLES} SELECT event_id, round(x * 0.01 / sqrt(avg(x * x) OVER (PARTITION BY stim)), 8) AS x FROM s",
    "zscore": f"WITH {SAMPLES} SELECT event_id, round((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 6) AS x FROM s WINDOW w AS (PARTITION BY stim)",
    "histogram": f"""WITH {SAMPLES}, h AS (SELECT label, CAST(least(greatest(floor(x / (500.0 / 19) + 0.5), 0), 19) AS BIGINT) AS bin, count(*) AS n FROM s GROUP BY 1, 2)
SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS p FROM h""",
    "js_divergence": f"""WITH {HALVES}, {bins(20)}, z AS (SELECT channel, (p + 1e-6 / 20) / (1 + 1e-6) AS p, (q + 1e-6 / 20) / (1 + 1e-6) AS q FROM j)
SELECT channel, round(sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) / 2, 6) AS jsd FROM z GROUP BY channel""",
    "bhatt_coef": f"WITH {HALVES}, {bins(50)} SELECT channel, round(sum(sqrt(p * q)), 6) AS bc FROM j GROUP BY channel",
    "nan_corr": """WITH l AS (SELECT l_returnflag, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS a, CASE WHEN l_orderkey % 11 <> 0 THEN l_extendedprice END AS b FROM lineitem),
d AS (SELECT l_returnflag, a - avg(a) OVER w AS a, b - avg(b) OVER w AS b FROM l WINDOW w AS (PARTITION BY l_returnflag)), r AS (SELECT l_returnflag, sum(a * b) / sqrt(sum(a * a) * sum(b * b)) AS r FROM d GROUP BY 1)
SELECT l_returnflag, round(r, 6) AS r, round(sign(r) * r * r, 6) AS r2 FROM r""",
    "moment_snr": f"WITH {PAIRS} SELECT moment, round(quantile_cont(CASE WHEN o <> 0 AND o <> s THEN 20 * log10(abs(o)) - 20 * log10(abs(s - o)) END, 0.5), 4) AS snr_db FROM r GROUP BY moment",
    "energy_snr": f"WITH {PAIRS} SELECT moment, round(10 * log10(sum(o * o) / nullif(sum((o - s) ** 2), 0)), 4) AS snr_db FROM r GROUP BY moment",
    "significant_band": f"WITH {SAMPLES}, v AS (SELECT stim, var_pop(x) AS v FROM s GROUP BY stim) SELECT stim, coalesce(10 * log10(max(v) OVER () / nullif(v, 0)) < 1.5, false) AS significant FROM v",
    "channel_corr": f"WITH {COVARIANCE} SELECT c.i, c.j, round(c.cov / sqrt(a.cov * b.cov), 6) AS r FROM c JOIN c a ON a.i = c.i AND a.j = c.i JOIN c b ON b.i = c.j AND b.j = c.j WHERE c.i < c.j",
    "feature_covariance": f"WITH {COVARIANCE} SELECT i, j, round(cov, 8) AS cov FROM c",
    "stat_morph": "WITH l AS (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS w, l_extendedprice AS v FROM lineitem WHERE l_linenumber <= 2) SELECT l_returnflag, round(sum(w * v) / sum(w), 4) AS value FROM l GROUP BY 1",
    "hist_match": rank_match("channel"),
    "hist_match_segments": rank_match("channel, n // 500"),
    "mean_var_match": f"""WITH {HALVES}, a AS (SELECT channel, avg(x) AS m, coalesce(nullif(stddev_samp(x), 0), 1) AS s FROM y GROUP BY 1), t AS (SELECT channel, avg(x) AS m, coalesce(stddev_samp(x), 0) AS s FROM o GROUP BY 1)
SELECT y.channel, n, round((x - a.m) / a.s * t.s + t.m, 6) AS x FROM y JOIN a USING (channel) JOIN t USING (channel)""",
    "cdf_match": f"""WITH {HALVES}, b AS (SELECT channel, n, x, min(x) OVER w AS lo, (max(x) OVER w - min(x) OVER w) / 29 AS st FROM y WINDOW w AS (PARTITION BY channel)),
k AS (SELECT *, least(greatest(floor((x - lo) / st + 0.5), 0), 29) AS bin FROM b), c AS (SELECT channel, bin, count(*) AS m FROM k GROUP BY 1, 2),
d AS (SELECT channel, bin, m, sum(m) OVER (PARTITION BY channel ORDER BY bin) - m AS before, sum(m) OVER (PARTITION BY channel) AS al FROM c),
u AS (SELECT k.channel, n, (before + least(greatest((x - lo) / st - bin + 0.5, 0), 1) * m) / al AS u FROM k JOIN d USING (channel, bin))
SELECT channel, n, round(CASE WHEN u <= 0.25 THEN u * 40 WHEN u <= 0.75 THEN 10 + (u - 0.25) * 20 WHEN u <= 1 THEN 20 + (u - 0.75) * 80 ELSE 40 END, 6) AS x FROM u""",
    "pca_reconstruct": f"WITH {FEATURES} SELECT vec_id, CAST(i AS INTEGER) AS k, round(v, 4) + 0.0 AS x FROM e",
}
