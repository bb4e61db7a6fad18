"""Queries on shapes of features, repeated measurements, comparisons, annotation sets and stored frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.operators import annotate, compare, grid, joins, pca, prepare, repeats, shapes, stats
from tallframe.plans.common import SAMPLES, Query, rounded, values
from tallframe.plans.relational import HOURS, KINDS, intervals
from tallframe.plans.statistics import HALVES, bins, halves
from tallframe.sources import files
from tallframe.sources.tables import samples, signals, table

DAY = 86_400_000_000


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element of each embedding, ``vec_id, feature, x``."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("feature", "x"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as repeated measurements ``stim, rep, n, x, score``: days are samples, types repetitions, each seventh an outlier."""
    start = 19_723 * DAY
    return signals(spark, sf_dir).select("stim", F.col("label").alias("rep"), F.floor((F.col("us") - start) / DAY).alias("n"), "x", F.when(F.col("event_id") % 7 == 0, 0.5).otherwise(0.05).alias("score"))


def layer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many outputs each layer of a speech network has for each stimulus, taken for ten samples an event, and when."""
    own = signals(spark, sf_dir).groupBy("stim").agg((F.count("*") * 10).alias("length"))
    return shapes.layer_frames(own, *shapes.SPEECH).select("stim", "layer", "frames", rounded("t0", 8).alias("t0"), rounded("sr").alias("sr"))


def flatten_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [("a", 4), ("b", 8), ("c", 2)]
    apart = shapes.unflattened(elements(spark, sf_dir), axes)
    c = shapes.flattened(apart.withColumns({f"_{k}": F.col(k) for k, _ in axes}), axes)
    back = [(f"_{k}", n) for k, n in axes]
    return shapes.squeezed(shapes.expanded(shapes.flattened(c, back, name="f_order", order="F"), "layer"), "layer").select("vec_id", F.col("feature").alias("c_order"), "f_order", F.col("x").cast("double").alias("x"))


def merge_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [("a", 4), ("b", 8), ("c", 2)]
    return shapes.all_but_last(shapes.unflattened(elements(spark, sf_dir), axes), axes, name="row").select("vec_id", "row", "c", F.col("x").cast("double").alias("x"))


def token_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("stim"), F.col("vec_id").alias("token"), F.slice("embedding", 1, 3).alias("v"))
    rows = shapes.token_rows(tokens, skip=2, bands=4, steps=101)
    return rows.select("stim", "frame", F.posexplode("v").alias("k", "x")).withColumn("x", F.col("x").cast("double"))


def map_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = shapes.unflattened(elements(spark, sf_dir), [("c", 4), ("f", 2), ("t", 8)]).withColumnRenamed("vec_id", "stim")
    return shapes.map_rows(maps, 4, 2).select("stim", "frame", "feature", F.col("x").cast("double").alias("x"))


def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.truncated(samples(spark, sf_dir), 75, "n").select("stim", "n", "x")


def feature_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("stim"), F.col("vec_id").alias("frame"), F.col("embedding").alias("v"))
    return shapes.sizes(rows)


def case_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return shapes.mapped(line, ["l_returnflag", "l_linestatus"], {("A", "F"): 1, ("N", "F"): 2, ("N", "O"): 3}, "stim").select("l_orderkey", "l_linenumber", "stim")


def zip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("stim")).agg(rounded(F.sum("c_acctbal"), 2).alias("x"))
    return shapes.named(sums, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stim"), F.col("n_name").alias("name")))


def repeats_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = repeats.without_outliers(days(spark, sf_dir))
    return repeats.mean_of_repeats(clean, ["stim", "n"]).select("stim", "n", rounded("x").alias("x"), "n_repeats")


def channel_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.median_of(repeats.without_outliers(days(spark, sf_dir)), ["stim"]).select("stim", rounded("x").alias("x"))


def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = signals(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("x")).alias("a"), F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("x")).alias("b"))
    return repeats.complete(pairs, ["a", "b"])


def join_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = signals(spark, sf_dir).select("stim", "event_id", "x", "label")
    runs = repeats.joined_runs(*[own.where(F.col("label") == k).drop("label") for k in ("view", "click")])
    return runs.groupBy("stim", "run").agg(F.count("*").alias("n"), rounded(F.avg("x")).alias("x"))


def envelope_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.envelopes(days(spark, sf_dir)).select("stim", "n", rounded("x").alias("x"))


def filter_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = compare.similarities(*halves(spark, sf_dir), ["channel"])
    return both.select("bins", "channel", rounded("jsd").alias("jsd"), rounded("bc").alias("bc"))


def filter_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of all filters' outputs: a filter is an event type, a channel a day of the week."""
    rows = signals(spark, sf_dir).select("label", F.pmod(F.floor(F.col("us") / DAY), F.lit(7)).alias("channel"), "x")
    m = stats.moments(rows, ["label", "channel"])
    return m.select("label", "channel", *[rounded(c).alias(c) for c in ("mean", "var", "skew", "kurt")])


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    parts = [line.where(F.col("l_linenumber") == k).groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("statistic")).agg(F.avg("l_quantity").alias("value")) for k in (1, 2, 3)]
    target, before, after = parts
    report = compare.before_and_after(target.withColumn("kind", F.col("statistic")), before, after, ["k", "statistic"], "kind")
    return report.select("kind", *[rounded(c, 4).alias(c) for c in ("before", "after", "gain_db")])


def class_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    a, b = (line.where(F.col("l_linenumber") == k).groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("statistic")).agg(F.avg("l_quantity").alias("value")) for k in (1, 2))
    bands = line.groupBy(F.col("l_suppkey").alias("k")).agg(F.var_pop("l_quantity").alias("var"))
    return compare.class_ratios(a, b, ["k", "statistic"], bands, 1.0).select("statistic", rounded("snr_db", 4).alias("snr_db"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).select(F.lit(0).alias("stim"), F.col("label").alias("filter"), F.floor(F.col("us") / 3_600_000_000).alias("n"), F.pmod("stim", F.lit(5)).cast("int").alias("channel"), "x")
    return rows.groupBy("stim", "filter", "n", "channel").agg((F.sum("x") - 50).alias("x"))


def filtered_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.filtered_correlation(hourly(spark, sf_dir)).select("filter", "i", "j", rounded("r").alias("r"))


def neighbour_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.filtered_correlation(hourly(spark, sf_dir), [1, 2]).select("filter", "i", "j", rounded("r").alias("r"))


def autocorr_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ac = grid.autocorrelation(samples(spark, sf_dir), [0, 1, 2, 4, 8])
    return prepare.energy(ac, ["stim"], "ac").select("stim", rounded("energy").alias("energy"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.vocabulary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("label")))


def positive_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct discounts above zero."""
    return joins.value_grid(rate=table(spark, sf_dir, "lineitem").select("l_discount")).where("rate > 0")


def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url").distinct().orderBy("url").limit(2)


def rare_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged labels themselves, of which counts are taken after."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("label"))
    return annotate.label_counts(annotate.rare_merged(words, 10))


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as phonemes with stresses, one of them silence."""
    names = F.create_map(*[F.lit(x) for k, v in zip(KINDS, ["AA1", "B", "IY0", "S", "spn"], strict=True) for x in (k, v)])
    return intervals(spark, sf_dir).withColumn("label", names[F.col("label")])


def phoneme_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.phonemes(sounds(spark, sf_dir), 1.0)


def phoneme_attribute_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("AA", "vowel"), ("IY", "vowel"), ("AA", "low"), ("B", "stop")], "label string, attribute string")
    return annotate.phonemes(sounds(spark, sf_dir), 1.0, attributes=pairs)


def word_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = intervals(spark, sf_dir).withColumn("label", F.when(F.col("offset") - F.col("onset") > 20, F.concat("label", F.lit("-"), "stim", F.lit("-"), F.floor("onset"))).otherwise(F.col("label")))
    return annotate.encoded(own, 1.0, [*KINDS, "LOWPROB"], least=10)


def feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = joins.one_hot(joins.occupied(intervals(spark, sf_dir), 1.0, onset_only=True), KINDS[:2])
    long = intervals(spark, sf_dir).where("offset - onset > 20")
    return annotate.combined(notes, joins.one_hot(joins.occupied(long.withColumn("label", F.lit("long")), 1.0), ["long"]))


def component_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The energy of all scores of a vector: that of its centred values, whatever the signs of components."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    scores = pca.project(own, pca.fit(own))
    return scores.select("vec_id", rounded(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x), 4).alias("energy"))


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = grid.lengths(samples(spark, sf_dir))
    return files.frame_times(lengths, sr=100.0, target=16, front=4, back=2)


def frame_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = samples(spark, sf_dir).where("event_id % 29 <> 0").select("stim", F.col("n").alias("frame"))
    return files.frame_catalog(own)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (layer_tables, flatten_axes, merge_axes, token_grid, map_grid, first_frames, feature_sizes, case_map, zip_names, repeats_mean, channel_median, complete_pairs, join_runs, envelope_loader, filter_similarities, filter_moments, before_after, class_snr, filtered_correlation, neighbour_correlation, autocorr_energy, vocabulary, positive_rates, first_files, rare_merge, phoneme_onehot, phoneme_attribute_onehot, word_onehot, feature_set, component_energy, frame_times, frame_catalog)
}

E = "e AS (SELECT vec_id, label, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
DAYS = f"{SAMPLES}, d AS (SELECT stim, label AS rep, CAST(floor((us - {19_723 * DAY}) / {DAY}.0) AS BIGINT) AS n, CASE WHEN event_id % 7 = 0 THEN NULL ELSE x END AS x FROM s)"
LINES = "l AS (SELECT l_suppkey AS k, l_returnflag AS kind, l_linenumber AS i, avg(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2, 3)"
HOURLY = f"{SAMPLES}, h AS (SELECT label AS filter, us // 3600000000 AS n, CAST(stim % 5 AS INTEGER) AS channel, sum(x) - 50 AS x FROM s GROUP BY 1, 2, 3)"
PAIRED = "SELECT a.filter, a.channel AS i, b.channel AS j, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) AS r FROM h a JOIN h b ON a.filter = b.filter AND a.n = b.n AND {} GROUP BY 1, 2, 3"
ONES = "CAST(max(CASE WHEN label = '{0}' THEN 1 ELSE 0 END) AS INTEGER) AS {0}"
SOUNDS = f"{HOURS}, j AS (SELECT stim, CASE label WHEN 'click' THEN 'AA' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'IY' WHEN 'signup' THEN 'S' END AS label, onset, offs FROM i WHERE label <> 'view')"


def spread(source: str, rate: float = 1.0) -> str:
    return f"c AS (SELECT stim, label, CAST(round_even(onset * {rate}, 0) AS BIGINT) AS a, CAST(round_even(offs * {rate}, 0) AS BIGINT) AS b FROM {source}), f AS (SELECT stim, label, unnest(range(a, greatest(b, a + 1))) AS frame FROM c)"


ORACLES: dict[str, str] = {
    "layer_tables": f"""WITH RECURSIVE c AS (SELECT user_id AS stim, count(*) * 10 AS m FROM events GROUP BY user_id), k AS (SELECT * FROM {values([(k, a, b) for k, (a, b) in enumerate(zip(*shapes.SPEECH[:2], strict=True))], "layer, size, stride")}),
w AS (SELECT stim, -1 AS layer, m AS frames, CAST(0 AS DOUBLE) AS t0, CAST(16000 AS DOUBLE) AS sr FROM c
      UNION ALL SELECT stim, k.layer, CASE WHEN frames < size THEN 0 ELSE (frames - size) // stride + 1 END, t0 + (size - 1) / (2 * sr), sr / stride FROM w JOIN k ON k.layer = w.layer + 1)
SELECT stim, layer, frames, round(t0, 8) AS t0, round(sr, 6) AS sr FROM w WHERE layer >= 0""",
    "flatten_axes": f"WITH {E} SELECT vec_id, k AS c_order, k // 16 + 4 * ((k // 2) % 8) + 32 * (k % 2) AS f_order, x FROM e",
    "merge_axes": f"WITH {E} SELECT vec_id, k // 16 + 4 * ((k // 2) % 8) AS row, k % 2 AS c, x FROM e",
    "token_grid": f"WITH {E} SELECT 'all' AS stim, (vec_id - 2) % 101 AS frame, CAST(k + 3 * ((vec_id - 2) // 101) AS INTEGER) AS k, x FROM e WHERE k < 3 AND vec_id BETWEEN 2 AND 405",
    "map_grid": f"WITH {E} SELECT vec_id AS stim, k % 8 AS frame, k // 8 AS feature, x FROM e",
    "first_frames": f"WITH {SAMPLES} SELECT stim, n, x FROM s WHERE n < 75",
    "feature_sizes": "SELECT label AS stim, max(vec_id) + 1 AS frames, CAST(max(len(embedding)) AS INTEGER) AS features FROM embeddings GROUP BY 1",
    "case_map": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'F' THEN 2 ELSE 3 END AS BIGINT) AS stim FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'F'), ('N', 'O'))",
    "zip_names": "SELECT c_nationkey AS stim, round(sum(c_acctbal), 2) AS x, any_value(n_name) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1",
    "repeats_mean": f"WITH {DAYS} SELECT stim, n, round(avg(x), 6) AS x, count(x) AS n_repeats FROM d GROUP BY stim, n",
    "channel_median": f"WITH {DAYS} SELECT stim, round(median(x), 6) AS x FROM d GROUP BY stim",
    "complete_pairs": "SELECT event_id, value AS a, value AS b FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0",
    "join_runs": "SELECT user_id AS stim, CAST(CASE event_type WHEN 'view' THEN 0 ELSE 1 END AS INTEGER) AS run, count(*) AS n, round(avg(value), 6) AS x FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2",
    "envelope_loader": f"""WITH {DAYS}, m AS (SELECT stim, n, avg(x) AS x FROM d GROUP BY stim, n), k AS (SELECT stim, max(n) AS last FROM m GROUP BY stim), v AS (SELECT * FROM m WHERE x IS NOT NULL),
g AS (SELECT stim, unnest(range(last + 1)) AS n FROM k), p AS (SELECT g.stim, g.n, v.n AS n0, v.x AS x0 FROM g ASOF LEFT JOIN v ON g.stim = v.stim AND g.n >= v.n),
q AS (SELECT p.*, v.n AS n1, v.x AS x1 FROM p ASOF LEFT JOIN v ON p.stim = v.stim AND p.n <= v.n)
SELECT stim, n, round(CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL OR n1 = n0 THEN x0 ELSE x0 + (n - n0) / CAST(n1 - n0 AS DOUBLE) * (x1 - x0) END, 6) AS x FROM q WHERE x0 IS NOT NULL OR x1 IS NOT NULL""",
    "filter_similarities": " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS bins, channel, round(sum((pp * log2(pp / ((pp + qq) / 2)) + qq * log2(qq / ((pp + qq) / 2))) / 2), 6) AS jsd, round(sum(sqrt(p * q)), 6) AS bc FROM (WITH {HALVES}, {bins(n)} SELECT channel, p, q, (p + 1e-6 / {n}) / (1 + 1e-6) AS pp, (q + 1e-6 / {n}) / (1 + 1e-6) AS qq FROM j) GROUP BY channel" for n in (20, 50)),
    "filter_moments": f"""WITH {SAMPLES}, r AS (SELECT label, (us // {DAY}) % 7 AS channel, x FROM s), m AS (SELECT label, channel, avg(x) AS mean, var_samp(x) AS var, avg(x * x) AS m2 FROM r GROUP BY 1, 2),
z AS (SELECT r.label, r.channel, any_value(mean) AS mean, any_value(var) AS var, avg((x - mean) ** 2) AS c2, avg((x - mean) ** 3) AS c3, avg((x - mean) ** 4) AS c4 FROM r JOIN m USING (label, channel) GROUP BY 1, 2)
SELECT label, channel, round(mean, 6) AS mean, round(var, 6) AS var, round(c3 / c2 ** 1.5, 6) AS skew, round(c4 / c2 ** 2, 6) AS kurt FROM z""",
    "before_after": f"""WITH {LINES}, e AS (SELECT t.kind, avg(abs(b.v - t.v)) AS before, avg(abs(a.v - t.v)) AS after FROM l t JOIN l b ON b.i = 2 AND b.k = t.k AND b.kind = t.kind JOIN l a ON a.i = 3 AND a.k = t.k AND a.kind = t.kind WHERE t.i = 1 GROUP BY 1)
SELECT kind, round(before, 4) AS before, round(after, 4) AS after, round(20 * log10(before / after), 4) AS gain_db FROM e""",
    "class_snr": f"""WITH {LINES}, v AS (SELECT l_suppkey AS k, var_pop(l_quantity) AS var FROM lineitem GROUP BY 1), g AS (SELECT k FROM v WHERE 10 * log10((SELECT max(var) FROM v) / var) < 1)
SELECT a.kind AS statistic, round(10 * log10(sum(a.v * a.v) / sum((a.v - b.v) ** 2)), 4) AS snr_db FROM l a JOIN l b ON b.i = 2 AND a.k = b.k AND a.kind = b.kind WHERE a.i = 1 AND a.k IN (SELECT k FROM g) GROUP BY 1""",
    "filtered_correlation": f"WITH {HOURLY} " + PAIRED.format("a.channel < b.channel"),
    "neighbour_correlation": f"WITH {HOURLY} " + PAIRED.format("b.channel - a.channel IN (1, 2)"),
    "autocorr_energy": f"""WITH {SAMPLES}, m AS (SELECT stim, avg(x) AS m, var_pop(x) AS v, count(*) AS c FROM s GROUP BY stim), y AS (SELECT stim, n, x - m AS y FROM s JOIN m USING (stim)), g AS (SELECT stim, v, c, unnest([0, 1, 2, 4, 8]) AS lag FROM m),
p AS (SELECT g.stim, g.lag, sum(a.y * b.y) AS s FROM g JOIN y a ON a.stim = g.stim JOIN y b ON b.stim = g.stim AND b.n = a.n - 2 * g.lag GROUP BY 1, 2)
SELECT g.stim, round(sum((coalesce(s, 0) / c / nullif(v, 0)) ** 2), 6) AS energy FROM g LEFT JOIN p USING (stim, lag) GROUP BY 1""",
    "vocabulary": "SELECT DISTINCT p_brand AS label FROM part",
    "positive_rates": "SELECT DISTINCT l_discount AS rate FROM lineitem WHERE l_discount > 0",
    "first_files": "SELECT DISTINCT url FROM pages ORDER BY url LIMIT 2",
    "rare_merge": "WITH k AS (SELECT unnest(string_split(lower(text), ' ')) AS label FROM documents), c AS (SELECT label, count(*) AS n FROM k GROUP BY label) SELECT CASE WHEN n < 10 THEN 'LOWPROB' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
    "phoneme_onehot": f"WITH {SOUNDS}, {spread('j')} SELECT stim, frame, {', '.join(ONES.format(p) for p in annotate.PHONEMES)} FROM f GROUP BY stim, frame",
    "phoneme_attribute_onehot": f"WITH {SOUNDS}, x AS (SELECT stim, unnest(CASE label WHEN 'AA' THEN ['vowel', 'low'] WHEN 'IY' THEN ['vowel'] WHEN 'B' THEN ['stop'] ELSE [] END) AS label, onset, offs FROM j), {spread('x')} SELECT stim, frame, {', '.join(ONES.format(p) for p in ('low', 'stop', 'vowel'))} FROM f GROUP BY stim, frame",
    "word_onehot": f"WITH {HOURS}, w AS (SELECT stim, CASE WHEN offs - onset > 20 THEN label || '-' || stim || '-' || CAST(floor(onset) AS BIGINT) ELSE label END AS label, onset, offs FROM i), r AS (SELECT label, count(*) AS n FROM w GROUP BY 1), x AS (SELECT stim, CASE WHEN n < 10 THEN 'LOWPROB' ELSE label END AS label, onset, offs FROM w JOIN r USING (label)), {spread('x')} SELECT stim, frame, {', '.join(ONES.format(p) for p in [*KINDS, 'LOWPROB'])} FROM f GROUP BY stim, frame",
    "feature_set": f"WITH {HOURS}, o AS (SELECT stim, CAST(round_even(onset, 0) AS BIGINT) AS frame, label FROM i), n AS (SELECT stim, frame, {', '.join(ONES.format(p) for p in KINDS[:2])} FROM o GROUP BY 1, 2), t AS (SELECT stim, 'long' AS label, onset, offs FROM i WHERE offs - onset > 20), {spread('t')}, g AS (SELECT DISTINCT stim, frame FROM f) SELECT stim, frame, {', '.join(f'CAST(coalesce({k}, 0) AS INTEGER) AS {k}' for k in KINDS[:2])}, CAST(CASE WHEN g.stim IS NULL THEN 0 ELSE 1 END AS INTEGER) AS long FROM n FULL JOIN g USING (stim, frame)",
    "component_energy": f"WITH {E}, m AS (SELECT k, avg(x) AS m FROM e GROUP BY k) SELECT vec_id, round(sum((x - m) ** 2), 4) AS energy FROM e JOIN m USING (k) GROUP BY 1",
    "frame_times": f"WITH {SAMPLES}, c AS (SELECT stim, count(*) AS m FROM s GROUP BY 1), g AS (SELECT stim, unnest(range(CAST(ceil(m / 16.0) AS BIGINT))) AS frame FROM c) SELECT stim, frame, CAST((frame * 16 - 4) / 100.0 AS DOUBLE) AS start, CAST(frame * 16 / 100.0 AS DOUBLE) AS onset, CAST((frame * 16 + 16) / 100.0 AS DOUBLE) AS offset, CAST((frame * 16 + 18) / 100.0 AS DOUBLE) AS end FROM g",
    "frame_catalog": f"WITH {SAMPLES}, k AS (SELECT stim, n FROM s WHERE event_id % 29 <> 0), r AS (SELECT stim, n, row_number() OVER (PARTITION BY stim ORDER BY n) - 1 AS i FROM k) SELECT stim, CAST(count(*) FILTER (WHERE n = i) AS BIGINT) AS frames FROM r GROUP BY stim",
}
