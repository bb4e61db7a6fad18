"""Queries on labels, lookups, sets and grids of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.functions import columns as C
from tallframe.operators import annotate, joins, stats
from tallframe.plans.common import SAMPLES, Query, rounded
from tallframe.sources.tables import signals, table

KINDS = ["click", "error", "purchase", "signup", "view"]
TOKEN = r"[^\s]+"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("label"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals in hours since January 2024 that last a twentieth of their value."""
    onset = (F.col("us") - 1_704_067_200_000_000) / 3.6e9
    return signals(spark, sf_dir).select("stim", "label", onset.alias("onset"), (onset + F.col("x") / 20).alias("offset"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.label_counts(tokens(spark, sf_dir)).where("n < 10")


def lowprob_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.rare_counts(tokens(spark, sf_dir), 10)


def merge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.label_counts(annotate.set_merged(signals(spark, sf_dir), ["click", "view"])).orderBy("label")


def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"))
    return annotate.label_counts(annotate.cleaned(labels, silence="5-LOW"))


def notes_onehot_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.one_hot(joins.occupied(intervals(spark, sf_dir), 1.0), KINDS)


def notes_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.one_hot(joins.occupied(intervals(spark, sf_dir), 1.0, onset_only=True), KINDS)


def beat_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = annotate.impulses(intervals(spark, sf_dir).where("label = 'click'").drop("offset"), 4.0)
    return joins.occupied(beats.withColumn("label", F.lit("all")), 4.0)


def phoneme_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("label"))
    pairs = parts.select("label").distinct().select("label", F.explode(F.array_distinct(F.split("label", " "))).alias("attribute"))
    return annotate.with_attributes(parts, pairs)


def glove_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are event types, whose vectors are the means of two labels' embeddings; of each frame's vector its size and its sum."""
    cells = table(spark, sf_dir, "embeddings").select(F.pmod("label", F.lit(len(KINDS))).alias("word"), F.posexplode("embedding").alias("k", "x"))
    means = cells.groupBy("word", "k").agg(F.avg("x").alias("x")).groupBy("word").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
    vectors = means.select(F.element_at(F.array(*map(F.lit, KINDS)), F.col("word").cast("int") + 1).alias("label"), F.transform("v", lambda s: s["x"]).alias("v"))
    frames = joins.embedded(intervals(spark, sf_dir), vectors, 0.25)
    return frames.groupBy("stim", "frame").agg(rounded(F.sqrt(F.sum(F.col("x") * F.col("x"))), 5).alias("size"), rounded(F.sum("x"), 5).alias("total"))


def meta_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("key"))
    return joins.exactly_one(suppliers, nations, "key").select("s_suppkey", "n_name")


def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


def skip_existing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order that is done."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


def tolerance_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return joins.within(a, table(spark, sf_dir, "supplier").select("s_acctbal"), "c_acctbal", "s_acctbal", 5.0)


def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of the quantities, taxes and ship states that occur."""
    line = table(spark, sf_dir, "lineitem")
    return joins.value_grid(scale=line.select("l_quantity"), rate=line.select("l_tax"), sign=line.select("l_linestatus"))


def nearest_elem(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 5).alias("q"))
    targets = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return joins.nearest(queries, targets, "q", "p_retailprice", "p_partkey").select("s_suppkey", F.col("nearest_number").alias("p_partkey"), "nearest")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return a.exceptAll(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k")).distinct())


def set_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    a, b = (line.where(f"l_returnflag = '{x}'").select("l_suppkey", "l_partkey").distinct() for x in "AN")
    return a.subtract(b).unionByName(b.subtract(a))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages").select("page_id", "url")
    return page.select("page_id", C.base_name(F.col("url")).alias("base"), C.escaped(F.col("url")).alias("escaped"), C.identity(F.lit("page"), F.col("page_id").cast("string")).alias("name"), F.md5("url").alias("hash"))


def subband_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_acctbal").alias("level"))
    return stats.outward(bands).select("k", "level", "position")


def masked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    mask: Column = F.when(F.col("event_id") % 5 != 0, F.col("label") == "click")
    return annotate.masked(s, mask).select("event_id", "label")


QUERIES: dict[str, Query] = {f.__name__: f for f in (label_counts, lowprob_merge, merge_set, clean_labels, notes_onehot_duration, notes_onset, beat_onset, phoneme_attributes, glove_frames, meta_exactly_one, exists_semi, skip_existing_anti, tolerance_semi, param_grid, nearest_elem, set_difference, set_symdiff, urls, subband_order, masked_notes)}

TOKENS = r"k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^ \t\n\x0b\f\r]+')) AS label FROM documents)"
HOURS = f"{SAMPLES}, i AS (SELECT stim, label, (us - 1704067200000000) / 3.6e9 AS onset, (us - 1704067200000000) / 3.6e9 + x / 20 AS offs FROM s)"
ONE_HOT = ", ".join(f"CAST(max(CASE WHEN label = '{k}' THEN 1 ELSE 0 END) AS INTEGER) AS {k}" for k in KINDS)


def cells(rate: float) -> str:
    return f"c AS (SELECT stim, label, onset, offs, CAST(round_even(onset * {rate}, 0) AS BIGINT) AS a, CAST(round_even(offs * {rate}, 0) AS BIGINT) AS b FROM i), f AS (SELECT stim, label, onset, offs, unnest(range(a, greatest(b, a + 1))) AS frame FROM c)"


ORACLES = {
    "label_counts": f"WITH {TOKENS} SELECT label, count(*) AS n FROM k GROUP BY label HAVING count(*) < 10",
    "lowprob_merge": f"WITH {TOKENS}, c AS (SELECT label, count(*) AS n FROM k GROUP BY label) SELECT CASE WHEN n < 10 THEN 'LOWPROB' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1",
    "merge_set": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'MERGED' ELSE event_type END AS label, count(*) AS n FROM events GROUP BY 1 ORDER BY 1",
    "clean_labels": r"SELECT regexp_replace(upper(o_orderpriority), '\d+', '', 'g') AS label, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1",
    "notes_onehot_duration": f"WITH {HOURS}, {cells(1.0)} SELECT stim, frame, {ONE_HOT} FROM f GROUP BY stim, frame",
    "notes_onset": f"WITH {HOURS}, f AS (SELECT stim, label, CAST(round_even(onset, 0) AS BIGINT) AS frame FROM i) SELECT stim, frame, {ONE_HOT} FROM f GROUP BY stim, frame",
    "beat_onset": f"WITH {HOURS}, c AS (SELECT stim, CAST(round_even(onset * 4, 0) AS BIGINT) AS a, CAST(round_even((onset + 0.5) * 4, 0) AS BIGINT) AS b FROM i WHERE label = 'click') SELECT DISTINCT stim, unnest(range(a, greatest(b, a + 1))) AS frame, 'all' AS label FROM c",
    "phoneme_attributes": "SELECT p_partkey, unnest(list_distinct(string_split(p_type, ' '))) AS label FROM part",
    "glove_frames": f"""WITH {HOURS}, {cells(0.25)}, u AS (SELECT label % 5 AS word, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT {KINDS}[word + 1] AS label, k, avg(x) AS v FROM u GROUP BY word, k),
m AS (SELECT stim, frame, k, avg(v) AS x FROM f JOIN e USING (label) GROUP BY stim, frame, k) SELECT stim, frame, round(sqrt(sum(x * x)), 5) AS size, round(sum(x), 5) AS total FROM m GROUP BY stim, frame""",
    "meta_exactly_one": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey",
    "exists_semi": "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)",
    "skip_existing_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    "tolerance_semi": "SELECT c_custkey, c_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE abs(c_acctbal - s_acctbal) < 5.0)",
    "param_grid": "SELECT scale, rate, sign FROM (SELECT DISTINCT l_quantity AS scale FROM lineitem), (SELECT DISTINCT l_tax AS rate FROM lineitem), (SELECT DISTINCT l_linestatus AS sign FROM lineitem)",
    "nearest_elem": """WITH q AS (SELECT s_suppkey, abs(s_acctbal) / 5 AS q FROM supplier), d AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p_retailprice - q), p_partkey) AS r FROM q, part)
SELECT s_suppkey, p_partkey, p_retailprice AS nearest FROM d WHERE r = 1""",
    "set_difference": "SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45",
    "set_symdiff": """WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), n AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N')
(SELECT * FROM a EXCEPT SELECT * FROM n) UNION ALL (SELECT * FROM n EXCEPT SELECT * FROM a)""",
    "urls": r"SELECT page_id, regexp_replace(list_last(string_split(url, '/')), '\.[^.]*$', '') AS base, regexp_replace(url, '([_^{}\\])', '\\\1', 'g') AS escaped, 'page_' || page_id AS name, md5(url) AS hash FROM pages",
    "subband_order": """WITH b AS (SELECT s_nationkey AS k, max(s_acctbal) AS level FROM supplier GROUP BY 1), t AS (SELECT k AS start FROM b ORDER BY level DESC, k LIMIT 1)
SELECT k, level, row_number() OVER (ORDER BY abs(k - start), k > start) - 1 AS position FROM b, t""",
    "masked_notes": "SELECT event_id, event_type AS label FROM events WHERE event_id % 5 = 0 OR event_type = 'click'",
}
