"""What each filter of a corpus removes in every order of the filters.

Spark brings every document down to a mask, the set of filters that it fails, and counts documents by part and
mask: a part has 2^filters cells at most, whatever the corpus. All orders are then visited by swaps of two
neighbours. A swap leaves the set that stands before any other step alone, so only two steps are counted anew,
from the cells; the sums of a filter's removals over the walk are its Shapley value times the number of orders.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Filters by letter; the last compares texts across the table and isn't a condition on one text.
FILTERS = "ABCDE"


def failures(text: Column) -> list[Column]:
    """Which filters a text that isn't null fails: few words, repeated words, capitals, signs."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by language and failed filters, those of quality 1 and those toxic.

    Bit k of ``mask`` is filter k of ``FILTERS``. A copy is a document whose text one of smaller doc_id has; rows of
    one id aren't smaller than each other, and a null id neither is nor has a smaller one. Texts meet by SHA-256.
    Rows are counted by id, text and part before anything is joined, so copies and repeated rows gather nowhere.
    An id with several labels is good or toxic if one of them says so.
    """
    text = F.coalesce("text", F.lit(""))
    mask = sum((F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(failures(text))), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.sha2(text, 256).alias("digest"))
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    # a null id has no labels; it meets by its text's digest, which is no number, so that nulls gather nowhere
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    named = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), "digest")).join(told, "key", "left").fillna(0, ["good", "toxic"])
    # of each text and kind of document: all rows, those of the least id and those without one
    no_id = F.col("doc_id").isNull()
    kinds = named.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.when(~no_id, F.struct("doc_id", "n"))).alias("low"), F.sum(F.when(no_id, F.col("n")).otherwise(0)).alias("nameless"))
    least = kinds.groupBy("digest").agg(F.min("low.doc_id").alias("least"))
    first = F.col("nameless") + F.when(F.col("low.doc_id") == F.col("least"), F.col("low.n")).otherwise(0)
    copies = F.struct((F.col("mask") + F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - first).alias("n"))
    split = kinds.join(least, "digest").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", first.alias("n")), copies)).alias("c"))
    whole = split.select("part", "good", "toxic", "c.mask", "c.n").where("n > 0")
    return whole.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def walk(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n things, each from the one before by a swap of the places k and k + 1; and that k, None for the first.

    Each thing moves one way through those before it until it stands at an end or beside a later thing; then it turns.
    """
    order, way = list(range(n)), [-1] * n
    yield order, None
    while True:
        moving = -1
        for at, x in enumerate(order):
            to = at + way[x]
            if 0 <= to < n and order[to] < x and x > moving:
                moving, place = x, at
        if moving < 0:
            return
        to = place + way[moving]
        order[place], order[to] = order[to], order[place]
        for x in range(moving + 1, n):
            way[x] = -way[x]
        yield order, min(place, to)


def audited(found: dict[int, tuple[int, int, int]], n: int) -> list[tuple]:
    """Rows ``order, step, kept, removed, redundant, unique, good, toxic, shapley`` of cells ``mask: (documents, good, toxic)``."""
    failing = [sum(v[0] for m, v in found.items() if m >> f & 1) for f in range(n)]
    unique = [found.get(1 << f, (0, 0, 0))[0] for f in range(n)]
    steps: list[tuple] = [()] * n
    sets = [0] * (n + 1)  # the filters before each step
    kept = [0] * (n + 1)
    kept[0] = sum(v[0] for v in found.values())
    shapley, rows = [0] * n, []

    def count(order: list[int], k: int) -> None:
        f = order[k]
        gone = [v for m, v in found.items() if m >> f & 1 and not m & sets[k]]
        removed, good, toxic = (sum(v[j] for v in gone) for j in range(3))
        sets[k + 1], kept[k + 1] = sets[k] | 1 << f, kept[k] - removed
        steps[k] = (kept[k + 1], removed, failing[f] - removed, unique[f], good, toxic)

    for order, swapped in walk(n):
        for k in range(n) if swapped is None else (swapped, swapped + 1):
            count(order, k)
        for k, f in enumerate(order):
            shapley[f] += steps[k][1]
        rows.append((list(order), list(steps)))
    return [(order, k + 1, *s, shapley[order[k]]) for order, own in rows for k, s in enumerate(own)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``: every order and step for each language.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns aren't read. Null texts are
    empty, a null language is the part ``''``. Of no documents there are no parts, and no rows.
    """
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in names)])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        found = {int(m): (int(n), int(g), int(t)) for m, n, g, t in zip(f["mask"], f["n"], f["good"], f["toxic"], strict=True)}
        rows = audited(found, len(FILTERS))
        assert len(rows) == math.factorial(len(FILTERS)) * len(FILTERS)
        out = pd.DataFrame([r[1:] for r in rows], columns=["step", *names])
        out.insert(0, "filter_order", ["".join(FILTERS[k] for k in r[0]) for r in rows])
        out.insert(0, "part", f["part"].iloc[0])
        return out

    return cells(docs, labels).groupBy("part").applyInPandas(run, schema)
