"""The filter audit against a count of every order over all documents."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tallframe.llm.filters import audit, audited, walk


def test_walk_visits_all_orders_by_swaps():
    for n in (1, 2, 3, 5):
        seen, last = set(), None
        for order, k in walk(n):
            if last is not None:
                last[k], last[k + 1] = last[k + 1], last[k]
                assert last == order
            last = list(order)
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def brute(docs, n):
    """``docs``: (mask, good, toxic)."""
    rows, shapley = [], [0] * n
    for order in permutations(range(n)):
        left = list(docs)
        for step, f in enumerate(order):
            gone = [d for d in left if d[0] >> f & 1]
            left = [d for d in left if not d[0] >> f & 1]
            redundant = sum(d[0] >> f & 1 for d in docs) - len(gone)
            shapley[f] += len(gone)
            rows.append((list(order), step + 1, len(left), len(gone), redundant, sum(d[0] == 1 << f for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)))
    return sorted((*r, shapley[r[0][r[1] - 1]]) for r in rows)


def test_steps_against_brute_force():
    rng = np.random.default_rng(0)
    for n in (1, 3, 4, 5):
        docs = [(int(m), int(g), int(t)) for m, g, t in zip(rng.integers(0, 1 << n, 80), rng.integers(0, 2, 80), rng.integers(0, 2, 80), strict=True)]
        cells = {}
        for m, g, t in docs:
            a = cells.get(m, (0, 0, 0))
            cells[m] = (a[0] + 1, a[1] + g, a[2] + t)
        found = audited(cells, n)
        assert sorted(found) == brute(docs, n)
        assert sum(r[-1] for r in found if r[1] == 1 and r[0] == list(range(n))) <= sum(r[-1] for r in found)


def fails(text, doc_id, all_docs):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    return "".join(
        name
        for name, c in (
            ("A", len(words) < 100),
            ("B", 100 * len(set(words)) < 80 * len(words)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)),
            ("E", doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in all_docs)),
        )
        if c
    )


def test_odd_rows(spark):
    good = " ".join(f"word{k}" for k in range(120))
    rows = [(5, good, "en"), (5, good, "en"), (4, good, "de"), (None, good, "en"), (9, good, None), (1, None, ""), (2, "", None), (3, "ABC", "en"), (6, "a# b", "de"), (7, "x " * 500, "en"), (8, "x " * 500, "de"), (8, "other text", "en"), (10, " ".join(["w"] * 200), "en")]
    labels = [(5, 1, 0), (5, 0, 1), (8, 1, 1), (None, 1, 1), (77, 1, 1), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("part", F.lit("mine")).withColumn("mask", F.lit(3)).withColumn("quality", F.lit(1)).repartition(4)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    want = {}
    for part in ("", "en", "de"):
        own = [(d, fails(t or "", d, rows)) for d, t, lang in rows if (lang or "") == part]
        own = [(sum(1 << "ABCDE".index(c) for c in f), d in (5, 8), d in (5, 8)) for d, f in own]
        want |= {(part, "".join("ABCDE"[k] for k in r[0]), r[1]): r[2:] for r in brute(own, 5)}
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit(docs, told).collect()}
    assert got == want
    assert audit(docs.limit(0), told).count() == 0
    assert audit(docs, told.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
