"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from compare import differences, duck
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallframe.llm import lm
from tallframe.llm.decontam import decontaminate
from tallframe.llm.fingerprint import EXACT, fingerprint, fingerprints, likeness, replaced, vector
from tallframe.llm.html import extract_text
from tallframe.llm.jaccard import jaccard_classes, keep_one, shingles
from tallframe.llm.langid import fit, identify
from tallframe.llm.lines import dedup_lines
from tallframe.llm.oracles import ORACLES
from tallframe.llm.packing import pack
from tallframe.llm.pii import luhn, replace_pii
from tallframe.llm.queries import QUERIES
from tallframe.llm.substring import dedup_substrings

SF = "/root/testdata/sf0.001"
BPE = tokenizer_path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
TEXTS = [(1, "the quick brown fox jumps over the lazy dog near the river bank today"), (2, None), (3, ""), (4, "!!! ..."), (5, LONG), (6, LONG), (7, "The QUICK brown fox jumps over the lazy dog near the river bank yesterday"), (7, "a repeated id"), (8, "a row"), (8, "a row"), (None, "no id at all"), (9, "ÄÖ straße naïve 東京 words"), (10, "   leading and trailing \t\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df):
    """With columns of the names that operators add."""
    names = "n_words n_hit hit_words hit_items n_items contaminated lang_pred score n_lines n_removed n_entities kinds _x".split()
    return df.select("*", *[F.lit("mine").alias(c) for c in names])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) == []


def alnum(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text or "").split(" ")


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, block_bytes):
    items = [("b", "Quick brown fox, jumps over the lazy dog near the river BANK"), ("a", "lazy dog"), ("c", None), ("d", "..."), ("e", "lazy dog"), (None, "a row")]
    got = decontaminate(clashing(docs), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        w = [x for x in alnum(r.text) if x]
        hit, ids = set(), set()
        for i, t in items:
            v = [x for x in alnum(t) if x]
            k = min(10, len(v))
            windows = {tuple(v[p : p + k]) for p in range(len(v) - k + 1)} if v else set()
            for p in range(len(w) - k + 1):
                if k and tuple(w[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    ids |= {i} - {None}
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit)), r.doc_id
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest() and r["_x"] == "mine"


def test_packing_is_a_round_trip(docs):
    rows = pack(clashing(docs), BPE).collect()
    tok = Tokenizer.from_file(BPE)
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in TEXTS)
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
        pieces[r.doc_id].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        n = sum(r.length for r in own)
        assert n == 4096 or n < 4096 and n & (n - 1) == 0
    got = Counter()
    for i, own in pieces.items():
        ids = b"".join(r.ids for r in sorted(own, key=lambda r: r.start)) if len({t for j, t in TEXTS if j == i}) == 1 and sum(j == i for j, _ in TEXTS) == 1 else None
        if ids is not None:
            got[i, tuple(np.frombuffer(ids, "<u4").tolist())] += 1
    assert all(want[k] == v for k, v in got.items()) and len(got) >= 9
    assert sum(r.length for r in rows) == sum(len(k[1]) * n for k, n in want.items())


def test_packed_neighbours_share_words(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"topic{i % 5}word{k}" for k in rng.integers(0, 40, 300))) for i in range(100)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), BPE).collect()
    topics = defaultdict(list)
    for r in got:
        topics[r.sequence_id].append(r.doc_id % 5)
    assert np.mean([Counter(t).most_common(1)[0][1] / len(t) for t in topics.values()]) > 0.7


def test_surrogates(spark):
    card = "4111 1111 1111 111" + str(luhn("411111111111111"))
    rows = [(1, f"Mail Jane.Doe@example.org or call +44 20 7946 0958. Card {card}."), (2, "jane.doe@example.org wrote; Dr No met Mrs Smith and MRS smith."), (3, "Mrs Smith met Mr Jones at 192.168.1.77 and 10.0.0.1"), (4, None), (5, ""), (6, "nothing personal, just 12 words: really"), (6, "nothing personal, just 12 words: really")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in replace_pii(clashing(df), "key").collect()}
    assert got[4].text is None and got[4].n_entities == 0 and got[5].text == "" and got[6].text == rows[5][1]
    for secret in ("Jane.Doe", "7946", card, "Smith", "Jones", "192.168.1.77"):
        assert not any(secret in (r.text or "") for r in got.values()), secret
    mail = got[2].text.split()[0]
    assert mail in got[1].text.lower() and mail.endswith(".org")
    digits = "".join(c for c in got[1].text.split("Card ")[1] if c.isdigit())
    assert len(digits) == 16 and digits[0] == "4" and luhn(digits[:-1]) == int(digits[-1])
    name = got[2].text.split("Mrs ")[1].split(" ")[0]
    assert f"Mrs {name} met" in got[3].text
    again = {r.doc_id: r.text for r in replace_pii(df, "key").collect()}
    assert again == {k: r.text for k, r in got.items()}
    assert replace_pii(df, "other").where("doc_id = 1").first().text != got[1].text


def test_surrogates_stay_distinct(spark):
    rows = [(i, f"Mr {a}{b} lives at 10.0.{i % 256}.{i // 256}") for i, (a, b) in enumerate((x, y) for x in ("Al", "Bo", "Cy", "Di") for y in ("den", "ker", "lam", "mon", "ner", "pol"))]
    got = replace_pii(spark.createDataFrame(rows, "doc_id bigint, text string"), "key").collect()
    assert len({r.text.split()[1] for r in got}) == len(rows) and len({r.text.split()[-1] for r in got}) == len(rows)


def test_html(spark):
    menu, notice = "<nav><a>Home</a> <a>About</a></nav>", "<p>All rights are reserved by the owners of this site for ever</p>"
    pages = [(k, f"https://site.org/{k}", f"<html><head><title>t</title><style>p{{}}</style></head><body>{menu}<div><p>Page number {k} tells &amp; shows   its own story about thing{k} here</p>{notice}</div><footer>f</footer></body></html>") for k in range(6)]
    pages += [(10, "https://b.org/", "<body><article><h1>A  title</h1><p>Body &lt;text&gt; with <b>bold</b> words<br>here</p></article><div class='comments'>nice</div></body>"), (11, None, None), (12, "https://b.org/2", "")]
    got = {r.page_id: r for r in extract_text(clashing(spark.createDataFrame(pages, "page_id bigint, url string, html string"))).collect()}
    assert len(got) == len(pages)
    assert got[3].text == "Page number 3 tells & shows its own story about thing3 here"
    assert got[10].text == "A title\n\nBody <text> with bold words here" and got[10].n_chars == len(got[10].text)
    assert got[11].text == got[12].text == "" and got[11].url is None


def test_language_model(spark, docs):
    rows = TEXTS + [(100 + i, "one two three four five six") for i in range(20)] + [(200, "one two three four five unheard")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = lm.score_documents(clashing(df), split=10).collect()
    assert len(got) == len(rows)
    split = lambda t: [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"]
    held = {i: None if i is None else crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    counts = Counter(w for i, t in rows if held[i] is False for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t))
        want[i, held[i], len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    seen = [r for r in got if r.doc_id is not None and 100 <= r.doc_id < 120]
    assert np.mean([r.score - r.base_score for r in seen]) > 3


def test_seating_follows_the_exact_distribution():
    """The tables of five customers, against the weights of all ways to seat them."""
    a, d, n = 0.7, 0.4, 5
    table = {(1, 1): a}  # the weight of t tables among m customers
    for m in range(1, n):
        for t in range(1, m + 2):
            table[m + 1, t] = table.get((m, t), 0) * (m - d * t) + table.get((m, t - 1), 0) * a
    exact = np.array([table[n, t] for t in range(1, n + 1)])
    _, mean = lm.sampled(np.full(20_000, n), np.full(20_000, a), d, 12, np.random.default_rng(0))
    assert mean.mean() == pytest.approx((exact / exact.sum()) @ np.arange(1, n + 1), rel=0.01)


def test_model_beats_counts_on_held_out_text(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > 0.9 * got.b


def test_probabilities_sum_to_one(spark):
    """Over all words and one unknown, after a context: single-word documents that follow it in training."""
    words = [f"v{k}" for k in range(12)]
    train = [(i, f"start {words[i % 12]} {words[i * 7 % 12]}") for i in range(200) if crc32(str(i).encode()) % 5 != 1]
    free = [i for i in range(1000, 3000) if crc32(str(i).encode()) % 5 == 1]
    vocabulary = ["start", *words, "unheard"]
    probes = [(free[0], "start")] + [(i, f"start {w}") for i, w in zip(free[1:], vocabulary, strict=False)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(train + probes, "doc_id bigint, text string")).collect()}
    alone = [(i, w) for i, w in zip(free[30:], vocabulary, strict=False)]
    first = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(train + alone + [(free[60], "")], "doc_id bigint, text string")).collect()}
    assert set(got) >= {p[0] for p in probes} and first[free[60]] < 0
    assert sum(10 ** first[i] for i, _ in alone) < 1 + 1e-6  # each followed by an end as well


def test_substrings(spark, docs):
    shared = " ".join(f"s{i}" for i in range(40))
    rows = TEXTS + [(20, f"x y z {shared} tail"), (21, f"other {shared}"), (22, shared), (22, shared + " more")]
    got = dedup_substrings(clashing(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))).collect()
    key = lambda i: math.inf if i is None else i
    least: dict = {}
    for i, t in rows:
        w = (t or "").split()
        for p in range(len(w) - 12):
            g = tuple(w[p : p + 13])
            least[g] = min(least.get(g, math.inf), key(i))
    want = Counter()
    for i, t in rows:
        w = (t or "").split()
        gone = {q for p in range(len(w) - 12) if least[tuple(w[p : p + 13])] < key(i) for q in range(p, p + 13)}
        want[i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


def test_language(spark, docs):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = fit(own)
    held = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1)
    got = identify(clashing(held), net).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = identify(docs, net).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd) and len(odd) == len(TEXTS)
    assert identify(docs, fit(own.where("false"))).first().lang_pred == "und"


def brute_classes(rows, n=5, threshold=0.8):
    sets = [frozenset(shingles(t, n).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                parent[find(i)] = find(j)
                if a != b:
                    links[a].add(b)
                    links[b].add(a)
    low = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        low[k] = min(low.get(k, math.inf), math.inf if d is None else d)
    return Counter((d, low[find(i)] if low[find(i)] < math.inf else None, len(links[sets[i]]) if sets[i] else 0) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [500, 7])
def test_jaccard(spark, chunk):
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(60)]
    rows = list(TEXTS)
    for i in range(60):
        w = list(base)
        for p in rng.integers(0, 60, rng.integers(0, 4)):
            w[p] = f"r{rng.integers(0, 5)}"
        rows.append((50 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = jaccard_classes(clashing(df), chunk=chunk, recall=0.9999).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)
    kept = keep_one(df, chunk=chunk, recall=0.9999)
    assert kept.columns == ["doc_id", "text"]
    heads = [r for r in got if r.keeps]
    assert kept.count() == len({(r.doc_id, r.row) for r in heads})


def test_jaccard_recall_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in sf.select("doc_id", "text").collect()]
    want = sum(n * k[2] for k, n in brute_classes(rows).items())
    got = jaccard_classes(sf).agg(F.sum("n_links")).first()[0]
    assert 0.99 * want <= got <= want


def test_fingerprints(spark):
    rows = [(3, "a\nb\nc and d"), (1, ""), (2, None), (5, "c and d\nb\na"), (9, "x" * 9 + "\n" + LONG)]
    got = {r.doc_id: r for r in fingerprints(clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    order = sorted(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert likeness(fingerprint(t), fingerprint(edited)) == pytest.approx(got[i].near_edited)
        assert got[i].near_next == pytest.approx(likeness(fingerprint(t), fingerprint(nxt)))
    assert got[3].fingerprint == got[5].fingerprint and got[1].fingerprint == got[2].fingerprint
    lines = [b"one two", b"three", b"one two"]
    np.testing.assert_array_equal(vector(lines), vector(lines[::-1]))
    np.testing.assert_array_equal(vector(lines) - vector([b"three"]), vector([b"one two"] * 2))
    np.testing.assert_array_equal(replaced(fingerprint("a\nbb\nc"), "a\nbb\nc", "a\nbd", 3), fingerprint("a\nbd"))
    assert len(vector([])[:EXACT]) == EXACT


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark, docs):
    line = "these are exactly the same seven words here"
    rows = [(1, f"{line}\nshort one\n{line.upper()}"), (2, f"unique words that nobody else has ever\n{line} "), (3, line[:-1] + "f"), (4, None), (5, ""), (6, "a b"), (6, "a b"), (None, line), (7, "totally different content stands in this line of text")]
    got = dedup_lines(clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == f"{line}\nshort one" and by[1].n_lines == 3 and by[1].n_removed == 1
    assert by[2].text == "unique words that nobody else has ever" and by[4].text is None and by[4].n_lines == 0 and by[5].text == "" and by[6].text == "a b"
    assert by[None].text == "" and by[7].n_removed == 0


def test_lines_remove_only_what_is_similar(spark, sf):
    """Each line that goes equals or resembles one that stays, through lines that go; near copies are mostly found."""
    own = sf.select("doc_id", "text").where("length(text) < 3000")
    texts = {r.doc_id: r.text for r in own.collect()}
    removed, kept = [], set()
    for r in dedup_lines(own).collect():
        left = Counter(r.text.split("\n"))
        for x in texts[r.doc_id].split("\n"):
            if left[x]:
                left[x] -= 1
                kept.add(x.lower().strip(" "))
            else:
                removed.append(x.lower().strip(" "))
    assert removed and all(len(x.split(" ")) >= 5 for x in removed)
    pool = kept | set(removed)
    for x in sorted(set(removed) - kept)[:40]:
        assert any(x != y and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and distance(x, y) <= 0.2 * max(len(x), len(y)) for y in pool), x


EMPTY = {
    "decontaminate": lambda d: decontaminate(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "pack": lambda d: pack(d, BPE),
    "pii": lambda d: replace_pii(d, "k"),
    "html": lambda d: extract_text(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))),
    "lm": lm.score_documents,
    "substrings": dedup_substrings,
    "language": lambda d: identify(d, fit(d.withColumn("lang", F.lit("en")))),
    "jaccard": jaccard_classes,
    "fingerprints": fingerprints,
    "lines": dedup_lines,
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_table(spark, name):
    assert EMPTY[name](spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_kinds_are_json(spark):
    assert all(isinstance(json.loads(r.kinds), dict) for r in QUERIES["op3_pii"](spark, SF).take(5))
