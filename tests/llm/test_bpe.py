"""Byte-level BPE against a plain merge loop, and round trips."""

import base64
from array import array
from hashlib import sha256

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from tallframe.llm.bpe import decode, encode, encoded, encoders, parts

RANK_FILE = tokenizer_path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}


def brute(text):
    """Ids by merging, again and again, the neighbours of least rank."""
    out = []
    for match in regex.findall(PATTERN, text):
        own = [bytes([b]) for b in match.encode()]
        while True:
            ranked = [(RANKS[a + b], k) for k, (a, b) in enumerate(zip(own, own[1:], strict=False)) if a + b in RANKS]
            if not ranked:
                break
            k = min(ranked)[1]
            own[k : k + 2] = [own[k] + own[k + 1]]
        out += [RANKS[x] for x in own]
    return out


PIECES = ["it's", "'s", "'", " we'll", "don't!", "a", "Ä", "漢字", "、", "é", "12", "½", " ", "  ", "\n\n", "\t", " ", "　 ", "\x1c", "...", " #", "<|endoftext|>", "\U0001f600", "x9'd"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40), st.integers(1, 12))
def test_parts_change_nothing(pieces, part):
    text = "".join(pieces)
    assert "".join(x for _, x in parts(text, part)) == text
    assert encoded(text, RANK_FILE, PATTERN, part).tolist() == brute(text)


@pytest.mark.parametrize("tail", ["", "x", " x", "\nx", "'s", "1"])
def test_long_white_space_is_one_match(tail):
    text = "word" + " \n" * 3000 + tail
    own = encoders(RANK_FILE, PATTERN)[0]
    assert encoded(text, RANK_FILE, PATTERN).tolist() == own.encode_ordinary(text)


def test_texts_the_matcher_overflows_on():
    text = "a" + " " * 2_000_000 + "b " + "c" * 300_000
    ids = encoded(text, RANK_FILE, PATTERN)
    assert encoders(RANK_FILE, PATTERN)[0].decode_bytes(ids.tolist()).decode() == text


def test_round_trip_of_odd_rows(spark):
    long = "straße 東京 'quoted' 3.14\n" * 20_000
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "no id"), (4, long), (5, "\x00\x1c\x85")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("mine")).withColumn("decoded", F.lit(1)).withColumn("n_tokens", F.lit("x")).repartition(3)
    found = decode(encode(docs, RANK_FILE, PATTERN), RANK_FILE, PATTERN)
    assert sorted(found.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.decoded).decode() == (r.text or "")
        ids = array("I", bytes(r.ids))
        assert r.n_tokens == len(ids) and ids.tolist() == encoded(r.text or "", RANK_FILE, PATTERN, 10**9).tolist()
        if len(r.text or "") < 100:
            assert ids.tolist() == brute(r.text or "")
    assert encode(docs.limit(0), RANK_FILE, PATTERN).count() == 0
    assert decode(spark.createDataFrame([(None,)], "ids binary"), RANK_FILE, PATTERN).first().decoded is None


def test_query_on_documents(spark):
    from tallframe.llm.queries import op13_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op13_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[:40]:
        ids = brute(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(array("I", ids).tobytes()).hexdigest())
    assert all(r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
