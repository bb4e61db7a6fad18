"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from public_tokenizers import PATTERN
from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallframe.llm.bpe import decode, encode
from tallframe.llm.conversations import damaged, repair
from tallframe.llm.decontam import decontaminate
from tallframe.llm.filters import audit
from tallframe.llm.fingerprint import fingerprints
from tallframe.llm.html import extract_text
from tallframe.llm.jaccard import jaccard_classes
from tallframe.llm.langid import fit, identify
from tallframe.llm.lines import dedup_lines
from tallframe.llm.lm import score_documents
from tallframe.llm.packing import pack
from tallframe.llm.pii import replace_pii
from tallframe.llm.substring import dedup_substrings


#: A stand-in: production takes the key from its vault.
KEY = "corpus-surrogates"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY).withColumn("kinds", F.to_json("kinds"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_id")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def op12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    found = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, PATTERN), ranks, PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pack": op2_pack,
    "op3_pii": op3_pii,
    "op4_html": op4_html,
    "op5_perplexity": op5_perplexity,
    "op6_substrings": op6_substrings,
    "op7_language": op7_language,
    "op8_jaccard": op8_jaccard,
    "op9_fingerprint": op9_fingerprint,
    "op10_lines": op10_lines,
    "op11_conversations": op11_conversations,
    "op12_filters": op12_filters,
    "op13_bpe": op13_bpe,
}
