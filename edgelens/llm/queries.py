"""The registered queries of the operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelens.llm import audit, cover, mil, minhash, packing, pieces, ppm, repair, secrets, spans, suffix, topk, url_filter
from edgelens.llm.common import shared_dir
from edgelens.llm.oracles import ORACLE_SQL  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(documents(spark, sf_dir).select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = f"{shared_dir(spark)}/ledger"
    secrets.scan(docs.select(secrets.earlier(F.col("text")).alias("text")), ledger)  # the table's version before
    found = secrets.find_secrets(docs, ledger=ledger)  # the version that is there now: only texts that were changed since are scanned

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=1)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_sentences", "n_removed", F.length("kept").cast("long").alias("n_chars_kept"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, added_tokens=True)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100, scale=1024)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Strings of 400 bytes are removed; passages of over 50 words, which can have fewer bytes, are told beside.
    return suffix.dedup_digest(documents(spark, sf_dir), length=400, words=51)


# The rules to be judged by.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_minhash": op2_minhash,
    "op3_secrets": op3_secrets,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_sentence_spans": op5_sentence_spans,
    "op6_packing": op6_packing,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_topk": op9_topk,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_quality": op13_quality,
}
