"""A cleaning pipeline over ``documents``; each stage works on all that the one before kept.

A stage's result is to be written before the next stage is called, as ``run`` does: the next one frees what the one
before has left in the shared folder. As what a stage returns runs only then, the session keeps the setting TEXTS.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelens.llm import minhash, packing, ppm, secrets, suffix
from edgelens.llm.common import TEXTS, drop, free, gathered, written

#: Bits a byte beyond which no language's model fits a text better than chance.
CHANCE = 8.0
#: Words from which on a passage that repeats goes, whatever its bytes: all of over 50 words.
PASSAGE = 51

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stage called last has left in the shared folder, by application.
_LEFT: dict[str, list[str]] = {}


def stage(work: Stage) -> Stage:
    @functools.wraps(work)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault(spark.sparkContext.applicationId, [])
        free(spark, left)
        spark.conf.set(*TEXTS)  # for what a stage returns, as for what it writes itself
        with gathered() as held:
            out = work(spark, docs, sf_dir)
        left.extend(held)
        return out

    return called


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose code under every language is longer than the text itself, go; lang becomes the language found.

    Where no row has a lang, nothing can be learnt: documents with a letter stay then, as they are. All columns but lang
    stay as they are, also those that the operator has a use for.
    """
    own = {c: f"own_{i}_{c}" for i, c in enumerate(docs.columns) if c.lower() in ("held_out", "lang_pred", "score", "bits_per_byte")}
    found = ppm.identify(docs.withColumnsRenamed(own)).filter(F.col("text").rlike("\\p{L}") & (F.col("bits_per_byte") <= CHANCE))
    lang = F.when(F.col("lang_pred") != "und", F.col("lang_pred")).otherwise(F.col("lang"))
    return found.select(*[(lang if c == "lang" else F.col(f"`{own.get(c, c)}`")).alias(c) for c in docs.columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays (five words, similarity 0.8): the one with the least doc_id, null last."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "rows")  # a written key, as doc_id can be null or repeat
    found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("row"))
    first = rows.select(key, "doc_id").join(found, key).groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first.row").alias(key)), key, "left_semi").select(docs.columns)


@stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What strings of 400 bytes or of PASSAGE words cover that start twice goes, whole characters only; documents of which no word is left go."""
    return suffix.clean(docs, words=PASSAGE).filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).withColumn("n_chars", F.length("text").cast("long"))


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens; the last stage."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("language id", language_id),
    ("minhash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: Language models, sketches and suffix sorting have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        before, docs = docs, written(work(spark, docs, sf_dir), "stage")
        drop(before)  # the table of the stage before; the input is not one
    return STAGES[-1][1](spark, docs, sf_dir)
