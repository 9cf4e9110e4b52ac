"""From raw documents to encoded training text: the stages of the corpus pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read
again as the next one's ``docs``.  All but the last return the columns they were given.

* ``language``: documents whose language cannot be told (``und``, or a posterior below
  ``LEAST_SCORE``) go; the models are trained on the labelled documents given.
* ``near_duplicates``: one document of each SimHash group stays, the one with the smallest id.
  Rows without an id stay.
* ``secrets``: the secrets found in a text are replaced by a mark, and its ``n_chars`` is counted
  again; documents without any stay as they are.
* ``mix``: every document as often as the mix of sources draws it.
* ``encode``: token counts and digests of the encoded and decoded text, a row per row.

Nulls in any column, empty and very long texts, ties, repeated rows and empty tables are
treated as the operators' texts say; columns beyond those named are handed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import bpe, language, mixing, secretscan, simhash
from offerloom.llm.catalog import BYTE_BPE, MAX_EPOCHS, PIECE_BPE, WEIGHTS
from offerloom.llm.common import stored

LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))), "doc_id", "text", "lang", PIECE_BPE)
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    found = language.identify(rows, F.col("doc.text"), model)
    known = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)
    return found.filter(known).select("doc.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, "doc_id", "text")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = secretscan.redact(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").alias("clean")), "clean")
    changed = ~F.col("clean").eqNullSafe(F.col("doc.text"))
    n_chars = F.when(changed, F.length("clean").cast("long")).otherwise(F.col("doc.n_chars"))
    replaced = {"text": F.col("clean"), "n_chars": n_chars}
    return rows.select(*[replaced.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, "doc_id", "text", "source", WEIGHTS, MAX_EPOCHS)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, "doc_id", "text", BYTE_BPE).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

# Hashes and tokens of a vocabulary cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
