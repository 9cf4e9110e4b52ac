"""The registered queries of this subpackage, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import (
    bpe,
    gridjoin,
    infill,
    language,
    mixing,
    phrases,
    preferences,
    secretscan,
    simhash,
    substrings,
    subwordlm,
    tokencount,
    topk,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WEIGHTS, MAX_EPOCHS = [5.0, 2.0, 1.0], 3.0


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix_sources(spark, sf):
    mixed = mixing.mix_counts(read(spark, sf, "documents"), "doc_id", "text", "source", WEIGHTS, MAX_EPOCHS)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op2_simhash(spark, sf):
    found = simhash.near_duplicates(read(spark, sf, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


@query
def op3_suffix_dedup(spark, sf):
    found = substrings.remove_repeats(read(spark, sf, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


@query
def op4_secrets(spark, sf):
    found = secretscan.find_secrets(read(spark, sf, "documents"), "doc_id", "text")

    def of_kind(number: int):
        # With a second parameter the function would be given the place of a span.
        return lambda s: s["kind"] == number

    counts = [
        F.size(F.filter("spans", of_kind(n))).cast("long").alias(f"n_{kind}")
        for n, kind in enumerate(secretscan.KINDS[:3])
    ]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(secretscan.written(base).cast("binary"), 256).alias("base_sha256"),
        secretscan.written(F.col("spans")).alias("spans"),
    )


@query
def op5_embedding_join(spark, sf):
    found = gridjoin.similar(read(spark, sf, "embeddings"), "vec_id", "embedding", 0.9)
    return found.select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query
def op6_topk(spark, sf):
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    vectors = read(spark, sf, "embeddings").filter(topk.usable(F.col("embedding"), True))
    return topk.top_k(vectors.select("vec_id", whole.alias("v")), "vec_id", "v", F.col("vec_id") % 50 == 0, 5)


@query
def op7_language(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.train(docs.filter(~out), "doc_id", "text", "lang", PIECE_BPE)
    rows = docs.select("doc_id", out.alias("held_out"), "text")
    found = language.identify(rows.select("doc_id", "held_out", "text"), F.col("text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_preferences(spark, sf):
    turns = read(spark, sf, "conversations")
    pairs = preferences.neighbours(turns, "conv_id", "turn", "role", "text")
    return preferences.format_preferences(pairs, turns)


@query
def op9_bpe(spark, sf):
    return bpe.encode_digests(read(spark, sf, "documents"), "doc_id", "text", BYTE_BPE).withColumnRenamed("id", "doc_id")


@query
def op10_token_counts(spark, sf):
    found = tokencount.token_counts(read(spark, sf, "documents"), "doc_id", "text", PIECE_BPE)
    return found.withColumnRenamed("id", "doc_id")


@query
def op11_subword_lm(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    out = subwordlm.held_out(F.col("doc_id"))
    model, counts = subwordlm.train(docs, "text", ~out, PIECE_BPE)
    return subwordlm.score(docs, "doc_id", "text", model, counts, out).withColumnRenamed("id", "doc_id")


@query
def op12_phrases(spark, sf):
    return phrases.collocations(read(spark, sf, "documents"), "text", "lang", first=2000, least=30)


@query
def op13_infill(spark, sf):
    store = infill.pack(read(spark, sf, "documents"), "doc_id", "text")
    marked = infill.rearrange(infill.place(store, seed=1))
    return infill.round_trip(marked).withColumnRenamed("id", "doc_id")
