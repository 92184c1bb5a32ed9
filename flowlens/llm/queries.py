"""The thin queries of the subpackage and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.chat import format_chats
from flowlens.llm.common import fold, table  # noqa: F401
from flowlens.llm.context_mixing import score_texts
from flowlens.llm.conversation_repair import repair
from flowlens.llm.decontaminate import mark_contamination
from flowlens.llm.embedding_dedup import embedding_dedup
from flowlens.llm.language_id import fit as fit_languages
from flowlens.llm.language_id import identify
from flowlens.llm.lexical_search import search
from flowlens.llm.license_scan import scan_licenses
from flowlens.llm.mixing import mix
from flowlens.llm.ngram_join import ngram_join
from flowlens.llm.oracles import ORACLES
from flowlens.llm.secrets import BASE_KINDS, RULES, find_secrets, scan_unseen, span_list
from flowlens.llm.token_counts import count_tokens
from flowlens.llm.toxicity import fit as fit_toxicity
from flowlens.llm.toxicity import score_toxicity
from flowlens.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, n = mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                   keep=["doc_id"])
    hit = F.aggregate(n["spans"], F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return marked.select(
        "doc_id", F.col(n["n_words"]).alias("n_words"), hit.alias("n_hit"),
        F.size(n["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", n["items"]), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit_languages(docs.where(~held_out), "text", "lang")
    found, n = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), F.col(n["lang_pred"]).alias("lang_pred"),
                        F.col(n["score"]).alias("score"), F.col(n["ambiguous"]).alias("ambiguous"))


def op3_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = fit_toxicity(docs, labels.where(~held_out), "text", "doc_id", "toxic")
    scored, name = score_toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), F.col(name).alias("score"),
                         (F.col(name) >= 0.5).cast("int").alias("predicted"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), scratch_path(spark, "blob-ledger")
    # a ledger that knows the base rules; the scan proper runs what it lacks, the other rules
    scan_unseen(docs, ledger, rules=tuple(r for r in RULES if r.kind in BASE_KINDS))
    found, spans = find_secrets(docs, ledger, keep=["doc_id"])
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.col(spans)).alias("spans"))


def op5_source_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, n = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", *(F.col(n[k]).alias(k) for k in ("size", "source_size", "target", "taken")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted, n = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                              keep=["doc_id"])
    return counted.select("doc_id", F.col(n["n_bytes"]).alias("n_bytes"), F.col(n["n_tokens"]).alias("n_tokens"),
                          (F.col(n["n_tokens"]) > TOKEN_LIMIT).alias("over_limit"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    scored, n = score_texts(table(spark, sf_dir, "documents"), ~held_out, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), *(F.col(n[k]).alias(k) for k in (
        "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined, n = ngram_join(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", F.col(n["class"]).alias("class_id"), F.col(n["links"]).alias("n_links"))


def op10_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped, n = embedding_dedup(table(spark, sf_dir, "embeddings"))
    return grouped.select("vec_id", *(F.col(n[k]).alias(k) for k in ("n_links", "component_id", "kept")))


def damaged(chats: DataFrame) -> DataFrame:
    """Turns with seeded faults: by the crc32 of ``conv_id:turn`` modulo 20 a row
    is dropped (0), emptied (1), loses its ends of sentences (2), is repeated
    (3) or becomes a user's (4).  A null reads as one space."""
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    marked = chats.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
         .otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def op11_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    mended = repair(damaged(chats))
    every = chats.select("conv_id").distinct()
    nothing = F.sha2(F.lit(""), 256)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(mended, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op12_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned, n = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.transform(F.filter(F.col(n["places"]), lambda p: p["base"]), lambda p: p["start"])
    return scanned.select(
        "doc_id", F.col(n["n_words"]).alias("n_words"), F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        F.array_join(n["base_labels"], ",").alias("base_labels"), F.array_join(n["labels"], ",").alias("labels"),
        F.col(n["share"]).alias("score"))


def op13_accumulator_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_codes": op2_language_codes,
    "op3_noisy_channel_toxicity": op3_noisy_channel_toxicity,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_source_flow": op5_source_flow,
    "op6_token_counts": op6_token_counts,
    "op7_chat_snapshots": op7_chat_snapshots,
    "op8_context_mixing": op8_context_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_spherical_cells": op10_spherical_cells,
    "op11_run_length_repair": op11_run_length_repair,
    "op12_rare_token_licenses": op12_rare_token_licenses,
    "op13_accumulator_search": op13_accumulator_search,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
