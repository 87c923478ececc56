"""The registered queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import common, decontaminate, embedding_dedup, language_model, line_dedup, merkle, near_dedup, packing, quality, spelling, substring_dedup, token_store, tokens, toxicity, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.default_vocabulary(), end_id=0, size=1024)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_scores(common.table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = quality.quality_scores(docs, common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.col("fm_held_out").alias("held_out"), F.col("fm_score").alias("score"), F.col("fm_predicted").alias("predicted"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(common.table(spark, sf_dir, "documents"), tokens.default_vocabulary(), end_id=2)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(common.table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the benchmark items it holds, and whether it holds any."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("bm_items") > 0).alias("contaminated"), F.col("bm_items").alias("items"), F.col("bm_distances").alias("distances"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of `documents`, whose `source` is the site."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.line_dedup(docs, F.col("source")).select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf a row of `documents`, a tree a source. Where 5 divides the crc32 of doc_id, the text is
    tampered with (A-Z lower-cased) before the proof is folded."""
    docs = common.table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(common.id_bucket(F.col("doc_id"), 5) == 0, merkle.leaf_hash(*rest, lowered))
    leaves = docs.select("doc_id", "source", merkle.leaf_hash(*rest, F.col("text")).alias("leaf"), tampered.alias("tampered"))
    made = merkle.merkle_manifest(leaves, F.col("source"), ["doc_id"]).withColumn("found", F.coalesce("tampered", "leaf"))
    made = merkle.folded(made, "found")
    shown = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    proof = F.sha2(F.encode(F.lower(F.hex("proof")), "UTF-8"), 256).alias("proof_sha256")
    return made.select("doc_id", *shown, proof, F.lower(F.hex("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(common.table(spark, sf_dir, "documents"), slip_every=97)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(common.table(spark, sf_dir, "pages"), min_bytes=0)


def line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on the visible lines of raw `pages`, by the host of the URL."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", line_dedup.page_host(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    return line_dedup.line_dedup(pages, F.col("host")).select("page_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_language_model, op3_substring_dedup, op4_quality, op5_near_dedup, op6_token_store, op7_embedding_dedup, op8_decontaminate, op9_line_dedup, op10_toxicity, op11_merkle_manifest, op12_spelling_variants, op13_warc, line_dedup_pages)}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op12_spelling_variants": spelling.ORACLE_SQL,
        "op13_warc": warc.ORACLE_SQL,
    }
