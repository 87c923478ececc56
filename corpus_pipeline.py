"""The corpus pipeline over `documents`: each stage calls one operator of tickloom.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import common, decontaminate, line_dedup, near_dedup, packing, quality, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    scored = quality.quality_scores(_columns(docs), common.table(spark, sf_dir, "labels"))
    return _columns(scored.where("fm_predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; n_chars follows the text."""
    cleaned = line_dedup.line_dedup(_columns(docs), F.col("source"))
    return _columns(cleaned.withColumn("n_chars", F.when(F.col("ld_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate group stays; documents without an id stay. Rows
    that share an id are documents of their own by their text: equal ones stay once (the first by
    the other columns), unlike ones all, and an id that one row has alone goes before them."""
    docs = _columns(docs)
    repeated = common.stage(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        several = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("first"))
        several = several.select("doc_id", "text", "first.*").select(*COLUMNS, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).bitwiseOR(F.lit(1 << 62)).alias("key"))
        keyed = docs.join(repeated, "doc_id", "left_anti").withColumn("key", F.col("doc_id").cast("long")).unionAll(several)
        docs = common.stage(keyed, "documents-by-key")
    else:
        docs = docs.withColumn("key", F.col("doc_id").cast("long"))
    found = near_dedup.near_duplicates(docs.select(F.col("key").alias("doc_id"), "text"), percent=80)
    gone = common.stage(found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("key")), "near-duplicates")
    return _columns(docs.join(gone.dropDuplicates(), "key", "left_anti"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = decontaminate.decontaminate(_columns(docs), common.table(spark, sf_dir, "benchmark"))
    return _columns(found.where(F.size("bm_items") == 0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 1024 ids."""
    return packing.pack_documents(docs, tokens.default_vocabulary(), end_id=0, size=1024)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained classifier nor the sketches; tests/llm compares the stages
#: with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
