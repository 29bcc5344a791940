"""The corpus pipeline: quality, exact and near deduplication, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents; the last returns op1's. Stages call the operators of spanlight.llm, and whole texts are read
throughout. A null quality score cannot occur. A document is an id with a text (told apart by text_hash): what is decided on
one text of an id, or of the null id, leaves the others alone. The deduplicating stages keep one of repeated rows; near
deduplication keeps null ids out of links, as op5 does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm import byte_bpe, decontaminate, exact_dedup, near_dedup, quality
from spanlight.llm.common import scratch, stored, table, text_hash

#: The near-duplicate stage's words a shingle and similarity in percent.
SHINGLE, SIMILARITY = 5, 80
#: Lists of dropped documents up to this many rows are sent to every task.
DROPPED_ROWS = 1_000_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose id and text ``dropped`` (doc_id, text_hash) does not list, with their own columns; a null id matches a null id.
    The list is broadcast below DROPPED_ROWS rows (they are counted), and joined by shuffle beyond."""
    return listed(docs, stored(dropped.select("doc_id", "text_hash").distinct(), scratch(docs.sparkSession), "dropped"), "left_anti")


def listed(docs: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """The rows that a stored list of distinct (doc_id, text_hash) has (left_semi) or lacks (left_anti)."""
    pairs = pairs.select(F.col("doc_id").alias("listed_id"), F.col("text_hash").alias("listed_hash"))
    pairs = F.broadcast(pairs) if pairs.count() <= DROPPED_ROWS else pairs.hint("shuffle_hash")
    return docs.join(pairs, docs["doc_id"].eqNullSafe(F.col("listed_id")) & (text_hash(docs["text"]) == F.col("listed_hash")), how)


def one_of_each(docs: DataFrame, rows: DataFrame, group: str) -> DataFrame:
    """Of each group of ``rows`` (doc_id, text_hash, group; a row for each of docs) one row: of the smallest id, null being the largest,
    then of the smallest text hash. Rows whose group is null stay. Only texts of rows that are repeated as a whole are shuffled."""
    folder = scratch(docs.sparkSession)
    rows = stored(rows.where(F.col(group).isNotNull()).select("doc_id", "text_hash", F.col(group).alias("g")), folder, "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = rows.groupBy("g").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "first")
    rows = rows.join(stored(first, folder, "first").hint("merge"), "g").select("doc_id", "text_hash", (order == F.col("first")).alias("is_first"))
    pairs = rows.groupBy("doc_id", "text_hash").agg(F.max("is_first").alias("is_first"), F.count(F.lit(1)).alias("n"))
    pairs = stored(pairs.where("n > 1 or not is_first"), folder, "pairs")
    # all copies of a repeated row are taken out, and one of them put back
    out, again = listed(docs, pairs, "left_anti"), stored(pairs.where("is_first"), folder, "again")
    if again.isEmpty():
        return out
    one = F.min(F.struct(*(c for c in docs.columns if c != "text"), "text")).alias("one")
    once = listed(docs, again, "left_semi").groupBy("doc_id", text_hash(F.col("text")).alias("of")).agg(one)
    return out.unionByName(once.select(*(F.col("one")[c].alias(c) for c in docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.kept(docs, *quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest id."""
    return one_of_each(docs, exact_dedup.DigestIndex(spark).add(docs), "digest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row with the smallest id; documents without words or id stay."""
    return one_of_each(docs, near_dedup.near_groups(docs, size=SHINGLE, threshold=SIMILARITY), "component")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return without(docs, decontaminate.judged(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and of what they decode to."""
    return byte_bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("tokens", token_stage),
]

#: The classifier and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{i}")
    return docs
