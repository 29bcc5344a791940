"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest. A batch is reduced to one row a digest (a map-side
partial aggregate, so a text that fills a third of the corpus sends one row a task), sort-merge
anti-joined with the index, and what is new is appended. Texts never enter a shuffle, only digests.

Defined results: a null text counts as the empty text; a null id sorts after all others, so it stays only
where its whole group has none; rows repeating both id and text are the same document and share one
decision; an empty batch leaves the index as it is. Other columns of the input are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table, text_hash, text_of

#: Runs of blanks that one space does not already stand for.
UNEVEN_BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of blanks becomes one space."""
    return F.regexp_replace(text, UNEVEN_BLANKS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far, in a table bucketed and sorted by digest: (digest, keep_id).

    The index is its folder: ``index`` has the bucketed files and ``layout`` the number of buckets. A session that opens a folder
    with an index registers what is there under a name of its own, and never creates over it."""

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = folder or scratch(spark)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/layout/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            kept = spark.read.schema("buckets int").parquet(f"{self.folder}/layout").first()["buckets"]
            if buckets and buckets != kept:
                raise ValueError(f"the index has {kept} buckets")
            self.buckets = kept
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).cast("int").alias("buckets")).write.parquet(f"{self.folder}/layout")
        spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/index'")

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch; for each of its rows: doc_id, text_hash, keep_id, group_size (rows of the batch with that text), kept, digest."""
        batch = f"{self.folder}/{uuid.uuid4().hex}"
        rows = stored(text_of(docs, id_col, text_col).select("doc_id", text_hash(F.col("text")).alias("text_hash"), digest(F.col("text")).alias("digest")), batch, "rows")
        groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), batch, "groups")
        fresh = groups.select("digest", F.col("first_id").alias("keep_id")).join(self.read().hint("merge"), "digest", "left_anti")
        self._append(fresh.repartition(self.buckets, "digest"))
        # a stored side has an exchange of its own, so that the many copies of one text can be split over tasks
        resolved = stored(groups.join(self.read().hint("merge"), "digest").select("digest", "keep_id", "group_size"), batch, "resolved")
        return rows.join(resolved.hint("merge"), "digest").select(
            "doc_id", "text_hash", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex(spark).add(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
