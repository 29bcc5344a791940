"""Removal of lines that many documents share (DataFrame operations only).

Lines are exploded once into narrow postings (document, position, 128-bit hash of the normalised line) and
stored; the text itself stays behind. Distinct documents a hash are counted in two aggregates, each with
map-side partials. Hashes over the threshold are joined back to the postings with exchanges on both sides,
so that the rows of a very common line are split over tasks, and the surviving positions reassemble each text.

Defined results: a null or empty text is one empty line; rows repeating id and text get the same
decisions and count as one document, as do all rows of one id; null ids count as one document. A key shorter
than ``min_chars`` code points is never common. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table, text_of

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Blanks stripped, A-Z lower-cased; the quick function serves wherever the line is ASCII."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def common_line_positions(docs: DataFrame, min_docs: int, min_chars: int, folder: str) -> DataFrame:
    """(doc_id, text_hash, positions): 0-based positions of the lines to drop, for documents that have some."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).where(F.char_length("line") >= min_chars)
    postings = stored(lines.select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2")), folder, "postings")
    common = (postings.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
              .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs))
    common = stored(common.select("h1", "h2"), folder, "common")
    # neither side of these joins is bounded: always by shuffle, and the first so that a hot line's rows can be split
    return postings.join(common.hint("merge"), ["h1", "h2"]).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without the lines whose key at least min_docs documents have."""
    spark = docs.sparkSession
    folder = scratch(spark)
    docs = text_of(docs, id_col, text_col)
    drops = stored(common_line_positions(docs, min_docs, min_chars, folder), folder, "drops")
    drops = drops.withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
    joined = docs.withColumn("text_hash", F.xxhash64("text")).join(
        drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    split = F.split("text", "\n", -1)
    rows = joined.select("doc_id", "text", "positions", split.alias("lines"), F.size(split).alias("n_lines"))
    rest = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("positions"))
    kept = F.array_join(F.transform(rest, lambda i: F.element_at("lines", i + 1)), "\n")
    return rows.select("doc_id", F.col("n_lines").cast("long"), F.when(F.col("positions").isNull(), F.lit(0)).otherwise(F.size("positions")).cast("long").alias("n_dropped"),
                       F.when(F.col("positions").isNull(), F.col("text")).otherwise(kept).alias("text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(1, len(s) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), keyed AS (
  SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (key) GROUP BY doc_id
"""
