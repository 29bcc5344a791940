"""Benchmark decontamination by a positional inverted index over the training text.

1. The benchmark's items are cut into windows of consecutive words (a shorter item is one window). Words are 64-bit hashes.
2. Term counts over the whole corpus tell the rarest terms of each window (``RAREST`` of them, its anchors).
3. Postings (document, position) of all anchor terms are taken from the corpus. They are stored, and joined with the windows
   by term; each posting's position less the anchor's offset is where that window would start. A start on which all of
   a window's anchors agree is a candidate: the offset-adjusted lists are intersected by counting in a group.
4. Candidates are held against all the document's words at that place, so what is returned are exact phrases.
   ``proximity_matches`` returns, from the same postings, places where a window's anchors lie close together instead.

Passes over the corpus let only those words through that a bitmap of fixed size has, and a join by term removes its false hits.
The corpus side is never broadcast or collected. The benchmark's terms and windows are broadcast below ``BROADCAST_ROWS``
rows (they are counted first) and joined by shuffle beyond that. A passage in a third of all documents gives postings that are
spread by document; only counts meet at a term.

Defined results: null and empty texts have no words; an item without words has no window; documents repeating id and text
are judged alike; a null id is treated as any other; empty tables give no windows or no rows; other columns are ignored.
Items with equal texts all count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Tally, blocks, hashed_words, mix, row_of, scratch, stored, table, text_hash, text_of

WINDOW, RAREST = 13, 3
#: Benchmark windows or terms up to this many rows are sent to every task.
BROADCAST_ROWS = 500_000
BITMAP_BITS = 22
BLOCK = 2 << 20
#: Digits, letters and all bytes of other scripts make words.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
ODD = U64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(data, offsets, OUTSIDE)


def phrase_digests(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A digest of the words from each start on; words beyond the end count as none."""
    out = np.zeros(len(starts), dtype=U64)
    padded = np.append(words, U64(0))
    for i in range(int(lengths.max(initial=0))):
        word = padded[np.minimum(starts + i, len(words))]
        out = np.where(i < lengths, mix(out * ODD + word + U64(1)), out)
    return out


def side(df: DataFrame) -> DataFrame:
    """A stored benchmark table, broadcast if it has ``BROADCAST_ROWS`` rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """(item_id, window, length, terms): the distinct windows of (item_id, text) rows."""
    schema = pa.schema([("item_id", pa.int64()), ("window", pa.int64()), ("length", pa.int32()), ("terms", pa.list_(pa.int64()))])

    def run(batches):
        for part, data, offsets in blocks(batches, most=BLOCK):
            words, counts = words_of(data, offsets)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            out = []
            for item, i, n in zip(part.column(0).to_pylist(), cuts, counts, strict=False):
                length = min(size, int(n))
                starts = np.arange(i, i + n - length + 1) if n else np.zeros(0, dtype=np.int64)
                for start, digest in zip(starts, phrase_digests(words, starts, np.full(len(starts), length)), strict=True):
                    out.append((item, int(digest.view(np.int64)), length, words[start : start + length].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return items.mapInArrow(run, "item_id long, window long, length int, terms array<long>").dropDuplicates(["item_id", "window"])


def anchors_of(windows: DataFrame, counts: DataFrame, rarest: int) -> DataFrame:
    """(window, place, term, offset, n_anchors): the rarest terms of each window, each at one place."""
    terms = windows.dropDuplicates(["window"]).select("window", F.posexplode("terms").alias("offset", "term"))
    ranked = (terms.join(counts, "term").groupBy("window", "term").agg(F.min(F.struct("n", "offset")).alias("x"))
              .groupBy("window").agg(F.slice(F.array_sort(F.collect_list(F.struct("x.n", "term", "x.offset"))), 1, rarest).alias("a"), F.count(F.lit(1)).alias("known")))
    # a window with a term that the corpus lacks has no place in it
    lengths = terms.groupBy("window").agg(F.count_distinct("term").alias("distinct"))
    ranked = ranked.join(lengths, "window").where("known = distinct")
    return ranked.select("window", F.size("a").alias("n_anchors"), F.posexplode("a").alias("place", "a")).select("window", "place", "a.term", "a.offset", "n_anchors")


def bitmap(terms: DataFrame) -> np.ndarray:
    """A bitmap that has the top bits of every term. It is put together from distinct slots, of which there are 2**BITMAP_BITS at most."""
    slots = terms.select(F.shiftrightunsigned("term", 64 - BITMAP_BITS).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)
    out = np.zeros(1 << BITMAP_BITS, dtype=bool)
    out[slots] = True
    return out


class PostingsIndex:
    """Positional postings, over a corpus, of the anchor terms of a benchmark."""

    def __init__(self, docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST):
        self.folder = scratch(docs.sparkSession)
        self.docs = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
        self.windows = stored(windows_of(items, window), self.folder, "windows")
        terms = stored(self.windows.select(F.explode("terms").alias("term")).distinct(), self.folder, "terms")
        counts = self._counted(bitmap(terms)).join(side(terms), F.col("key") == F.col("term"))
        self.anchors = stored(anchors_of(self.windows, stored(counts.select("term", "n"), self.folder, "counts"), rarest), self.folder, "anchors")
        wanted = stored(self.anchors.select("term").distinct(), self.folder, "wanted")
        self.postings = stored(self._placed(bitmap(wanted)).join(side(wanted), "term", "left_semi"), self.folder, "postings")

    def _counted(self, wanted: np.ndarray) -> DataFrame:
        shared = self.docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

        def run(batches):
            wanted, tally = np.unpackbits(shared.value).view(bool), Tally()
            for _, data, offsets in blocks(batches, most=BLOCK):
                words, _ = words_of(data, offsets)
                yield from tally.add(words[wanted[(words >> U64(64 - BITMAP_BITS)).astype(np.int64)]])
            yield from tally.flush()

        return self.docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))

    def _placed(self, wanted: np.ndarray) -> DataFrame:
        shared = self.docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32()), ("term", pa.int64())])

        def run(batches):
            wanted = np.unpackbits(shared.value).view(bool)
            for part, data, offsets in blocks(batches, most=BLOCK):
                words, counts = words_of(data, offsets)
                at = np.flatnonzero(wanted[(words >> U64(64 - BITMAP_BITS)).astype(np.int64)])
                row = row_of(counts)[at]
                first = np.cumsum(counts) - counts
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), pa.array((at - first[row]).astype(np.int32)), pa.array(words[at].view(np.int64))], schema=schema)

        return self.docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, pos int, term long")

    def _starts(self) -> DataFrame:
        return self.postings.join(side(self.anchors), "term").withColumn("start", F.col("pos") - F.col("offset"))

    def candidates(self) -> DataFrame:
        """(doc_id, text_hash, start, window) where all anchors of a window agree on its start."""
        groups = self._starts().where("start >= 0").groupBy("doc_id", "text_hash", "start", "window")
        # each anchor is a bit, so that repeated rows do not count twice
        return groups.agg(F.expr("bit_count(bit_or(shiftleft(1L, place)))").alias("n"), F.max("n_anchors").alias("n_anchors")).where("n = n_anchors").drop("n", "n_anchors")

    def phrase_matches(self) -> DataFrame:
        """doc_id, text_hash, n_words and hits (struct of start, length and item_id) of every document; hits are exact phrases."""
        found = self.candidates().join(side(self.windows.select("window", "length", "item_id")), "window")
        found = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "length", "window", "item_id")).alias("found"))
        found = stored(found, self.folder, "found").withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
        rows = self.docs.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
        hit = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item_id", pa.int64())])

        def run(batches):
            for part, data, offsets in blocks(batches, most=BLOCK):
                words, counts = words_of(data, offsets)
                lists = part.column(3)
                many = np.asarray(lists.value_lengths().fill_null(0))
                flat, row = lists.flatten(), row_of(many)
                start, length, window = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
                good = start + length <= counts[row]
                digest = phrase_digests(words, (np.cumsum(counts) - counts)[row] + start, length)
                good &= digest.view(np.int64) == window
                kept = np.concatenate([[0], np.cumsum(np.bincount(row[good], minlength=part.num_rows))]).astype(np.int32)
                mask = pa.array(good)
                hits = pa.StructArray.from_arrays([flat.field(i).filter(mask) for i in (0, 1, 3)], fields=list(hit))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(kept), hits)], names=["doc_id", "text_hash", "n_words", "hits"])

        return rows.select("doc_id", "text", "text_hash", "found").mapInArrow(run, "doc_id long, text_hash long, n_words long, hits array<struct<start: int, length: int, item_id: long>>")

    def proximity_matches(self, slop: int) -> DataFrame:
        """(doc_id, text_hash, window, start): every place from which on each of a window's anchors stands, in any order, so that the starts which the anchors
        give the window lie within 2 * slop words of one another, that is, each within ``slop`` of a common one. ``start`` is the least of them,
        and negative where a window would begin before its text. Starts go into bins of 2 * slop + 1, each into its own and the one before, so a
        bin has all that its places need, and holds only a bounded number of distinct starts."""
        width = 2 * slop + 1
        own = F.floor(F.col("start") / width)
        placed = self._starts().withColumn("bin", F.explode(F.array(own, own - 1)))
        groups = placed.groupBy("doc_id", "text_hash", "bin", "window").agg(F.collect_set(F.struct("start", "place")).alias("found"), F.max("n_anchors").alias("n_anchors"))
        near = f"aggregate(filter(found, y -> y.start between x and x + {2 * slop}), 0L, (s, y) -> s | shiftleft(1L, y.place))"
        places = F.expr(f"filter(array_distinct(found.start), x -> floor(x / {width}) = bin and bit_count({near}) = n_anchors)")
        return groups.select("doc_id", "text_hash", "window", F.explode(places).alias("start"))


def covered(hits: str) -> Column:
    """How many words the spans (start, length) of an array column cover together."""
    return F.expr(f"""aggregate(array_sort(transform({hits}, x -> struct(x.start, x.start + x.length as stop))), struct(0L as n, 0 as upto),
        (s, x) -> struct(s.n + greatest(x.stop - greatest(x.start, s.upto), 0) as n, greatest(s.upto, x.stop) as upto), s -> s.n)""")


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """Per document: text_hash, n_words, n_hit, n_items, items (their ids as strings, sorted) and contaminated."""
    index = PostingsIndex(text_of(docs), items.select(F.col("item_id"), F.coalesce("text", F.lit("")).alias("text")), window, rarest)
    rows = index.phrase_matches().withColumn("n_hit", covered("hits"))
    rows = rows.withColumn("items", F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"].cast("string")))))
    return rows.select("doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                       ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digests(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judged(docs, items).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items", "text_hash")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS phrase, least(len(w), 13) AS size
  FROM bw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0
), spot AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM dw, (SELECT DISTINCT size FROM win) z, unnest(range(1, len(w) - size + 2)) AS t(s) WHERE len(w) >= size
), hit AS (SELECT doc_id, s, size, item_id FROM spot JOIN win USING (phrase, size)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + size)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
