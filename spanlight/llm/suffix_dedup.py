"""Removal of long repeated strings with a logarithmic family of sparse suffix arrays.

Any string of LENGTH bytes has a sampled suffix: the place in it whose next GRAM bytes hash lowest. Equal strings have it at
the same place, so only sampled suffixes (about one in (LENGTH - GRAM) / 2 bytes) need an array. Suffixes are ordered by the
64-bit digest of their first GRAM bytes, which puts equal beginnings side by side as text order would.

1. ``postings``: for each sampled suffix its digest (kd), and the row, place and digest (sd) of all bytes of the strings
   that share it (first to last start, ``width`` starts).
2. ``SuffixFamily``: batches of documents become sorted arrays of kd with counts, bucketed by kd. A new array is merge-scanned
   with the existing levels (sort-merge joins without a shuffle) and with itself for repeated suffixes; then equal-sized
   levels are merged, so that a suffix is rewritten a logarithmic number of times.
3. Postings of repeated suffixes are put into classes by (kd, sd). In a class of two or more, every string is repeated. A class of
   one beside others of its kd lies on the edge of a shared passage. Its starts are cut into cells of CELL; a cell is
   repeated throughout if the bytes of all its strings together stand in another class at that place, and not at all if the
   bytes that its strings have in common do not. Only cells in between are compared string by string, by digest.
4. The covered bytes of each document are cut out.

Everything is keyed by digest and aggregated with map-side partials before it meets, so a passage in a third of all documents costs
its edges. Two passes read texts again, for the edges' bytes and for the cut; what they look up is broadcast below
BROADCAST_ROWS rows (counted first) and joined by shuffle beyond.

Defined results: null texts count as empty; texts shorter than LENGTH bytes keep everything; repeated rows, even of one id, are different
places, so both lose what they share; a null id is a document like any other; an empty table gives an empty result; other
columns are ignored. Bytes are those of UTF-8, and what is kept may end inside a character.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Rolling, blocks, mix, scratch, stored, table, text_of

LENGTH, GRAM, CELL = 400, 200, 20
BATCHES = 4
BROADCAST_ROWS = 1_000_000
BLOCK = 1 << 20
POS_BITS = 28
_gram, _whole = Rolling(31), Rolling(37)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by minima from the left and from the right of fixed blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """The sampled suffixes of a block: row, first start (in the row) of the ``length``-byte strings that share the suffix, number
    of starts, the suffix's place after the first start, its digest, and the digest of all bytes that those strings cover."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    prefix = _gram.prefix(data)
    at = np.arange(len(data) - gram + 1)
    digest = mix(_gram.spans(prefix, at, at + gram))
    low = U64((1 << POS_BITS) - 1)
    least = sliding_least((digest & ~low) | at.astype(U64), length - gram + 1)
    place = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.arange(len(place))
    start = start[row[start] == row[start + length - 1]]
    if not len(start):
        return none, none, none, none, none, none
    place, row = place[start], row[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    a, b, p, row = start[first], start[np.append(first[1:], len(start)) - 1], place[first], row[first]
    whole = _whole.spans(_whole.prefix(data), a, b + length)
    whole = mix(whole + (p - a).astype(U64) * U64(0x9E3779B97F4A7C15) + (b - a).astype(U64) * U64(0xBF58476D1CE4E5B9))
    return row, a - offsets[row], b - a + 1, p - a, digest[p].view(np.int64), whole.view(np.int64)


def owned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a key of the row's content."""
    return docs.withColumn("own", F.xxhash64("doc_id", "text"))


def postings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(kd, sd, own, start, width, lead) of (own, text) rows."""
    types = [("kd", pa.int64()), ("sd", pa.int64()), ("own", pa.int64()), ("start", pa.int32()), ("width", pa.int32()), ("lead", pa.int32())]

    def run(batches):
        for part, data, offsets in blocks(batches, most=BLOCK):
            row, start, width, lead, kd, sd = samples(data, offsets, length, gram)
            if len(row):
                arrays = [pa.array(kd), pa.array(sd), part.column(0).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (start, width, lead))]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(types))

    return docs.select("own", "text").mapInArrow(run, "kd long, sd long, own long, start int, width int, lead int")


class SuffixFamily:
    """Levels of sorted suffix keys with counts; each is a bucketed table of (kd, n)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []
        self.repeats: list[DataFrame] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"suffix_level_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, "kd").write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}")
         .bucketBy(self.buckets, "kd").sortBy("kd").saveAsTable(name))
        return name

    def add(self, batch: DataFrame) -> None:
        """Index a batch of postings and note the suffixes that it repeats."""
        name, size = self._write(batch.groupBy("kd").agg(F.count(F.lit(1)).alias("n"))), 1
        new = self.spark.table(name)
        found = new.where("n > 1").select("kd")
        for _, level in self.levels:
            found = found.unionByName(new.hint("merge").join(self.spark.table(level), "kd", "left_semi").select("kd"))
        self.repeats.append(stored(found, self.folder, f"repeats-{len(self.repeats)}"))
        while self.levels and self.levels[-1][0] == size:
            _, old = self.levels.pop()
            both = self.spark.table(old).unionByName(self.spark.table(name))
            merged = self._write(both.groupBy("kd").agg(F.sum("n").alias("n")))
            for gone in (old, name):
                self.spark.sql(f"DROP TABLE {gone}")
            name, size = merged, 2 * size
        self.levels.append((size, name))

    def repeated(self) -> DataFrame:
        """(kd) of all suffixes that stand in two places or more."""
        out = self.repeats[0]
        for more in self.repeats[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def drop(self) -> None:
        for _, name in self.levels:
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def grouped(rows: DataFrame, folder: str, name: str, *columns: str) -> DataFrame:
    """A row's entries as a list, to be joined with its text: broadcast if they are few."""
    lists = stored(rows.groupBy("own").agg(F.collect_list(F.struct(*columns)).alias("entries"), F.count(F.lit(1)).alias("many")), folder, name)
    total = lists.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    lists = lists.select(F.col("own").alias("of"), "entries")
    return F.broadcast(lists) if total <= BROADCAST_ROWS else lists.hint("shuffle_hash")


def edges(docs: DataFrame, classes: DataFrame, folder: str, length: int) -> DataFrame:
    """The bytes of each class's strings, from the row that stands for it: (kd, sd, single, own, start, width, lead, data)."""
    entries = grouped(classes.select("kd", "sd", "single", "own", "start", "width", "lead"), folder, "edge-entries", "kd", "sd", "single", "start", "width", "lead")
    rows = docs.join(entries, F.col("own") == F.col("of"))
    types = [("kd", pa.int64()), ("sd", pa.int64()), ("single", pa.bool_()), ("own", pa.int64()), ("start", pa.int32()), ("width", pa.int32()), ("lead", pa.int32()), ("data", pa.binary())]

    def run(batches):
        for part, data, offsets in blocks(batches, most=BLOCK):
            out = []
            for i, (own, entries) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                for e in entries:
                    at = offsets[i] + e["start"]
                    out.append((e["kd"], e["sd"], e["single"], own, e["start"], e["width"], e["lead"], data[at : at + e["width"] - 1 + length].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), types, strict=True)], schema=pa.schema(types))

    # a text that stands in two rows with one id gives its classes twice
    return rows.select("own", "text", "entries").mapInArrow(run, "kd long, sd long, single boolean, own long, start int, width int, lead int, data binary").dropDuplicates(["kd", "sd"])


def cells(strings: DataFrame, length: int, cell: int) -> DataFrame:
    """(kd, sd, single, cell, core, whole): digests of what a cell's strings have in common and of all that they cover; whole is null
    where the class has only some of the cell's starts. A start is named by how far before the sampled suffix it lies."""
    types = [("kd", pa.int64()), ("sd", pa.int64()), ("single", pa.bool_()), ("cell", pa.int32()), ("core", pa.int64()), ("whole", pa.int64())]

    def run(batches):
        for part, data, offsets in blocks(batches, "data", most=BLOCK):
            prefix = _whole.prefix(data)
            width, lead = (part.column(i).to_numpy().astype(np.int64) for i in (5, 6))
            low, high = (lead - width + 1) // cell, lead // cell
            many = high - low + 1
            of = np.repeat(np.arange(part.num_rows), many)
            c = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
            least, most = c * cell, c * cell + cell - 1
            place = offsets[:-1][of] + lead[of]
            core = mix(_whole.spans(prefix, place - least, place + length - most) + c.astype(U64))
            full = (least >= (lead - width + 1)[of]) & (most <= lead[of])
            whole = np.zeros(len(of), dtype=U64)
            whole[full] = mix(_whole.spans(prefix, (place - most)[full], (place + length - least)[full]) + c[full].astype(U64))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(c.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64), mask=~full)], schema=pa.schema(types))

    return strings.select("kd", "sd", "single", "own", "start", "width", "lead", "data").mapInArrow(run, "kd long, sd long, single boolean, cell int, core long, whole long")


def single_strings(strings: DataFrame, length: int, cell: int) -> DataFrame:
    """(kd, sd, single, before, digest) of the strings in the cells that the rows list."""
    types = [("kd", pa.int64()), ("sd", pa.int64()), ("single", pa.bool_()), ("before", pa.int32()), ("digest", pa.int64())]

    def run(batches):
        for part, data, offsets in blocks(batches, "data", most=BLOCK // 8):
            prefix = _whole.prefix(data)
            width, lead = (part.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            lists = part.column(6)
            listed = np.asarray(lists.flatten()).astype(np.int64)
            of = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            before = (listed[:, None] * cell + np.arange(cell)).ravel()
            of = of.repeat(cell)
            own = (before >= (lead - width + 1)[of]) & (before <= lead[of])
            before, of = before[own], of[own]
            at = offsets[:-1][of] + lead[of] - before
            digest = mix(_whole.spans(prefix, at, at + length) + before.astype(U64))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), pa.array(before.astype(np.int32)), pa.array(digest.view(np.int64))], schema=pa.schema(types))

    return strings.select("kd", "sd", "single", "width", "lead", "data", "cells").mapInArrow(run, "kd long, sd long, single boolean, before int, digest long")


def spans(docs: DataFrame, folder: str, length: int = LENGTH, gram: int = GRAM, cell: int = CELL, batches: int = BATCHES) -> DataFrame:
    """(own, first, last): starts of repeated strings, as ranges, of (own, text) rows."""
    spark = docs.sparkSession
    placed = stored(postings(docs, length, gram), folder, "postings")
    family = SuffixFamily(spark, folder)
    for i in range(batches):
        family.add(placed.where(F.pmod(F.xxhash64("own"), F.lit(batches)) == i))
    repeats = stored(family.repeated(), folder, "repeated")
    family.drop()
    held = stored(placed.join(repeats.hint("merge"), "kd"), folder, "held")
    classes = held.groupBy("kd", "sd").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("own", "start", "width", "lead")).alias("at"))
    classes = stored(classes.select("kd", "sd", "n", "at.*", (F.col("n") == 1).alias("single")), folder, "classes")
    sure = held.join(classes.where("n > 1").select("kd", "sd").hint("merge"), ["kd", "sd"]).select("own", F.col("start").alias("first"), (F.col("start") + F.col("width") - 1).alias("last"))
    mixed = classes.groupBy("kd").agg(F.count(F.lit(1)).alias("m"), F.max("single").alias("any")).where("m > 1 and any").select("kd")
    edge = stored(classes.join(stored(mixed, folder, "mixed").hint("merge"), "kd"), folder, "edge-classes")
    strings = stored(edges(docs, edge, folder, length), folder, "strings")
    places = strings.where("single").select("kd", "sd", "own", (F.col("start") + F.col("lead")).alias("place"), "start", "width")
    cut = stored(cells(strings, length, cell), folder, "cells")
    shared = lambda column: stored(cut.where(F.col(column).isNotNull()).groupBy("kd", "cell", column).agg(F.count(F.lit(1)).alias("m"), F.max("single").alias("any")).where("m > 1 and any").select("kd", "cell", column), folder, f"shared-{column}")
    cores, wholes = shared("core"), shared("whole")
    judged = cut.join(cores.hint("merge"), ["kd", "cell", "core"]).join(wholes.withColumn("sure", F.lit(True)).hint("merge"), ["kd", "cell", "whole"], "left")
    judged = stored(judged.select("kd", "sd", "single", "cell", "core", F.coalesce("sure", F.lit(False)).alias("sure")), folder, "judged")
    open_cores = stored(judged.where("single and not sure").select("kd", "cell", "core").distinct(), folder, "open-cores")
    asked = judged.join(open_cores.hint("merge"), ["kd", "cell", "core"]).groupBy("kd", "sd").agg(F.collect_set("cell").alias("cells"))
    asked = stored(asked, folder, "asked")
    one = stored(single_strings(strings.join(asked.hint("merge"), ["kd", "sd"]), length, cell), folder, "single-strings")
    equal = one.groupBy("kd", "digest").agg(F.count(F.lit(1)).alias("m"), F.max("single").alias("any")).where("m > 1 and any").select("kd", "digest")
    one = one.where("single").join(stored(equal, folder, "equal").hint("merge"), ["kd", "digest"]).select("kd", "sd", F.col("before").alias("least"), F.col("before").alias("most"))
    whole = judged.where("single and sure").select("kd", "sd", (F.col("cell") * cell).alias("least"), (F.col("cell") * cell + cell - 1).alias("most"))
    found = one.unionByName(whole).join(places.hint("merge"), ["kd", "sd"])
    found = found.select("own", F.greatest(F.col("place") - F.col("most"), F.col("start")).alias("first"), F.least(F.col("place") - F.col("least"), F.col("start") + F.col("width") - 1).alias("last"))
    return sure.unionByName(found)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, cell: int = CELL, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row."""
    folder = scratch(docs.sparkSession)
    docs = owned(text_of(docs, id_col, text_col))
    entries = grouped(spans(docs.select("own", "text"), folder, length, gram, cell, batches), folder, "spans", "first", "last")
    rows = docs.join(entries, F.col("own") == F.col("of"), "left").select("doc_id", "text", "entries")
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]

    def run(batches):
        for part, data, offsets in blocks(batches, most=BLOCK):
            lists = part.column(2)
            flat = lists.flatten()
            of = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
            first, last = (np.asarray(flat.field(i)).astype(np.int64) + offsets[of] for i in (0, 1))
            change = np.bincount(first, minlength=len(data) + 1) - np.bincount(last + length, minlength=len(data) + 1)
            gone = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            begins = gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]
            heads = offsets[:-1][np.diff(offsets) > 0]
            begins[heads] = gone[heads]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept = data[~gone]
            cuts = offsets - total[offsets]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])),
                pa.array([kept[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=pa.schema(types))

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
