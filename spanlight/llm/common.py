"""What the corpus operators share: scratch tables, Arrow text blocks, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

#: Bytes of text handled at once inside a Python worker.
BLOCK_BYTES = 4 << 20
#: Bytes of input for a task that its rows are dealt out to, and the most tasks that are made for an estimate.
TASK_BYTES, MOST_TASKS = 256 << 20, 100_000
#: Distinct keys a counting task holds before it passes them on.
HELD = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is this machine, as in tests,
    a local temporary folder is set for the session; on a cluster, executors could not read one another's part of it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanlight-")
        spark.sparkContext.setCheckpointDir(root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, uuid.uuid4().hex)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{folder}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """How many tasks to deal df out to: the session's shuffle partitions, or more where its input, by Catalyst's estimate, has over ``task_bytes`` for each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, size // task_bytes))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, text) with null texts as empty; whatever else the input carries is left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def text_hash(text: Column) -> Column:
    """What tells the texts of one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; df should be a stored table, whose count is read from its footers."""
    return df.count() <= max_rows


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the incoming batches holding about ``most`` bytes of text (one row at least), each with its
    UTF-8 bytes, joined, and the rows' offsets in them. Nulls count as empty."""
    for batch in batches:
        i, n = 0, batch.num_rows
        if not n:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        bounds = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        while i < n:
            j = int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1
            j = min(n, max(j, i + 1))
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


class Rolling:
    """Polynomial hashes modulo 2**64 of any substrings of a byte block, from one prefix sum."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256).astype(U64) * U64(2) + U64(1)
        self.base = (int(rng.integers(1, 1 << 61)) << 3) | 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, factor & (1 << 64) - 1, dtype=U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (prefix[ends] - prefix[starts]) * self.down[starts]


#: A-Z to a-z, bytewise.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and 0x09 to 0x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_words = Rolling(20240229)


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes not marked in ``outside``, and how many each row has; no run crosses rows."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~outside[data]
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts + 1]]
    starts[both] = True
    ends[both] = True
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends)
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def hashed_words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block, A-Z lower-cased, and how many each row has. Never 0, which stands for the end of a text."""
    low = LOWER[data]
    starts, ends, counts = word_spans(low, offsets, outside)
    prefix = _words.prefix(low)
    h = mix(_words.spans(prefix, starts, ends) + (ends - starts).astype(U64))
    h[h == 0] = 1
    return h, counts


class Tally:
    """Counts of 64-bit keys, held up to a bound and passed on when it is reached."""

    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys):
            self.parts.append(np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])
        if self.size > 2 * HELD:
            self._merge()
            if self.size > HELD:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            keys, place = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            self.parts = [(keys, np.bincount(place, np.concatenate([n for _, n in self.parts])).astype(np.int64))]
        self.size = sum(len(k) for k, _ in self.parts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for keys, n in self.parts:
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], schema=self.schema)
        self.parts, self.size = [], 0


def row_of(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


#: crc32 of the id as text, modulo 5, is what the contracts split rows by.
def fold(col: Column) -> Column:
    return F.pmod(F.crc32(col.cast("string")), F.lit(5))
