"""Quality classifier: supervised subword embeddings.

A text's words, pairs of words in a row and character n-grams are hashed into buckets, each with a learned vector; a text is the mean
of its vectors, put through a linear layer and a softmax. Vectors and layer are trained together by stochastic
gradient descent in numpy, on a bounded sample of the labelled rows (``SAMPLE_ROWS``: those whose id hashes lowest);
the sample's features, a bounded number a row, are made by the executors. For scoring, bucket vectors and layer fold into
one weight a bucket, which is broadcast (``BUCKETS`` floats, whatever the input).

Only the text is an input of a score. Whole texts are read, in blocks; a text longer than a block is one. Defined results: null and
empty texts have no features and score the learned prior; repeated rows score alike; with no labelled rows, every text scores 0.5; rows
with a null label or id are not learned from; an id labelled more than once has its lowest label; a document with a null id is
scored and is not held out; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, U64, Rolling, blocks, fold, mix, table, text_of, word_spans

BUCKETS, DIM, NGRAMS = 1 << 17, 12, (3, 4, 5)
SAMPLE_ROWS, EPOCHS, RATE = 4000, 6, 0.5
THRESHOLD = 0.3
BLOCK = 1 << 20

_bytes = Rolling(7)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every feature of a block."""
    starts, ends, counts = word_spans(data, offsets)
    prefix = _bytes.prefix(data)
    rows = np.repeat(np.arange(len(counts)), counts)
    words = mix(_bytes.spans(prefix, starts, ends) + U64(1))
    pairs = np.flatnonzero(rows[1:] == rows[:-1])
    found = [(words, rows), (mix(words[pairs] * U64(0x9E3779B97F4A7C15) + words[pairs + 1]), rows[pairs])]
    # n-grams lie within a word and the one blank on either side of it
    n = len(data)
    blank = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(BLANK[data], out=blank[1:])
    of = np.repeat(np.arange(len(counts), dtype=np.int32), np.diff(offsets))
    for size in NGRAMS:
        last = n - size + 1
        if last <= 0:
            continue
        at = np.flatnonzero((blank[size - 1 : n] == blank[1 : last + 1]) & (of[size - 1 :] == of[:last]))
        found.append((mix(_bytes.spans(prefix, at, at + size) + U64(size)), of[at]))
    ids = np.concatenate([(h >> U64(40)).astype(np.int64) & (BUCKETS - 1) for h, _ in found])
    return ids, np.concatenate([r for _, r in found])


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, usable, per_class: int | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of the labelled rows that are learned from: at most ``rows``, or ``per_class`` of each label, those
    whose id hashes lowest. The chosen ids are few by that bound, so they are broadcast and the texts never shuffled."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    order = (F.xxhash64("labelled_id"), "labelled_id", "label")
    if per_class:
        chosen = known.where("label = 1").orderBy(*order).limit(per_class).unionByName(known.where("label = 0").orderBy(*order).limit(per_class))
    else:
        chosen = known.orderBy(*order).limit(rows)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "text", "label")


def collected(sample: DataFrame, make, block: int = BLOCK) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, features, their counts) of the sample's rows, in a fixed order. They come as Arrow batches and are kept as two flat arrays, so that
    the driver holds little besides; counts are sent in 16 bits where they fit."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for part, data, offsets in blocks(batches, most=block):
            ids, rows = make(data, offsets)
            both, counts = np.unique(rows * np.int64(1 << 40) + ids, return_counts=True)
            cuts = np.searchsorted(both, np.arange(part.num_rows + 1) * np.int64(1 << 40))
            ids = (both & (1 << 40) - 1).astype("<i4")
            fit = lambda x: x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4").tobytes()
            pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array([ids[i:j].tobytes() for i, j in pairs], pa.binary()), pa.array([fit(counts[i:j]) for i, j in pairs], pa.binary())], schema=schema)

    table = sample.mapInArrow(run, "doc_id long, label int, ids binary, counts binary").toArrow().combine_chunks()
    table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("ids", "ascending")])
    labels, out = table.column("label").to_pylist(), []
    for label, ids, counts in zip(labels, table.column("ids"), table.column("counts"), strict=True):
        ids = np.frombuffer(ids.as_buffer(), "<i4").copy()
        width = len(counts.as_buffer()) // max(1, len(ids))
        out.append((label, ids, np.frombuffer(counts.as_buffer(), "<u4" if width == 4 else "<u2").copy()))
    del table
    released()
    return out


def released() -> None:
    """Give memory that is free again back to the machine, as a driver lives on with what training has once held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on softmax loss; the weight of each bucket in the score's log odds, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), dtype=np.float32), np.zeros(2, dtype=np.float32)
    if not rows:
        return np.zeros(buckets, dtype=np.float32), 0.0
    share = np.clip(np.mean([label for label, _, _ in rows]), 0.01, 0.99)
    bias[1] = np.log(share / (1 - share))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, ids, counts = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            weight = (counts / counts.sum()).astype(np.float32)
            hidden = weight @ vectors[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= lr * np.outer(p, hidden)
            # a mean's gradient is spread over its features: the step on a vector is that of the mean, as in fastText
            vectors[ids] -= lr * back * (counts > 0)[:, None] * np.minimum(1, weight * len(ids))[:, None]
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, weights: np.ndarray, bias: float, block: int = BLOCK) -> DataFrame:
    """(doc_id, score) of (doc_id, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for part, data, offsets in blocks(batches, most=block):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(chances(data, offsets, shared.value, bias))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, score double")


def chances(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each row of a block."""
    ids, rows = features(data, offsets)
    n = len(offsets) - 1
    total, many = np.bincount(rows, weights[ids], n), np.bincount(rows, minlength=n)
    return 1 / (1 + np.exp(-(total / np.maximum(many, 1) + bias)))


def kept(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The rows that score ``threshold`` at least, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for part, data, offsets in blocks(batches, text_col, block):
            yield part.filter(pa.array(chances(data, offsets, shared.value, bias) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: int = 0, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """Learn from labelled rows outside the held-out fold."""
    model = train(collected(sampled(text_of(docs), labels, label_col, fold(F.col("doc_id")) != held_out, rows=rows), features))
    released()
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(text_of(docs), *fit(docs, labels))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
