"""Toxicity: a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the first bytes of longer ones (insults are inflected), hashed
into buckets. A bucket has a linear weight and a vector; the log odds are

    bias + sum of weights + (|sum of vectors|^2 - sum of |vector|^2) / 2

so that pairs of terms count beyond what each weighs alone. It is trained by AdaGrad in numpy on a bounded sample: the
``PER_CLASS`` labelled rows of either label whose ids hash lowest, and the bias is then set back to the labels'
own share. Buckets in fewer than ``MIN_ROWS`` sampled rows keep no parameters, and small weights are shrunk to zero,
so the many neutral words of a very long text add up to nothing. The parameters (``BUCKETS`` rows) are broadcast.

Only the text is an input of a score. Whole texts are read, in blocks; a text longer than a block is one. Defined results: null and
empty texts score the learned prior; repeated rows score alike; with no labelled rows, every text scores 0.5; rows with a null label or
id are not learned from; an id labelled more than once has its lowest label; a document with a null id is scored and is not held
out; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Rolling, blocks, fold, mix, row_of, table, text_of, word_spans
from .quality import collected, released, sampled

BUCKETS, DIM, PREFIXES = 1 << 18, 8, (4, 5, 6)
PER_CLASS, MIN_ROWS, EPOCHS, RATE, SHRINK = 2500, 8, 10, 0.2, 0.2
THRESHOLD = 0.5
BLOCK = 1 << 20
#: Letters, digits and all bytes of other scripts make words.
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_bytes = Rolling(11)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every term of a block; a term comes as often as it stands there."""
    data = LOWER[data]
    starts, ends, counts = word_spans(data, offsets, OUTSIDE)
    prefix = _bytes.prefix(data)
    rows = row_of(counts)
    found = [(mix(_bytes.spans(prefix, starts, ends) + U64(1)), rows)]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts > size)
        found.append((mix(_bytes.spans(prefix, starts[long], starts[long] + size) + U64(size)), rows[long]))
    return np.concatenate([(h >> U64(40)).astype(np.int64) & (BUCKETS - 1) for h, _ in found]), np.concatenate([r for _, r in found])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1):
    """(weights, vectors, bias) by AdaGrad on the logistic loss; share: the positives' share among all labels."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(buckets, np.float32), np.zeros((buckets, dim), np.float32), 0.0
    if not rows:
        return w, v, bias
    seen = np.zeros(buckets, np.int64)
    for _, ids, _ in rows:
        seen[ids] += 1
    live = seen >= MIN_ROWS
    v[live] = rng.normal(0, 0.003, (int(live.sum()), dim))
    gw, gv, gb = np.full(buckets, 1e-2, np.float32), np.full((buckets, dim), 1e-2, np.float32), 1e-2
    data = [(label, ids[live[ids]]) for label, ids, _ in rows]
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            label, ids = data[i]
            x = v[ids]
            total = x.sum(0)
            z = bias + w[ids].sum() + 0.5 * float(total @ total - (x * x).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            gw[ids] += g * g
            w[ids] -= rate * g / np.sqrt(gw[ids])
            d = g * (total - x) + 1e-4 * x
            gv[ids] += d * d
            v[ids] = x - rate * 0.3 * d / np.sqrt(gv[ids])
        w = np.sign(w) * np.maximum(0, np.abs(w) - SHRINK)
        v = np.sign(v) * np.maximum(0, np.abs(v) - SHRINK / 10)
        live = (w != 0) | (v != 0).any(1)  # what has shrunk to nothing stays so
        data = [(label, ids[live[ids]]) for label, ids in data]
    mine = np.clip(np.mean([label for label, _ in data]), 0.01, 0.99)
    share = np.clip(share, 0.001, 0.999)
    return w, v, float(bias + np.log(share / (1 - share)) - np.log(mine / (1 - mine)))


def score(docs: DataFrame, weights: np.ndarray, vectors: np.ndarray, bias: float, block: int = BLOCK) -> DataFrame:
    """(doc_id, score) of (doc_id, text) rows."""
    live = np.flatnonzero((weights != 0) | (vectors != 0).any(1))
    shared = docs.sparkSession.sparkContext.broadcast((len(weights), live, weights[live], vectors[live]))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        size, live, w, v = shared.value
        place = np.full(size, -1, dtype=np.int64)
        place[live] = np.arange(len(live))
        w, v = w.astype(np.float64), v.astype(np.float64)
        squares = (v * v).sum(1) if len(v) else np.zeros(0)
        for part, data, offsets in blocks(batches, most=block):
            ids, rows = terms(data, offsets)
            ids = place[ids]
            rows, ids = rows[ids >= 0], ids[ids >= 0]
            both = np.unique(rows * np.int64(size) + ids)
            rows, ids = both // size, both % size
            n = part.num_rows
            z = bias + np.bincount(rows, w[ids], n)
            if len(ids):
                z += 0.5 * (sum(np.bincount(rows, v[ids, f], n) ** 2 for f in range(v.shape[1])) - np.bincount(rows, squares[ids], n))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", held_out: int = 0, per_class: int = PER_CLASS):
    """Learn from labelled rows outside the held-out fold."""
    usable = fold(F.col("doc_id")) != held_out
    share = labels.where(usable & F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    model = train(collected(sampled(text_of(docs), labels, label_col, usable, per_class=per_class), terms), 0.5 if share is None else share)
    released()
    return model


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(text_of(docs), *fit(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
