"""Language-model scoring with a probabilistic suffix tree over words.

Training, over all texts of the training rows:
1. Every token is counted (``counts``: one row a word, summed by shuffle). Words are 64-bit hashes, 0 is a text's end.
2. Texts are passed once more for each level of the tree, and word sequences (a context and its follower) are counted by shuffle.
   Sequences that stand ``LEAST`` times are kept, at every size of the corpus, so the tree grows with it. A sequence cannot stand
   more often than its parts, so only those whose parts passed the level before are counted; bitmaps of fixed size tell
   most of the others apart, and what they let through is too rare to be kept.
3. A context is retained if its followers' distribution diverges enough from that of its longest retained suffix: the
   gain in log likelihood must be ``GAIN`` nats at least and ``GAIN_A_TOKEN`` for each time the context stands.

A follower's probability is count / (count of context + PRIOR) plus the rest of the mass times its probability after the
longest retained suffix; the root is the smoothed distribution of single words. Probabilities of a context sum to one.

So the logarithm of a token's probability is that of the root, plus a back-off for each retained context before it, plus a gain for each
kept sequence of a retained context that ends with it. A text's score is a sum over its sequences, and those values stand in
a distributed table. Scoring walks each text: words with a share of ``WORD_SHARE`` of all tokens and sequences with one of ``PAIR_SHARE`` are
few whatever the corpus (1 / share at most, of each length), and are scored on the spot from a broadcast. The others are
joined by shuffle with the table, and summed by row.

A context has up to ``DEPTH`` words; the depth, ``LEAST``, ``PRIOR`` and the gains are parameters of the model, not of the corpus's size.

Defined results: null and empty texts are the end alone; repeated rows are scored each; without training rows N and V are 0
and scores are those of the smoothing; null ids are a fold of their own and train; other columns are ignored.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HELD, U64, Tally, blocks, drop_path, fold, hashed_words, mix, scratch, stored, table, text_of

WORD_SHARE, PAIR_SHARE = 2.0**-21, 2.0**-20
DEPTH, LEAST, PRIOR, GAIN, GAIN_A_TOKEN = 3, 4, 1.0, 8.0, 0.005
BLOCK = 1 << 20
BITMAP_BITS = 26
ODD = U64(0x9E3779B97F4A7C15)


class Lookup:
    """The place of 64-bit keys in an array, -1 for others; vectorised, with three tables that take each other's collisions."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(U64)
        bits = max(8, int(8 * len(keys)).bit_length())
        left = np.arange(len(keys))
        self.tables, self.bits = [], bits
        while len(left):
            slots = np.full(1 << bits, -1, dtype=np.int32)
            at = self._slot(self.keys[left], len(self.tables))
            slots[at] = left
            self.tables.append(slots)
            left = left[slots[at] != left]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return (mix(keys + U64(level * 0x9E3779B97F4A7C15 & 2**64 - 1)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U64, copy=False)
        out = np.full(len(keys), -1, dtype=np.int32)
        left = None
        for level, slots in enumerate(self.tables):
            own = keys if left is None else keys[left]
            found = slots[self._slot(own, level)]
            good = found >= 0
            good[good] = self.keys[found[good]] == own[good]
            if left is None:
                out[good] = found[good]
                left = np.flatnonzero(~good & (found >= 0))
            else:
                out[left[good]] = found[good]
                left = left[~good & (found >= 0)]
            if not len(left):
                break
        return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's tokens (each row's words, then 0), the row of each, and its place in the row."""
    words, counts = hashed_words(data, offsets)
    ends = np.cumsum(counts)
    out = np.insert(words, ends, U64(0))
    counts = counts + 1
    rows = np.repeat(np.arange(len(counts)), counts)
    return out, rows, np.arange(len(out)) - np.repeat(np.cumsum(counts) - counts, counts)


def counted(docs: DataFrame, keys_of) -> DataFrame:
    """(key, n) of the keys that ``keys_of(hashes, rows, places)`` gives for each block."""

    def run(batches):
        tally = Tally()
        for _, data, offsets in blocks(batches, most=BLOCK):
            yield from tally.add(keys_of(*tokens(data, offsets)))
        yield from tally.flush()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def join_of(context: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
    """The hash of a sequence of ``length`` tokens from those of its first and of its last length - 1 tokens."""
    return mix(context * ODD + mix(suffix + U64(length)))


def sequences(hashes: np.ndarray, places: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 to ``most``: at each token the hashes of the context before it, of the suffix and of the sequence that end with it,
    and whether the text has so many tokens there."""
    now = hashes
    for length in range(2, most + 1):
        before = np.concatenate([now[:1], now[:-1]])
        whole = join_of(before, now, length)
        yield before, now, whole, places >= length - 1
        now = whole


def bitmap(keys: DataFrame) -> np.ndarray:
    """Two bitmaps of 2**BITMAP_BITS bits, of the top and of the lowest bits of every key, put together in words of 64 bits."""
    out = np.zeros((2, 1 << BITMAP_BITS - 6), dtype=np.int64)
    for bits, slot in zip(out, (F.shiftrightunsigned("key", 64 - BITMAP_BITS), F.col("key").bitwiseAND((1 << BITMAP_BITS) - 1)), strict=True):
        words = keys.select(slot.alias("slot")).groupBy(F.shiftrightunsigned("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
        bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(U64)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), dtype=bool)
    for own, slot in zip(bits, (keys >> U64(64 - BITMAP_BITS), keys & U64((1 << BITMAP_BITS) - 1)), strict=True):
        found &= (own[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63)) & U64(1)).astype(bool)
    return found


class PairTally:
    """Counts of (context, suffix). Those that a block has more than once are held, up to a bound, and passed on when it is reached; see Tally.
    The others are mostly rare, and go on as they are, so a frequent sequence comes about once a task and a rare one costs no merging."""

    schema = pa.schema([("context", pa.int64()), ("suffix", pa.int64()), ("n", pa.int64())])

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, contexts: np.ndarray, suffixes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, first, n = keys[starts], order[starts], np.diff(np.append(starts, len(keys)))
        once = n == 1
        yield from self._batches(contexts[first[once]], suffixes[first[once]], n[once])
        held = ~once
        self.parts.append((keys[held], contexts[first[held]], suffixes[first[held]], n[held]))
        self.size += int(held.sum())
        if self.size > 2 * HELD:
            self._merge()
            if self.size > HELD:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            keys, contexts, suffixes, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
            self.parts = [(keys, contexts[first], suffixes[first], np.bincount(place, n).astype(np.int64))]
        self.size = sum(len(p[0]) for p in self.parts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for _, contexts, suffixes, n in self.parts:
            yield from self._batches(contexts, suffixes, n)
        self.parts, self.size = [], 0

    def _batches(self, contexts: np.ndarray, suffixes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(n), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(contexts[j].view(np.int64)), pa.array(suffixes[j].view(np.int64)), pa.array(n[j])], schema=self.schema)


def kept_sequences(docs: DataFrame, length: int, parts: np.ndarray) -> DataFrame:
    """(key, context, suffix, n) of the sequences that stand LEAST times; ``parts`` is the bitmap of those one shorter."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        tally, bits = PairTally(), shared.value
        for _, data, offsets in blocks(batches, most=BLOCK):
            hashes, _, places = tokens(data, offsets)
            *_, (before, now, whole, ok) = sequences(hashes, places, length)
            at = np.flatnonzero(ok)
            at = at[has(bits, before[at])]
            at = at[has(bits, now[at])]
            if len(at):
                yield from tally.add(whole[at], before[at], now[at])
        yield from tally.flush()

    def keyed(batches):
        for part in batches:
            context, suffix = (part.column(i).to_numpy(zero_copy_only=False).view(U64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(join_of(context, suffix, length).view(np.int64)), *part.columns], names=["key", *part.schema.names])

    # tallies are combined already, so counts are dealt out as they are and summed once
    found = docs.select("text").mapInArrow(run, "context long, suffix long, n long").repartition("context", "suffix")
    return found.groupBy("context", "suffix").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).mapInArrow(keyed, "key long, context long, suffix long, n long")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been stored; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def tested(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """The sequences with p, their followers' probabilities after the longest retained suffix, and of their contexts: how often (of), retained, back, and
    whether this is the row that stands for its context. ``shorter``: (key, n, p) of the sequences one token shorter. The join by context comes last, as
    the windows then need no other shuffle."""
    rows = pairs.join(shorter.select(F.col("key").alias("suffix"), F.col("p").alias("parent")).hint("merge"), "suffix").drop("suffix")
    rows = rows.join(shorter.select(F.col("key").alias("context"), F.col("n").alias("of")).hint("merge"), "context")
    followers = Window.partitionBy("context")
    rows = rows.withColumn("rest", F.col("of") - F.sum("n").over(followers)).withColumn("back", (F.col("rest") + PRIOR) / (F.col("of") + PRIOR))
    rows = rows.withColumn("mixed", F.col("n") / (F.col("of") + PRIOR) + F.col("back") * F.col("parent"))
    rows = rows.withColumn("gain", F.sum(F.col("n") * F.log(F.col("mixed") / F.col("parent"))).over(followers) + F.col("rest") * F.log("back"))
    rows = rows.withColumn("stands", F.col("key") == F.min("key").over(followers))
    rows = rows.withColumn("retained", (F.col("gain") >= GAIN) & (F.col("gain") >= GAIN_A_TOKEN * F.col("of")))
    return rows.select("key", "context", "n", "of", "retained", "back", F.when(F.col("retained"), F.col("mixed")).otherwise(F.col("parent")).alias("p"), "parent", "stands")


class Tree:
    """What is broadcast: the commonest words with their numbers, the commonest sequences' values, and a bitmap of the other sequences that have one."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        self.total, self.distinct, self.depth = total, distinct, 0
        order = np.argsort(words.view(U64))
        self.words, self.counts = words.view(U64)[order], counts[order]
        self.root = (self.counts + 0.5) / (total + 0.5 * (distinct + 1))
        self.find = Lookup(self.words)
        # of contexts of one numbered word: the word, whether it is retained, its back-off
        self.node_words: list[list[tuple[int, ...]]] = []
        self.retained: list[np.ndarray] = []
        self.back_off: list[np.ndarray] = []
        self.tail = np.zeros((2, 1 << BITMAP_BITS - 6), dtype=U64)
        self.put(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))

    def put(self, keys: np.ndarray, gains: np.ndarray, backs: np.ndarray) -> None:
        """The values of the commonest sequences: as a context's follower, and as a context of the next token."""
        self.quick = Lookup(keys.view(U64))
        self.gains, self.backs = np.append(gains, 0.0), np.append(backs, 0.0)  # place -1 is the last: no value

    def walk(self, hashes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """log10 of the root's and of the tree's probability of each token, as far as this object has them, and (keys, places) of the sequences that
        the distributed table may have. Words without a number have no root here."""
        base = np.log10(np.where(ids >= 0, self.root[np.maximum(ids, 0)], 1.0)) if len(self.root) else np.zeros(len(ids))
        full, rest, inside = base.copy(), [], places[1:] > 0
        if not self.depth:
            return base, full, rest

        def add(at, found):
            full[at] += self.gains[found]
            back = np.zeros(len(full))
            back[at] = self.backs[found]
            full[1:] += np.where(inside, back[:-1], 0.0)

        at = np.flatnonzero(ids >= 0)
        add(at, self.quick(hashes[at]))
        for _, _, whole, ok in sequences(hashes, places, self.depth + 1):
            at = np.flatnonzero(ok)
            found = self.quick(whole[at])
            add(at, found)
            at = at[found < 0]
            at = at[has(self.tail, whole[at])]
            rest.append((whole[at], at))
        return base, full, rest

    def log10(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``walk`` of numbered words (-1: none), without the distributed table."""
        return self.walk(np.where(ids >= 0, self.words[np.maximum(ids, 0)], U64(2**64 - 1)), ids, places)[:2]


def fit(docs: DataFrame, folder: str, depth: int = DEPTH) -> tuple[Tree, DataFrame]:
    """The broadcast part of (text) rows' tree, and the stored table of all words' counts and all sequences' values: (key, n, value).
    n is null for what is not a word."""
    counts = stored(counted(docs, lambda hashes, rows, places: hashes), folder, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = {length: max(1, total * (WORD_SHARE if length == 1 else PAIR_SHARE)) for length in range(1, depth + 2)}
    frequent = counts.where(F.col("n") >= least[1]).toArrow()
    spark = docs.sparkSession
    tree = Tree(frequent["key"].to_numpy(), frequent["n"].to_numpy(), total, distinct)
    shorter = counts.where(F.col("n") >= LEAST).select("key", "n", ((F.col("n") + 0.5) / F.lit(total + 0.5 * (distinct + 1))).alias("p"))
    values = []
    for length in range(2, depth + 2):
        if shorter.isEmpty():
            break
        pairs = stored(kept_sequences(docs, length, bitmap(shorter)), folder, f"pairs-{length}")
        release(spark)
        level = stored(tested(pairs, shorter), folder, f"level-{length}")
        drop_path(spark, f"{folder}/pairs-{length}")
        tree.depth = length - 1
        gain = F.log10("p") - F.log10("parent") - F.log10("back")
        contexts = level.where("stands").select("context", "of", "retained", "back")
        values.append(level.where("retained").select("key", F.lit(length).alias("length"), "n", gain.alias("gain"), F.lit(0.0).alias("back")))
        values.append(contexts.where("retained").select(F.col("context").alias("key"), F.lit(length - 1).alias("length"), F.col("of").alias("n"), F.lit(0.0).alias("gain"), F.log10("back").alias("back")))
        if length == 2:
            nodes = contexts.where(F.col("of") >= least[1]).toArrow()
            tree.node_words.append([(int(i),) for i in tree.find(nodes["context"].to_numpy().view(U64))])
            tree.retained.append(nodes["retained"].to_numpy())
            tree.back_off.append(nodes["back"].to_numpy())
        shorter = level.select("key", "n", "p")
    found = counts.select("key", F.col("n").alias("word_n"), F.lit(1).alias("length"), "n", F.lit(0.0).alias("gain"), F.lit(0.0).alias("back"))
    for more in values:
        found = found.unionByName(more.withColumn("word_n", F.lit(None).cast("long")))
    found = found.groupBy("key").agg(*(F.max(c).alias(c) for c in ("word_n", "length", "n")), *(F.sum(c).alias(c) for c in ("gain", "back")))
    found = stored(found, folder, "table")
    for name in ("counts", *(f"level-{length}" for length in range(2, depth + 2))):
        drop_path(spark, f"{folder}/{name}")
    release(spark)
    quick = F.col("n") >= F.when(F.col("length") == 1, least[1]).otherwise(least[2])
    common = found.where(quick & ((F.col("gain") != 0) | (F.col("back") != 0))).select("key", "gain", "back").toArrow()
    tree.put(common["key"].to_numpy(), common["gain"].to_numpy(), common["back"].to_numpy())
    tree.tail = bitmap(found.where(~quick & (F.col("length") > 1)))
    looked_up = found.where(~quick | F.col("word_n").isNotNull())
    return tree, looked_up.select("key", F.col("word_n").alias("n"), F.when(quick, 0.0).otherwise(F.col("gain") + F.col("back")).alias("value"))


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of (doc_id, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    # a row of its own for each text, and one for each of its words without a number (times is positive) or sequences that are not broadcast (negative)
    own_type = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("tree", pa.float64())])
    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("times", pa.int32()), ("own", own_type)])

    def run(batches):
        from pyspark import TaskContext

        tree, row = shared.value, TaskContext.get().partitionId() << 40
        for part, data, offsets in blocks(batches, most=BLOCK):
            hashes, rows, places = tokens(data, offsets)
            ids, n = tree.find(hashes), part.num_rows
            base, full, rest = tree.walk(hashes, ids, places)
            own = np.arange(row, row + n)
            texts = [part.column(0), *(pa.array(x) for x in (np.bincount(rows, minlength=n), np.bincount(rows[ids >= 0], minlength=n), np.bincount(rows, base, n), np.bincount(rows, full, n)))]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mix(own.astype(U64)).view(np.int64)), pa.array(np.zeros(n, dtype=np.int32)), pa.StructArray.from_arrays(texts, fields=list(own_type))], schema=schema)
            rare = np.flatnonzero(ids < 0)
            for sign, (keys, at) in [(1, (hashes[rare], rare)), *((-1, x) for x in rest)]:
                if len(keys):
                    of = rows[at]
                    # sorted by a hash of both; what shares one by chance is told apart, and merely stands in two rows
                    both = mix(keys + of.astype(U64) * ODD)
                    order = np.argsort(both)
                    key, of, both = keys[order], of[order], both[order]
                    first = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]) | (key[1:] != key[:-1]) | (of[1:] != of[:-1])]))
                    times = sign * np.diff(np.append(first, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array(of[first] + row), pa.array(key[first].view(np.int64)), pa.array(times.astype(np.int32)), pa.nulls(len(first), own_type)], schema=schema)
            row += n

    rows = docs.select("doc_id", "text").mapInArrow(run, "row long, key long, times int, own struct<doc_id: long, n_tokens: long, known: long, base: double, tree: double>")
    # texts' own rows have a key that spreads them, and what they meet is not looked at
    joined = rows.join(counts.hint("shuffle_hash"), "key", "left")
    count, rare, sequence = F.coalesce(F.col("n"), F.lit(0)), F.col("times") > 0, F.col("times") < 0
    log = F.when(rare, F.col("times") * F.log10((count + 0.5) / F.lit(tree.total + 0.5 * (tree.distinct + 1)))).otherwise(0.0)
    value = F.when(rare, F.col("times") * F.coalesce("value", F.lit(0.0))).when(sequence, -F.col("times") * F.coalesce("value", F.lit(0.0))).otherwise(0.0)
    known = F.when(rare & (count > 0), F.col("times")).otherwise(0) + F.coalesce("own.known", F.lit(0))
    return joined.groupBy("row").agg(
        F.max("own.doc_id").alias("doc_id"), F.max("own.n_tokens").alias("n_tokens"), F.sum(known).cast("long").alias("n_known"),
        F.sum(F.coalesce("own.base", F.lit(0.0)) + log).alias("base_score"), F.sum(F.coalesce("own.tree", F.lit(0.0)) + log + value).alias("score")).drop("row")


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_of(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    tree, counts = fit(docs.where(~held_out), scratch(spark))
    return score(docs, tree, counts).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
