"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct word shingles. Texts with equal sets are one class from the start,
numbered by a hash of the set's two digests; ids come in only at the end, so each text of an id is held against others on its own. Each class is sketched: a coordinate of the sketch is the least value any element puts there,
where in round i every element is thrown into one coordinate with a value between i and i + 1, and in the rounds
after ``SIZE`` the i-th coordinate gets all elements. So every coordinate fills, nearly always in the first few rounds,
and equal coordinates estimate the similarity with concentration bounds like those of independent hashes.

Bands of ``ROWS`` coordinates make buckets; at similarity 0.8 a pair misses all ``BANDS`` of them with a chance of 4e-8.
A bucket does not emit its pairs. Its hub (a class with most copies, the same one in as many buckets as possible) meets every
member. A bit sketch (one bit a coordinate) rules out pairs that are far below the threshold (6 standard deviations), the
others are verified on their full sets, and what is linked gets its component's label. A bucket whose members have one label
is done, as no further link could change anything. The others take as center the hub with most links that any of their members has
met, or rather the set that most members around it agree on, and still list no pairs: x and y differ in just as many shingles as their
differences from the center, X and Y, do, so they are linked only if X and Y overlap enough. Those differences are small where texts are alike, and what many texts share is not in them.
An exact prefix filter finds the pairs whose differences can overlap that much (the places of the shared shingle bound the overlap
as well), and these pairs are verified on their full sets. So no bucket is capped, no link is lost, and a large group of texts that
are alike but not linked does not meet itself. Components are formed over all links.

Defined results: texts without words (null, empty, blank) have an empty set and are linked with nothing; shorter texts
than a shingle have one; rows repeating id and text are one class; an id with several texts is one document a text, and each
may be in a component of its own; a null id is kept out of links and is its own component (null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, blocks, hashed_words, mix, scratch, stored, table, text_hash, text_of
from .components import merged, settled

BANDS, ROWS, BIT_WORDS = 56, 6, 6
SIZE = BANDS * ROWS
ODD = (U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0xD6E8FEB86659FD93))
EMPTY = U64(2**64 - 1)
_seeds = np.random.default_rng(5).integers(1, 1 << 63, 2 * SIZE).astype(U64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles, from its words' hashes."""
    if not len(words):
        return np.zeros(0, dtype=U64)
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, dtype=U64)
    for i in range(k):
        h = mix(h * ODD[i & 3] + words[i : i + n] + U64(i + 1))
    return np.unique(h if k == size else h + U64(k))


def sketch(elements: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty: the round in the top 10 bits of a coordinate, a hash below."""
    out, n, i = np.full(size, EMPTY, dtype=U64), len(elements), 0
    while i < size:
        rounds = max(1, min(size - i, 2048 // n))
        h = mix(elements[None, :] ^ _seeds[i : i + rounds, None])
        value = (h >> U64(10)) | (np.arange(i, i + rounds, dtype=U64) << U64(54))[:, None]
        place = ((h & U64(0xFFFFFFFF)) * U64(size)) >> U64(32)
        np.minimum.at(out, place.ravel().astype(np.int64), value.ravel())
        i += rounds
        if (out != EMPTY).all():
            return out
    for j in np.flatnonzero(out == EMPTY):
        out[j] = (mix(elements ^ _seeds[size + j]).min() >> U64(10)) | U64((size + int(j)) << 54)
    return out


_coordinate = np.arange(BANDS, dtype=U64) * ODD[0] + U64(1)


def bands(sketched: np.ndarray) -> np.ndarray:
    """A key for each band."""
    key = _coordinate.copy()
    for part in sketched.reshape(BANDS, ROWS).T:
        key = mix(key * ODD[1] + part)
    return key


def bits(sketched: np.ndarray) -> np.ndarray:
    """One bit of each coordinate, packed."""
    one = (mix(sketched + _coordinate.repeat(ROWS)) & U64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([one, np.zeros(64 * BIT_WORDS - SIZE, dtype=np.uint8)])).view("<i8")


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, s1, s2, bands, bits) of (doc_id, text, text_hash) rows; s1 and s2 digest the set, and are null if it is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        for part, data, offsets in blocks(batches, most=1 << 20):
            words, counts = hashed_words(data, offsets)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            n, s1, s2, keys, marks = [], [], [], [], []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                elements = shingles(words[i:j], size)
                n.append(len(elements))
                if not len(elements):
                    for x in (s1, s2, keys, marks):
                        x.append(None)
                    continue
                s1.append(int(mix(elements * ODD[0]).sum(dtype=U64).view(np.int64)))
                s2.append(int(mix(elements * ODD[1] + ODD[2]).sum(dtype=U64).view(np.int64)))
                own = sketch(elements)
                keys.append(bands(own).view(np.int64))
                marks.append(bits(own))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(x, t) for x, t in zip((n, s1, s2, keys, marks), schema.types[2:], strict=True))], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The (a, b) pairs whose sets have 100 * intersection >= threshold * union."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    rows = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        kept: dict = {}

        def sets(part, column):
            ids = part.column(part.schema.get_field_index(column)).to_pylist()
            text = part.column(part.schema.get_field_index("t" + column))
            out = []
            for i, x in enumerate(ids):
                if x not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    data = np.frombuffer(text[i].as_buffer(), dtype=np.uint8)
                    words, _ = hashed_words(data, np.array([0, len(data)]))
                    kept[x] = shingles(words, size)
                out.append(kept[x])
            return ids, out

        for whole, _, _ in blocks(batches, "ta"):
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                (a, left), (b, right) = sets(part, "a"), sets(part, "b")
                good = []
                for x, y in zip(left, right, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= threshold * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pa.array(good)), pa.array(b, pa.int64()).filter(pa.array(good))], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def differences(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """How each (hub, rep, c) row's set differs from its hub's: n (the set's size), more and less (the shingles that only it has, and that only the hub
    has), and whether the two are linked."""
    hubs = texts.select(F.col("rep").alias("hub"), F.col("text").alias("thub"))
    rows = pairs.join(texts.select("rep", F.col("text").alias("trep")).hint("merge"), "rep").join(hubs.hint("merge"), "hub").select("hub", "rep", "c", "thub", "trep")
    schema = pa.schema([("hub", pa.int64()), ("rep", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("linked", pa.bool_()), ("more", pa.list_(pa.int64())), ("less", pa.list_(pa.int64()))])

    def run(batches):
        last, own = None, None
        for part, data, offsets in blocks(batches, "trep", 1 << 20):
            out = []
            for i, (hub, rep, c) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)):
                if hub != last:
                    text = np.frombuffer(part.column(3)[i].as_buffer(), dtype=np.uint8)
                    last, own = hub, shingles(hashed_words(text, np.array([0, len(text)]))[0], size)
                text = data[offsets[i] : offsets[i + 1]]
                x = shingles(hashed_words(text, np.array([0, len(text)]))[0], size)
                more, less = np.setdiff1d(x, own, assume_unique=True), np.setdiff1d(own, x, assume_unique=True)
                linked = (100 + threshold) * (len(more) + len(less)) <= (100 - threshold) * (len(x) + len(own))
                out.append((hub, rep, c, len(x), linked, more.view(np.int64), less.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(run, "hub long, rep long, c long, n long, linked boolean, more array<long>, less array<long>")


def centered(parts: DataFrame, folder: str, threshold: int) -> DataFrame:
    """The differences again, from the set that most of a hub's members agree on: (hub, rep, c, n, a, e, least, star, star_c, front, cut, elements).

    Any set will do as a center. With a the size of a difference and e = (100 + threshold) * a - (100 - threshold) * n, two sets are linked if and only if
    the overlap of their differences is (e + e') / (2 * (100 + threshold)) at least. So those with e + least <= 0 are linked with the star,
    the member whose e is least; a probe (any other) needs an overlap with whatever it is linked with. ``front`` shingles of a probe's difference,
    in a fixed order, and ``cut`` shingles of its partner's must then have one in common; no linked sets are more unequal than the threshold."""
    both, off = 100 + threshold, 100 - threshold
    members = stored(parts.groupBy("hub").agg(F.count(F.lit(1)).alias("m")), folder, "hub-members")
    # the shingles that most of a hub's members have more, or less, than it, as two lists: no longer than the sets themselves are on average, twice.
    # Both sides go through one count, and come in one row a hub: of two joins by hub in a row, a large hub's task could not be split
    sides = [parts.select("hub", F.lit(c).alias("side"), F.explode(c).alias("x")) for c in ("more", "less")]
    counts = stored(sides[0].unionByName(sides[1]).groupBy("hub", "side", "x").agg(F.count(F.lit(1)).alias("k")), folder, "counts")
    most = stored(counts.join(members.hint("merge"), "hub").where("2 * k > m").select("hub", "side", "x"), folder, "most")
    turned = stored(most.groupBy("hub").agg(*(F.collect_list(F.when(F.col("side") == c, F.col("x"))).alias("most_" + c) for c in ("more", "less"))), folder, "turned")
    none = F.array().cast("array<long>")
    rows = parts.join(turned.hint("merge"), "hub", "left").withColumns({c: F.coalesce(c, none) for c in ("most_more", "most_less")})
    apart = lambda c, other: F.array_sort(F.concat(F.array_except(c, "most_" + c), F.array_except("most_" + other, other)))
    rows = rows.select("hub", "rep", "c", "n", F.concat(apart("more", "less"), apart("less", "more")).alias("elements"))
    rows = rows.withColumn("a", F.size("elements").cast("long")).withColumn("e", both * F.col("a") - off * F.col("n"))
    rows = stored(rows, folder, "centered")
    stars = rows.groupBy("hub").agg(F.min(F.struct("e", "rep", "c")).alias("s")).select("hub", F.col("s.e").alias("least"), F.col("s.rep").alias("star"), F.col("s.c").alias("star_c"))
    rows = rows.join(stored(stars, folder, "stars").hint("merge"), "hub")
    front = F.col("a") - F.greatest(F.lit(1), F.col("a") - F.floor(off * F.col("n") / threshold)) + 1
    rows = rows.withColumn("front", F.greatest(F.lit(0), front))
    cut = F.col("a") - F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("least")) / (2 * both))) + 1
    return rows.withColumn("cut", F.greatest(F.lit(0), F.least("front", cut)))


def possible(rows: DataFrame, threshold: int) -> DataFrame:
    """The (a, b) pairs of different labels whose differences from a center may overlap enough for a link."""
    probe = (F.col("e") + F.col("least") > 0) & (F.col("c") != F.col("star_c"))
    kept = F.slice("elements", 1, F.when(probe, F.col("front")).otherwise(F.col("cut")).cast("int"))
    entries = rows.select("hub", "rep", "c", "a", "e", "cut", probe.alias("probe"), F.posexplode(kept).alias("place", "element"))
    x = entries.where("probe").select("hub", "element", *(F.col(k).alias("x" + k) for k in ("rep", "c", "a", "e", "place")))
    y = entries.where("place < cut").select("hub", "element", *(F.col(k).alias("y" + k) for k in ("rep", "c", "a", "e", "place")))
    most = 2 * (100 + threshold) * F.least(F.col("xa") - F.col("xplace"), F.col("ya") - F.col("yplace"))
    pairs = x.join(y.hint("merge"), ["hub", "element"]).where((F.col("xc") != F.col("yc")) & (most >= F.col("xe") + F.col("ye")))
    return pairs.select(F.least("xrep", "yrep").alias("a"), F.greatest("xrep", "yrep").alias("b")).distinct()


def unlike(one: str, other: str) -> Column:
    """How many of the coordinates' bits differ."""
    return F.expr(" + ".join(f"bit_count({one}[{i}] ^ {other}[{i}])" for i in range(BIT_WORDS)))


def most_unlike(threshold: int) -> int:
    """Differing bits that a pair at the threshold exceeds with a chance below 1e-9 (6 standard deviations)."""
    p = (1 - threshold / 100) / 2
    return int(SIZE * p + 6 * (SIZE * p * (1 - p)) ** 0.5) + 1


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, threshold: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component (a number, null for rows that are kept out of links) and component_id (the smallest id
    reachable by links) of every row."""
    spark = docs.sparkSession
    folder = scratch(spark)
    docs = text_of(docs, id_col, text_col).withColumn("text_hash", text_hash(F.col("text")))
    rows = stored(sketched(docs, size), folder, "sketched")
    classes = rows.where("s1 is not null and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes.select("s1", "s2", F.xxhash64("s1", "s2").alias("rep"), "first.doc_id", "first.text_hash", "copies"), folder, "classes")
    known = rows.select("doc_id", "text_hash", "s1", "s2", "bands", "bits")
    reps = classes.hint("merge").join(known, ["doc_id", "text_hash", "s1", "s2"]).dropDuplicates(["doc_id", "text_hash", "s1", "s2"])
    reps = stored(reps.select("rep", "copies", "bands", "bits"), folder, "reps")
    # buckets with two classes or more, each with its hub
    members = reps.select("rep", "copies", F.explode("bands").alias("key"))
    hub = F.max(F.struct("copies", F.xxhash64("rep").alias("draw"), "rep"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), hub.alias("hub")).where("n > 1").select("key", "n", F.col("hub.rep").alias("hub"))
    buckets = stored(buckets, folder, "buckets")
    members = stored(reps.select("rep", F.explode("bands").alias("key")).join(buckets.hint("merge"), "key"), folder, "members")
    marks = reps.select("rep", "bits")
    hub_pairs = members.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    hub_pairs = (hub_pairs.join(marks.select(F.col("rep").alias("a"), F.col("bits").alias("ma")).hint("merge"), "a")
                 .join(marks.select(F.col("rep").alias("b"), F.col("bits").alias("mb")).hint("merge"), "b")
                 .where(unlike("ma", "mb") <= most_unlike(threshold)).select("a", "b"))
    hub_pairs = stored(hub_pairs, folder, "hub-pairs")
    wanted = classes.join(members.select("rep").distinct().hint("merge"), "rep", "left_semi").select("doc_id", "text_hash", "rep")
    texts = docs.join(wanted.hint("shuffle_hash"), ["doc_id", "text_hash"]).select("rep", "text")
    texts = stored(texts.groupBy("rep").agg(F.min("text").alias("text")), folder, "texts")
    links = stored(verified(hub_pairs, texts, size, threshold), folder, "links-hubs")
    near = merged(settled(links, folder), links, folder, "near")
    label = lambda df, column, name: df.join(near.select(F.col("vertex").alias(column), F.col("label").alias(name)).hint("merge"), column, "left").withColumn(name, F.coalesce(name, column))
    # buckets whose members are not in one component yet, each with the best linked of the hubs that its members have met
    at = stored(label(members.where("n > 2 and rep <> hub").select("key", "rep", "hub"), "rep", "c"), folder, "labelled")
    open_keys = stored(at.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most").select("key"), folder, "open")
    at = stored(at.join(open_keys.hint("merge"), "key"), folder, "open-members")
    degree = links.select(F.col("a").alias("hub")).unionByName(links.select(F.col("b").alias("hub"))).groupBy("hub").agg(F.count(F.lit(1)).alias("degree"))
    met = at.select("rep", "hub").distinct().join(degree.hint("merge"), "hub", "left").select("rep", F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "hub").alias("center"))
    met = stored(met.groupBy("rep").agg(F.max("center").alias("center")), folder, "met")
    centers = at.select("key", "rep").join(met.hint("merge"), "rep").groupBy("key").agg(F.max("center").alias("center")).select("key", F.col("center.hub").alias("hub"))
    around = at.select("key", "rep", "c").join(stored(centers, folder, "centers").hint("merge"), "key")
    around = stored(around.where("rep <> hub").select("hub", "rep", "c").distinct(), folder, "around")
    parts = stored(differences(around, texts, size, threshold), folder, "differences")
    rows_apart = stored(centered(parts, folder, threshold), folder, "apart")
    rest = stored(possible(rows_apart, threshold), folder, "rest")
    links = verified(rest, texts, size, threshold).unionByName(parts.where("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    links = links.unionByName(rows_apart.where("e + least <= 0 and rep <> star").select(F.col("star").alias("a"), F.col("rep").alias("b")))
    found = merged(near, stored(links, folder, "links-rest"), folder, "found").select("vertex", F.col("label").alias("component"))
    # a class is in its number's component, which has the smallest id of all its classes, and a row is its class's
    placed = stored(classes.join(found.hint("merge"), F.col("rep") == F.col("vertex"), "left").select("s1", "s2", "doc_id", F.coalesce("component", "rep").alias("component")), folder, "placed")
    named = stored(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")), folder, "named")
    placed = stored(placed.join(named.hint("merge"), "component").select("s1", "s2", "component", "component_id"), folder, "placed-named")
    linked = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(placed.hint("merge"), ["s1", "s2"], "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(linked, F.col("component")).alias("component"), F.when(linked, F.coalesce("component_id", "doc_id")).alias("component_id"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
