"""Connected components of an edge list by alternating star contractions.

Each round points every vertex's neighbours at the smallest one (first those above it, then those below), which takes
a logarithmic number of rounds. Rounds are cut by tables in the shared folder. Nothing is collected but a row count and
a checksum a round; a vertex with many edges meets a map-side partial minimum and a splittable join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, stored


def _star(edges: DataFrame, large: bool, folder: str, name: str) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.where("v > u")
    else:
        least = both.where("v < u").groupBy("u").agg(F.min("v").alias("m"))
        moved = both.where("v < u")
    least = stored(least, folder, name + "-least")
    joined = moved.join(least.hint("merge"), "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return stored(out.where("u <> v").distinct(), folder, name)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(vertex, component) for every vertex of the (a, b) edges; a component is named by its smallest vertex."""
    spark = edges.sparkSession
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "edges-0")
    mark, n, old = None, 0, None
    while True:
        n += 1
        step = _star(_star(now, True, folder, f"edges-{n}-large"), False, folder, f"edges-{n}-small")
        seen = step.agg(F.count(F.lit(1)).alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))").alias("s")).first()
        if old:
            drop_path(spark, old)
        old = f"{folder}/edges-{n}-large"
        if mark == seen:
            break
        now, mark = step, seen
    stars = step.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("vertex"), "component").distinct())


def settled(links: DataFrame, folder: str, rounds: int = 3) -> DataFrame:
    """(vertex, label) after a few rounds in which each vertex takes the smallest label around it. Vertices with one label are connected;
    the reverse need not hold, so edges between labels are left to ``components``."""
    both = stored(links.select(F.col("a").alias("vertex"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("vertex"), F.col("a").alias("other"))), folder, "both")
    now = both.groupBy("vertex").agg(F.least(F.min("other"), F.col("vertex")).alias("label"))
    for i in range(1, rounds):
        now = stored(now, folder, f"labels-{i}")
        now = both.join(now.withColumnRenamed("vertex", "other").hint("merge"), "other").groupBy("vertex").agg(F.min("label").alias("label"))
    return stored(now, folder, "labels")


def merged(near: DataFrame, links: DataFrame, folder: str, name: str) -> DataFrame:
    """(vertex, label) of ``near`` after the links (a, b) have joined labels; a vertex that near lacks is its own label."""
    label = lambda df, column, name: df.join(near.select(F.col("vertex").alias(column), F.col("label").alias(name)).hint("merge"), column, "left").withColumn(name, F.coalesce(name, column))
    between = label(label(links, "a", "ca"), "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    between = stored(between, folder, f"between-{name}")
    if between.isEmpty():
        return near
    into = stored(components(between, f"{folder}/merging-{name}").select(F.col("vertex").alias("label"), F.col("component").alias("into")), folder, f"merged-{name}")
    alone = into.join(near.select(F.col("vertex").alias("label")).hint("merge"), "label", "left_anti").select(F.col("label").alias("vertex"), F.col("into").alias("label"))
    out = near.join(into.hint("merge"), "label", "left").select("vertex", F.coalesce("into", "label").alias("label")).unionByName(alone)
    return stored(out, folder, f"labels-{name}")
