"""Connected components of an edge table, in a few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


#: A node is a hub if it has so many edges, or more than one in so many of all edges: of the latter
#: there are no more than twice this number.
HUB, HUBS = 200, 1000


def _with_least(rows: DataFrame, edges: int) -> DataFrame:
    """rows(u, v) with m, the least v of each u. Rows of hubs stay where they are; the others, none of
    which has many, meet their least by a shuffle."""
    most = max(HUB, edges // HUBS)
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
    hubs, others = least.where(F.col("k") > most).drop("k"), least.where(F.col("k") <= most).drop("k")
    marked = rows.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("m is null").drop("m").join(others, "u")
    return marked.where("m is not null").unionByName(rest)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """edges(a, b) -> node, comp: each node of an edge with its component's least node.

    Alternates the large-star and the small-star step: every node's neighbours above it (then
    below it) are linked to its least neighbour. A star's centre may have a third of all nodes as
    neighbours: the minimum is combined before the shuffle, and what the centres' edges need comes to
    them by a broadcast of at most 2 HUBS rows (see _with_least). Rounds grow as the logarithm of a
    component's diameter.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    count = now.count()
    for _ in range(limit):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * count).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, count).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small, "edges")
        # Settled when the edges are stars around least nodes: same edges as before.
        a, b = (x.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first() for x in (now, new))
        drop_cut(now)
        now, count = new, b[0]
        if tuple(a) == tuple(b):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
