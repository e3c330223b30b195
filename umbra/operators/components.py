"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.shared import stash

#: Rows of one key from which they are joined by broadcast instead of a shuffle.
HUB = 1 << 17


def _with_least(rows: DataFrame, least: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` (``n`` of them) with m of ``least`` (node, m) by ``key``, null where there is none.

    Keys of more than ``HUB`` rows, at most one in so many rows, take their m from a broadcast, so none gathers its rows in one task.
    """
    plain = lambda some: some.join(least, F.col(key) == F.col("node"), "left").drop("node")
    if n <= HUB:
        return plain(rows)
    hubs = stash(rows.groupBy(F.col(key).alias("hub")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HUB).select("hub"), "components-hubs", n)
    if hubs.isEmpty():
        return plain(rows)
    known = stash(hubs.join(least, F.col("hub") == F.col("node"), "left").select("hub", "m"), "components-hubs", n)
    light = rows.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left_anti")
    return plain(light).unionByName(rows.join(F.broadcast(known), F.col(key) == F.col("hub")).drop("hub"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node of the component, for every node of an edge.

    Each round first links a node's larger neighbours to its smallest one (large star), then its smaller
    neighbours (small star); the edges become one star per component after about log(n) rounds. Pairs are kept once, the larger node first, so the
    large star only puts a smaller node's least neighbour in its place. Every step is a grouped minimum (combined inside map tasks) and an equi-join in which
    hubs stay in pieces. Only counts reach the driver. Null ends and loops are ignored. Raises if ``most_rounds``
    rounds don't settle it.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    nodes_alone = edges.where(F.col(src) == F.col(dst)).select(F.col(src).alias("node"))
    pairs = stash(pairs.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "components")
    least_of = lambda rows: rows.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    for _ in range(most_rounds):
        n = pairs.count()
        large = _with_least(pairs, least_of(pairs), "v", n).select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        large = stash(large, "components-large", n)
        least = stash(least_of(large), "components-least", n)
        if least.count() == n and large.where("moved").isEmpty():
            break
        others = _with_least(large.select("u", "v"), least, "u", n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stash(least.select(F.col("node").alias("u"), F.col("m").alias("v")).union(others).distinct(), "components", n)
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = nodes_alone.select("node", F.col("node").alias("component"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
