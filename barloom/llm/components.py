"""Connected components of an edge table: alternating large-star and small-star steps, a forest on the driver for few edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch


def forest(edges: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node of the edges reaches."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        above[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(above)}


def connected_components(work: Scratch, edges: DataFrame, name: str, max_rounds: int = 60, few: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) reaches.

    Up to ``few`` counted edges go to the driver, beyond that none does.

    Each round writes its edges, so a lost executor never restarts the iteration. Every step deals out edges by a
    node; the large star of a node is a minimum, formed before the shuffle, written and joined back, so a hub does not
    gather its neighbours and the join can deal a hub's edges to several tasks.
    """
    now = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    if now.count() <= few:
        found = forest([(r["a"], r["b"]) for r in now.collect()])
        work.drop(f"{name}-0")
        return work.spark.createDataFrame(list(found.items()), "node long, component long")
    done = None
    for k in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = work.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-low-{k}")
        # large star: larger neighbours of a node point at the least node around it
        large = now.join(low.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).where("a <> b")
        large = large.unionByName(low.where("a <> m").select("a", F.col("m").alias("b"))).distinct()
        # small star: a node and its smaller neighbours point at the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = work.save(least.select("a", F.col("m").alias("b")).unionByName(small).distinct(), f"{name}-{k}")
        # finished when each node has one smaller neighbour, and that has none
        state = then.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        work.drop(f"{name}-{k - 1}", f"{name}-low-{k}")
        if done == tuple(state):
            return then.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(then.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        done, now = tuple(state), then
    raise RuntimeError(f"components still change after {max_rounds} rounds")
