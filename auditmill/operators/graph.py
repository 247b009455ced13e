"""Graph operators on edge tables: connected components and breadth-first depth."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of all ids in ``edges``; the component is its smallest id.

    Alternating large-star and small-star steps: the number of rounds grows with
    the logarithm of the longest path. Smallest neighbours are found by
    aggregation, so a node with a third of all edges is combined on the map side.
    """
    now = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").distinct())
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.filter("x <> y")
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y")))
        then = cut(small.filter("x <> y").distinct())
        changed = not then.exceptAll(now).isEmpty() or not now.exceptAll(then).isEmpty()
        now = then
        if not changed:
            break
    roots = now.select("y").distinct().select(F.col("y").alias("id"), F.col("y").alias("component"))
    return now.select(F.col("x").alias("id"), F.col("y").alias("component")).unionByName(roots).distinct()


def crawl_depth(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, depth) of all nodes reached from ``starts`` (id) over ``edges`` (source_id, target_id).

    Runs until no new node is met. Rounds are merged two by two as they grow
    old, so there are as many tables as the logarithm of the depth and every
    row is written again as often.
    """
    e = cut(edges.select("source_id", "target_id").distinct())
    front = cut(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    parts = [(1, front)]
    for d in count(1):
        seen = reduce(DataFrame.unionByName, [p for _, p in parts])
        reached = front.join(e, front.id == e.source_id).select(F.col("target_id").alias("id")).distinct()
        front = cut(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            return seen
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (n, new), (_, old) = parts.pop(), parts.pop()
            parts.append((2 * n, cut(old.unionByName(new), old, new)))
        parts.append((1, front))
