"""Connected components of a link table, by alternating large-star and small-star steps as Spark joins.

Each step replaces links by links to smaller neighbours; after a logarithmic number of steps every node hangs on the
smallest node of its component. Nothing is gathered on the driver but counts. A node with very many links (the centre of a
star) is never dealt out to one task: its one row is broadcast to its links instead (spread_join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import cut, spread_join


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of its component. Self-links and repeats are harmless."""
    e = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = spread_join(both, least, ["x"]).where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        inner = e.select(F.col("v").alias("u")).distinct().join(e.select("u").distinct(), "u", "left_semi")
        n, nodes = e.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and inner.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(n: int, left, right) -> list[int]:
    """Roots (smallest index) of n nodes under the pairs given by two index sequences; for the few nodes of one block."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left, right):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]
