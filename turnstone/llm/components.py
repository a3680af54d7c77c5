"""Connected components of a large graph, without its links ever leaving the executors.

Alternating large-star and small-star rounds (Kiveris et al., 2014): each round
is two shuffles whose aggregates combine on the map side, and the number of
rounds grows with the logarithm of the graph.  The links of hubs are joined where
they are, by a broadcast of bounded size.  Each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def forest(links: DataFrame) -> DataFrame:
    """The same components with fewer links (a, b): each partition keeps a spanning forest of stars."""

    def contract(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(parent)]
        found = [(x, r) for x, r in found if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(contract, "a long, b long")


def stars(edges: DataFrame) -> bool:
    """Whether each node is either the leaf of one link (a) or a centre (b)."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 OR leaf + centre > 1").isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links a - b, longs; nodes without links, or linked with themselves only, don't appear."""
    edges = written(forest(links.where(F.col("a") != F.col("b"))).distinct())
    for _ in range(max_rounds):
        if stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each node's larger neighbours move to the smallest of its neighbours and itself
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = spread_join(both.where("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: each node's smaller neighbours and itself move to the smallest of them
        large = written(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, down, ["a"], "n").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        edges = written(small.where("a != b").distinct())
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
