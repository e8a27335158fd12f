"""Connected components of a link table.

Chunks of links are first reduced to forests, each in one task of bounded size; alternating large-star and small-star
contraction then joins the forests of all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links that one task reduces to a forest.
CHUNK = 1_000_000


def local_forests(links: DataFrame) -> DataFrame:
    """a, b: for the links of each partition, each node but the least of its tree with that least node."""

    def reduce(it):
        import pyarrow as pa

        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in it:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = [x for x in list(parent) if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])

    return links.mapInArrow(reduce, "a long, b long")


def _least(edges: DataFrame) -> DataFrame:
    """u, v, m: every edge with the least of u and its neighbours. Minima are summed before the shuffle; a hub's rows are only joined."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of the links (a, b); self links and nulls are ignored."""
    plain = links.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    plain = common.staged(plain, "links")
    chunks = -(-plain.count() // CHUNK)
    forest = local_forests(plain.repartition(max(1, chunks))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges, seen = common.staged(forest.distinct(), "links"), None
    for _ in range(rounds if chunks > 1 else 0):  # one chunk's forest is whole
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = _least(large)
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges = common.staged(small.filter("u > v").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    else:
        if chunks > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
