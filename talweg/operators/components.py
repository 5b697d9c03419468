"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins whose hot keys AQE can split; the number of rounds
grows with the logarithm of the longest path.  Edges are written to the shared folder between
rounds, so lost executors repeat one round at most.  Up to ``ONE_TASK`` edges, a bound that is
checked, one task joins them instead: the result is the same and the rounds' overhead is saved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.storage import stored

MAX_ROUNDS = 60
ONE_TASK = 200_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of one task; the smaller root wins."""
    parent: dict = {}
    kind = None

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            x, y = root(u), root(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    for at in range(0, len(nodes), 20_000):
        part = nodes[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["node", "component"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every end of an edge; the component is its smallest node.

    Null ends are left out; an edge from a node to itself makes it a component of one.
    """
    raw = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = stored(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if e.count() <= ONE_TASK:
        kind = e.schema["u"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
    loops, e = e.where("u = v").select("u"), e.where("u <> v")
    mark = _mark(e)
    for _ in range(MAX_ROUNDS):
        e = stored(_small_star(_large_star(e)), "cc")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    known = labels.unionByName(roots)
    return known.unionByName(alone.join(known, "node", "left_anti"))
