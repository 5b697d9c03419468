"""Component-safe splits, greedy two-key selection and bipartite matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.functions.keys import split_of, unit_hash
from talweg.operators.components import connected_components
from talweg.operators.validation import unpivoted
from talweg.storage import stored


def row_components(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, component): rows that share any value of a field, over any number of steps.

    Rows and ``field:value`` keys form a bipartite graph; a component is named by its least key,
    so blank fields link nothing and a row of blanks stands alone under its own id."""
    links = unpivoted(df, fields, [key]).select(F.concat(F.lit("row:"), F.col(key)).alias("a"), F.concat("field", F.lit(":"), "value").alias("b"))
    parts = stored(connected_components(links), "row-components")
    # the least name among field:value keys, which is what names the component
    least = parts.where("node NOT LIKE 'row:%'").groupBy("component").agg(F.min("node").alias("name"))
    rows = parts.where("node LIKE 'row:%'").join(least, "component").select(F.expr("substr(node, 5)").alias("_k"), "name")
    out = df.select(F.col(key), F.col(key).alias("_k")).join(rows, "_k", "left")
    return out.select(key, F.coalesce("name", F.concat(F.lit("row:"), F.col(key))).alias("component"))


def assigned_splits(df: DataFrame, key: str, fields: Sequence[str], seed: str, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """(key, component, split): whole components by the hash of their least key; ood rows keep theirs."""
    free = df.where("split IS NULL OR split <> 'ood'")
    parts = row_components(free, key, fields)
    out = parts.withColumn("split", split_of(unit_hash(seed, F.col("component")), train, dev))
    ood = df.where("split = 'ood'").select(key, F.lit(None).cast("string").alias("component"), F.lit("ood").alias("split"))
    return out.unionByName(ood)


def ood_leaks(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value) that an ood row shares with another row."""
    keys = unpivoted(df, fields, ["split"])
    ood = keys.where("split = 'ood'").select("field", "value").distinct()
    return keys.where("split <> 'ood'").select("field", "value").distinct().join(ood, ["field", "value"], "left_semi")


def greedy_distinct(df: DataFrame, rank: str, first: str, second: str, target: int) -> DataFrame:
    """Rows in rank order such that no ``first`` and no ``second`` value repeats, ``target`` at most.

    Same result as the one-by-one loop: a row that is the least of both its keys is always taken,
    and whatever shares a key with it is not; the rest is looked at again.  Every round takes at
    least the least row that is left, so it ends; with ranks by hash the rounds are few.  Once enough
    rows are taken, only ranks below the last of them are looked at further."""
    rest = stored(df.select(rank, first, second), "greedy-rest")
    taken = None
    while True:
        a = rest.groupBy(first).agg(F.min(rank).alias("_a"))
        b = rest.groupBy(second).agg(F.min(rank).alias("_b"))
        now = rest.join(a, first).join(b, second).where((F.col(rank) == F.col("_a")) & (F.col(rank) == F.col("_b"))).select(rank, first, second)
        now = stored(now, "greedy-now")
        if now.isEmpty():
            break
        taken = now if taken is None else stored(taken.union(now), "greedy-taken")
        last = taken.orderBy(rank).limit(target).agg(F.count("*").alias("n"), F.max(rank).alias("k")).first()
        rest = rest.join(now.select(first), first, "left_anti").join(now.select(second), second, "left_anti").select(rank, first, second)
        rest = stored(rest.where(F.col(rank) < F.lit(last.k)) if last.n >= target else rest, "greedy-rest")
    if taken is None:
        return df.limit(0)
    return df.join(taken.orderBy(rank).limit(target).select(rank), rank, "left_semi")


# ---- maximum matching --------------------------------------------------------------------------------


def _greedy_pairs(edges: DataFrame, rounds: int) -> DataFrame:
    """A matching to begin with: every free left asks one right, every asked right takes one."""
    pairs = edges.select("l", "r").limit(0)
    free = edges
    for i in range(rounds):
        asked = free.groupBy("l").agg(F.min(F.struct(F.xxhash64("r", F.lit(i)).alias("h"), "r")).alias("x")).select("l", "x.r")
        now = stored(asked.groupBy("r").agg(F.min(F.struct(F.xxhash64("l").alias("h"), "l")).alias("x")).select("x.l", "r"), "match-now")
        if now.isEmpty():
            break
        pairs = stored(pairs.unionByName(now), "match-pairs")
        free = stored(free.join(now.select("l"), "l", "left_anti").join(now.select("r"), "r", "left_anti"), "match-free")
    return pairs


def _search(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(ends, layers, lefts): alternating layers from all free lefts up to the first with a free right.

    Every right is reached from one left of one root, so paths of different roots do not meet; ``ends``
    has one free right a root, and is empty where the pairs are as many as can be.  ``lefts`` are all that
    were reached.
    """
    front = stored(edges.select("l").distinct().join(pairs, "l", "left_anti").select("l", F.col("l").alias("root")), "match-front")
    lefts, layers, seen = front.select("l"), [], None
    while True:
        reach = front.join(edges, "l")
        if seen is not None:
            reach = reach.join(seen, "r", "left_anti")
        layer = reach.groupBy("r").agg(F.min(F.struct(F.xxhash64("r", "root").alias("h"), "root", "l")).alias("x")).select("r", "x.root", "x.l")
        layer = stored(layer, "match-layer")
        layers.append(layer)
        ends = stored(layer.join(pairs.select("r"), "r", "left_anti").groupBy("root").agg(F.min("r").alias("r")), "match-ends")
        if not ends.isEmpty() or layer.isEmpty():
            return ends, layers, lefts
        seen = layer.select("r") if seen is None else stored(seen.unionByName(layer.select("r")), "match-seen")
        front = stored(layer.select("r", "root").join(pairs, "r").select("l", "root"), "match-front")
        lefts = lefts.unionByName(front.select("l"))


def _augmented(pairs: DataFrame, ends: DataFrame, layers: list[DataFrame]) -> DataFrame:
    """The pairs after every path has been turned over, from its end back to its root."""
    at, turned = ends, None
    for layer in reversed(layers):
        new = stored(at.join(layer, ["r", "root"]).select("l", "r", "root"), "match-turned")
        turned = new if turned is None else turned.unionByName(new)
        at = new.select("l", "root").join(pairs, "l").select("r", "root")
    turned = stored(turned.select("l", "r"), "match-paths")
    return stored(pairs.join(turned.select("l"), "l", "left_anti").unionByName(turned), "match-pairs")


def matched(edges: DataFrame, left: str, right: str, greedy_rounds: int = 4) -> DataFrame:
    """(left, right) of a maximum matching of the graph of ``edges``.

    Pairs found greedily are augmented in phases, each along disjoint shortest paths from all free lefts
    at once; every step is a join, so one giant component is as good as many.  Rows with a null on either
    side are no edges, repeated edges are one, an empty table has an empty matching.
    """
    e = edges.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l IS NOT NULL AND r IS NOT NULL").distinct()
    e = stored(e, "match-edges")
    pairs = _greedy_pairs(e, greedy_rounds)
    while True:
        ends, layers, _ = _search(e, pairs)
        if ends.isEmpty():
            return pairs.select(F.col("l").alias(left), F.col("r").alias(right))
        pairs = _augmented(pairs, ends, layers)


def vertex_cover(edges: DataFrame, pairs: DataFrame, left: str, right: str) -> tuple[DataFrame, DataFrame]:
    """(lefts, rights) that touch every edge, as many together as ``pairs`` if those are a maximum matching.

    By alternating search: lefts it does not reach, and rights it does.  So it proves that no larger
    matching exists.
    """
    e = stored(edges.select(F.col(left).alias("l"), F.col(right).alias("r")).where("l IS NOT NULL AND r IS NOT NULL").distinct(), "cover-edges")
    p = pairs.select(F.col(left).alias("l"), F.col(right).alias("r"))
    _, layers, reached = _search(e, p)
    lefts = e.select("l").distinct().join(reached.distinct(), "l", "left_anti").select(F.col("l").alias(left))
    rights = layers[0].select("r")
    for layer in layers[1:]:
        rights = rights.unionByName(layer.select("r"))
    return lefts, rights.distinct().select(F.col("r").alias(right))
