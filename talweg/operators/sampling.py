"""Deterministic sampling: hash ranks, strata, quotas, interleaving, assignment, covering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.functions.keys import rank_hex
from talweg.operators.prefix import numbered


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_stratum(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int | Column, name: str = "rank") -> DataFrame:
    """First n per stratum; a constant n is limited before the shuffle by the planner."""
    return ranked(df, by, order, name).where(F.col(name) <= n)


def shortages(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """(by..., n_rows) of strata that hold fewer than n rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") < n)


def first_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The least row of each key by ``order``; partial aggregation keeps one candidate per task."""
    rest = [c for c in df.columns if c not in order]
    least = df.groupBy(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]).agg(F.min(F.struct(*order, *rest)).alias("m"))
    return least.select(*[F.col(f"m.{c}").alias(c) for c in df.columns])


def bounded_quota(counts: DataFrame, by: str, stratum: str, n: str, total: Column, low: int, high: int) -> DataFrame:
    """(by, stratum, quota): everyone gets ``low``, then one more per round in the order of falling spare
    room, up to min(high, n), until ``total`` per ``by`` is reached."""
    room = F.least(F.lit(high), F.col(n)) - low
    base = counts.select(by, stratum, F.col(n).alias("n"), room.cast("int").alias("room"), total.alias("total"))
    all_ = Window.partitionBy(by)
    base = base.withColumn("rest", F.col("total") - F.lit(low) * F.count("*").over(all_))
    slots = base.where("room > 0").withColumn("level", F.explode(F.sequence(F.lit(1), F.col("room"))))
    order = Window.partitionBy(by).orderBy("level", F.desc("n"), stratum)
    kept = slots.withColumn("i", F.row_number().over(order)).where("i <= rest").groupBy(by, stratum).agg(F.count("*").alias("more"))
    return base.join(kept, [by, stratum], "left").select(by, stratum, (F.lit(low) + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))


def quota_faults(counts: DataFrame, by: str, n: str, total: Column, low: int, high: int) -> DataFrame:
    """(by, fault) where the minimum or the total cannot be reached."""
    g = counts.groupBy(by).agg(F.min(n).alias("least"), F.sum(F.least(F.lit(high), F.col(n))).alias("most"), F.count("*").alias("k"), F.max(total).alias("t"))
    fault = F.when(F.col("least") < low, "minimum").when(F.col("k") * low > F.col("t"), "total below minima").when(F.col("most") < F.col("t"), "too few rows")
    return g.select(by, fault.alias("fault")).where("fault IS NOT NULL")


def largest_remainder(counts: DataFrame, by: str, stratum: str, n: str, total: Column, low: int) -> DataFrame:
    """(by, stratum, quota): ``low`` each and the rest in proportion to spare rows, one pass of remainders."""
    w = Window.partitionBy(by)
    base = counts.select(by, stratum, F.col(n).alias("n"), total.alias("total"), (F.col(n) - low).cast("double").alias("spare"))
    base = base.withColumn("rest", (F.col("total") - F.lit(low) * F.count("*").over(w)).cast("double")).withColumn("all_spare", F.sum("spare").over(w))
    exact = F.when(F.col("all_spare") > 0, F.col("rest") * F.col("spare") / F.col("all_spare")).otherwise(F.lit(0.0))
    base = base.withColumn("exact", exact).withColumn("q0", F.lit(low) + F.least(F.col("spare"), F.floor("exact").cast("double")))
    base = base.withColumn("missing", F.col("total") - F.sum("q0").over(w))
    open_ = F.when(F.col("q0") < F.col("n"), 1).otherwise(0)
    order = w.orderBy(open_.desc(), (F.col("exact") - F.floor("exact")).desc(), stratum)
    more = F.when((F.row_number().over(order) <= F.col("missing")) & (open_ == 1), 1).otherwise(0)
    return base.select(by, stratum, (F.col("q0") + more).cast("long").alias("quota"))


def balanced_quota(categories: DataFrame, name: str, key: Column, total: int) -> DataFrame:
    """(name, quota): total // k each, the remainder to the first categories in hash order."""
    k = Window.partitionBy()
    order = Window.orderBy(key, name)
    size = F.count("*").over(k)
    return categories.select(name, (F.floor(F.lit(total) / size) + F.when(F.row_number().over(order) <= F.lit(total) % size, 1).otherwise(0)).cast("long").alias("quota"))


def interleaved(df: DataFrame, rank: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Rows in rounds: all first ranks in category order, then all second ones; only a bounded selection goes here."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(rank, *order)))


def quota_slots(quotas: DataFrame, name: str, quota: str, order: str) -> DataFrame:
    """(name, position): each route once per round while its quota lasts, in route order."""
    slots = quotas.where(F.col(quota) > 0).select(name, order, F.explode(F.sequence(F.lit(1).cast("long"), F.col(quota))).alias("slot"))
    return slots.select(name, F.row_number().over(Window.orderBy("slot", order, name)).alias("position"))


def round_robin(df: DataFrame, order: Sequence[Column | str], profiles: Sequence[str], by: Sequence[str] = (), name: str = "profile") -> DataFrame:
    """Profiles dealt in turn along an order, within each group of ``by``, whatever the size of a group."""
    names = F.array(*[F.lit(p) for p in profiles])
    out = numbered(df, by, order, "_i")
    return out.withColumn(name, F.element_at(names, ((F.col("_i") - 1) % len(profiles) + 1).cast("int"))).drop("_i")


def two_level_round_robin(df: DataFrame, order: Sequence[Column | str], families: dict[str, Sequence[str]], by: Sequence[str] = ()) -> DataFrame:
    """Family by index, then voice by index within the family.

    Families take turns, so row i of a group is number i // families of its family."""
    n = len(families)
    out = numbered(df, by, order, "_i").withColumn("_i", F.col("_i") - 1)
    out = out.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in families]), (F.col("_i") % n + 1).cast("int")))
    voice = F.lit(None).cast("string")
    for f, voices in families.items():
        names = F.array(*[F.lit(v) for v in voices])
        turn = F.floor(F.col("_i") / n) % len(voices) + 1
        voice = F.when(F.col("family") == f, F.element_at(names, turn.cast("int"))).otherwise(voice)
    return out.withColumn("voice", voice).drop("_i")


def target_reserve(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], target: int, reserve: int) -> DataFrame:
    """Contiguous rank per group and state target or reserve."""
    out = top_per_stratum(df, by, order, target + reserve)
    return out.withColumn("state", F.when(F.col("rank") <= target, "target").otherwise("reserve"))


def cover_then_fill(df: DataFrame, component: str, order: Sequence[str], n: int) -> DataFrame:
    """First the best row of each component, then by rank, n in all."""
    out = ranked(df, [component], order, "_i").withColumn("covers", F.col("_i") == 1)
    first = F.when(F.col("covers"), 0).otherwise(1)
    return out.orderBy(first, F.when(F.col("covers"), F.col(component)), *order).limit(n).drop("_i")


def balanced_batches(df: DataFrame, cell: Sequence[str], order: Sequence[Column | str], per_cell: int) -> DataFrame:
    """``batch`` numbers such that every full batch holds ``per_cell`` rows of each cell."""
    return numbered(df, cell, order, "_i").withColumn("batch", F.floor((F.col("_i") - 1) / per_cell).cast("long")).drop("_i")


def uneven_cells(df: DataFrame, cell: Sequence[str], per_cell: int) -> DataFrame:
    """(cell..., n_rows) of cells that are not of one size or not a whole number of batches; a balanced plan has none."""
    n = df.groupBy(*cell).agg(F.count("*").alias("n_rows"))
    least = n.agg(F.min("n_rows").alias("_least"), F.max("n_rows").alias("_most"))
    # one row of totals
    return n.join(F.broadcast(least), (F.col("_least") != F.col("_most")) | (F.col("n_rows") % per_cell != 0)).select(*cell, "n_rows")


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The first rule that holds, or null."""
    out = F.lit(None).cast("string")
    for cond, reason in reversed(rules):
        out = F.when(cond, reason).otherwise(out)
    return out


def balanced_slice(df: DataFrame, by: str, stratum: str, key: str, limit: int, low: int, seed: str) -> DataFrame:
    """``limit`` rows of each ``by``: quotas of its strata by largest remainder, then the first by hash of each.

    A first pass counts the strata, a second keeps the lowest hashes of each; ``by`` with fewer than
    ``limit`` rows or strata of fewer than ``low`` gives all or what there is (see ``slice_faults``).
    """
    counts = df.groupBy(by, stratum).agg(F.count("*").alias("n"))
    total = F.least(F.lit(limit), F.sum("n").over(Window.partitionBy(by)))
    counts = counts.withColumn("total", total).withColumn("low", F.lit(low))
    quota = largest_remainder(counts, by, stratum, "n", F.col("total"), low).withColumnRenamed("quota", "_quota")
    best = top_per_stratum(df, [by, stratum], [rank_hex(seed, F.col(key), sep=":"), key], limit, "_rank")
    return best.join(quota, [by, stratum]).where("_rank <= _quota").select(*df.columns)


def slice_faults(df: DataFrame, chosen: DataFrame, by: str, stratum: str, limit: int, low: int) -> DataFrame:
    """(by, fault): too few rows or too small a stratum in ``df``, or not ``limit`` rows in ``chosen``."""
    n = df.groupBy(by, stratum).agg(F.count("*").alias("n")).groupBy(by).agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count("*").alias("strata"))
    got = chosen.groupBy(by).agg(F.count("*").alias("got"))
    both = n.join(got, by, "left")
    tests = [(F.col("n") < limit, "too few rows"), (F.col("least") < low, "small stratum"), (F.col("strata") * low > limit, "minima above the limit"), (F.coalesce("got", F.lit(0)) != limit, "not the limit")]
    return both.select(by, F.explode(F.filter(F.array(*[F.when(c, m) for c, m in tests]), lambda x: x.isNotNull())).alias("fault"))
