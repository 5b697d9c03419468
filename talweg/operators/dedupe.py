"""Exact ownership, the decision cascade and closures over digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owners(df: DataFrame, digest: str, key: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``owner``: the first row of the digest in a frozen order."""
    first = df.groupBy(digest).agg(F.min(F.struct(*order, *([] if key in order else [key]))).alias("_m"))
    return df.join(first, digest).withColumn("owner", F.col(f"_m.{key}")).drop("_m")


def raw_eligibility(df: DataFrame, history: DataFrame, digest: str, key: str, order: Sequence[str], cell: str) -> DataFrame:
    """(key, state): historical_duplicate, conflicting_cell, pool_duplicate or eligible."""
    cells = df.groupBy(digest).agg(F.countDistinct(cell).alias("_cells"))
    known = history.select(digest).distinct().withColumn("_seen", F.lit(True))
    out = owners(df, digest, key, order).join(cells, digest).join(known, digest, "left")
    state = F.when(F.col("_seen"), "historical_duplicate").when(F.col("_cells") > 1, "conflicting_cell").when(F.col("owner") != F.col(key), "pool_duplicate").otherwise("eligible")
    return out.select(key, state.alias("state"))


def near_of_other_digests(near: DataFrame, df: DataFrame, *, key: str, digest: str) -> DataFrame:
    """(key, n_near) of matched pairs (candidate, reference) whose digests differ; references beyond ``df`` count."""
    digests = df.select(F.col(key).alias("reference"), F.col(digest).alias("_other"))
    hits = near.join(df.select(F.col(key).alias("candidate"), F.col(digest).alias("_own")), "candidate").join(digests, "reference", "left")
    return hits.where("_other IS NULL OR _own <> _other").groupBy(F.col("candidate").alias(key)).agg(F.count("*").alias("n_near"))


def decision(df: DataFrame, history_digests: DataFrame, n_near: DataFrame, *, key: str, digest: str, ready: Column, order: Sequence[str]) -> DataFrame:
    """(key, decision, n_near) in fixed order: not_ready, historical_exact, pool_exact, near_pending, eligible.

    ``n_near`` (key, n_near) counts near matches of other digests; owners are taken among ready rows."""
    known = history_digests.select(digest).distinct().withColumn("_seen", F.lit(True))
    good = owners(df.where(ready), digest, key, order).select(key, "owner")
    out = df.withColumn("_ready", ready).join(good, key, "left").join(known, digest, "left").join(n_near, key, "left")
    n = F.coalesce("n_near", F.lit(0))
    state = (
        F.when(~F.coalesce("_ready", F.lit(False)), "not_ready")
        .when(F.col("_seen"), "historical_exact")
        .when(F.col("owner") != F.col(key), "pool_exact")
        .when(n > 0, "near_pending")
        .otherwise("eligible")
    )
    return out.select(key, state.alias("decision"), n.cast("long").alias("n_near"))


def history_gaps(manifest: DataFrame, inventories: DataFrame, digest: str) -> DataFrame:
    """(digest, problem): manifest digests no inventory covers, or with conflicting fingerprints."""
    known = inventories.groupBy(digest).agg(F.countDistinct("fingerprint").alias("_n"))
    out = manifest.select(digest).distinct().join(known, digest, "left")
    problem = F.when(F.col("_n").isNull(), "uncovered").when(F.col("_n") > 1, "conflicting")
    return out.select(digest, problem.alias("problem")).where("problem IS NOT NULL")


def earliest(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    return df.withColumn("first", F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1)


def decision_inventory(decisions: DataFrame, assets: DataFrame, *, key: str, digest: str, history: DataFrame, near_history: DataFrame, near_pool: DataFrame) -> DataFrame:
    """Every asset with its decision and what it matched: n_historical_exact, n_pool_exact, n_historical_near, n_pool_near.

    ``history`` has the digests of former assets, the two others (key, n_near) counts; exact matches within
    the pool are the other assets of the same digest.
    """
    known = history.groupBy(digest).agg(F.count("*").alias("n_historical_exact"))
    same = assets.groupBy(digest).agg((F.count("*") - 1).alias("n_pool_exact"))
    out = assets.join(decisions.select(key, "decision"), key, "left").join(known, digest, "left").join(same, digest, "left")
    out = out.join(near_history.withColumnRenamed("n_near", "n_historical_near"), key, "left").join(near_pool.withColumnRenamed("n_near", "n_pool_near"), key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_historical_exact", "n_pool_exact", "n_historical_near", "n_pool_near")}
    return out.withColumns(zero)
