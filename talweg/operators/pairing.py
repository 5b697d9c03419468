"""Exact pairs, reconciliation, review gates, reuse and multiset comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frozen_pairs(source: DataFrame, spoof: DataFrame, on: str, ranks: DataFrame, target: int, same: str = "text_hash") -> DataFrame:
    """(on, rank, source_id, spoof_id, same_hash) of the first ``target`` pairs in rank order."""
    a = source.select(on, F.col("sample_id").alias("source_id"), F.col(same).alias("_a"))
    b = spoof.select(on, F.col("sample_id").alias("spoof_id"), F.col(same).alias("_b"))
    pairs = a.join(b, on).join(ranks.select(on, "rank"), on)
    return pairs.select(on, "rank", "source_id", "spoof_id", (F.col("_a") == F.col("_b")).alias("same_hash")).orderBy("rank", on).limit(target)


def pair_groups(df: DataFrame, group: str, label: str, expected: Sequence[str], hashed: str | None = None) -> DataFrame:
    """(group, n_rows, labels, complete): complete if the labels are exactly the expected, once each, with one hash."""
    ok = (F.count("*") == len(expected)) & (F.array_sort(F.collect_set(label)) == F.array(*[F.lit(x) for x in sorted(expected)]))
    if hashed:
        ok = ok & (F.countDistinct(hashed) == 1)
    return df.groupBy(group).agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), ok.alias("complete"))


def reconciled(base: DataFrame, raw: DataFrame, ready: DataFrame, text_rejects: DataFrame, audio_rejects: DataFrame, key: str) -> DataFrame:
    """(key, state) where raw = base - text rejects and ready = raw - audio rejects are accounted for.

    state: ready, text_rejected, audio_rejected, or a fault (unaccounted, unexpected, rejected_but_present)."""
    flags = {"base": base, "raw": raw, "ready": ready, "tr": text_rejects, "ar": audio_rejects}
    rows = None
    for name, df in flags.items():
        part = df.select(key).distinct().select(key, F.lit(name).alias("where"))
        rows = part if rows is None else rows.unionByName(part)
    seen = rows.groupBy(key).agg(F.collect_set("where").alias("s"))
    has = {n: F.array_contains("s", n) for n in flags}
    state = (
        F.when(~has["base"], "unexpected")
        .when(has["tr"] & has["raw"] | has["ar"] & has["ready"], "rejected_but_present")
        .when(has["tr"], "text_rejected")
        .when(~has["raw"], "unaccounted")
        .when(has["ar"], "audio_rejected")
        .when(has["ready"], "ready")
        .otherwise("unaccounted")
    )
    return seen.select(key, state.alias("state"))


def reusable(rows: DataFrame, prior_raw: DataFrame, prior_ready: DataFrame, key: str, sha: str) -> DataFrame:
    """``rows`` with ``reuse``: prior output exists for the same id and the same raw digest."""
    raw = prior_raw.select(F.col(key).alias("_k"), F.col(sha).alias("_s"))
    ready = prior_ready.select(F.col(key).alias("_r")).distinct()
    both = rows.join(raw, (F.col(key) == F.col("_k")) & (F.col(sha) == F.col("_s")), "left").join(ready, F.col(key) == F.col("_r"), "left")
    return both.select(*rows.columns, (F.col("_k").isNotNull() & F.col("_r").isNotNull()).alias("reuse"))


def coalesced(raw: DataFrame, new: DataFrame, old: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per raw row: the new values, else the reusable ones, with where they came from."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.struct(*columns).alias(name))

    both = raw.select(key).join(side(new, "n"), key, "left").join(side(old, "o"), key, "left")
    came = F.when(F.col("n").isNotNull(), "new").when(F.col("o").isNotNull(), "reused").otherwise("missing")
    value = F.coalesce("n", "o")
    return both.select(key, came.alias("came_from"), *[value[c].alias(c) for c in columns])


def review_gate(packet: DataFrame, reviews: DataFrame, key: str, bound: Sequence[str], answers: Sequence[str], reviewers: int = 2) -> DataFrame:
    """(key, n_reviews, state): eligible if exactly ``reviewers`` different people answered yes to everything.

    A review that is bound to other values than the packet's, a foreign one or a second one by the
    same reviewer is a fault; too few reviews make ``not_eligible``."""
    theirs = reviews.select(F.col(key).alias("_k"), "reviewer", *[F.col(c).alias(f"_{c}") for c in bound], *answers)
    both = packet.join(theirs, F.col(key) == F.col("_k"), "left")
    same = F.lit(True)
    for c in bound:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    yes = F.lit(True)
    for a in answers:
        yes = yes & (F.col(a) == "yes")
    got = F.count("_k")
    state = (
        F.when(F.bool_or(F.col("_k").isNotNull() & ~same), "mismatch")
        .when(got > F.countDistinct("reviewer"), "duplicate")
        .when(got < reviewers, "not_eligible")
        .when((got == reviewers) & F.bool_and(yes), "eligible")
        .otherwise("rejected")
    )
    foreign = reviews.join(packet.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n_reviews")).select(key, "n_reviews", F.lit("foreign").alias("state"))
    return both.groupBy(key).agg(got.alias("n_reviews"), state.alias("state")).unionByName(foreign)


def multiset_difference(left: DataFrame, right: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key..., n_left, n_right) of keys whose counts or values differ between two multisets."""
    def side(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count("*").alias(f"n_{n}"), F.min(value).alias(f"lo_{n}"), F.max(value).alias(f"hi_{n}"))

    both = side(left, "left").join(side(right, "right"), list(key), "full_outer")
    differ = ~F.col("n_left").eqNullSafe(F.col("n_right")) | ~F.col("lo_left").eqNullSafe(F.col("lo_right")) | ~F.col("hi_left").eqNullSafe(F.col("hi_right"))
    zero = F.lit(0).cast("long")
    return both.where(differ).select(*key, F.coalesce("n_left", zero).alias("n_left"), F.coalesce("n_right", zero).alias("n_right"))


def grouping_inventory(df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, Column]) -> DataFrame:
    """Several independent groupings in one scan; absent keys are null."""
    names = sorted({c for s in sets for c in s})
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*[m.alias(n) for n, m in measures.items()])


def pair_lock(rows: DataFrame, decisions: DataFrame, by: Sequence[str], key: str = "sample_id", hashed: str = "text_hash") -> DataFrame:
    """(by..., bonafide_id, spoof_id, locked): both sides approved and of one hash."""
    own = rows.join(decisions.select(key, "approved"), key, "left")
    a = own.where("label = 'bonafide'").select(*by, F.col(key).alias("bonafide_id"), F.col(hashed).alias("_h"), F.col("approved").alias("_p"))
    b = own.where("label = 'spoof'").select(*by, F.col(key).alias("spoof_id"), F.col(hashed).alias("_g"), F.col("approved").alias("_q"))
    locked = F.coalesce(F.col("_p") & F.col("_q") & (F.col("_h") == F.col("_g")), F.lit(False))
    return a.join(b, list(by)).select(*by, "bonafide_id", "spoof_id", locked.alias("locked"))


def set_equality(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, only_in) of values that one side lacks."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer").where("_l IS NULL OR _r IS NULL")
    return both.select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))


def path_set_audit(rows: DataFrame, split: str, path: str, metadata: DataFrame) -> DataFrame:
    """(a, b, n): paths that two splits share, splits in order; and paths of ``metadata`` in no split (``missing``) or the reverse (``foreign``).

    Nothing is returned where the splits are disjoint and their union is the metadata's.
    """
    own = rows.select(F.col(split).alias("s"), F.col(path).alias("p")).distinct()
    held = own.groupBy("p").agg(F.array_sort(F.collect_set("s")).alias("in_"))  # at most as many as there are splits
    i = F.explode(F.sequence(F.lit(0), F.size("in_") - 2)).alias("i")
    first = held.where(F.size("in_") > 1).select("in_", i)
    shared = first.select(F.get("in_", F.col("i")).alias("a"), F.explode(F.slice("in_", F.col("i") + 2, F.size("in_"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    listed = metadata.select(F.col(path).alias("p")).distinct().withColumn("_m", F.lit(True))
    odd = held.join(listed, "p", "full").where("in_ IS NULL OR _m IS NULL")
    kinds = odd.groupBy(F.when(F.col("in_").isNull(), "missing").otherwise("foreign").alias("a")).agg(F.count("*").alias("n"))
    return shared.unionByName(kinds.select("a", F.lit("").alias("b"), "n"))
