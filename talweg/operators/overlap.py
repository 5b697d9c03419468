"""Overlap audits, anti-joins with reasons, group taint and lineage bindings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.operators.validation import unpivoted


def overlap_by_field(candidate: DataFrame, reference: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, n_overlap, example): distinct values that both frames hold, by field; example is the least."""
    a = unpivoted(candidate, fields).distinct()
    b = unpivoted(reference, fields).distinct()
    return a.join(b, ["field", "value"], "left_semi").groupBy("field").agg(F.count("*").alias("n_overlap"), F.min("value").alias("example"))


def pairwise_role_overlap(df: DataFrame, role: str, fields: Sequence[str]) -> DataFrame:
    """(role_a, role_b, field, n_values) over unordered pairs of roles."""
    seen = unpivoted(df, fields, [role]).groupBy("field", "value").agg(F.array_sort(F.collect_set(role)).alias("roles"))
    seen = seen.where(F.size("roles") > 1)
    pairs = F.flatten(F.transform("roles", lambda a: F.transform(F.filter("roles", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = seen.select("field", F.explode(pairs).alias("p"))
    return rows.groupBy(F.col("p.a").alias("role_a"), F.col("p.b").alias("role_b"), "field").agg(F.count("*").alias("n_values"))


def anti_join_reasons(candidate: DataFrame, reference: DataFrame, fields: Sequence[str], key: str, pair: str = "text_hash", pair_reason: str = "paired_text_group") -> DataFrame:
    """(key, reasons): fields of a candidate row found in the reference; rows without one that share
    ``pair`` with such a row get the pair reason.  Rows with no reason at all survive (empty array)."""
    out = candidate.select(key, pair, *[f for f in fields if f not in (key, pair)])
    marks = []
    for f in fields:
        known = reference.where(f"`{f}` IS NOT NULL AND `{f}` <> ''").select(F.col(f).alias(f"_{f}")).distinct().withColumn(f"hit_{f}", F.lit(True))
        out = out.join(known, F.col(f) == F.col(f"_{f}"), "left").drop(f"_{f}")
        marks.append(F.when(F.col(f"hit_{f}"), F.lit(f)))
    out = out.select(key, pair, F.array_compact(F.array(*marks)).alias("direct"))
    tainted = out.where(F.size("direct") > 0).select(pair).distinct().withColumn("pair_hit", F.lit(True))
    out = out.join(tainted, pair, "left")
    reasons = F.when(F.size("direct") > 0, F.col("direct")).when(F.col("pair_hit"), F.array(F.lit(pair_reason))).otherwise(F.array().cast("array<string>"))
    return out.select(key, reasons.alias("reasons"))


def survivors(reasoned: DataFrame, key: str) -> DataFrame:
    return reasoned.where(F.size("reasons") == 0).select(key)


def reason_histogram(reasoned: DataFrame) -> DataFrame:
    return reasoned.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def group_taint_exclusion(rows: DataFrame, exposed: DataFrame, key: str, groups: Sequence[str]) -> DataFrame:
    """Rows of which no group holds an exposed row: one hop, by every grouping field."""
    hit = rows.join(exposed.select(key).distinct(), key, "left_semi")
    out = rows
    for g in groups:
        out = out.join(hit.select(g).distinct(), g, "left_anti")
    return out


def group_screen(rows: DataFrame, flags: dict[str, Column], group: str) -> DataFrame:
    """Rows with ``group_<flag>``: whether any row of the group has the flag; rows without a group are one."""
    any_ = rows.groupBy(F.col(group).alias("_g")).agg(*[F.max(f).alias(f"group_{name}") for name, f in flags.items()])
    return rows.join(any_, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def screened_groups(rows: DataFrame, scopes: dict[str, DataFrame], fields: Sequence[str], group: str) -> DataFrame:
    """(group, clean, n_<scope>_<field>...): rows of each group whose value the scope holds."""
    out = rows.select(group, *[f for f in fields if f != group])
    for scope, other in scopes.items():
        for f in fields:
            known = other.select(F.col(f).alias("_v")).where("_v IS NOT NULL AND _v <> ''").distinct().withColumn(f"{scope}_{f}", F.lit(1))
            out = out.join(known, F.col(f) == F.col("_v"), "left").drop("_v")
    names = [f"{s}_{f}" for s in scopes for f in fields]
    counted = out.groupBy(group).agg(F.count("*").alias("n_rows"), *[F.count(n).alias(f"n_{n}") for n in names])
    total = sum((F.col(f"n_{n}") for n in names), F.lit(0))
    return counted.withColumn("clean", total == 0)


def exposure_audit(candidate: DataFrame, scopes: dict[str, DataFrame], fields: Sequence[str], blocking: Sequence[str]) -> DataFrame:
    """(scope, field, n_overlap, blocking) for every scope and field, zero included."""
    mine = unpivoted(candidate, fields).distinct()
    grid = candidate.sparkSession.createDataFrame([(s, f, f in blocking) for s in scopes for f in fields], "scope string, field string, blocking boolean")
    found = None
    for s, other in scopes.items():
        hit = mine.join(unpivoted(other, fields).distinct(), ["field", "value"], "left_semi").groupBy("field").agg(F.count("*").alias("n")).withColumn("scope", F.lit(s))
        found = hit if found is None else found.unionByName(hit)
    return grid.join(found, ["scope", "field"], "left").select("scope", "field", F.coalesce("n", F.lit(0)).alias("n_overlap"), "blocking")


def unbound_rows(candidate: DataFrame, source: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (with repeats) of ``candidate`` that the source lacks, on all given columns."""
    columns = list(columns or candidate.columns)
    return candidate.select(*columns).exceptAll(source.select(*columns))


def lineage_breaks(candidate: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, broken): candidate rows whose source row is missing or differs, with the columns that differ."""
    theirs = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = candidate.join(theirs, F.col(key) == F.col("_k"), "left")
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    broken = F.when(F.col("_k").isNull(), F.array(F.lit("missing"))).otherwise(differ)
    return both.select(key, broken.alias("broken")).where(F.size("broken") > 0)


def outsiders(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which a whole-input predicate does not hold (null counts as not)."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def mentions(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which one of the columns holds the needle, case ignored."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return df.where(hit)


def test_isolation(df: DataFrame, test: str, order: str, fields: Sequence[str], exempt: Column | None = None) -> DataFrame:
    """(field, value, first_test, tests) of values that several tests share, exempt rows left out."""
    rows = df.where(~exempt) if exempt is not None else df
    seen = unpivoted(rows, fields, [test, order]).groupBy("field", "value")
    out = seen.agg(F.min_by(test, order).alias("first_test"), F.array_sort(F.collect_set(test)).alias("t"))
    return out.where(F.size("t") > 1).select("field", "value", "first_test", F.array_join("t", ",").alias("tests"))


def route_exposure(candidate: DataFrame, history: DataFrame, route: Sequence[str], alias: Column | None = None) -> DataFrame:
    """Distinct candidate routes with ``novel`` (not in the history) and ``family_known``.

    With ``alias`` (an expression over a row) also ``alias_known``: one of the route's aliases is one of the
    history's, under whatever route it stands there.
    """
    if alias is not None:
        known = history.select(alias.alias("_a")).where("_a IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
        seen = candidate.select(*route, alias.alias("_a")).distinct().join(known, "_a", "left")
        seen = seen.groupBy(*route).agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("alias_known"))
        return route_exposure(candidate, history, route).join(seen, list(route))
    mine = candidate.select(*route).distinct()
    past = history.select(*route).distinct().withColumn("_seen", F.lit(True))
    families = history.select(route[0]).distinct().withColumn("_family", F.lit(True))
    out = mine.join(past, list(route), "left").join(families, route[0], "left")
    return out.select(*route, F.col("_seen").isNull().alias("novel"), F.col("_family").isNotNull().alias("family_known"))
