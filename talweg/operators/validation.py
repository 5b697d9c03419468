"""Row rules with accumulated issues, uniqueness, leakage, ledgers and consents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg import schema as S
from talweg.functions.text import iso_date_or_time_ok, iso_timestamp_ok, portable_path_ok


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def listed(*rules: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(m) if isinstance(m, str) else m) for cond, m in rules]))


def stepwise(*steps: Column) -> Column:
    """The first array that is not empty: earlier checks hide later ones."""
    out = steps[-1]
    for s in reversed(steps[:-1]):
        out = F.when(F.size(s) > 0, s).otherwise(out)
    return out


def enum_issue(name: str, allowed: Sequence[str]) -> tuple[Column, str]:
    return ~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), f"{name}: not allowed"


def provenance_issues(label: str = "label", fields: Sequence[str] = S.GENERATOR) -> list[tuple[Column, Column]]:
    """Spoof rows need every generator field, bonafide rows none."""
    def names(keep_blank: bool) -> Column:
        return F.array_join(F.array_compact(F.array(*[F.when(blank(F.col(f)) if keep_blank else ~blank(F.col(f)), F.lit(f)) for f in fields])), ",")

    missing, extra = names(True), names(False)
    return [
        ((F.col(label) == "spoof") & (missing != ""), F.concat(F.lit("spoof lacks "), missing)),
        ((F.col(label) == "bonafide") & (extra != ""), F.concat(F.lit("bonafide has "), extra)),
    ]


def manifest_issues(languages: Sequence[str] = S.LANGUAGES, mandatory: Sequence[str] = S.MANDATORY) -> Column:
    """``array<string>`` of a manifest row's issues: blanks, hash and path alone, the rest together."""
    blanks = listed(*[(blank(F.col(c)), f"{c}: blank") for c in mandatory])
    sha = listed((~F.lower("sha256").rlike("^[0-9a-f]{64}$"), "sha256: not a digest"))
    path = listed((~portable_path_ok(F.col("relative_path")), "relative_path: not portable"))
    duration, rate = F.col("duration_s").try_cast("double"), F.col("original_sr").try_cast("int")
    rest = listed(
        enum_issue("split", S.SPLITS),
        enum_issue("label", S.LABELS),
        enum_issue("language", languages),
        ((F.col("language") == "other") & (F.col("split") != "ood"), "language: other outside ood"),
        (~F.coalesce(F.lower("code_switch").isin(*S.CODE_SWITCH), F.lit(False)), "code_switch: not allowed"),
        (duration.isNull() | (duration <= 0), "duration_s: not positive"),
        (rate.isNull() | (rate <= 0), "original_sr: not positive"),
        (~iso_timestamp_ok(F.col("created_at")), "created_at: not ISO-8601"),
        *provenance_issues(),
    )
    return stepwise(blanks, sha, path, rest)


def _value(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _one_of(name: str, allowed: Sequence[str]) -> tuple[Column, str]:
    return ~F.lower(_value(name)).isin(*allowed), f"{name}: not allowed"


def ledger_issues() -> Column:
    """``array<string>`` of a ledger row's issues; values are trimmed, enumerations and digests lower-cased."""
    size, sha = _value("expected_size_bytes").try_cast("long"), F.lower(_value("sha256"))
    return listed(
        *[(_value(c) == "", f"{c}: blank") for c in S.LEDGER.names if c not in ("last_modified_utc", "sha256")],
        (size.isNull(), "expected_size_bytes: not an integer"),
        (size <= 0, "expected_size_bytes: not positive"),
        ((_value("last_modified_utc") != "") & ~iso_date_or_time_ok(_value("last_modified_utc")), "last_modified_utc: not ISO-8601"),
        ((sha != "") & ~sha.rlike("^[0-9a-f]{64}$"), "sha256: not a digest"),
        _one_of("train_dev_test_use", S.PROTOCOL_USES),
        _one_of("ood_evaluation_use", S.PROTOCOL_USES),
        _one_of("bonafide_group_provenance", S.GROUP_PROVENANCES),
        _one_of("spoof_voice_group_provenance", S.GROUP_PROVENANCES),
        (F.lower(_value("status")).isin(*S.APPROVED_STATUSES) & (sha == ""), "sha256: approved without digest"),
    )


def consent_issues() -> Column:
    """``array<string>`` of a consent row's issues; values are trimmed, enumerations and booleans lower-cased."""
    status = F.lower(_value("status"))
    opaque = "^[a-z0-9][a-z0-9._:-]{2,127}$"
    return listed(
        *[(_value(c) == "", f"{c}: blank") for c in S.CONSENT.names if c != "revoked_at"],
        *[((_value(c) != "") & ~_value(c).rlike(opaque), f"{c}: not opaque") for c in ("consent_record_id", "speaker_pseudo_id")],
        _one_of("language", S.CONSENT_LANGUAGES),
        _one_of("status", S.CONSENT_STATUSES),
        *[(~F.lower(_value(c)).isin("true", "false"), f"{c}: not boolean") for c in S.CONSENT_SCOPES],
        *[((_value(c) != "") & ~iso_date_or_time_ok(_value(c)), f"{c}: not ISO-8601") for c in ("signed_at", "revoked_at")],
        ((status == "active") & (_value("revoked_at") != ""), "revoked_at: set on active"),
        ((status == "revoked") & (_value("revoked_at") == ""), "revoked_at: missing"),
    )


def eligible_speakers(consents: DataFrame) -> DataFrame:
    """(speaker_pseudo_id, eligible, missing, n_active): active consents, the scopes that one of them lacks."""
    lacks = F.array_compact(F.array(*[F.when(F.lower(_value(c)) != "true", F.lit(c)) for c in S.CONSENT_SCOPES]))
    active = consents.where(F.lower(_value("status")) == "active").select(_value("speaker_pseudo_id").alias("speaker_pseudo_id"), lacks.alias("lacks"))
    out = active.groupBy("speaker_pseudo_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lacks")))).alias("m"), F.count("*").alias("n_active"))
    return out.select("speaker_pseudo_id", (F.size("m") == 0).alias("eligible"), F.array_join("m", ",").alias("missing"), "n_active")


def issues_of(df: DataFrame, issues: Column, key: str) -> DataFrame:
    """One row (key, issue) per issue."""
    return df.select(F.col(key), F.explode(issues).alias("issue"))


def duplicate_occurrences(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row (field, value, occurrence) per occurrence beyond the first, counted without moving rows together."""
    counted = unpivoted(df, fields).groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")
    return counted.select("field", "value", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("occurrence"))


def unpivoted(df: DataFrame, fields: Sequence[str], keep: Sequence[str] = (), skip_blank: bool = True) -> DataFrame:
    """Long rows (keep..., field, value); blanks stand for missing and are left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    out = df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.field", "p.value")
    return out.where("value IS NOT NULL AND value <> ''") if skip_blank else out


def cross_split_leakage(df: DataFrame, fields: Sequence[str] = S.LEAKAGE_FIELDS, split: str = "split") -> DataFrame:
    """(field, value, splits) of values that stand in several splits."""
    seen = unpivoted(df, fields, [split]).groupBy("field", "value").agg(F.array_sort(F.collect_set(split)).alias("s"))
    return seen.where(F.size("s") > 1).select("field", "value", F.array_join("s", ",").alias("splits"))


def ood_families(df: DataFrame, family: str = "generator_family", split: str = "split") -> DataFrame:
    """(family, n_ood, n_other, isolated) of generator families that appear in ood; "" is none."""
    ood = F.col(split) == "ood"
    rows = df.where((F.col("label") == "spoof") & ~blank(F.col(family))).groupBy(F.col(family).alias("family"))
    out = rows.agg(F.count_if(ood).alias("n_ood"), F.count_if(~ood).alias("n_other")).where("n_ood > 0")
    return out.withColumn("isolated", F.col("n_other") == 0)


def ledger_coverage(df: DataFrame, ledger: DataFrame, source: str = "source_name") -> DataFrame:
    """(source, problem) of distinct sources that the ledger lacks or has not approved."""
    used = df.select(F.col(source).alias("source")).distinct()
    known = ledger.select(F.col("source_id").alias("source"), F.lower(F.trim("status")).alias("status"))
    problem = F.when(F.col("status").isNull(), "missing").when(~F.col("status").isin(*S.APPROVED_STATUSES), "not_approved")
    return used.join(known, "source", "left").select("source", problem.alias("problem")).where("problem IS NOT NULL")


def training_protocol_issues(df: DataFrame, ledger: DataFrame, purpose: str = "research") -> DataFrame:
    """(rule, value) of what a training protocol breaks.

    Research reads train, dev and test, and needs sources that allow it there; a product reads ood too, and
    needs product-allowed, verified, commercially clean sources with verified groups, and generator families
    and voices that keep apart.  The ledger must cover and approve every source of the table.
    """
    if purpose not in ("research", "product"):
        raise ValueError(f"purpose: {purpose}")
    product = purpose == "product"
    splits = df.sparkSession.createDataFrame([(s,) for s in S.SPLITS if product or s != "ood"], "split string")
    names = ("status", "usage_scope", "train_dev_test_use", "ood_evaluation_use", "bonafide_group_provenance", "spoof_voice_group_provenance")
    known = ledger.select(F.col("source_id").alias("source_name"), *[(F.trim(n) if n == "usage_scope" else F.lower(F.trim(n))).alias(n) for n in names])
    rows = df.join(F.broadcast(splits), "split")  # three or four rows
    covered = rows.join(known, "source_name")

    def found(rule: str, of: DataFrame, value: Column) -> DataFrame:
        return of.select(F.lit(rule).alias("rule"), value.alias("value")).distinct()

    held = splits.join(rows.groupBy("split").agg(F.collect_set("label").alias("labels")), "split", "left")
    licence = ledger_coverage(df, ledger)
    use_field = F.when(F.col("split") == "ood", "ood_evaluation_use").otherwise("train_dev_test_use")
    use = F.when(F.col("split") == "ood", F.col("ood_evaluation_use")).otherwise(F.col("train_dev_test_use"))
    by_use = F.concat_ws(":", "source_name", use_field)
    out = [
        found("source missing from the ledger", licence.where("problem = 'missing'"), F.col("source")),
        found("source not approved", licence.where("problem = 'not_approved'"), F.col("source")),
        found("split empty", held.where("labels IS NULL"), F.col("split")),
        found("split lacks a label", held.where("array_sort(labels) <> array('bonafide', 'spoof')"), F.col("split")),
    ]
    if not product:
        out.append(found("use prohibited", covered.where(~use.isin("research_only", "product_allowed")), by_use))
    else:
        provenance = F.when(F.col("label") == "bonafide", F.col("bonafide_group_provenance")).otherwise(F.col("spoof_voice_group_provenance"))
        spoof = rows.where("label = 'spoof'")
        families = spoof.groupBy("generator_family").agg(F.bool_or(F.col("split") == "ood").alias("o"), F.bool_or(F.col("split") != "ood").alias("r"))
        voices = covered.where("label = 'spoof' AND spoof_voice_group_provenance = 'verified'").groupBy("voice_id").agg(F.countDistinct("split").alias("n"))
        out += [
            found("use not for products", covered.where(use != "product_allowed"), by_use),
            found("status not verified", covered.where("status <> 'verified'"), F.col("source_name")),
            found("scope not commercial", covered.where("usage_scope <> 'commercial_clean'"), F.col("source_name")),
            found("groups not verified", covered.where(provenance != "verified"), F.concat_ws(":", "source_name", "label")),
            found("no generator family in ood", families.agg(F.bool_or("o").alias("any")).where("NOT coalesce(any, false)"), F.lit("ood")),
            found("generator family in ood and elsewhere", families.where("o AND r"), F.col("generator_family")),
            found("voice in several splits", voices.where("n > 1"), F.col("voice_id")),
        ]
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def functional_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_values) of keys with more than one value."""
    return df.groupBy(F.col(key).alias("key")).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def shared_by_roles(df: DataFrame, value: str, role: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.countDistinct(role).alias("n_roles"), F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles")).where("n_roles > 1")


def cell_counts(df: DataFrame, by: Sequence[str], expected: DataFrame | None = None) -> DataFrame:
    """(cell, n_rows[, n_expected, matches]): counts by cell name, against expectations if given."""
    counted = df.groupBy(F.concat_ws("/", *by).alias("cell")).agg(F.count("*").alias("n_rows"))
    if expected is None:
        return counted
    both = counted.join(expected, "cell", "full_outer")
    rows, want = F.coalesce("n_rows", F.lit(0)), F.coalesce("n_expected", F.lit(0))
    return both.select("cell", rows.alias("n_rows"), want.alias("n_expected"), (rows == want).alias("matches"))


def contiguous_ranks(df: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    """(group..., contiguous): whether ranks are 1..n without gaps or repeats."""
    r = F.col(rank)
    return df.groupBy(*group).agg(((F.min(r) == 1) & (F.max(r) == F.count("*")) & (F.countDistinct(r) == F.count("*"))).alias("contiguous"))


def require_empty(issues: DataFrame, what: str) -> None:
    """Fail closed: raise with some examples if there are issues."""
    some = issues.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[r.asDict() for r in some]}")


def occurrence_number(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
