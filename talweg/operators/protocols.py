"""Composite protocols: each returns an issues frame (rule, key, detail) that must be empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions import normaliser
from talweg.functions.keys import rank_hex
from talweg.operators import graph, overlap, sampling, validation
from talweg.operators.validation import ledger_coverage, unpivoted
from talweg.storage import stored

ISSUE = "rule string, key string, detail string"


def _issue(df: DataFrame, rule: str, key: Column | str, detail: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    detail = F.col(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def combined(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def source_matrix_issues(rows: DataFrame, ledger: DataFrame, roles: DataFrame, role: str = "role") -> DataFrame:
    """Roles hold exactly their sources and both labels; sources are licensed and stand in one role.

    ``roles`` lists (role, source_name) as planned."""
    have = rows.select(role, "source_name").distinct()
    both = have.withColumn("_h", F.lit(1)).join(roles.select(role, "source_name").distinct().withColumn("_p", F.lit(1)), [role, "source_name"], "full_outer")
    odd = both.where("_h IS NULL OR _p IS NULL")
    detail = F.concat(F.col("source_name"), F.when(F.col("_h").isNull(), ": absent").otherwise(": not planned"))
    labels = rows.groupBy(role).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("l")).where("l <> 'bonafide,spoof'")
    shared = validation.shared_by_roles(rows, "source_name", role)
    licence = ledger_coverage(rows, ledger)
    return combined(_issue(odd, "sources", role, detail), _issue(labels, "labels", role, "l"), _issue(shared, "source in several roles", "value", "roles"), _issue(licence, "licence", "source", "problem"))


def unseen_suite_issues(rows: DataFrame, test: str, text: str, hashed: str, fields: Sequence[str], least: int = 3) -> DataFrame:
    """At least ``least`` tests, each of exact pairs with one hash, sharing no value of the fields."""
    few = rows.agg(F.countDistinct(test).alias("n")).where(F.col("n") < least)
    pairs = rows.groupBy(test, text).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("l"), F.countDistinct(hashed).alias("h"))
    broken = pairs.where("n <> 2 OR l <> 'bonafide,spoof' OR h <> 1")
    shared = overlap.test_isolation(rows, test, test, fields)
    key = F.concat_ws("/", test, text)
    return combined(_issue(few, "too few tests", F.lit("suite"), "n"), _issue(broken, "pair", key, "l"), _issue(shared, "shared value", F.concat_ws(":", "field", "value"), "tests"))


def final_input_issues(final: DataFrame, others: dict[str, DataFrame], fields: Sequence[str], text: str = "text_id", hashed: str = "text_hash") -> DataFrame:
    """Final inputs are exact pairs and share nothing with any other role."""
    pairs = final.groupBy("language", text).agg(F.count("*").alias("n"), F.countDistinct("label").alias("k"), F.countDistinct(hashed).alias("h")).where("n <> 2 OR k <> 2 OR h <> 1")
    parts = [_issue(pairs, "pair", F.concat_ws("/", "language", text), "n")]
    parts += [_issue(overlap.overlap_by_field(final, o, fields), f"overlap with {name}", "field", F.concat_ws(",", F.col("n_overlap").cast("string"), "example")) for name, o in others.items()]
    return combined(*parts)


def combined_train_issues(parts: dict[str, DataFrame], cells: DataFrame, disjoint: Sequence[str], pinned: dict[str, int]) -> DataFrame:
    """Parts share nothing in ``disjoint``; fields in ``pinned`` are shared by exactly that many values; cells are as expected."""
    long = None
    for name, df in parts.items():
        rows = unpivoted(df, [*disjoint, *pinned]).distinct().withColumn("part", F.lit(name))
        long = rows if long is None else long.unionByName(rows)
    many = long.groupBy("field", "value").agg(F.count("*").alias("n")).where("n > 1")
    clash = many.where(F.col("field").isin(*disjoint)).groupBy("field").agg(F.min("value").alias("example"))
    out = [_issue(clash, "not disjoint", "field", "example")]
    spark = long.sparkSession
    if pinned:
        want = spark.createDataFrame(list(pinned.items()), "field string, want long")
        got = want.join(many.groupBy("field").agg(F.count("*").alias("n")), "field", "left").where("coalesce(n, 0) <> want")
        out.append(_issue(got, "pinned overlap", "field", F.coalesce("n", F.lit(0))))
    every = None
    for df in parts.values():
        some = df.select("language", "label")
        every = some if every is None else every.unionByName(some)
    wrong = validation.cell_counts(every, ("language", "label"), cells).where("NOT matches")
    out.append(_issue(wrong, "cell", "cell", F.concat_ws("/", F.col("n_rows").cast("string"), F.col("n_expected").cast("string"))))
    return combined(*out)


def selection_binding_issues(selection: DataFrame, source: DataFrame, key: str, columns: Sequence[str], rank_group: Sequence[str], rank: str) -> DataFrame:
    """A frozen selection still equals its source, has unique ids and contiguous ranks."""
    broken = overlap.lineage_breaks(selection, source, key, columns)
    again = selection.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    gaps = validation.contiguous_ranks(selection, rank_group, rank).where("NOT contiguous")
    return combined(_issue(broken, "binding", key, F.array_join("broken", ",")), _issue(again, "repeated", key, "n"), _issue(gaps, "ranks", F.concat_ws("/", *rank_group), F.lit("gap")))


def route_history(rows: DataFrame, key: Sequence[str], label: str) -> DataFrame:
    """(source_name, n_rows, n_conflicts): distinct history by key, keys with two labels counted apart."""
    one = rows.groupBy(*key).agg(F.countDistinct(label).alias("_k"))
    return one.groupBy("source_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("_k") > 1).alias("n_conflicts"))


def _against_plan(rows: DataFrame, plan: DataFrame, by: str, name: str) -> DataFrame:
    """(by, detail) of names that a role holds and the plan does not, or the reverse."""
    have = rows.select(by, name).distinct().withColumn("_h", F.lit(1))
    both = have.join(plan.select(by, name).distinct().withColumn("_p", F.lit(1)), [by, name], "full_outer").where("_h IS NULL OR _p IS NULL")
    return both.select(by, F.concat(F.col(name), F.when(F.col("_h").isNull(), ": absent").otherwise(": not planned")).alias("detail"))


def _use_issues(rows: DataFrame, ledger: DataFrame, uses: Sequence[str]) -> DataFrame:
    """Sources that the ledger does not allow for this use; those that it lacks are the licence's issue."""
    have = rows.select(F.col("source_name").alias("source_id")).distinct().join(ledger.select("source_id", "train_dev_test_use"), "source_id")
    odd = have.where(~F.coalesce(F.col("train_dev_test_use").isin(*uses), F.lit(False)))
    return _issue(odd, "use", "source_id", F.coalesce("train_dev_test_use", F.lit("")))


def training_selection_issues(rows: DataFrame, sources: DataFrame, cells: DataFrame, ledger: DataFrame, fields: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """Roles train and dev as planned and apart from each other.

    ``rows`` have a role; ``sources`` lists (role, source_name) and ``cells`` (role, cell, n_expected), a cell
    being language/label.  Each role holds its sources and cells, sources are licensed for research, the
    roles share no value of ``fields`` and no source, and dev has all ``languages``.
    """
    found = _against_plan(rows, sources, "role", "source_name")
    counted = rows.groupBy("role", F.concat_ws("/", "language", "label").alias("cell")).agg(F.count("*").alias("n")).join(cells, ["role", "cell"], "full_outer")
    wrong = counted.where("coalesce(n, 0) <> coalesce(n_expected, 0)")
    numbers = F.concat_ws("/", F.coalesce("n", F.lit(0)).cast("string"), F.coalesce("n_expected", F.lit(0)).cast("string"))
    train, dev = rows.where("role = 'train'"), rows.where("role = 'dev'")
    shared = overlap.overlap_by_field(train, dev, [*fields, "source_name"])
    spark = rows.sparkSession
    need = spark.createDataFrame([(x,) for x in languages], "language string").join(dev.select("language").distinct(), "language", "left_anti")
    return combined(
        _issue(found, "sources", "role", "detail"),
        _issue(wrong, "cell", F.concat_ws(":", "role", "cell"), numbers),
        _issue(ledger_coverage(rows, ledger), "licence", "source", "problem"),
        _use_issues(rows, ledger, ("research_only", "product_allowed")),
        _issue(shared, "overlap", "field", "n_overlap"),
        _issue(need, "dev lacks", "language", F.lit("language")),
    )


def calibration_input_issues(rows: DataFrame, plan: dict, ledger: DataFrame, others: dict[str, DataFrame], fields: Sequence[str]) -> DataFrame:
    """A calibration set is a lock of exact pairs, as planned, of licensed sources and apart from every other role.

    ``plan`` has rows, labels (label to number), sources, pairs, split and language.
    """
    spark = rows.sparkSession
    n = rows.agg(F.count("*").alias("n")).where(F.col("n") != plan["rows"])
    labels = spark.createDataFrame(list(plan["labels"].items()), "label string, want long")
    counted = rows.groupBy("label").agg(F.count("*").alias("n")).join(labels, "label", "full_outer").where("coalesce(n, 0) <> coalesce(want, 0)")
    scope = rows.where(~(F.col("split").eqNullSafe(plan["split"]) & F.col("language").eqNullSafe(plan["language"]))).groupBy("split", "language").agg(F.count("*").alias("n"))
    planned = spark.createDataFrame([("calibration", x) for x in plan["sources"]], "role string, source_name string")
    found = _against_plan(rows.withColumn("role", F.lit("calibration")), planned, "role", "source_name")
    pairs = rows.groupBy("text_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("l"), F.countDistinct("text_hash").alias("h"))
    broken = pairs.where("n <> 2 OR l <> 'bonafide,spoof' OR h <> 1")
    number = pairs.agg(F.count("*").alias("n")).where(F.col("n") != plan["pairs"])
    parts = [
        _issue(n, "rows", F.lit("calibration"), "n"),
        _issue(counted, "label", "label", F.coalesce("n", F.lit(0))),
        _issue(scope, "scope", F.concat_ws("/", "split", "language"), "n"),
        _issue(found, "sources", "role", "detail"),
        _issue(ledger_coverage(rows, ledger), "licence", "source", "problem"),
        _use_issues(rows, ledger, ("research_only",)),
        _issue(number, "pairs", F.lit("calibration"), "n"),
        _issue(broken, "pair", "text_id", "l"),
    ]
    parts += [_issue(overlap.overlap_by_field(rows, o, fields), f"overlap with {name}", "field", "n_overlap") for name, o in others.items()]
    return combined(*parts)


def final_layer_issues(layers: DataFrame, observed: DataFrame, plan: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Final layers are balanced exact pairs of their own language, of sources and spoof families never observed before.

    ``layers`` have a layer, ``observed`` a role; ``plan`` lists (layer, n_rows, n_pairs, language, code_switch).
    """
    spoof, bona = F.count_if(F.col("label") == "spoof"), F.count_if(F.col("label") == "bonafide")
    g = layers.groupBy("layer").agg(F.count("*").alias("n"), spoof.alias("s"), bona.alias("b"), F.countDistinct("text_hash").alias("t"))
    both = plan.join(g, "layer", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    unplanned = both.where("n_rows IS NULL")
    known = both.where("n_rows IS NOT NULL")
    again = layers.groupBy("layer", "text_hash", "label").agg(F.count("*").alias("n")).where("n > 1").groupBy("layer").agg(F.count("*").alias("n"))
    scoped = layers.join(plan.select("layer", F.col("language").alias("_l"), F.col("code_switch").alias("_c")), "layer")
    odd = scoped.where(~((F.col("split") == "test") & (F.col("language") == F.col("_l")) & (F.col("code_switch") == F.col("_c")))).groupBy("layer").agg(F.count("*").alias("n"))
    reused = layers.select("layer", "source_name").distinct().join(observed.select("source_name").distinct(), "source_name", "left_semi")
    families = lambda df, *by: df.where("label = 'spoof' AND generator_family <> ''").select(*by, "generator_family").distinct()
    old = families(layers, "layer").join(families(observed), "generator_family", "left_semi")
    roles = layers.select(F.col("layer").alias("role"), *fields).unionByName(observed.select("role", *fields))
    shared = overlap.pairwise_role_overlap(roles, "role", fields)
    return combined(
        _issue(unplanned, "not planned", "layer", "n"),
        _issue(known.where(zero("n") != F.col("n_rows")), "rows", "layer", zero("n")),
        _issue(known.where((zero("s") != F.col("n_pairs")) | (zero("b") != F.col("n_pairs"))), "balance", "layer", F.concat_ws("/", zero("b").cast("string"), zero("s").cast("string"))),
        _issue(known.where(zero("t") != F.col("n_pairs")), "texts", "layer", zero("t")),
        _issue(again, "repeated text and label", "layer", "n"),
        _issue(odd, "scope", "layer", "n"),
        _issue(reused, "observed source", "layer", "source_name"),
        _issue(old, "observed family", "layer", "generator_family"),
        _issue(shared, "overlap", F.concat_ws("/", "role_a", "role_b", "field"), "n_values"),
    )


def final_inputs(records: DataFrame, scopes: dict[str, DataFrame], *, key: str, group: str, text: str, language: str, fields: Sequence[str], seed: str, targets: dict[str, int]) -> DataFrame:
    """(key, language, group, text_sha256, position): final inputs by metadata alone.

    Groups of which any row has a value of ``fields`` in a scope are out, texts that the stage normaliser
    rejects too; then each language takes records in the order of their hash, no group and no text twice,
    ``targets`` at most.  ``final_input_shortages`` says where that is fewer.
    """
    clean = overlap.screened_groups(records, scopes, fields, group).where("clean").select(group)
    rows = records.join(clean, group).withColumn("_n", normaliser.normalised_text(F.col(text), F.col(language))).where("_n.error IS NULL")
    rows = stored(rows.select(key, language, group, F.col("_n.sha256").alias("text_sha256"), rank_hex(seed, F.col(language), F.col(key), sep=":").alias("_rank")), "final-pool")
    out = None
    for name, target in targets.items():  # a few routes
        own = graph.greedy_distinct(rows.where(F.col(language) == name), "_rank", group, "text_sha256", target)
        out = own if out is None else out.unionByName(own)
    return sampling.ranked(out, [language], ["_rank"], "position").drop("_rank")


def final_input_shortages(chosen: DataFrame, language: str, targets: dict[str, int]) -> DataFrame:
    """(rule, key, detail) of languages with fewer inputs than their target."""
    want = chosen.sparkSession.createDataFrame(list(targets.items()), f"{language} string, want long")
    got = want.join(chosen.groupBy(language).agg(F.count("*").alias("n")), language, "left").where("coalesce(n, 0) < want")
    return _issue(got, "shortage", language, F.concat_ws("/", F.coalesce("n", F.lit(0)).cast("string"), F.col("want").cast("string")))
