"""Selections, audits and bindings composed of the basic operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.operators import dedupe, metrics, perceptual, timeseries
from talweg.operators.digest import joined_digest
from talweg.operators.prefix import numbered
from talweg.operators.sampling import ranked, top_per_stratum
from talweg.session import arrow_rows
from talweg.storage import stored

WAVES_AT_ONCE = 256


def missing_by_speaker(rows: DataFrame, assets: DataFrame, path: str = "relative_path", speaker: str = "speaker_pseudo_id") -> DataFrame:
    """(speaker, n_rows, n_missing): rows whose file is not among ``assets``."""
    have = assets.select(path).distinct().withColumn("_have", F.lit(True))
    return rows.join(have, path, "left").groupBy(speaker).agg(F.count("*").alias("n_rows"), F.count_if(F.col("_have").isNull()).alias("n_missing"))


def held_out_by_text(rows: DataFrame, earlier: DataFrame, kept: DataFrame, text: str = "text_hash") -> DataFrame:
    """Rows of the texts in ``kept`` that no earlier candidate used."""
    return rows.join(earlier.select(text).distinct(), text, "left_anti").join(kept.select(text).distinct(), text, "left_semi")


def counterparts(spoof: DataFrame, bonafide: DataFrame, key: Sequence[str], name: str = "sample_id") -> DataFrame:
    """(spoof_id, bonafide_id, problem): each spoof row's one bonafide row; ``missing`` or ``shared`` where it is not one of its own."""
    own = bonafide.groupBy(*key).agg(F.min(name).alias("bonafide_id"), F.count("*").alias("_b"))
    uses = spoof.groupBy(*key).agg(F.count("*").alias("_s"))
    out = spoof.select(*key, F.col(name).alias("spoof_id")).join(uses, list(key)).join(own, list(key), "left")
    problem = F.when(F.col("bonafide_id").isNull(), "missing").when((F.col("_b") > 1) | (F.col("_s") > 1), "shared")
    return out.select("spoof_id", F.when(problem.isNull(), F.col("bonafide_id")).alias("bonafide_id"), problem.alias("problem"))


def suite_report(rows: DataFrame, test: str) -> DataFrame:
    """(test, n_rows, n_bonafide, n_spoof, sources, families) by test."""
    names = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(a) for c, a in (("source_name", "sources"), ("generator_family", "families"))]
    return rows.groupBy(test).agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == "bonafide").alias("n_bonafide"), F.count_if(F.col("label") == "spoof").alias("n_spoof"), *names)


def unique_text_per_group(df: DataFrame, group: str, text: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The best row of each text of a group, then the best ``n`` of a group."""
    return top_per_stratum(top_per_stratum(df, [group, text], order, 1).drop("rank"), [group], order, n)


def one_per_group(df: DataFrame, group: str, group_rank: Column, order: Sequence[Column | str], n: int) -> DataFrame:
    """One row of each group, groups in the order of their own hash, ``n`` in all."""
    best = top_per_stratum(df, [group], order, 1).drop("rank").withColumn("group_rank", group_rank)
    return best.orderBy("group_rank", group).limit(n)


def frozen(df: DataFrame, eligible: Column, route: str, rank: str, key: str, state: str, n: int) -> DataFrame:
    """Eligible rows per route, targets before reserves, then by rank and id; ``position`` from 1 to ``n``."""
    first = F.when(F.col(state) == "target", 0).otherwise(1)
    return ranked(df.where(eligible), [route], [first, rank, key], "position").where(F.col("position") <= n)


def route_tasks(rows: DataFrame, route: str, rank: str, profiles: dict[str, Sequence[str]]) -> DataFrame:
    """``rows`` with the position within their route and its profiles in turn; routes without profiles get none."""
    table = F.create_map(*[x for r, names in profiles.items() for x in (F.lit(r), F.array(*[F.lit(p) for p in names]))])
    out = ranked(rows, [route], [rank], "position").withColumn("_p", F.try_element_at(table, F.col(route)))
    turn = ((F.col("position") - 1) % F.size("_p") + 1).cast("int")
    return out.withColumn("profile", F.when(F.col("_p").isNotNull(), F.try_element_at("_p", turn))).drop("_p")


def target_faults(tasks: DataFrame, route: str, targets: dict[str, int]) -> DataFrame:
    """(route, n_tasks, target) of routes whose tasks are not as many as planned, planned ones without tasks included."""
    plan = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    names = tasks.sparkSession.createDataFrame([(r,) for r in targets], f"{route} string")
    n = tasks.groupBy(route).agg(F.count("*").alias("n_tasks")).join(names, route, "full")
    out = n.select(route, F.coalesce("n_tasks", F.lit(0)).cast("long").alias("n_tasks"), F.coalesce(F.try_element_at(plan, F.col(route)), F.lit(0)).cast("long").alias("target"))
    return out.where("n_tasks <> target")


def eligible_records(df: DataFrame, allowed: Column, labels: dict[str, str], label: str, text: Column, text_hash: Column, surrogate: Sequence[Column | str]) -> DataFrame:
    """Rows that may be used: ``allowed`` and of a known label, which is recoded; ``text_hash`` falls back to the
    hash of the text, and where there is none to that of what identifies the record, marked in ``surrogate``."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    own = F.sha2(F.concat_ws("\0", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in surrogate]), 256)
    blank = F.coalesce(F.trim(text), F.lit("")) == ""
    known = F.coalesce(F.nullif(F.trim(text_hash), F.lit("")), F.when(~blank, F.sha2(F.trim(text), 256)))
    out = df.where(F.coalesce(allowed, F.lit(False))).withColumn(label, F.try_element_at(table, F.col(label))).where(F.col(label).isNotNull())
    return out.withColumn("surrogate", known.isNull()).withColumn("text_hash", F.coalesce(known, own))


def order_breaks(subset: DataFrame, full: DataFrame, key: str, rank: str) -> DataFrame:
    """(key, fault) where ``subset`` is not ``full`` less some rows, in the same order: foreign, repeated or out of order."""
    both = subset.select(key, F.col(rank).alias("_r")).join(full.select(key, F.col(rank).alias("_f")), key, "left")
    both = both.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    odd = both.where("_f IS NULL OR _n > 1").select(key, F.when(F.col("_f").isNull(), "foreign").otherwise("repeated").alias("fault")).distinct()
    plain = both.where("_f IS NOT NULL AND _n = 1")
    moved = numbered(numbered(plain, [], ["_r", key], "_i"), [], ["_f", key], "_j").where("_i <> _j")
    return odd.union(moved.select(key, F.lit("order")))


def fresh_text_selection(df: DataFrame, used: DataFrame, allowed: Column, text: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """Allowed rows of unused texts, the first by rank of each text, ``n`` in all."""
    rows = df.where(F.coalesce(allowed, F.lit(False))).join(used.select(text).distinct(), text, "left_anti")
    best = top_per_stratum(rows, [text], order, 1).drop("rank")
    return best.orderBy(*order).limit(n)


def overridden(decisions: DataFrame, overrides: DataFrame, key: str = "sample_id", sha: str = "raw_sha256") -> DataFrame:
    """Decisions with those of ``overrides`` (raw digest, decision) put in their place; ``was`` keeps the first one."""
    new = overrides.select(sha, F.col("decision").alias("_new"))
    out = decisions.join(new, sha, "left")
    return out.select(key, sha, F.coalesce("_new", "decision").alias("decision"), F.col("decision").alias("was"))


def rekeyed(results: DataFrame, rows: DataFrame, key: str = "sample_id", by: Sequence[str] = ("raw_relative_path", "raw_sha256")) -> DataFrame:
    """(key, n_results, problem): results bound to rows by path and digest; a row needs exactly one, a result a row."""
    n = results.groupBy(*by).agg(F.count("*").alias("n_results"))
    both = rows.select(key, *by).join(n, list(by), "full_outer").select(key, F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"))
    problem = F.when(F.col(key).isNull(), "foreign").when(F.col("n_results") == 0, "missing").when(F.col("n_results") > 1, "repeated")
    return both.select(key, "n_results", problem.alias("problem"))


def field_strata(df: DataFrame, fields: Sequence[str], score: str, threshold: float = 0.0) -> DataFrame:
    """(field, value, n, n_bonafide, n_spoof, balanced_accuracy): blanks are ``not_applicable``; no accuracy without both labels."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", "not_applicable").otherwise(F.col(f).cast("string")).alias("value")) for f in fields])
    rows = df.select("label", F.col(score).alias("s"), F.explode(pairs).alias("p")).select("p.*", "label", "s")
    spoof, bona = F.col("label") == "spoof", F.col("label") == "bonafide"
    out = rows.groupBy("field", "value").agg(
        F.count("*").alias("n"), F.count_if(bona).alias("n_bonafide"), F.count_if(spoof).alias("n_spoof"),
        F.count_if(spoof & (F.col("s") >= threshold)).alias("_tp"), F.count_if(bona & (F.col("s") < threshold)).alias("_tn"),
    )
    both = (F.col("n_bonafide") > 0) & (F.col("n_spoof") > 0)
    accuracy = F.when(both, (F.col("_tp") / F.col("n_spoof") + F.col("_tn") / F.col("n_bonafide")) / 2)
    return out.select("field", "value", "n", "n_bonafide", "n_spoof", accuracy.alias("balanced_accuracy"))


def full_strata(df: DataFrame, fields: Sequence[str], score: str) -> DataFrame:
    """(field, value, n, n_bonafide, n_spoof, accuracy with its interval; recalls, balanced accuracy and EER where both labels occur)."""
    blank = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.when(blank(f), "not_applicable").otherwise(F.col(f).cast("string")).alias("value")) for f in fields])
    rows = df.select("label", F.col(score).alias("s"), F.explode(pairs).alias("p")).select("p.*", "label", "s")
    spoof, by = F.col("label") == "spoof", ["field", "value"]
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    m = metrics.confusion(rows, by, "s", spoof).withColumn("n", n).withColumn("interval", metrics.wilson(F.col("tp") + F.col("tn"), n))
    out = m.join(metrics.eer(rows, by, "s", spoof), by, "left")
    return out.select(
        *by, "n", (F.col("tn") + F.col("fp")).alias("n_bonafide"), (F.col("tp") + F.col("fn")).alias("n_spoof"), "accuracy", F.col("interval.low").alias("low"), F.col("interval.high").alias("high"),
        *[F.when(F.col("balanced_accuracy").isNotNull(), F.col(c)).alias(c) for c in ("spoof_recall", "bonafide_recall", "balanced_accuracy", "eer")],
    )


def review_packet(pairs: DataFrame, assets: DataFrame, evidence: DataFrame, protocol: str) -> DataFrame:
    """One row per asset of each exact pair that has evidence, with an annotation id that tells nothing of the label.

    ``pairs`` has (pair, bonafide_id, spoof_id), ``assets`` (sample_id, label, relative_path, audio_sha256, text_hash),
    ``evidence`` (pair, tokens)."""
    ids = pairs.join(evidence, "pair").select("pair", "tokens", F.explode(F.array("bonafide_id", "spoof_id")).alias("sample_id"))
    note = F.sha2(F.concat_ws(":", F.lit(protocol), "pair", "sample_id"), 256)
    return ids.join(assets, "sample_id").select(F.lit(protocol).alias("protocol_id"), note.alias("annotation_id"), "pair", "label", "sample_id", "relative_path", "audio_sha256", "text_hash", "tokens")


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    """Lists as arrays, missing values in them as NaN."""
    flat, edges = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
    for there, begin, end in zip(column.is_valid().to_pylist(), edges, edges[1:], strict=False):
        yield flat[begin:end] if there else None


def _measured(samples: np.ndarray | None, active: np.ndarray | None) -> tuple[float | None, float | None, str | None, str | None]:
    if samples is None or not len(samples):
        return None, None, None, None
    x = samples.astype(np.float64)
    known = np.isfinite(x)
    power = float(np.add.accumulate(np.square(x / 32768.0))[-1]) / len(x) if known.all() else None
    clipped = np.count_nonzero(np.abs(x) >= timeseries.CLIPPED) / len(x)
    return power, clipped, joined_digest(x[known].astype(np.int64)), None if active is None else perceptual.spectral_fingerprint(active)


def measured(waves: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., power, clipped_fraction, digest, fingerprint) of each wave in one pass; all null without samples.

    The digest is the SHA-256 of the samples in decimal with commas between, the print is that of the segments of speech.
    """
    df = waves.select(*keep, "samples", perceptual.active_samples(F.col("samples"), F.col("segments")).alias("active"))
    kind = T.StructType([df.schema[c] for c in keep]).add("power", "double").add("clipped_fraction", "double").add("digest", "string").add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_measured(x, a) for x, a in zip(_arrays(batch.column("samples")), _arrays(batch.column("active")), strict=True)]
            types = (pa.float64(), pa.float64(), pa.string(), pa.string())
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=kind.names)

    return df.mapInArrow(run, kind)


def decoded_and_frozen(waves: DataFrame, history: DataFrame, *, key: str, route: str, rank: str, target: int, threshold: int = perceptual.THRESHOLD, blocks: int | None = None) -> DataFrame:
    """From waveforms to a frozen selection: quality, print, exact and near duplicates, decision, first ``target`` of each route.

    ``waves`` have the key, route, rank, ``samples`` (16-bit), ``segments`` of speech and ``speech_seconds``;
    ``history`` the digest, fingerprint and speech_seconds of former assets.  Every wave comes out with its
    status, flags, digest, fingerprint, decision, n_near (near matches of other digests, former or in the
    pool) and, where it is frozen, its position.  Waves without samples are not ready.
    """
    done = measured(waves, [key, route, rank, "speech_seconds"])
    flags = timeseries.quality_flags(timeseries.decibels(F.col("power")), F.col("clipped_fraction"))
    done = done.withColumn("_r", timeseries.readiness(flags, F.col("speech_seconds"))).select(
        key, route, rank, "speech_seconds",
        F.when(F.col("digest").isNotNull(), F.col("_r.status")).otherwise("rejected_quality").alias("status"),
        F.array_join("_r.flags", ",").alias("flags"), "digest", "fingerprint",
    )
    with arrow_rows(waves.sparkSession, WAVES_AT_ONCE):
        done = stored(done, "decoded")
    every = history.select("digest", "fingerprint", "speech_seconds").unionByName(done.select("digest", "fingerprint", "speech_seconds"))
    n = perceptual.near_counts(done, every, key=key, threshold=threshold, blocks=blocks)
    ready = F.col("status") == "ready"
    made = dedupe.decision(done, history, n, key=key, digest="digest", ready=ready, order=[rank, key])
    out = stored(done.join(made, key), "decided")
    frozen = top_per_stratum(out.where("decision = 'eligible'"), [route], [rank, key], target, "position").select(key, "position")
    return out.join(frozen, key, "left")


Scorer = Callable[[pd.DataFrame], pd.Series]


def scored_once(df: DataFrame, key: str, columns: Sequence[str], scorer: Scorer, batch: int = 256) -> DataFrame:
    """(key, logit): ``scorer`` maps frames of at most ``batch`` rows to one finite number a row.

    A frame that comes back shorter, longer or with anything else fails the task, so every row has one logit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                logit = pd.Series(list(scorer(part[list(columns)])), dtype="float64")
                if len(logit) != len(part) or not logit.map(lambda v: v - v == 0).all():
                    raise ValueError(f"{len(logit)} logits for {len(part)} rows, or some not finite")
                yield pd.DataFrame({key: part[key].to_numpy(), "logit": logit.to_numpy()})

    kind = dict(df.dtypes)[key]
    return df.select(key, *[c for c in columns if c != key]).mapInPandas(run, f"{key} {kind}, logit double")


def not_scored_once(scores: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n_scores) of rows without exactly one score, and of scores without a row."""
    n = scores.groupBy(key).agg(F.count("*").alias("n_scores"))
    known = rows.select(key).distinct().withColumn("_k", F.lit(True))
    return n.join(known, key, "full_outer").where("_k IS NULL OR n_scores IS NULL OR n_scores <> 1").select(key, F.coalesce("n_scores", F.lit(0)).cast("long").alias("n_scores"))


def reported(c: Column, digits: int = 4) -> Column:
    """Half-even rounding of a reported figure."""
    return F.bround(c, digits)


def key_parts(c: Column, prefix: str, sep: str = ":") -> Column:
    """struct<head, tail, last>: what follows ``prefix``, split at its first separator, and its last part."""
    rest = F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c)
    head = F.substring_index(rest, sep, 1)
    return F.struct(head.alias("head"), F.when(rest.contains(sep), F.substring(rest, F.length(head) + len(sep) + 1, F.lit(1 << 30))).alias("tail"), F.substring_index(rest, sep, -1).alias("last"))


Preparer = Callable[[np.ndarray], tuple[np.ndarray, str]]
Detector = Callable[[np.ndarray], Sequence[tuple[int, int]]]


def prepared(df: DataFrame, key: str, samples: str, preparer: Preparer) -> DataFrame:
    """(key, samples, status): what a given ``preparer`` makes of each waveform; its errors are a status, not the job's end."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x in frame[samples]:
                try:
                    made, status = preparer(np.asarray([] if x is None else x))
                    out.append((list(map(int, made)), status))
                except Exception as e:  # noqa: BLE001  whatever the given code raises
                    out.append((None, f"error: {type(e).__name__}"))
            yield pd.DataFrame({key: frame[key].to_numpy(), "samples": [o[0] for o in out], "status": [o[1] for o in out]})

    return df.select(key, samples).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, samples array<int>, status string")


def detected(df: DataFrame, key: str, samples: str, detector: Detector) -> DataFrame:
    """(key, segments, fault): spans of samples that a given ``detector`` finds; they must ascend, not meet and lie inside."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans, faults = [], []
            for x in frame[samples]:
                x = np.asarray([] if x is None else x)
                found = [(int(a), int(b)) for a, b in detector(x)]
                edges = [e for span in found for e in span]
                wrong = edges != sorted(set(edges)) or edges and (edges[0] < 0 or edges[-1] > len(x))
                spans.append([{"start": a, "end": b} for a, b in found])
                faults.append("segments" if wrong else None)
            yield pd.DataFrame({key: frame[key].to_numpy(), "segments": spans, "fault": faults})

    return df.select(key, samples).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, segments array<struct<start:bigint,end:bigint>>, fault string")
