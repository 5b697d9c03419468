"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.operators.prefix import running_sums
from talweg.storage import stored

BINS = 15


def wilson(successes: Column, total: Column, confidence: float = 0.95) -> Column:
    """struct<low, high> clamped to [0, 1]; null for an empty class."""
    z = F.lit(NormalDist().inv_cdf(0.5 + confidence / 2))
    n, k = total.cast("double"), successes.cast("double")
    p = k / n
    base = F.lit(1.0) + z * z / n
    centre = (p + z * z / (n * 2.0)) / base
    half = z * F.sqrt(p * (F.lit(1.0) - p) / n + z * z / (n * n * 4.0)) / base
    return F.when(total > 0, F.struct(F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def confusion(df: DataFrame, by: Sequence[str], logit: str, spoof: Column) -> DataFrame:
    """Counts, recalls and balanced accuracy at the boundary logit >= 0 => spoof; null where a class is absent."""
    said = F.col(logit) >= 0
    g = df.groupBy(*by).agg(
        F.count_if(spoof & said).alias("tp"), F.count_if(~spoof & said).alias("fp"), F.count_if(~spoof & ~said).alias("tn"), F.count_if(spoof & ~said).alias("fn")
    )
    hit, clean = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return g.select(*by, "tp", "fp", "tn", "fn", ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"), hit.alias("spoof_recall"), clean.alias("bonafide_recall"), ((hit + clean) / 2).alias("balanced_accuracy"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibration(df: DataFrame, by: Sequence[str], probability: str, label: Column, bins: int = BINS) -> DataFrame:
    """(by..., n, brier, ece): ECE over equal bins, the last one closed."""
    p, y = F.col(probability), label.cast("double")
    b = F.least(F.floor(p * bins), F.lit(bins - 1))
    g = df.groupBy(*by, b.alias("_b")).agg(F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"), F.sum((p - y) * (p - y)).alias("_s"))
    n = F.sum("_n")
    return g.groupBy(*by).agg(n.alias("n"), (F.sum("_s") / n).alias("brier"), (F.sum(F.abs(F.col("_p") - F.col("_y")) * F.col("_n")) / n).alias("ece"))


def eer(df: DataFrame, by: Sequence[str], score: str, spoof: Column) -> DataFrame:
    """(by..., eer): thresholds at +inf, each score downwards and -inf; least gap, the highest threshold of equal ones."""
    scores = df.groupBy(*by, F.col(score).alias("_t")).agg(F.count_if(spoof).alias("_p"), F.count_if(~spoof).alias("_n"))
    cum = running_sums(scores, by, [F.desc("_t")], {"tp": F.col("_p"), "fp": F.col("_n")}, {"all_p": F.col("_p"), "all_n": F.col("_n")})
    cum = cum.select(*by, "_t", "tp", "fp", "all_p", "all_n")
    start = cum.groupBy(*by).agg(F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"))
    start = start.select(*by, F.lit(float("inf")).alias("_t"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "all_p", "all_n")
    rows = cum.unionByName(start).where("all_p > 0 AND all_n > 0")
    fpr, fnr = F.col("fp") / F.col("all_n"), (F.col("all_p") - F.col("tp")) / F.col("all_p")
    return rows.groupBy(*by).agg(F.min_by((fpr + fnr) / 2, F.struct(F.abs(fpr - fnr), -F.col("_t"))).alias("eer"))


def pair_outcomes(df: DataFrame, by: Sequence[str], pair: str, correct: Column) -> DataFrame:
    """(by..., n_pairs, both, one, neither, both_rate)."""
    g = df.groupBy(*by, pair).agg(F.count_if(correct).alias("_k"), F.count("*").alias("_n")).where("_n = 2")
    n = F.count("*")
    return g.groupBy(*by).agg(n.alias("n_pairs"), F.count_if(F.col("_k") == 2).alias("both"), F.count_if(F.col("_k") == 1).alias("one"), F.count_if(F.col("_k") == 0).alias("neither"), (F.count_if(F.col("_k") == 2) / n).alias("both_rate"))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str = "global_logit") -> DataFrame:
    w = F.sum(weight)
    return df.groupBy(*by).agg(F.when(w > 0, F.sum(F.col(value) * F.col(weight)) / w).alias(name))


def peak_mean(df: DataFrame, by: Sequence[str], value: str, fraction: float = 0.2, least: int = 2, name: str = "peak_logit") -> DataFrame:
    """Mean of the k largest values, k = min(n, max(least, ceil(fraction n)))."""
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value))))
    ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    k = F.least(F.col("_n"), F.greatest(F.lit(least), F.ceil(F.col("_n") * fraction)))
    return ranked.where(F.col("_i") <= k).groupBy(*by).agg(F.avg(value).alias(name))


def strata(label: Column, source: Column, family: Column, voice: Column) -> Column:
    """Strata of a row: bonafide by source, spoof by family and by voice."""
    bonafide = F.array(F.concat(F.lit("source:"), source))
    spoof = F.array(F.concat(F.lit("family:"), family), F.concat(F.lit("voice:"), voice))
    return F.when(label == "bonafide", bonafide).otherwise(spoof)


def stratified(df: DataFrame, keys: Column, correct: Column) -> DataFrame:
    """(stratum, n, n_correct, low, high) over all strata in one pass."""
    g = df.select(F.explode(keys).alias("stratum"), correct.alias("_c")).groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("_c").alias("n_correct"))
    ci = wilson(F.col("n_correct"), F.col("n"))
    return g.select("stratum", "n", "n_correct", ci["low"].alias("low"), ci["high"].alias("high"))


def macro_mean(df: DataFrame, by: str, value: str, name: str = "macro") -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias(name))


def temperature(df: DataFrame, logit: str, label: Column, steps: int = 30) -> float:
    """Temperature that minimises the log loss: Newton steps on log T over counts of distinct (logit, label); T in [1e-3, 1e3]."""
    import math

    counted = df.select(F.col(logit).cast("double").alias("x"), label.cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    counted = stored(counted, "temperature")
    x, y = F.col("x"), F.col("y")
    log_t = 0.0
    for _ in range(steps):
        s = math.exp(-log_t)
        z = x * s
        p = sigmoid(z)
        mean = [F.sum(F.col("n") * v) / F.sum(F.when(v.isNotNull(), F.col("n"))) for v in ((p - y) * -z, p * (1 - p) * z * z + (p - y) * z)]
        row = counted.agg(mean[0].alias("g"), mean[1].alias("h")).first()
        if row is None or row["g"] is None:
            return 1.0
        g, h = row["g"], row["h"]
        move = g / h if h > 1e-12 else math.copysign(0.5, g)
        move = max(-1.0, min(1.0, move))
        log_t = max(math.log(1e-3), min(math.log(1e3), log_t - move))
        if abs(move) < 1e-10:
            break
    return math.exp(log_t)


def nll(df: DataFrame, logit: str, label: Column, t: float) -> float:
    z, y = F.col(logit) / t, label.cast("double")
    return df.agg(F.avg(F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))).alias("v")).first()["v"]
