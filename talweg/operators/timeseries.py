"""Activity islands, gap merging, sliding windows and signal quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIPPED = 32700
FLOOR = 1e-12


def islands(frames: DataFrame, by: Sequence[str], index: str, active: str) -> DataFrame:
    """(by..., first, last) of runs of consecutive active frames."""
    w = Window.partitionBy(*by).orderBy(index)
    on = frames.where(F.col(active)).withColumn("_run", F.col(index) - F.row_number().over(w))
    return on.groupBy(*by, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last")).drop("_run")


def segments(runs: DataFrame, by: Sequence[str], frame: int, total: Column, last_frame: Column) -> DataFrame:
    """(by..., start, end) in samples; a run that reaches the final frame extends to the total."""
    end = F.when(F.col("last") >= last_frame, total).otherwise((F.col("last") + 1) * frame)
    return runs.select(*by, (F.col("first") * frame).alias("start"), end.alias("end"))


def merged_segments(spans: DataFrame, by: Sequence[str], gap: int | Column, shortest: int | Column) -> DataFrame:
    """(by..., start, end): spans whose gap to the one before is at most ``gap`` are joined, short ones dropped."""
    w = Window.partitionBy(*by).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(w) <= gap, 0).otherwise(1)
    out = spans.withColumn("_new", new).withColumn("_s", F.sum("_new").over(w))
    out = out.groupBy(*by, "_s").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_s")
    return out.where(F.col("end") - F.col("start") >= shortest)


def sliding_windows(spans: DataFrame, by: Sequence[str], length: int, hop: int) -> DataFrame:
    """Distinct (by..., start, end): windows at each hop and one aligned to the right end; short spans give one."""
    a, b = F.col("start"), F.col("end")
    starts = F.when(b - a <= length, F.array(a)).otherwise(F.array_union(F.sequence(a, F.greatest(b - length, a), F.lit(hop)), F.array(b - length)))
    out = spans.select(*by, "end", F.explode(starts).alias("start"))
    return out.select(*by, "start", F.least(F.col("end"), F.col("start") + length).alias("end")).distinct()


def quality(samples: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., n, peak, rms_dbfs, clipped_fraction, dc_offset) of int16 samples in rows."""
    x = F.col(value).cast("double") / 32768.0
    power = F.avg(x * x)
    return samples.groupBy(*by).agg(
        F.count(value).alias("n"),
        F.max(F.abs(x)).alias("peak"),
        (F.log10(F.greatest(F.sqrt(power), F.lit(FLOOR))) * 20).alias("rms_dbfs"),
        F.avg(F.when(F.abs(F.col(value)) >= CLIPPED, 1.0).otherwise(0.0)).alias("clipped_fraction"),
        F.avg(x).alias("dc_offset"),
    )


def decibels(power: Column) -> Column:
    """Of full scale, from a mean square."""
    return F.log10(F.greatest(F.sqrt(power), F.lit(FLOOR))) * 20


def array_quality(samples: Column) -> Column:
    """The same of one array column, as a struct."""
    x = F.transform(samples, lambda v: v.cast("double") / 32768.0)
    n = F.size(samples)
    power = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / n
    clipped = F.size(F.filter(samples, lambda v: F.abs(v) >= CLIPPED)) / n
    return F.struct(
        F.array_max(F.transform(x, F.abs)).alias("peak"),
        (F.log10(F.greatest(F.sqrt(power), F.lit(FLOOR))) * 20).alias("rms_dbfs"),
        clipped.alias("clipped_fraction"),
        (F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n).alias("dc_offset"),
    )


# The quality policy.
QUIET_DBFS, CLIPPED_SHARE, LEAST_SPEECH = -55.0, 0.02, 2.5


def quality_flags(rms_dbfs: Column, clipped_fraction: Column) -> Column:
    """Ordered array of flags."""
    return F.array_compact(
        F.array(
            F.when(rms_dbfs < QUIET_DBFS, "signal_too_quiet"),
            F.when(clipped_fraction > CLIPPED_SHARE, "excessive_clipping"),
        )
    )


def readiness(flags: Column, speech_seconds: Column) -> Column:
    """struct<status, flags>: bad quality rejects, then too little speech, which is a flag of its own."""
    little = F.coalesce(speech_seconds, F.lit(0.0)) < LEAST_SPEECH
    status = F.when(F.size(flags) > 0, "rejected_quality").when(little, "insufficient_speech").otherwise("ready")
    return F.struct(status.alias("status"), F.when(status == "insufficient_speech", F.array(F.lit("insufficient_speech"))).otherwise(flags).alias("flags"))


def prepared_results(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Reported results: status, flags, seconds and decibels to 3 places, shares to 6, ties to even."""
    done = readiness(quality_flags(F.col("rms_dbfs"), F.col("clipped_fraction")), F.col("speech_seconds"))
    rounded = [F.bround(c, d).alias(c) for c, d in (("speech_seconds", 3), ("rms_dbfs", 3), ("peak", 6), ("clipped_fraction", 6), ("dc_offset", 6))]
    return df.withColumn("_done", done).select(*keep, F.col("_done.status").alias("status"), F.array_join("_done.flags", ",").alias("flags"), *rounded)


def energy_active(rms_dbfs: Column, threshold: float = -45.0) -> Column:
    return rms_dbfs >= threshold


def cropped(samples: Column, length: int, start: Column | int = 0) -> Column:
    """Exactly ``length`` values: cut from ``start``, or the whole repeated to fill."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.size(samples)
    copies = F.ceil(F.lit(length) / F.greatest(n, F.lit(1))).cast("int")
    longer = F.flatten(F.array_repeat(samples, copies))
    return F.when(n >= length, F.slice(samples, start + 1, F.lit(length))).otherwise(F.slice(longer, 1, length))
