"""Source records as manifest rows, derived synthetic rows, audits of durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg import schema as S


def manifest_rows(records: DataFrame, assets: DataFrame, given: dict[str, Column | str], key: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """(rows, missing): records with their asset's digest and duration as manifest rows, and those without one.

    ``given`` maps manifest columns to columns or constants; what it leaves out is blank."""
    both = records.join(assets.select(key, F.col("sha256").alias("_sha"), F.col("duration_s").alias("_dur")), key, "left")
    values: dict[str, Column] = {"sha256": F.col("_sha"), "duration_s": F.col("_dur").cast("string"), key: F.col(key)}
    values |= {c: v if isinstance(v, Column) else F.lit(v) for c, v in given.items()}
    rows = both.where("_sha IS NOT NULL").select(*[values.get(c, F.lit("")).cast("string").alias(c) for c in S.MANIFEST.names])
    return rows, both.where("_sha IS NULL").select(key)


def derived_spoof(base: DataFrame, outputs: DataFrame, generator: dict[str, Column | str], key: str = "sample_id", suffix: str = "-spoof") -> DataFrame:
    """Synthetic rows that keep the base row's text, group and language and take the output's file."""
    made = outputs.select(key, F.col("relative_path").alias("_path"), F.col("sha256").alias("_sha"), F.col("duration_s").cast("string").alias("_dur"))
    new = {"sample_id": F.concat(F.col(key), F.lit(suffix)), "relative_path": F.col("_path"), "sha256": F.col("_sha"), "duration_s": F.col("_dur"), "label": F.lit("spoof")}
    new |= {c: v if isinstance(v, Column) else F.lit(v) for c, v in generator.items()}
    return base.join(made, key).select(*[new.get(c, F.col(c)).alias(c) for c in S.MANIFEST.names])


def duration_audit(df: DataFrame, by: Sequence[str], seconds: str, digest: str, scale: int = 6) -> DataFrame:
    """(by..., n_files, n_digests, total, least, median, most) with exact decimal sums."""
    d = F.col(seconds).cast(f"decimal(18,{scale})")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_files"), F.countDistinct(digest).alias("n_digests"), F.sum(d).alias("total"), F.min(d).alias("least"), F.percentile(d, 0.5).alias("median"), F.max(d).alias("most")
    )


def selected_members(names: DataFrame, chosen: DataFrame, key: str = "member") -> DataFrame:
    """Archive members whose metadata was chosen; join this before any content is read."""
    return names.join(chosen.select(key).distinct(), key, "left_semi")
