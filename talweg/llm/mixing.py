"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a share of all words by its weight, stopping at ``cap`` times its own size, the
excess reshared by weight among the rest.  A document's expected copies are ``target / size`` of
its source.  Documents of a source stand in a fixed order (size class, then a keyed hash), the
expected copies are prefix-summed along it, one offset per source is added, and a document is
emitted once per integer boundary that its interval crosses.  As the order goes by size, the words
taken stay near the target.

The prefix sum is dealt out over (source, size class, 256 hash salts): counts per bucket first,
offsets of buckets from those, and row numbers within buckets last, so no source is one task.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own,
last in the order; repeated rows are rows of their own; an empty table gives an empty table; all
further columns of the input pass through ``mix`` whatever their names, and a name for a new column
that the table has already is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talweg.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
WEIGHTS = (1, 2, 3)
CAP = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordered(source: Column, key: Column, size: Column, seed: str) -> Column:
    """Where a row stands: source key, size class (three leading bits) and hash."""
    bits = F.length(F.bin(size))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    top = F.call_function("shiftright", size, F.greatest(bits - 3, F.lit(0)))
    return F.struct(
        F.coalesce(F.concat(F.lit("s"), source), F.lit("t")).alias("source"),
        (bits * 8 + top).cast("int").alias("band"),
        F.substring(hashed, 1, 2).alias("salt"),
        hashed.alias("hash"),
    )


def targets(per_source: DataFrame, weights: Sequence[int] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Water-filled target of each row of (source_key, source_size); one small row per source.

    A source is full when its cap per weight is at most the level that the rest would get.
    """
    by_name = Window.orderBy("source_key")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = per_source.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.sum("source_size").over(every).cast("double").alias("total"),
        F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("used"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("used_w"),
    )
    t = t.withColumn("full", F.col("limit") * (F.col("all_w") - F.col("used_w")) <= (F.col("total") - F.col("used")) * F.col("w"))
    t = t.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(every), F.lit(0.0)))
    t = t.withColumn("left_w", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(every), F.lit(0.0)))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("left") * F.col("w") / F.col("left_w"))
    return t.select("source_key", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    cap: float = CAP,
    seed: str = SEED,
    name: str = "mix_",
) -> DataFrame:
    """The rows of ``docs`` with one struct ``name``: size, source_size, target, copies, taken.

    ``size`` replaces the word count of ``text`` where it is known already.
    """
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")
    n = (n_words(F.col(text)) if size is None else size).cast("long")
    rows = docs.select(F.struct("*").alias("row"), n.alias("n"))
    rows = rows.withColumn("at", _ordered(F.col(f"row.`{source}`"), F.col(f"row.`{key}`"), F.col("n"), seed))
    bucket = [F.col("at.source").alias("source_key"), F.col("at.band").alias("band"), F.col("at.salt").alias("salt")]
    counted = stored(rows.groupBy(*bucket).agg(F.count("*").alias("rows_in"), F.sum("n").alias("words")), "mix-buckets")
    sums = targets(counted.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, cap)
    order = Window.partitionBy("source_key").orderBy("band", "salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("source_key", "band", "salt", F.coalesce(F.sum("rows_in").over(order), F.lit(0)).alias("start"))
    placed = placed.join(sums, "source_key")
    rows = rows.select("row", "n", *bucket, F.col("at.hash").alias("hash"), F.coalesce(F.col(f"row.`{key}`").cast("string"), F.lit("")).alias("k"))
    within = Window.partitionBy("source_key", "band", "salt").orderBy("n", "hash", "k")
    rows = rows.withColumn("i", F.row_number().over(within)).join(placed, ["source_key", "band", "salt"])
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "source_key")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = F.col("start") + F.col("i")
    copies = (F.floor(rate * place + unit) - F.floor(rate * (place - 1) + unit)).cast("int")
    rows = rows.withColumn("copies", copies)
    made = F.struct(F.col("n").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("n")).alias("taken"))
    return rows.select("row.*", made.alias(name))


def emitted(mixed: DataFrame, copy: str = "copy", name: str = "mix_") -> DataFrame:
    """The sample itself: each row of ``mix`` once per copy, numbered from 1 in column ``copy``."""
    if copy in mixed.columns:
        raise ValueError(f"the table has a column {copy} already")
    copies = F.col(f"`{name}`.copies")
    return mixed.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).drop(name)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("n")), "mix-sizes")
    out = mix(sized, size=F.col("n"))
    return out.select("doc_id", *[F.col(f"mix_.{c}").alias(c) for c in ("size", "source_size", "target", "taken", "copies")])


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, length(bin(n)) AS bits FROM d),
f AS (SELECT *, bits * 8 + (n >> greatest(bits - 3, 0)) AS band, substr(h, 1, 2) AS salt FROM e),
s AS (SELECT k, sum(n)::BIGINT AS source_size FROM f GROUP BY k),
w AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT]::DOUBLE AS w,
             source_size * 3.0::DOUBLE AS cap FROM s),
c AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(w) OVER () AS all_w,
             coalesce(sum(cap) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS used_w
      FROM w WINDOW o AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, cap * (all_w - used_w) <= (total - used) * w AS is_full FROM c),
h AS (SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS rest,
             coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (), 0) AS rest_w FROM g),
t AS (SELECT k, source_size, CASE WHEN is_full THEN cap ELSE rest * w / rest_w END AS target FROM h),
p AS (SELECT f.*, source_size, target,
             row_number() OVER (PARTITION BY f.k ORDER BY band, salt, n, h, coalesce(doc_id::VARCHAR, '')) AS i,
             CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('{SEED}/' || f.k), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS u
      FROM f JOIN t USING (k))
SELECT doc_id, n AS size, source_size, target,
       ((floor(rate * i + u) - floor(rate * (i - 1) + u))::BIGINT * n)::BIGINT AS taken,
       (floor(rate * i + u) - floor(rate * (i - 1) + u))::INT AS copies FROM p
"""
QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": ORACLE}
