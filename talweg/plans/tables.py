"""Views over the given tables that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.functions.keys import split_of, unit_hash
from talweg.functions.text import ascii_collapsed

SEED = "20260808"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manifest rows; columns that a query does not use are pruned from the scan."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = d.join(labels.select("doc_id", "quality"), "doc_id", "left").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("sample_id"),
        F.sha2("text", 256).alias("sha256"),
        F.sha2(ascii_collapsed(F.col("text")), 256).alias("text_hash"),
        F.col("lang").alias("language"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("grp:"), F.floor(F.col("doc_id") / 4)).alias("parent_group_id"),
        F.concat(F.lit("spk:"), F.floor(F.col("doc_id") / 8)).alias("speaker_pseudo_id"),
        F.when(F.col("quality") == 1, "bonafide").when(F.col("quality") == 0, "spoof").otherwise("unlabelled").alias("label"),
        "doc_id",
        "n_chars",
    )
    out = out.withColumn("u", unit_hash(SEED, F.col("sample_id")))
    return out.withColumn("split", split_of(F.col("u")))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a made-up detector logit, label, language and pair."""
    o = table(spark, sf_dir, "orders")
    spoof = F.col("o_orderkey") % 3 == 0
    logit = ((F.col("o_orderkey") * 7919) % 2001 - 1000).cast("double") / 250.0 + F.when(spoof, 1.0).otherwise(-1.0)
    return o.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("language"),
        F.when(spoof, "spoof").otherwise("bonafide").alias("label"),
        logit.alias("logit"),
        F.floor(F.col("o_orderkey") / 2).alias("pair"),
        F.concat(F.lit("fam"), F.col("o_orderkey") % 5).alias("family"),
        F.concat(F.lit("voice"), F.col("o_orderkey") % 7).alias("voice"),
        F.concat(F.lit("src"), F.col("o_orderkey") % 4).alias("source"),
    )


SCORED = """o AS (SELECT o_orderkey, o_orderpriority AS language, CASE WHEN o_orderkey % 3 = 0 THEN 'spoof' ELSE 'bonafide' END AS label,
  ((o_orderkey * 7919) % 2001 - 1000)::DOUBLE / 250.0::DOUBLE + (CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS logit,
  o_orderkey // 2 AS pair, 'fam' || (o_orderkey % 5) AS family, 'voice' || (o_orderkey % 7) AS voice, 'src' || (o_orderkey % 4) AS source FROM orders)"""
