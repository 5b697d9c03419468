"""The corpus pipeline: each stage takes what its predecessor kept, as a table like documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm import decontam, mixing, ngram_join, pii, quality
from talweg.storage import stored


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or with as many ``_`` as make it none of the table's columns."""
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores at its threshold or above.

    Null and empty texts are scored as an empty text; rows with a null doc_id are kept or not like any
    other, repeated rows alike; further columns pass through; an empty table gives an empty table, and
    without labels of both classes everything is kept (every score is 0.5).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality.fitted(docs, labels, allowed=~quality.held_out(F.col("doc_id")))
    return quality.kept(docs, net)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones: the one with the smallest doc_id.

    Rows with a null doc_id stay.  An id that stands once with a smaller one in its component goes.  Where
    an id stands with several texts, each text is decided for itself: it goes if its component has a
    smaller id; equal rows of a text that stays leave one.  Null and empty texts are similar to nothing;
    further columns pass through; an empty table gives an empty table.
    """
    held, keep = _free(docs, "text_"), docs.columns
    rows = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"))
    ids = stored(rows.where("rows > 1").select("doc_id"), "stage-near-ids")
    classes = stored(ngram_join.near_duplicates(docs, with_text_hash=True), "stage-near-classes")
    first = classes.join(ids, "doc_id", "left_anti").where("component_id <> doc_id").select("doc_id")
    alone = docs.join(ids, "doc_id", "left_anti").join(first, "doc_id", "left_anti").select(*keep)
    again = classes.join(ids, "doc_id", "left_semi").where("component_id = doc_id").select("doc_id", F.col("text_hash").alias(held)).distinct()
    several = docs.join(ids, "doc_id", "left_semi").withColumn(held, F.coalesce(F.sha2("text", 256), F.lit("")))
    several = several.join(again, ["doc_id", held], "left_semi").dropDuplicates(["doc_id", held]).select(*keep)
    return alone.unionByName(several)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none; repeated rows, null ids and further columns pass through; an empty
    table gives an empty table, and without items every document stays.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars follows the text.

    Null texts stay null and have null n_chars; repeated rows are changed alike; further columns pass
    through whatever their names; an empty table gives an empty table.
    """
    out = pii.pseudonymised(docs, key=pii.key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sample: documents once per copy that the mix takes, numbered in ``copy``.

    Null and empty texts have size 0 and stand in the sample as often as their place says; a null source
    is one of its own; repeated rows are rows of their own; where the table has a column ``copy``, the
    new one gets a ``_`` more; an empty table gives an empty table.
    """
    name = _free(docs, "mix_")
    return mixing.emitted(mixing.mix(docs, name=name), copy=_free(docs, "copy"), name=name)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The classifier and the pseudonyms have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
