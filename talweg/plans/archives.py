"""Queries on archives, which Spark writes from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.plans.registry import query
from talweg.plans.tables import table
from talweg.sources import archives, files
from talweg.storage import folder, stored

S = SparkSession


def _members(spark: S, sf_dir: str) -> DataFrame:
    """A record and a text for each document in one of 16 folders; every fiftieth lacks its text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    stem = F.concat((F.col("doc_id") % 16).cast("string"), F.lit("/"), F.col("doc_id").cast("string"))
    record = F.struct(F.concat(stem, F.lit(".json")).alias("member"), F.concat(F.lit('{"id":'), F.col("doc_id"), F.lit("}")).cast("binary").alias("content"))
    text = F.struct(F.concat(stem, F.lit(".txt")).alias("member"), F.col("text").cast("binary").alias("content"))
    return d.select(F.inline(F.when(F.col("doc_id") % 50 == 0, F.array(record)).otherwise(F.array(record, text))))


MEMBERS = """m AS (SELECT doc_id % 16 AS folder, '{"id":' || doc_id || '}' AS content, 'json' AS kind, doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id % 16, coalesce(text, ''), 'txt', doc_id FROM documents WHERE doc_id % 50 <> 0)"""


@query(
    f"""WITH {MEMBERS}
SELECT folder, count(*)::BIGINT AS n_members, sum(strlen(content))::BIGINT AS n_bytes, count(*) FILTER (kind = 'json' AND doc_id % 50 <> 0)::BIGINT AS n_complete,
  count(*) FILTER (kind = 'json' AND doc_id % 50 = 0)::BIGINT AS n_incomplete, count(*) FILTER (kind = 'txt' AND content <> '')::BIGINT AS n_same_text,
  count(*) FILTER (content = '')::BIGINT AS n_faults FROM m GROUP BY folder"""
)
def archive_membership(spark: S, sf_dir: str) -> DataFrame:
    """TARs of all documents read by byte range: members, pairs, contents against the table, faults of membership."""
    made = archives.write_tars(_members(spark, sf_dir), folder(spark, "tars"))
    index = archives.member_index(made.select(F.explode("parts").alias("archive")))
    in_folder = F.substring_index("member", "/", 1).cast("long").alias("folder")
    by = index.groupBy(in_folder).agg(F.count("*").alias("n_members"), F.sum("size").alias("n_bytes"))
    pairs = archives.paired_members(index, ".json", ".txt").groupBy(F.substring_index("stem", "/", 1).cast("long").alias("folder"))
    pairs = pairs.agg(F.count_if("complete").alias("n_complete"), F.count_if(~F.col("complete")).alias("n_incomplete"))
    texts = archives.member_contents(index, [".txt"]).where("fault IS NULL AND size > 0")
    texts = texts.select(in_folder, F.regexp_extract("member", r"/(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.sha2("content", 256).alias("digest"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    same = texts.join(d, ["doc_id", "digest"]).groupBy("folder").agg(F.count("*").alias("n_same_text"))
    faults = archives.membership_faults(index, r"\d+/\d+\.(json|txt)").groupBy(in_folder).agg(F.count("*").alias("n_faults"))
    out = by.join(pairs, "folder").join(same, "folder", "left").join(faults, "folder", "left")
    return out.fillna(0, ["n_same_text", "n_faults"])


@query(f"""WITH {MEMBERS} SELECT folder, kind, count(*)::BIGINT AS n_members, sum(strlen(content))::BIGINT AS n_bytes, count(DISTINCT sha256(content))::BIGINT AS n_digests FROM m GROUP BY ALL""")
def archive_streams(spark: S, sf_dir: str) -> DataFrame:
    """Compressed TARs of all documents in parts of 100 KB, each read as one hashed stream; nothing if a part or a digest is amiss."""
    made = archives.write_tars(_members(spark, sf_dir), folder(spark, "streams"), compressed=True, part_bytes=100_000)
    parts = [r["parts"] for r in made.select("parts").collect()]  # one short row an archive
    rows = archives.read_tar_stream(spark, parts).where("kind <> 'archive' OR fault IS NOT NULL")
    kind, in_folder = F.substring_index("name", ".", -1).alias("kind"), F.substring_index("name", "/", 1).cast("long").alias("folder")
    members = rows.where("kind = 'member' OR fault IS NOT NULL")
    return members.groupBy(in_folder, kind).agg(F.count("*").alias("n_members"), F.sum("size").alias("n_bytes"), F.countDistinct("sha256").alias("n_digests"))


@query(
    """SELECT count(*)::BIGINT AS n_rows, 'doc_id:int64,text:string,lang:string,source:string,n_chars:int64' AS columns, 0::BIGINT AS n_faults,
  'columns missing: item_id:int64|columns not expected: doc_id:int64,source:string,n_chars:int64' AS as_another FROM documents"""
)
def parquet_release(spark: S, sf_dir: str) -> DataFrame:
    """The documents written as a release of parts: rows and columns from the footers alone, no fault as itself, the right ones as another release."""
    at = f"{folder(spark, 'release')}/parts"
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(at)
    found = stored(files.footers(spark, at), "footers")
    columns = ["doc_id:int64", "text:string", "lang:string", "source:string", "n_chars:int64"]
    own = files.release_faults(found, columns).agg(F.count("*").alias("n_faults"))
    other = files.release_faults(found, ["item_id:int64", "text:string", "lang:string"]).agg(F.array_join(F.array_sort(F.collect_set("fault")), "|").alias("as_another"))
    kinds = F.array_join(F.array_sort(F.collect_set(F.array_join("columns", ","))), "|")
    return found.agg(F.sum("rows").alias("n_rows"), kinds.alias("columns")).crossJoin(own).crossJoin(other)


@query("""SELECT source AS name, count(*)::BIGINT AS n_rows, 0::BIGINT AS n_faults FROM documents WHERE source IS NOT NULL GROUP BY ALL""")
def discovered_tables(spark: S, sf_dir: str) -> DataFrame:
    """The documents written as CSV files by source, next to files without their columns: found by header, counted by record, whatever line breaks texts hold."""
    at = folder(spark, "csv")
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "text", F.col("source").alias("name"), "source")
    write = lambda df, name: df.write.partitionBy("source").option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{at}/{name}")
    write(d, "texts")
    write(d.select("doc_id", "source"), "others")
    name = F.url_decode(F.regexp_extract("path", "/source=([^/]*)/", 1)).alias("name")
    found = files.discovered(spark, at, ["doc_id", "text", "name"]).groupBy(name).agg(F.sum("rows").alias("n_rows"))
    faults = files.structural_faults(spark, f"{at}/texts", pattern="*.csv").groupBy(name).agg(F.count("*").alias("n_faults"))
    return found.join(faults, "name", "left").fillna(0, ["n_faults"])
