"""Explicit-schema readers and write-once publication."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import wave
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg import schema as S


def _strings_filled(df: DataFrame) -> DataFrame:
    """Missing is the empty string throughout, never null."""
    return df.na.fill("", [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Names in a CSV file's first line, by Spark's reader."""
    return spark.read.option("sep", sep).option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, *, exact: bool = True, sep: str = ",") -> DataFrame:
    """CSV by header: exactly the schema's columns, or a superset of them; RFC quoting, blanks as ""."""
    names = header_of(spark, path if isinstance(path, str) else path[0], sep)
    names[0] = names[0].lstrip("﻿")
    if names != schema.names if exact else not set(schema.names) <= set(names):
        raise ValueError(f"header of {path}: {names}")
    given = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(given).option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return _strings_filled(df.select(*schema.names))


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_csv(spark, path, S.MANIFEST, exact=False)


def unique_rows(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df`` if no key stands twice; else an error that names some."""
    again = [r[key] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if again:
        raise ValueError(f"{what}: repeated {key}: {again}")
    return df


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; every source stands once."""
    return unique_rows(read_csv(spark, path, S.LEDGER), "source_id", path)


def read_consents(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.CONSENT)


def numbered(df: DataFrame, name: str = "row_number", start: int = 2) -> DataFrame:
    """File row numbers of a frame read from one file; rows stay in their partitions.

    Rows are counted per partition and each goes on from the counts before it; one small row per partition
    is what meets in one task."""
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = df.withColumn("_part", F.spark_partition_id()).withColumn("_within", within)
    per = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_within") + start).alias(name))


def manifest_report(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, issue) of one manifest file: row issues, and repeated sample ids; rows of the file count from 1, the header too."""
    from talweg.operators.validation import manifest_issues

    rows = numbered(read_manifest(spark, path))
    first = rows.groupBy("sample_id").agg(F.min("row_number").alias("_first"))
    again = rows.join(first, "sample_id").where("row_number > _first AND sample_id <> ''").select("row_number", F.lit("sample_id: repeated").alias("issue"))
    return rows.select("row_number", F.explode(manifest_issues()).alias("issue")).unionByName(again)


def write_manifest(rows: DataFrame, path: str) -> str:
    """One CSV file in the fixed column order and the order (language, label, sample_id), from rows without issues.

    It is staged, read back and renamed; a manifest is a list of rows of bounded length."""
    from talweg.operators.validation import issues_of, manifest_issues, require_empty

    rows = rows.select(*S.MANIFEST.names)
    require_empty(issues_of(rows, manifest_issues(), "sample_id"), path)
    return _csv_once(rows.orderBy("language", "label", "sample_id"), path, lambda staged: read_manifest(rows.sparkSession, staged))


def write_ledger_snapshot(ledger: DataFrame, source_ids: Sequence[str], path: str) -> list[str]:
    """The ledger's rows of these sources, sorted, as one CSV file that must not exist; every source must be known, once."""
    wanted = sorted(set(source_ids))
    if not wanted:
        raise ValueError("a ledger snapshot needs sources")
    rows = ledger.select(*S.LEDGER.names).where(F.col("source_id").isin(wanted))
    known = [r["source_id"] for r in rows.select("source_id").orderBy("source_id").collect()]  # as many as asked for
    if known != wanted:
        raise ValueError(f"missing or repeated sources: {sorted(set(wanted) ^ set(known)) or known}")
    _csv_once(rows.orderBy("source_id"), path, lambda staged: read_ledger(ledger.sparkSession, staged))
    return wanted


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _csv_once(rows: DataFrame, path: str, read) -> str:
    """Write one CSV file beside ``path``, compare what ``read`` gets from it, rename it; returns its digest."""
    spark = rows.sparkSession
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} already exists")
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    try:
        rows.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(stage)
        (part,) = [s.getPath() for s in fs.globStatus(_file_system(spark, f"{stage}/part-*.csv")[1])]
        if rows.exceptAll(read(part.toString())).count() or read(part.toString()).exceptAll(rows).count():
            raise OSError(f"{path}: read back with differences")
        digest = files(spark, part.toString()).select(F.sha2("content", 256)).first()[0]
        if not fs.rename(part, target):
            raise OSError(f"cannot publish {path}")
        return digest
    finally:
        fs.delete(_file_system(spark, stage)[1], True)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, *, header: bool = True, quoted: bool = True) -> DataFrame:
    """TSV with RFC quotes, or with quotes taken literally."""
    r = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", '"' if quoted else "")
    return _strings_filled(r.option("escape", '"' if quoted else "").csv(path))


def referenced_manifests(document: str, key: str = "manifest") -> list[str]:
    """Values under a key anywhere in a JSON document, in order, each once."""
    out: list[str] = []

    def walk(x: object) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                out.append(v) if k == key and isinstance(v, str) else walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(json.loads(document))
    return list(dict.fromkeys(out))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet with exactly these names and types."""
    df = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError(f"schema of {path}: {df.schema.simpleString()}")
    return df


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "length", "content")


def verified_assets(rows: DataFrame, assets: DataFrame, relative: Column, verify: bool = True) -> DataFrame:
    """(sample_id, issue) of rows whose file is missing or has another digest.

    ``assets`` comes from ``files``; ``relative`` maps its path to the manifest's relative_path."""
    have = assets.select(relative.alias("relative_path"), F.sha2("content", 256).alias("_sha"))
    both = rows.select("sample_id", "relative_path", "sha256").join(have, "relative_path", "left")
    issue = F.when(F.col("_sha").isNull(), "missing").when(F.lit(verify) & (F.lower("sha256") != F.col("_sha")), "digest differs")
    return both.select("sample_id", issue.alias("issue")).where("issue IS NOT NULL")


@F.pandas_udf(T.StructType([T.StructField("samples", T.ArrayType(T.ShortType())), T.StructField("rate", T.IntegerType()), T.StructField("error", T.StringType())]))
def pcm16_mono(content: pd.Series) -> pd.DataFrame:
    """Samples of canonical WAV bytes; anything else gives an error."""
    out = []
    for b in content:
        try:
            with wave.open(io.BytesIO(b)) as w:
                if (w.getnchannels(), w.getsampwidth()) != (1, 2):
                    raise ValueError("not 16-bit mono")
                out.append((np.frombuffer(w.readframes(w.getnframes()), dtype="<i2"), w.getframerate(), None))
        except (wave.Error, ValueError, EOFError, TypeError) as x:
            out.append((None, None, str(x) or type(x).__name__))
    return pd.DataFrame(out, columns=["samples", "rate", "error"])


def published(df: DataFrame, path: str, faults: DataFrame | None = None, key: str | None = None) -> str:
    """Write once: nothing is written if there are faults or the target exists; returns the fingerprint."""
    return published_together({path: df}, {path: faults} if faults is not None else None, {path: key} if key else None)[path]


def published_together(frames: dict[str, DataFrame], faults: dict[str, DataFrame] | None = None, keys: dict[str, str] | None = None) -> dict[str, str]:
    """Several tables, all or none: each is staged beside its target, read back and given a receipt, then all are
    renamed; if a rename fails, the targets renamed before go again.  No target may exist."""
    from talweg.operators.validation import require_empty

    for path, found in (faults or {}).items():
        require_empty(found, path)
    spark = next(iter(frames.values())).sparkSession
    for path in frames:
        fs, target = _file_system(spark, path)
        if fs.exists(target):
            raise FileExistsError(f"{path} already exists")
    run, receipts, moved = uuid.uuid4().hex, {}, []
    try:
        for path, df in frames.items():
            key = (keys or {}).get(path)
            (df.orderBy(key) if key else df).write.mode("errorifexists").parquet(f"{path}.stage-{run}/data")
            back = spark.read.schema(df.schema).parquet(f"{path}.stage-{run}/data")
            n, mark = back.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first()
            receipts[path] = json.dumps({"rows": n, "mark": mark}, sort_keys=True, separators=(",", ":"))
            spark.createDataFrame([(receipts[path],)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}.stage-{run}/_receipt")
        for path in frames:
            fs, target = _file_system(spark, path)
            if fs.exists(target) or not fs.rename(_file_system(spark, f"{path}.stage-{run}")[1], target):
                raise OSError(f"cannot publish {path}")
            moved.append(path)
    except BaseException:
        for path in moved:
            fs, target = _file_system(spark, path)
            fs.delete(target, True)
        raise
    finally:
        for path in frames:
            fs, stage = _file_system(spark, f"{path}.stage-{run}")
            fs.delete(stage, True)
    return receipts


def write_once_json(spark: SparkSession, path: str, value: object) -> str:
    """A small JSON document, sorted and compact, at a path of any store that must not exist; returns its digest."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    fs, target = _file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} already exists")
    out = fs.create(target, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return hashlib.sha256(text.encode()).hexdigest()
