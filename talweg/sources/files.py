"""Whole files looked at without holding them: discovery by header, record structure, Parquet footers.

Files are listed by Spark and opened by their address in tasks, one file at a time, in chunks.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.sources.archives import CHUNK, _opened, archives


class _Counted(io.RawIOBase):
    """A stream that hashes and counts what is read from it."""

    def __init__(self, f):
        self.f, self.hash, self.n = f, hashlib.sha256(), 0

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.f.read(len(buffer))
        buffer[: len(data)] = data
        self.hash.update(data)
        self.n += len(data)
        return len(data)


def _records(address: str, sep: str) -> Iterator[tuple[int, list[str], _Counted]]:
    """(number from 1, fields, stream) of every record of a CSV file; quoted separators and line breaks are fields' own."""
    system, path = _opened(address)
    with system.open_input_stream(path) as f:
        counted = _Counted(f)
        text = io.TextIOWrapper(io.BufferedReader(counted, CHUNK), encoding="utf-8-sig", errors="strict", newline="")
        for i, fields in enumerate(csv.reader(text, delimiter=sep), 1):
            if fields:
                yield i, fields, counted


def _per_file(found: DataFrame, rows_of: Callable[[str], Iterator[tuple]], schema: str, types: Sequence[pa.DataType]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for address in b.column(0).to_pylist():
                out: list[tuple] = []
                for row in rows_of(address):
                    out.append((address, *row))
                    if len(out) == 5_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return found.select("archive").repartition("archive").mapInArrow(run, schema)


def discovered(spark: SparkSession, folder: str, required: Sequence[str], pattern: str = "*.csv", sep: str = ",") -> DataFrame:
    """(path, sha256, length, rows) of files whose header has all required columns; of others only the header is read.

    ``rows`` are the records after the header.  A file that is no text has no header.
    """
    need = set(required)

    def look(address: str) -> Iterator[tuple]:
        n, stream = 0, None
        try:
            for _, fields, stream in _records(address, sep):
                if n == 0 and not need <= set(fields):
                    return
                n += 1
        except (UnicodeDecodeError, csv.Error):
            return
        if n:
            yield stream.hash.hexdigest(), stream.n, n - 1

    return _per_file(archives(spark, folder, pattern), look, "path string, sha256 string, length bigint, rows bigint", [pa.string(), pa.string(), pa.int64(), pa.int64()])


def structural_faults(spark: SparkSession, folder: str, sep: str = ",", pattern: str = "*") -> DataFrame:
    """(path, record, n_fields) of records that have not as many fields as their file's header; a broken file has one with -1."""

    def look(address: str) -> Iterator[tuple]:
        width = None
        try:
            for i, fields, _ in _records(address, sep):
                width = len(fields) if width is None else width
                if len(fields) != width:
                    yield i, len(fields)
        except (UnicodeDecodeError, csv.Error):
            yield -1, -1

    return _per_file(archives(spark, folder, pattern), look, "path string, record bigint, n_fields bigint", [pa.string(), pa.int64(), pa.int64()])


# ---- Parquet footers ---------------------------------------------------------------------------------


def footers(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, rows, row_groups, columns, metadata, fault) of every Parquet file, from its footer alone.

    ``columns`` are ``name:type`` in order, ``metadata`` the key-value pairs without those of writers
    (``ARROW:``, ``org.apache.spark.``, ``pandas``, ``huggingface`` stay).
    """

    def look(address: str) -> Iterator[tuple]:
        system, path = _opened(address)
        try:
            with system.open_input_file(path) as f:
                meta = pq.read_metadata(f)
            pairs = {k.decode(): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items() if not k.startswith((b"ARROW:", b"org.apache.spark."))}
            schema = meta.schema.to_arrow_schema()
            yield meta.num_rows, meta.num_row_groups, [f"{c.name}:{c.type}" for c in schema], json.dumps(pairs, sort_keys=True), None
        except (pa.ArrowException, OSError) as x:
            yield None, None, None, None, f"unreadable: {type(x).__name__}"

    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string()]
    return _per_file(archives(spark, folder, pattern), look, "path string, rows bigint, row_groups bigint, columns array<string>, metadata string, fault string", types)


def release_faults(found: DataFrame, columns: Sequence[str], metadata: dict[str, str] | None = None, files: int | None = None, rows: int | None = None) -> DataFrame:
    """(path, fault) of a release of Parquet files that must have exactly these columns, types and metadata.

    Faults of single files bear their path; ``files`` and ``rows``, if given, are of all together, and so
    is ``mixed`` (several schemas in one release): those have a null path.
    """
    want = F.array(*[F.lit(c) for c in columns])
    tests = [
        (F.col("fault").isNotNull(), F.col("fault")),
        (F.size(F.array_except(want, "columns")) > 0, F.concat(F.lit("columns missing: "), F.array_join(F.array_except(want, "columns"), ","))),
        (F.size(F.array_except("columns", want)) > 0, F.concat(F.lit("columns not expected: "), F.array_join(F.array_except("columns", want), ","))),
        ((F.size(F.array_except(want, "columns")) == 0) & (F.size(F.array_except("columns", want)) == 0) & (F.col("columns") != want), F.lit("order of columns")),
    ]
    for k, v in (metadata or {}).items():
        tests.append((F.col("fault").isNull() & ~F.get_json_object("metadata", f"$['{k}']").eqNullSafe(F.lit(v)), F.lit(f"metadata: {k}")))
    each = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in tests]), lambda x: x.isNotNull())
    single = found.select("path", F.explode(each).alias("fault"))
    total = found.agg(F.count("*").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.countDistinct("columns").alias("kinds"))
    whole = [(F.col("kinds") > 1, F.lit("mixed"))]
    if files is not None:
        whole.append((F.col("files") != files, F.concat(F.lit("files: "), F.col("files"))))
    if rows is not None:
        whole.append((F.col("rows") != rows, F.concat(F.lit("rows: "), F.col("rows"))))
    together = total.select(F.lit(None).cast("string").alias("path"), F.explode(F.filter(F.array(*[F.when(c, m) for c, m in whole]), lambda x: x.isNotNull())).alias("fault"))
    return single.unionByName(together)
