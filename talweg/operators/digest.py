"""SHA-256 over the ordered rows of groups of any size.

A digest of a sequence cannot be combined from digests of its parts, so whoever hashes a group must see
all of it in order.  Here no group stands in one row: rows are dealt by range of (group, order), so a
large group lies in many parts, which join their rows to pieces of bounded size; then the pieces of each
group are streamed in order through one hash.  That stream reads only the joined bytes and holds one
piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.keys import canonical_json

PIECE = 1 << 20


def sequential_sha256(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], text: Column, separator: str = "", opening: str = "", closing: str = "") -> DataFrame:
    """``by``, n_rows and sha256 (lowercase hex) of ``opening``, the rows' texts with ``separator`` between, ``closing``.

    ``order`` should tell rows apart or leave equal texts next to each other; a null text is empty, a null
    group is a group of its own, an empty table has no groups.
    """
    n, sep = len(by), separator.encode()
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    names = [f"o{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], *[k.alias(o) for k, o in zip(keys, names, strict=True)], F.coalesce(text, F.lit("")).alias("t"))
    groups = [f"b{i}" for i in range(n)]
    sorted_rows = rows.repartitionByRange(*groups, *names).sortWithinPartitions(*groups, *names).select(*groups, "t")
    kinds = [f"b{i} {df.schema[b].dataType.simpleString()}" for i, b in enumerate(by)]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, piece, count, group = TaskContext.get().partitionId(), [], 0, 0, 0, None
        out: list[tuple] = []

        def flush() -> None:
            nonlocal held, size, piece, count
            if held:
                out.append((*group, part, piece, count, sep.join(held)))
                held, size, piece, count = [], 0, piece + 1, 0

        for b in batches:
            types = [b.schema.field(i).type for i in range(n)]
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                own, raw = row[:n], row[n].encode("utf-8", "surrogatepass")
                if own != group:
                    flush()
                    group, piece = own, 0
                held.append(raw)
                size, count = size + len(raw), count + 1
                if size >= PIECE:
                    flush()
            if len(out) >= 1000 or sum(len(o[-1]) for o in out) > 4 * PIECE:
                yield batch_of(out, types)
                out.clear()
        flush()
        if out:
            yield batch_of(out, types)

    def batch_of(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        fields = [*types, pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names=[*groups, "part", "piece", "rows", "bytes"])

    pieces = sorted_rows.mapInArrow(joined, ", ".join([*kinds, "part int, piece int, rows bigint, bytes binary"]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, rows_in = None, None, 0
        for b in batches:
            out: list[tuple] = []
            types = [b.schema.field(i).type for i in range(n)]
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:n] != group or state is None:
                    if state is not None:
                        out.append((*group, rows_in, ended(state)))
                    group, state, rows_in = row[:n], hashlib.sha256(opening.encode()), 0
                else:
                    state.update(sep)
                state.update(row[n + 1])
                rows_in += row[n]
            if out:
                yield digests(out, types)
        if state is not None:
            yield digests([(*group, rows_in, ended(state))], types)

    def ended(state) -> str:
        state.update(closing.encode())
        return state.hexdigest()

    def digests(out: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int64(), pa.string()], strict=True)], names=[*groups, "n_rows", "sha256"])

    streamed = pieces.repartition(*groups).sortWithinPartitions(*groups, "part", "piece").select(*groups, "rows", "bytes")
    done = streamed.mapInArrow(hashed, ", ".join([*kinds, "n_rows bigint, sha256 string"]))
    return done.select(*[F.col(f"b{i}").alias(b) for i, b in enumerate(by)], "n_rows", "sha256")


def fingerprint(df: DataFrame, columns: Sequence[str], by: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, n_rows, fingerprint): SHA-256 of the JSON array of all rows of a group, sorted by ``by``; string and integer columns only."""
    one = df.select(*group, F.col(by).cast("string").alias("k_"), canonical_json(columns).alias("j_"))
    return sequential_sha256(one, group, ["k_", "j_"], F.col("j_"), ",", "[", "]").withColumnRenamed("sha256", "fingerprint")


_NUMBERS = np.array([b"%d," % i for i in range(-32768, 32768)], dtype="S7")


def joined_digest(values: np.ndarray) -> str:
    """SHA-256 of whole numbers in decimal with commas between."""
    if len(values) and (values.min() < -32768 or values.max() > 32767):
        return hashlib.sha256(",".join(map(str, values.tolist())).encode()).hexdigest()
    return hashlib.sha256(_NUMBERS[values + 32768].tobytes().translate(None, b"\0")[:-1]).hexdigest()
