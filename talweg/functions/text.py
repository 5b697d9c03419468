"""Text scalars: whitespace, hashes, character tests, alphabet normalisers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def collapsed(s: Column) -> Column:
    """All runs of Unicode white space as one space, ends trimmed (as Python's split and join)."""
    return F.trim(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", " "))


def ascii_collapsed(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[ \t\n\r]+", " "))


def text_hash(s: Column) -> Column:
    return F.sha2(collapsed(s), 256)


def double_binding(s: Column) -> Column:
    return F.struct(F.sha2(s, 256).alias("literal_sha256"), text_hash(s).alias("collapsed_sha256"))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC form; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc_hash(s: Column) -> Column:
    return F.sha2(collapsed(nfkc(s)), 256)


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def unknown_to_null(s: Column, unknown: tuple[str, ...] = ("", "unknown", "n/a", "none", "null", "-")) -> Column:
    return F.when(F.lower(F.trim(s)).isin(*unknown), F.lit(None).cast("string")).otherwise(s)


def has_cyrillic(s: Column) -> Column:
    return s.rlike("[\\u0400-\\u052f]")


def offenders(s: Column, allowed: str) -> Column:
    """Sorted distinct characters outside an alphabet."""
    letters = F.filter(F.array_distinct(F.split(s, "")), lambda c: (c != "") & ~F.lit(allowed).contains(c))
    return F.array_sort(letters)


def alphabet_normalised(s: Column, allowed: str, swaps: dict[str, str] | None = None) -> Column:
    """struct<text, rejected>: lower-cased, characters swapped, whitespace collapsed, offenders listed."""
    swaps = swaps or {}
    moved = F.translate(F.lower(s), "".join(swaps), "".join(swaps.values()))
    text = collapsed(moved)
    return F.struct(text.alias("text"), offenders(text, allowed).alias("rejected"))


def evidence_positions(s: Column, letters: str, token: str = r"[\p{L}\p{M}]+") -> Column:
    """1-based numbers of the tokens that hold one of the letters."""
    words = F.regexp_extract_all(F.lower(s), F.lit(f"({token})"), F.lit(1))
    marked = F.transform(words, lambda w, i: F.when(w.rlike(f"[{letters}]"), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def identifier(value: Column, pattern: str = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") -> Column:
    """struct<value,status,sha256>: identifier-shaped values kept, others replaced by their digest."""
    ok = value.rlike(pattern)
    status = F.when(value.isNull() | (F.trim(value) == ""), "missing").when(ok, "kept").otherwise("digested")
    return F.struct(F.when(ok, value).alias("value"), status.alias("status"), F.when(status == "digested", F.sha2(value, 256)).alias("sha256"))


def iso_timestamp_ok(s: Column) -> Column:
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"
    return F.coalesce(s.rlike(shape) & F.try_to_timestamp(s).isNotNull(), F.lit(False))


def iso_date_or_time_ok(s: Column) -> Column:
    """A date, or a date and a time with or without an offset."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d{1,9})?)?)?(Z|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)?)?$"
    return F.coalesce(s.rlike(shape) & F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def portable_path_ok(s: Column) -> Column:
    return s.rlike(r"^[^/\\][^\\]*$") & ~s.rlike(r"(^|/)\.{1,2}(/|$)") & ~s.rlike("//")
