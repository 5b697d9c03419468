"""Hash keys for deterministic ranking, splitting and fingerprints, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_64 = 18446744073709551616.0


def rank_hex(*parts: Column | str, sep: str = "\0") -> Column:
    """SHA-256 of the parts joined by ``sep``; hex order is the order of the 256-bit number."""
    return F.sha2(F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def unsigned64(hexed: Column, at: int = 1) -> Column:
    return F.conv(F.substring(hexed, at, 16), 16, 10).cast("decimal(20,0)")


def unit_hash(*parts: Column | str, sep: str = ":") -> Column:
    """First eight bytes of the rank key as a fraction in [0, 1)."""
    return unsigned64(rank_hex(*parts, sep=sep)).cast("double") / F.lit(TWO_64)


def hash_mod(m: int | Column, *parts: Column | str, sep: str = ":") -> Column:
    m = F.lit(m) if isinstance(m, int) else m
    return (unsigned64(rank_hex(*parts, sep=sep)) % m.cast("decimal(20,0)")).cast("long")


def seed32(*parts: Column | str, sep: str = ":") -> Column:
    return F.conv(F.substring(rank_hex(*parts, sep=sep), 1, 8), 16, 10).cast("long")


def split_of(u: Column, train: float = 0.8, dev: float = 0.1) -> Column:
    return F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test")


def canonical_json(columns: Sequence[str]) -> Column:
    """Compact JSON of one row, keys sorted, nulls left out by the caller's coalesce."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def file_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def git_blob_sha1(content: Column) -> Column:
    head = F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0"))
    return F.sha1(F.concat(head.cast("binary"), content.cast("binary")))


def content_path(sha: Column, suffix: str, *prefix: Column | str) -> Column:
    """Content-addressed relative path prefix/ab/<sha>suffix."""
    head = [F.lit(p) if isinstance(p, str) else p for p in prefix]
    return F.concat_ws("/", *head, F.substring(sha, 1, 2), F.concat(sha, F.lit(suffix)))
