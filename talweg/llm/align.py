"""Alignment of two tokenizers' tokens of the same text.

Token ends of both sides are marked in packed bitsets over the bytes of the text.  Their AND marks the
shared cuts; popcounts before a cut give how many tokens of each side end up to it, so they map cuts to
token ranges: the groups.  The links are the pairs of tokens that end at one cut, one pair a cut, as no
token is empty.  Cuts between units (see ``tokens``) are shared, so each distinct unit of a block is
aligned once and its groups and links are expanded to all its places.

How often a pair of ids is linked in the whole corpus is one aggregation.  Tokens that end together
have bytes of which one is an end of the other's, so there are at most as many linked pairs of ids as
both vocabularies have bytes (about half a million here), whatever the corpus: the table of counts has
a proven bound and is broadcast.

Defined results: texts null, empty, or whose tokens' bytes differ from the text (such as texts that hold
the space mark U+2581) have no tokens: zeros, and '' for the groups; repeated rows are rows of their
own, each counted; null ids stay; further columns are not read; an empty table gives an empty table.
A text is one row and its groups one string before they are hashed, so it must fit a worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm.tokens import ByteTokens, PieceTokens, Units, byte_tokens, bytes_of, piece_tokens, ragged, text_blocks
from talweg.session import arrow_rows
from talweg.storage import stored

LOW_BITS = np.uint64(63)
CHUNK = 4_000_000  # bytes of texts whose links are held at a time
ROWS = 1_000  # texts in an Arrow batch


class Bits:
    """Set of positions as 64-bit words; ``rank`` counts the members up to each position, itself included."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        flags = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
        flags[positions] = 1
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def select(self) -> np.ndarray:
        """All members, ascending."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))

    def rank(self, positions: np.ndarray) -> np.ndarray:
        p = positions.astype(np.uint64)
        low = self.words[positions >> 6] << (LOW_BITS - (p & LOW_BITS))
        return self.before[positions >> 6] + np.bitwise_count(low)


class Alignment:
    """Groups and links of the distinct units of a block."""

    def __init__(self, units: pa.LargeBinaryArray, a: ByteTokens, b: PieceTokens):
        (self.a, self.a_at), (self.b, self.b_at) = a.encode(units), b.encode(units)
        self.names = a.names if a.size > b.size else b.names
        whole, unit_at = bytes_of(units)
        size = np.diff(unit_at)
        self.bad = self._differs(whole, unit_at, a, self.a, self.a_at) | self._differs(whole, unit_at, b, self.b, self.b_at)
        # tokens of units that do not agree take no part, so that both sides cover the same bytes
        good = np.flatnonzero(~self.bad)
        self.a, self.a_at = self._only(self.a, self.a_at, good, len(units))
        self.b, self.b_at = self._only(self.b, self.b_at, good, len(units))
        total = int(size[good].sum())
        ends_a, ends_b = (Bits.of(np.cumsum(t.lengths[ids]) - 1, total) for t, ids in ((a, self.a), (b, self.b)))
        shared = ends_a & ends_b
        cuts = shared.select()
        self.upto_a, self.upto_b = ends_a.rank(cuts), ends_b.rank(cuts)
        self.links = self.a[self.upto_a - 1].astype(np.int64) * b.size + self.b[self.upto_b - 1]
        # cuts of each unit: those up to its last byte
        upto = np.cumsum(np.where(self.bad, 0, size))
        self.cut_at = np.concatenate(([0], np.searchsorted(cuts, upto - 1, side="right")))

    @staticmethod
    def _differs(whole: memoryview, unit_at: np.ndarray, t: ByteTokens | PieceTokens, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        joined = [t.bytes[i] for i in ids.tolist()]
        if b"".join(joined) == whole and np.array_equal(np.concatenate(([0], np.cumsum(t.lengths[ids])))[at], unit_at):
            return np.zeros(len(at) - 1, dtype=bool)
        return np.array([b"".join(joined[at[i] : at[i + 1]]) != whole[unit_at[i] : unit_at[i + 1]] for i in range(len(at) - 1)], dtype=bool)

    @staticmethod
    def _only(ids: np.ndarray, at: np.ndarray, good: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(good) == n:
            return ids, at
        sizes = np.zeros(n, dtype=np.int64)
        sizes[good] = np.diff(at)[good]
        return ragged(ids, at, good)[0], np.concatenate(([0], np.cumsum(sizes)))

    def groups(self) -> pa.StringArray:
        """Text of each unit's groups: ``a1,a2|b1;a3|b2,b3``."""
        sides = []
        for ids, upto in ((self.a, self.upto_a), (self.b, self.upto_b)):
            offsets = pa.array(np.concatenate(([0], upto)), pa.int32())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, self.names.take(pa.array(ids))), ","))
        return _joined(pc.binary_join_element_wise(*sides, "|"), self.cut_at)


def _joined(texts: pa.StringArray, at: np.ndarray) -> pa.StringArray:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), texts), ";")


class _Text:
    """What is known of a text that may stand in several blocks."""

    def __init__(self) -> None:
        self.bad, self.n_a, self.n_b, self.n_groups = False, 0, 0, 0
        self.hash = hashlib.sha256()
        self.links: list[np.ndarray] = []


def _sums(values: np.ndarray, first: np.ndarray) -> list[int]:
    total = np.concatenate(([0], np.cumsum(values)))
    return np.diff(total[first]).tolist()


def aligned_batch(texts: pa.Array, a: ByteTokens, b: PieceTokens) -> list[tuple]:
    """(n_a, n_b, n_groups, groups_sha256, linked pairs ascending, their counts) of each text."""
    held = [_Text() for _ in range(len(texts))]
    some = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    for at, raw, ends in text_blocks(texts.take(pa.array(some)), whole=a.whole or b.whole, prefix=b" "):
        u = Units(raw, ends, whole=a.whole or b.whole)
        al = Alignment(u.dictionary, a, b)
        words = al.groups()
        n_a, n_b, n_g, bad = (_sums(x[u.codes], u.first) for x in (np.diff(al.a_at), np.diff(al.b_at), np.diff(al.cut_at), al.bad.astype(np.int64)))
        links, begin = ragged(al.links, al.cut_at, u.codes)
        codes = pa.array(u.codes)
        for k, i in enumerate(at):
            d, s, e = held[some[i]], int(u.first[k]), int(u.first[k + 1])
            d.bad |= bad[k] > 0
            if d.bad:
                continue
            d.hash.update(b";" * bool(d.n_groups) + _joined(words.take(codes.slice(s, e - s)), np.array([0, e - s]))[0].as_buffer().to_pybytes())
            d.n_a, d.n_b, d.n_groups = d.n_a + n_a[k], d.n_b + n_b[k], d.n_groups + n_g[k]
            d.links.append(links[begin[s] : begin[e]])
    out, none = [], np.empty(0, dtype=np.int64)
    for d in held:
        if d.bad or not d.n_groups:
            out.append((0, 0, 0, "", none, none))
        else:
            pairs, n = np.unique(np.concatenate(d.links), return_counts=True)
            out.append((d.n_a, d.n_b, d.n_groups, d.hash.hexdigest(), pairs, n))
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_a, n_b, n_groups, groups_sha256, pairs (id of A x size of B + id of B) and their counts."""
    size_a, size_b = byte_tokens(byte_path, True).size, piece_tokens(piece_path).size
    narrow = size_a * size_b < 1 << 31
    kind = pa.int32() if narrow else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_tokens(byte_path, True), piece_tokens(piece_path)
        for batch in batches:
            column, begin = batch.column(1), 0
            size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while begin < batch.num_rows:  # few texts at a time, so that only their links are held
                end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + CHUNK, side="right")))
                rows = aligned_batch(column.slice(begin, end - begin), a, b)
                n_a, n_b, n_groups, digest, pairs, counts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digest), _lists(pairs, kind), _lists(counts, pa.int32())],
                    names=["key", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"],
                )
                begin = end

    spark_kind = "int" if narrow else "bigint"
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<{spark_kind}>, counts array<int>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def pair_counts(texts: DataFrame, size_b: int) -> DataFrame:
    """Corpus-wide count of each linked pair of ids, and whether it is the highest of its B id."""
    one = texts.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("x.pairs", "x.counts")
    n = one.groupBy("pairs").agg(F.sum("counts").alias("n"))
    # a window holds the A ids whose bytes end as the B id's: bounded by the vocabulary
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("pairs") % size_b)))


def link_figures(texts: DataFrame, size_b: int) -> DataFrame:
    """``texts`` of ``aligned``, stored with a number ``row_`` for each row, with n_links, n_best and count_sum."""
    counts = stored(pair_counts(texts, size_b), "align-counts")
    one = texts.select("row_", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row_", "x.pairs", "x.counts")
    one = one.join(F.broadcast(counts), "pairs")  # as many rows at most as the vocabularies have bytes
    best = F.when(F.col("best"), F.col("counts"))
    sums = one.groupBy("row_").agg(F.sum("counts").alias("n_links"), F.sum(best).alias("n_best"), F.sum(F.col("counts") * F.col("n")).alias("count_sum"))
    out = texts.drop("pairs", "counts").join(sums, "row_", "left").drop("row_")
    return out.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("n_links", "n_best", "count_sum")})


def op11_align(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    with arrow_rows(spark, ROWS):
        texts = stored(aligned(docs, a, b).withColumn("row_", F.monotonically_increasing_id()), "align-texts")
    out = link_figures(texts, piece_tokens(b).size)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op11_align": op11_align}
ORACLES: dict[str, str] = {}
