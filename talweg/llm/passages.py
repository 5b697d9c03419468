"""Passages that repeat across documents, by sparse suffix arrays.

Of a text's suffixes only those at content-selected positions are retained: every stretch of 50
words owns the smallest 12-word hash in it (a minimiser), so two equal stretches retain suffixes at
the same place of their content, and about one suffix in twenty is kept.

1. Retained suffixes are sorted by their first 12 words and neighbours are compared: one that no
   other document shares is done with.
2. The others are extended to the left up to each start of a stretch that they own, and to the right
   to its 50th word; these are sorted and neighbours compared again.  Equal neighbours of different
   documents are repeated stretches.
3. Overlapping stretches of a document make its maximal repeated passages.

So a word is in a passage exactly if some stretch of 50 words around it stands in another document
too.  Sorting and comparing run as a stream over sorted partitions that holds one row, whatever the
size of a group; nothing is paired.  Documents of equal words are one text from the start; a copy of
at least 50 words is a repeated passage as a whole.  Words are compared by 64-bit hashes.

Defined results: null, empty and short texts have no passages; repeats within one document alone do
not count; rows with one id and one text are one document, with different texts separate ones; rows
without an id take no part; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm.words import mixed, runs, whole, word_blocks
from talweg.storage import stored

LENGTH = 50
PREFIX = 12
_U = np.uint64
_PLACE = 22
# An odd multiplier and its inverse modulo 2**64.
_K = 0xA0761D6478BD642F
_K_INVERSE = pow(_K, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_id(hashes: np.ndarray) -> int:
    return int(mixed(np.array([whole(hashes) + _U(len(hashes))], dtype=_U)).view(np.int64)[0])


def owners(prefixes: np.ndarray, window: int) -> np.ndarray:
    """Position of the smallest prefix hash (leftmost of equal ones) in each window of them."""
    n = len(prefixes)
    if n < window:
        return np.empty(0, dtype=np.int64)
    at = np.arange(n, dtype=_U)
    key = (prefixes >> _U(_PLACE) << _U(_PLACE)) | (at & _U((1 << _PLACE) - 1))
    size = -(-n // window) * window
    padded = np.full(size, ~_U(0), dtype=_U)
    padded[:n] = key
    square = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    first = np.arange(n - window + 1)
    least = np.minimum(behind[first], ahead[first + window - 1])
    return first + ((least - first.astype(_U)) & _U((1 << _PLACE) - 1)).astype(np.int64)


def stretches(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length`` consecutive words, by prefix sums."""
    n = len(hashes)
    total = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(hashes * _powers(n, _K), dtype=_U)))
    first = np.arange(n - length + 1)
    return mixed((total[first + length] - total[first]) * _powers(n, _K_INVERSE)[first])


def _retained(length: int, prefix: int):
    """Rows (key, text, place, id): retained suffixes by prefix, and one row per document (place < 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            key, text, place, doc = [], [], [], []
            for i, h in word_blocks(batch.column("text")):
                if len(h) < length:
                    continue
                t = text_id(h)
                p = runs(h, prefix)
                kept = np.unique(p[np.unique(owners(p, length - prefix + 1))])  # one for all places of equal words
                key += [np.array([t], dtype=np.int64), kept.view(np.int64)]
                place += [np.array([-len(h)], dtype=np.int64), np.zeros(len(kept), dtype=np.int64)]
                text.append(np.full(len(kept) + 1, t, dtype=np.int64))
                doc.append(np.full(len(kept) + 1, ids[i], dtype=np.int64))
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (key, text, place, doc)], ["key", "text", "place", "id"])

    return run


def _neighbours(names: list[str], passed: bool):
    """From rows sorted by (key, text, ...): those whose key stands in two texts at least.

    Rows with a negative place are passed on as they are, if wanted.  One row and the state of its
    group are held between batches; rows of a group before its second text are held back, and these
    are the places of one text under one key, copies counted once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, dtype=np.int64) for _ in names]
        shared = None  # the key at the end of what was given out, known to be in two texts
        for batch in batches:
            columns = [np.append(h, batch.column(c).to_numpy(zero_copy_only=False)) for h, c in zip(held, names, strict=True)]
            if not len(columns[0]):
                continue
            again = np.ones(len(columns[0]) - 1, dtype=bool)  # the same place of a text, from a copy
            for c in columns[:3]:
                again &= c[1:] == c[:-1]
            once = np.concatenate(([True], ~again | (columns[2][1:] < 0)))
            columns = [c[once] for c in columns]
            key, text = columns[0], columns[1]
            n = len(key)
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(new) - 1
            other = np.concatenate(([False], (text[1:] != text[:-1]) & ~new[1:]))
            many = np.bincount(group, weights=other) > 0
            if shared is not None and key[0] == shared:
                many[0] = True
            keep = many[group]
            last = group == group[-1]
            if passed:
                place = columns[2]
                document = place < 0
                keep = (keep & ~document) | document
                last &= ~document
            if many[-1]:
                shared, wait = key[-1], np.zeros(n, dtype=bool)
            else:
                shared, wait = None, last
                keep = keep & ~wait
            held = [c[wait] for c in columns]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)

    return run


def _extended(length: int, prefix: int):
    """Rows (key, text, place): hash and start of each stretch owned by a suffix that is shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, text, place, size = [], [], [], 0
            prefixes, ids = batch.column("prefixes"), batch.column("text_id").to_pylist()
            for i, h in word_blocks(batch.column("text")):
                if len(h) < length or text_id(h) != ids[i]:
                    continue  # another text under the same id
                p = runs(h, prefix)
                own = p[owners(p, length - prefix + 1)].view(np.int64)
                start = np.flatnonzero(np.isin(own, prefixes[i].values.to_numpy(zero_copy_only=False)))
                key.append(stretches(h, length)[start].view(np.int64))
                text.append(np.full(len(start), ids[i], dtype=np.int64))
                place.append(start)
                size += len(start)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (key, text, place)], ["key", "text", "place"])
                    key, text, place, size = [], [], [], 0
            if key:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (key, text, place)], ["key", "text", "place"])

    return run


def _merged(length: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("places"):
                s = np.unique(row.values.to_numpy(zero_copy_only=False))
                cut = np.flatnonzero(np.diff(s) > length)
                first, last = s[np.concatenate(([0], cut + 1))], s[np.concatenate((cut, [len(s) - 1]))] + length
                out.append([{"start": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(out, span)], ["text", "spans"])

    return run


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """(key, n_words, n_repeated, spans) of documents with passages that others hold; spans are word ranges."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    suffixes = rows.mapInArrow(_retained(length, prefix), "key bigint, text bigint, place bigint, id bigint")
    order = suffixes.repartition("key").sortWithinPartitions("key", "text", "place", "id")
    names = ["key", "text", "place", "id"]
    shared = stored(order.mapInArrow(_neighbours(names, True), "key bigint, text bigint, place bigint, id bigint"), "suffixes")
    documents = shared.where("place < 0").groupBy("id", "text").agg((-F.min("place")).alias("n_words"))
    documents = stored(documents, "suffix-docs")
    texts = documents.groupBy("text").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"))
    prefixes = shared.where("place >= 0").groupBy("text").agg(F.collect_set("key").alias("prefixes"))
    asked = prefixes.join(texts.select("text", "first"), "text").select(F.col("text").alias("text_id"), F.col("first").alias("id"), "prefixes")
    found = rows.join(asked, "id").select("text", "text_id", "prefixes")
    stretch = found.mapInArrow(_extended(length, prefix), "key bigint, text bigint, place bigint")
    order = stretch.repartition("key").sortWithinPartitions("key", "text", "place")
    repeated = order.mapInArrow(_neighbours(["key", "text", "place"], False), "key bigint, text bigint, place bigint")
    spans = repeated.groupBy("text").agg(F.collect_set("place").alias("places"))
    spans = spans.mapInArrow(_merged(length), "text bigint, spans array<struct<start:bigint,end:bigint>>")
    whole_text = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    by_text = texts.join(spans, "text", "left").select("text", F.when(F.col("copies") > 1, whole_text).otherwise(F.col("spans")).alias("spans"))
    by_text = by_text.where("spans IS NOT NULL")
    out = documents.join(by_text, "text")
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("id").alias(key), "n_words", covered.alias("n_repeated"), "spans")


def op5_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_passages": op5_passages}
ORACLES: dict[str, str] = {}
