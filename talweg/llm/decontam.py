"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions.

Texts are normalised to lower-case words (A-Z lowered; digits, a-z and everything beyond ASCII make
words).  A window is 10 consecutive words of an item, or all words of a shorter one.  All windows go
into one automaton, each text is run through it once, and hits are mapped to words and to byte
offsets of the original text.

The automaton is built once per Python worker from a broadcast of the items.  Items are taken in groups
of at most ``GROUP_BYTES`` of text (one group for the tables here), and each group is a pass of its own
over what the pass before wrote, so the driver, a broadcast and a worker hold one group at a time.

Defined results: a null or empty text has no words and no hits; a null item or one without words has
no window; items without an id are left out; repeated items count by item_id once; repeated documents
are rows of their own; further columns pass through ``decontaminated`` whatever their names and are
not read by ``scan``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.storage import stored

WINDOW = 10
GROUP_BYTES = 8_000_000
# Bytes that make words, A-Z lowered; the rest separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPANS = "array<struct<start:int,end:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(words: list[bytes], n: int = WINDOW) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def _key(window: bytes) -> str:
    return f" {window.decode('latin-1')} "


class Matcher:
    """Automaton over the windows of (item_id, text) pairs."""

    def __init__(self, items: list[tuple[object, str]], n: int = WINDOW):
        by_window: dict[bytes, set] = defaultdict(set)
        for item, text in items:
            for w in windows_of(words_of(text), n):
                by_window[w].add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in by_window.items():
            self.automaton.add_word(_key(w), (len(w) + 2, w.count(b" ") + 1, tuple(ids)))
        if by_window:
            self.automaton.make_automaton()
        self.any = bool(by_window)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(first word, words) of every occurrence, and the items they belong to."""
        if not self.any or not words:
            return [], set()
        text = f" {b' '.join(words).decode('latin-1')} "
        spans, items, ends = [], set(), []
        for end, value in self.automaton.iter(text):
            ends.append((end, value))
        if not ends:
            return [], items
        spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), dtype=np.uint8) == 32)
        for end, (length, n, ids) in ends:
            first = int(np.searchsorted(spaces, end - length + 1))
            spans.append((first, n))
            items.update(ids)
        return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, n in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + n))
        else:
            out.append((first, first + n))
    return out


def _offsets(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Byte offsets in the original text of runs of words."""
    plain = np.frombuffer(text.translate(TABLE), dtype=np.uint8) != 32
    start = np.flatnonzero(plain & ~np.concatenate(([False], plain[:-1])))
    stop = np.flatnonzero(plain & ~np.concatenate((plain[1:], [False]))) + 1
    return [{"start": int(start[a]), "end": int(stop[b - 1])} for a, b in runs]


_BUILT: dict[tuple, Matcher] = {}


def _matcher(group: tuple, n: int) -> Matcher:
    """The automaton of a group (its name, its broadcast); a worker keeps the last one it built."""
    name, items = group
    if (name, n) not in _BUILT:
        _BUILT.clear()
        _BUILT[name, n] = Matcher(items.value, n)
    return _BUILT[name, n]


def _groups(items: DataFrame, limit: int = GROUP_BYTES) -> Iterator[list[tuple[object, str]]]:
    """Items with a text in groups of about ``limit`` characters; one empty group where there are none."""
    group: list[tuple[object, str]] = []
    size, any_ = 0, False
    for r in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if group and size + len(r[1]) > limit:
            yield group
            group, size, any_ = [], 0, True
        group.append((r[0], r[1]))
        size += len(r[1])
    if group or not any_:
        yield group


def _passes(rows: DataFrame, items: DataFrame, one_pass) -> DataFrame:
    """``one_pass(rows, group)`` for every group, the results of all but the last written."""
    groups, run = _groups(items), uuid.uuid4().hex
    now = next(groups)
    for i, later in enumerate(groups):
        shared = rows.sparkSession.sparkContext.broadcast(now)
        rows = stored(one_pass(rows, (f"{run}-{i}", shared)), "decontam-pass")
        shared.unpersist()
        now = later
    return one_pass(rows, (run, rows.sparkSession.sparkContext.broadcast(now)))


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _matched(group, n: int):
    """Adds the group's hits (ranges of words) and items to each row (id, text, hits, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(group, n)
        for batch in batches:
            hits, items = [], []
            for text, before, known in zip(batch.column("text"), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                spans, ids = m.hits(words_of(text.as_py()))
                spans += [(x["start"], x["end"] - x["start"]) for x in before or ()]
                hits.append([{"start": a, "end": b} for a, b in _merged(spans)])
                named = {*(known or ()), *(None if i is None else str(i) for i in ids)}
                items.append(sorted(named - {None}) + [None] * (None in named))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))], ["id", "text", "hits", "items"])

    return run


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, ids = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
        texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") if h else b"" for t, h in zip(batch.column("text"), hits, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                pa.array([len(words_of(t.as_py())) for t in batch.column("text")], pa.int64()),
                pa.array([sum(x["end"] - x["start"] for x in h) for h in hits], pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(",".join(i for i in x if i is not None).encode()).hexdigest() for x in ids]),
                pa.array(ids, pa.list_(pa.string())),
                pa.array([_offsets(t, [(x["start"], x["end"]) for x in h]) if h else [] for t, h in zip(texts, hits, strict=True)], _HITS),
            ],
            ["id", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans"],
        )


def scan(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, items, spans (byte offsets).

    ``items`` (item_id, text) is the test set.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(None).cast(SPANS).alias("hits"), F.lit(None).cast("array<string>").alias("items"))
    state = f"id {kind}, text string, hits {SPANS}, items array<string>"
    rows = _passes(rows, items, lambda rows, group: rows.mapInArrow(_matched(group, n), state))
    return rows.mapInArrow(_described, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>, spans {SPANS}")


def decontaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", n: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; all columns pass through."""
    at = docs.columns.index(text)

    def one_pass(rows: DataFrame, group) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = _matcher(group, n)
            for batch in batches:
                yield batch.filter(pa.array([not m.hits(words_of(t.as_py()))[0] for t in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    return _passes(docs, items, one_pass)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = scan(docs, items).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 10 THEN [array_to_string(ws, ' ')]
             ELSE [array_to_string(ws[i:i + 9], ' ') for i in range(1, len(ws) - 8)] END) AS w,
             least(len(ws), 10) AS n FROM b),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS p, ws FROM d, lens WHERE len(ws) >= n),
h AS (SELECT g.doc_id, g.p, g.n, win.item_id FROM g JOIN win ON win.n = g.n AND win.w = array_to_string(g.ws[g.p:g.p + g.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
       FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
QUERIES = {"op3_decontamination": op3_decontamination}
ORACLES = {"op3_decontamination": ORACLE}
