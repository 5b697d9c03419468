"""Jaccard self-join over word shingles by universe partition and pigeonhole.

A document's set holds the hashes of its distinct shingles of five words.  Sets of a Jaccard
similarity of 0.8 differ in at most H = (|r| + |s|) / 9 elements.  The universe of hashes is cut
into m > H ranges (segments), m fixed per size band [2^b, 2^(b+1)); two such sets then agree on some
segment.  Each document indexes a signature per segment that is not empty, in its own band and, if
its partners may reach into the next band, there too.  Allocation by cost:

* empty segments say nothing and get no unit; where a document is then short of H + 1 units
  (class 1), it adds the one-deletion neighbourhood of its larger segments, worth two units each,
  and only where that is not enough (class 2) the empty segments as well.  Of two documents the one
  of the lower class has units enough among what both emit, so no pair is lost;
* a signature with many holders is dear: each document gives up its dearest ones of a band as long as
  H + 1 units are left there.  Giving up is not to probe; the signature stays indexed, so that of a
  pair the one that comes later in a fixed order finds the other by the H + 1 it still probes.  A
  bucket in which nobody probes is left out;
* a document of class 0 agrees with a similar one on more signatures than it has units to spare, so
  one that shares fewer with anybody (a common passage is not enough) is out before anything is compared.

Buckets are not expanded into pairs.  In each bucket the first member leads and is compared with the
rest; members of one component need no comparison among themselves, so a group of n copies costs
about n.  What is left of buckets with up to ``LEADERS`` + 1 members is compared member by member.
In a larger one the members are compared by rare elements, of two kinds:

* members that differ from the leader L by at most three quarters of their size mostly come from one
  text.  What counts between two of them is D, their symmetric difference with L, as
  |t ^ u| = |D_t ^ D_u|.  Two similar ones share (|D_t| + |D_u| - (|t| + |u|) / 9) / 2 elements of D,
  and since one of them at least is not similar to L, more than four ninths of the other's D: they
  meet among its first elements in an order that has what is not in L first, and what copies merely
  lost last;
* members that differ from L by more than two fifths share a passage with it and no more.  They meet on
  the first fifth of their own elements, in an order that has those of L last.

Two similar sets are both of the first kind or both of the second.  The buckets of rare elements are
compared by leaders in turn (1, 16, 256, ...), with the overlap that a pair needs at its places in
both orders, until none holds an untried pair from two components.  Components are exact.
Comparisons of whole sets first bound the difference by counts per hash bin.

Copies are one node from the start: equal sets have equal 64-bit ids (collisions need about 2^32
different documents; shingles and sets are compared by hashes of 64 bits too).

Defined results: null, empty and blank texts have an empty set and link with nothing (n_shingles 0,
component of their own); a text of fewer words than a shingle is one shingle; repeated rows are
copies; rows without an id take no part; empty tables give empty tables; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.llm.words import mixed, runs, whole, word_blocks
from talweg.operators.components import connected_components
from talweg.storage import stored

WORDS = 5
DEAR = 64
LEADERS = 16
SURPLUS = 20
PRUNINGS = 2
BROADCAST_IDS = 1_000_000
_U = np.uint64


def shingle_set(hashes: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one document."""
    if not len(hashes):
        return np.empty(0, dtype=_U)
    if len(hashes) < n:
        return np.array([whole(hashes) ^ _U(len(hashes))], dtype=_U)
    return np.unique(runs(hashes, n))


def node_id(s: np.ndarray) -> int:
    """64-bit id of a set, as a signed number; 0 for the empty set."""
    if not len(s):
        return 0
    a = mixed(np.array([np.sum(mixed(s), dtype=_U) ^ mixed(np.array([len(s)], dtype=_U))[0]], dtype=_U))
    return int(a.view(np.int64)[0]) or 1


def segments_of_band(b: int) -> int:
    h = (2 * (2 ** (b + 1) - 1)) // 9
    return h + 1 + -(-SURPLUS * (h + 1) // 100)


def _sums(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each element, and sum and number of elements by segment."""
    seg = (((s >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
    count = np.bincount(seg, minlength=m)
    cum = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(s, dtype=_U)))
    end = np.cumsum(count)
    return seg, cum[end] - cum[end - count], count


def _signed(sums: np.ndarray, seg: np.ndarray, b: int) -> np.ndarray:
    return mixed(sums + (seg.astype(_U) + _U(b << 40)) * _U(0xD1342543DE82EF95))


def _emitted(s: np.ndarray, b: int, need: int) -> tuple[np.ndarray, int]:
    """Signatures in the segments of band ``b``, and units to spare."""
    m = segments_of_band(b)
    seg, sums, count = _sums(s, m)
    held = np.flatnonzero(count)
    spare = len(held) - need
    if spare >= 0:
        return _signed(sums[held], held, b), spare
    out = [_signed(sums[held], held, b)]
    large = count[seg] > 1
    out.append(_signed(sums[seg[large]] - s[large], seg[large], b))
    if len(held) + int(np.count_nonzero(count > 1)) < need:
        empty = np.flatnonzero(count == 0)
        out.append(_signed(sums[empty], empty, b))
    return np.concatenate(out), 0


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set and, for each, the units to spare in its band."""
    n = len(s)
    b = n.bit_length() - 1
    top, most = 2 ** (b + 1) - 1, 5 * n // 4
    own, spare = _emitted(s, b, (n + min(most, top)) // 9 + 1)
    if most <= top:
        return own, np.full(len(own), spare, dtype=np.int32)
    up, more = _emitted(s, b + 1, (n + most) // 9 + 1)
    return np.concatenate((own, up)), np.repeat(np.array([spare, more], dtype=np.int32), [len(own), len(up)])


def sketch(s: np.ndarray) -> bytes:
    """Elements per bin, about four each; the bins follow the band so that partners compare."""
    bins = 1 << max(0, len(s).bit_length() - 3)
    seg = (((s & _U(0xFFFFFFFF)) * _U(bins)) >> _U(32)).astype(np.int64)
    return np.minimum(np.bincount(seg, minlength=bins), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference from two sketches."""
    x, y = np.frombuffer(a, dtype=np.uint8).astype(np.int64), np.frombuffer(b, dtype=np.uint8).astype(np.int64)
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        if (y == 255).any() or (x == 255).any():
            return 0
        y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.abs(x - y).sum())


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, hashes in word_blocks(batch.column("text")):
        yield i, shingle_set(hashes)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, n, marks = [], [], []
        for _, s in _sets(batch):
            node.append(node_id(s))
            n.append(len(s))
            marks.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), batch.column("text_hash")],
            ["id", "node", "n", "sketch", "text_hash"],
        )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, node, spare, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in (sig, node, spare)], ["sig", "node", "spare"]
            )

        for _, s in _sets(batch):
            if not len(s):
                continue
            x, y = signatures(s)
            sig.append(x.view(np.int64))
            node.append(np.full(len(x), node_id(s), dtype=np.int64))
            spare.append(y)
            held += len(x)
            if held > 200_000:
                yield out()
                sig, node, spare, held = [], [], [], 0
        if held:
            yield out()


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, data, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], ["node", "items"])

        for _, s in _sets(batch):
            node.append(node_id(s))
            data.append(s.tobytes())
            size += len(s) * 8
            if size > 4_000_000:
                yield out()
                node, data, size = [], [], 0
        if node:
            yield out()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, node): those whose sig has two nodes at least, each once."""
    last: tuple | None = None
    open_ = False  # the last row's bucket has been begun in the output

    for batch in batches:
        sig, node, spare = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "node", "spare"))
        if last is not None:
            sig, node, spare = np.append(last[0], sig), np.append(last[1], node), np.append(last[2], spare)
        fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        if last is None:
            open_ = False
        sig, node, spare = sig[fresh], node[fresh], spare[fresh]
        same = sig[1:] == sig[:-1]
        keep = np.zeros(len(sig), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        was_open = open_
        open_ = bool(keep[-1]) or (len(sig) == 1 and was_open)
        if was_open:
            keep[0] = False  # given out with the batch before
        last = (sig[-1], node[-1], spare[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (sig, node, spare)], ["sig", "node", "spare"])


def _compare(lo: int, hi: int):
    """Pairs (leader, member) of each bucket: leaders have rank lo to hi - 1, members probe and come later.

    Rows come sorted by sig, then the order of nodes that holds in all buckets; of two similar nodes
    the later one has a bucket in which it probes and finds the other.  Held between batches: the
    bucket's leaders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rank, leaders = None, 0, []
        for batch in batches:
            a, b, size = [], [], 0
            rows = zip(*(batch.column(c).to_pylist() for c in ("sig", "node", "comp", "probes")), strict=True)
            for sig, node, comp, probes in rows:
                if sig != now:
                    now, rank, leaders = sig, 0, []
                if probes:
                    mine = [other for other, its in leaders if its != comp]
                    a += mine
                    b += [node] * len(mine)
                    size += len(mine)
                if lo <= rank < hi:
                    leaders.append((node, comp))
                rank += 1
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                    a, b, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True)
        ok = [9 * least_difference(x, y) <= p + q for p, q, x, y in n]
        yield batch.select(["a", "b", "shared"]).filter(pa.array(ok, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # buffers of the batch are read in place: its sets may be large
        sets = zip(batch.column("x"), batch.column("y"), strict=True)
        ok = [similar(np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)) for x, y in sets]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


NEAR, FAR = 0, 1


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each member's set ``y`` is compared by, given its leader's set ``x``: rows of the kinds above.

    ``far`` is the size of the symmetric difference of the two sets, ``size`` that of the ordered set of
    which ``items`` are the first ones: of these a row holds the first ``holds`` and, where it probes,
    probes with the first ``reach``.
    """
    names = ["lead", "node", "kind", "n", "n_lead", "far", "size", "holds", "reach", "items"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.list_(pa.int64())]
    for batch in batches:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
            known = np.isin(y, x, assume_unique=True)
            new, n = y[~known], len(y)
            far = len(new) + len(x) - (n - len(new))
            kept = []
            if 4 * far <= 3 * n:
                holds = far - (9 * far + len(x) - n) // 18
                reach = far - max(1, -((n - 4 * far) // 4)) + 1
                kept.append((NEAR, far, holds, reach, np.concatenate((new, np.setdiff1d(x, y, assume_unique=True)))))
            if 5 * far > 2 * n:
                kept.append((FAR, n, n // 5 + 1, n // 5 + 1, np.concatenate((new, y[known]))))
            for kind, size, holds, reach, items in kept:
                items = items[: max(holds, reach)].view(np.int64)
                rows.append((batch.column("lead")[i].as_py(), batch.column("node")[i].as_py(), kind, n, len(x), far, size, holds, reach, items))
                held += len(items)
            if held > 500_000:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()


_PART = ("node", "comp", "n", "size", "pos", "probes", "holds")


def _compare_parts(lo: int, hi: int):
    """Like ``_compare`` for buckets of rare elements: pairs (a, b).

    ``pos`` is the element's place in the order of the row's own ``size`` elements; of a pair one
    must probe and the other hold, and the element must stand early enough in both for the overlap
    that the pair needs.  Held between batches: the bucket's leaders, ``hi - lo`` at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rank, leaders = None, 0, None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "kind", "e")])
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _PART}
            n = key.shape[1]
            if not n:
                continue
            cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [n]))
            a, b, size = [], [], 0
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(key[:, begin].tolist())
                if here != now:
                    now, rank, leaders = here, 0, None
                part = {c: x[begin:end] for c, x in rows.items()}
                ranks = np.arange(rank, rank + end - begin)
                mine = (ranks >= lo) & (ranks < hi)
                if mine.any():
                    add = {c: x[mine] for c, x in part.items()} | {"rank": ranks[mine]}
                    leaders = add if leaders is None else {c: np.concatenate((leaders[c], x)) for c, x in add.items()}
                rank += end - begin
                if leaders is None:
                    continue
                step = max(1, 1_000_000 // len(leaders["rank"]))
                for at in range(0, end - begin, step):
                    x = {c: v[None, :] for c, v in leaders.items()}
                    y = {c: v[at : at + step, None] for c, v in part.items()}
                    need = np.maximum(1, -((x["n"] + y["n"] - 9 * (x["size"] + y["size"])) // 18))
                    ok = (x["rank"] < ranks[at : at + step, None]) & (x["comp"] != y["comp"])
                    ok &= (x["probes"] & y["holds"]) | (x["holds"] & y["probes"])
                    ok &= (x["pos"] + need <= x["size"] + 1) & (y["pos"] + need <= y["size"] + 1)
                    ok &= 5 * np.minimum(x["n"], y["n"]) >= 4 * np.maximum(x["n"], y["n"])
                    j, i = np.nonzero(ok)
                    a.append(leaders["node"][i])
                    b.append(part["node"][at + j])
                    size += len(i)
                    if size > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])
                        a, b, size = [], [], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], ["a", "b"])

    return run


class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, with_text_hash: bool = False):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
        hashed = F.coalesce(F.sha2("text", 256), F.lit("")) if with_text_hash else F.lit(None).cast("string")
        kind = self.docs.schema["id"].dataType.simpleString()
        rows = self.docs.select("id", "text", hashed.alias("text_hash"))
        self.known = stored(rows.mapInArrow(_describe, f"id {kind}, node bigint, n bigint, sketch binary, text_hash string"), "ngram-docs")
        first = F.min(F.struct("id", "n", "sketch")).alias("f")
        self.nodes = self.known.where("n > 0").groupBy("node").agg(first)
        self.nodes = stored(self.nodes.select("node", F.col("f.id").alias("id"), F.col("f.n").alias("n"), F.col("f.sketch").alias("sketch")), "ngram-nodes")

    def buckets(self) -> DataFrame:
        """Rows (sig, node, probes, popular) of signatures that two nodes share, dear ones given up.

        ``popular`` counts the holders of a node's signatures: what many near copies come from is first."""
        rows = self.docs.select("text").mapInArrow(_index, "sig bigint, node bigint, spare int")
        dealt = rows.repartition("sig").sortWithinPartitions("sig", "node")
        held = stored(dealt.mapInArrow(_shared, "sig bigint, node bigint, spare int"), "ngram-held")
        for _ in range(PRUNINGS):
            enough = held.groupBy("node", "spare").agg(F.count("*").alias("c")).where("c > spare").select("node", "spare")
            held = held.join(enough, ["node", "spare"], "left_semi")
            held = stored(held.join(held.groupBy("sig").agg(F.count("*").alias("c")).where("c > 1").select("sig"), "sig", "left_semi"), "ngram-held")
        counted = stored(held.groupBy("sig").agg(F.count("*").alias("holders")), "ngram-counts")
        popular = held.join(counted, "sig").groupBy("node").agg(F.sum("holders").alias("popular"))
        dear = counted.where(f"holders >= {DEAR}")
        costly = held.where("spare > 0").join(dear, "sig")
        order = Window.partitionBy("node", "spare").orderBy(F.desc("holders"), "sig")
        given = costly.withColumn("i", F.row_number().over(order)).where("i <= spare").select("sig", "node", F.lit(True).alias("given"))
        marked = held.join(given, ["sig", "node"], "left").select("sig", "node", F.col("given").isNull().alias("probes"))
        live = marked.groupBy("sig").agg(F.bool_or("probes").alias("live")).where("live").select("sig")
        return stored(marked.join(live, "sig", "left_semi").join(popular, "node"), "ngram-buckets")

    def sets_of(self, pairs: DataFrame) -> DataFrame:
        """Sets of the nodes in ``pairs``, made from the text of one document each."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        ids = stored(wanted.join(self.nodes, "node").select("id"), "ngram-ids")
        side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        texts = self.docs.join(side, "id", "left_semi").select("text")
        made = texts.mapInArrow(_whole_sets, "node bigint, items binary")
        return made.groupBy("node").agg(F.first("items").alias("items"))

    def check(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) that are similar; ``sets`` (node, items) are made where they are not given."""
        sets = stored(self.sets_of(pairs), "ngram-sets") if sets is None else sets
        x = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
        return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a bigint, b bigint")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes and sketches allow the similarity, with their shared buckets."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
        left = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
        both = pairs.join(left, "a").join(right, "b").where("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        return both.select("a", "b", "shared", "n_a", "n_b", "s_a", "s_b").mapInArrow(_bounded, "a bigint, b bigint, shared bigint")

    def joined(self, edges: DataFrame, new: DataFrame) -> DataFrame:
        """``edges`` with new ones (a written table), and the components of all in ``self.parts``."""
        if new.isEmpty():
            return edges
        edges = edges.union(new.select("a", "b"))
        self.parts = stored(connected_components(edges), "ngram-parts")
        return edges

    def with_component(self, rows: DataFrame, node: str = "node", name: str = "comp") -> DataFrame:
        p = self.parts.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        return rows.join(p, rows[node] == p["_n"], "left").withColumn(name, F.coalesce("_c", node)).drop("_n", "_c")

    def links(self) -> DataFrame:
        """Verified links enough to connect every component; rows (a, b) of nodes."""
        buckets = self.buckets()
        self.parts = self.spark.createDataFrame([], "node bigint, component bigint")
        edges = self.spark.createDataFrame([], "a bigint, b bigint")
        first = buckets.withColumn("comp", F.col("node")).repartition("sig").sortWithinPartitions("sig", F.desc("popular"), "node")
        found = stored(self.plausible(first.mapInArrow(_compare(0, 1), "a bigint, b bigint")), "ngram-pairs")
        # For each node the partner with which it shares most; then what is left between components.
        best = found.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("end"))
        best = best.groupBy("end").agg(F.max(F.struct("shared", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        edges = self.joined(edges, stored(self.check(best), "ngram-edges"))
        rest = self.with_component(self.with_component(found, "a", "c_a"), "b", "c_b").where("c_a <> c_b")
        rest = stored(rest.select("a", "b").join(best, ["a", "b"], "left_anti"), "ngram-rest")
        edges = self.joined(edges, stored(self.check(rest), "ngram-new"))
        open_ = self.with_component(buckets)
        per = open_.groupBy("sig").agg(
            F.count("*").alias("n"), F.min("comp").alias("c"), F.max("comp").alias("d"), F.max_by("node", F.struct("popular", -F.col("node"))).alias("lead")
        )
        left = stored(per.where("n > 2 AND c <> d").select("sig", "n", "lead"), "ngram-left")
        few = open_.join(left.where(F.col("n") <= LEADERS + 1).select("sig"), "sig", "left_semi")
        few = few.repartition("sig").sortWithinPartitions("sig", F.desc("popular"), "node")
        found = stored(self.plausible(few.mapInArrow(_compare(1, LEADERS), "a bigint, b bigint")), "ngram-pairs")
        edges = self.joined(edges, stored(self.check(found), "ngram-new"))
        many = left.where(F.col("n") > LEADERS + 1)
        held = stored(buckets.select("sig", "node", "popular").join(many.select("sig", "lead"), "sig"), "ngram-many")
        members = held.join(self.common_leads(held), "lead").where("node <> root").groupBy(F.col("root").alias("lead"), "node").agg(F.max("popular").alias("popular"))
        return self.links_by_rare_elements(edges, stored(members, "ngram-members"))

    def common_leads(self, held: DataFrame) -> DataFrame:
        """(lead, root): what leads a bucket may be any set, so buckets share the most popular one near their own.

        That is the most popular leader of the own leader's component or, two steps on, of a bucket in
        which the leader is a member.
        """
        known = held.where("node = lead").select("lead", "popular").distinct()
        root = Window.partitionBy("comp").orderBy(F.desc("popular"), "lead")
        hubs = self.with_component(known, "lead").withColumn("hub", F.first("lead").over(root))
        hubs = stored(hubs.select("lead", "hub"), "ngram-hubs")
        of = known.select(F.col("lead").alias("hub"), F.col("popular").alias("rank"))
        above = held.select("node", "lead").join(hubs, "lead").join(known.select(F.col("lead").alias("node")), "node", "left_semi").join(of, "hub")
        above = above.groupBy("node").agg(F.max(F.struct("rank", -F.col("hub"), "hub")).alias("m")).select(F.col("node").alias("hub"), F.col("m.hub").alias("next"))
        above = stored(above, "ngram-above")
        roots = hubs
        for _ in range(2):
            roots = roots.join(above, "hub", "left").select("lead", F.coalesce("next", "hub").alias("hub"))
        return roots.withColumnRenamed("hub", "root")

    def links_by_rare_elements(self, edges: DataFrame, members: DataFrame) -> DataFrame:
        """``edges`` and those between members (lead, node, popular) of one leader in different components."""
        if members.isEmpty():
            return edges
        ends = members.select(F.col("lead").alias("a"), F.col("node").alias("b"))
        sets = stored(self.sets_of(ends), "ngram-sets")
        both = members.select("lead", "node").join(sets.select("node", F.col("items").alias("y")), "node")
        both = both.join(sets.select(F.col("node").alias("lead"), F.col("items").alias("x")), "lead")
        fields = "lead bigint, node bigint, kind int, n bigint, n_lead bigint, far bigint, size bigint, holds bigint, reach bigint, items array<bigint>"
        parts = stored(both.select("lead", "node", "x", "y").mapInArrow(_elements, fields), "ngram-elements")
        near = parts.where(f"kind = {NEAR}")
        edges = self.joined(edges, stored(near.where("9 * far <= n + n_lead").select(F.col("lead").alias("a"), F.col("node").alias("b")), "ngram-new"))
        # Of two near members in different components one at least is outside the leader's: that one probes.
        tagged = self.with_component(self.with_component(parts, "lead", "of_lead"))
        outside = (F.col("comp") != F.col("of_lead")) | (F.col("kind") == FAR)
        tagged = tagged.withColumn("asks", outside).withColumn("used", F.when(outside, F.greatest("holds", "reach")).otherwise(F.col("holds")).cast("int"))
        spread = tagged.select("lead", "kind", "node", "n", "size", "asks", "holds", "reach", F.posexplode(F.slice("items", 1, F.col("used"))).alias("pos", "e"))
        spread = spread.withColumn("pos", F.col("pos").cast("long") + 1)
        spread = spread.withColumn("holds", F.col("pos") <= F.col("holds")).withColumn("probes", F.col("asks") & (F.col("pos") <= F.col("reach")))
        spread = spread.where("holds OR probes").drop("asks", "reach")
        counted = spread.groupBy("lead", "kind", "e").agg(F.count("*").alias("m"), F.max("probes").alias("p"), F.max("holds").alias("h")).where("m > 1 AND p AND h")
        shared = spread.join(counted.select("lead", "kind", "e"), ["lead", "kind", "e"], "left_semi").join(members, ["lead", "node"])
        shared = stored(shared.select("lead", "kind", "e", "node", "n", "size", "pos", "probes", "holds", "popular"), "ngram-shared")
        lo, hi = 0, 1
        while True:
            here = self.with_component(shared)
            per = here.groupBy("lead", "kind", "e").agg(F.count("*").alias("m"), F.min("comp").alias("c"), F.max("comp").alias("z"))
            left = stored(per.where(f"m > {lo + 1} AND c <> z").select("lead", "kind", "e"), "ngram-left")
            if left.isEmpty():
                return edges
            here = here.join(left, ["lead", "kind", "e"], "left_semi").select("lead", "kind", "e", "popular", *_PART)
            order = here.repartition("lead", "kind", "e").sortWithinPartitions("lead", "kind", "e", F.desc("popular"), "node")
            pairs = order.mapInArrow(_compare_parts(lo, hi), "a bigint, b bigint")
            edges = self.joined(edges, stored(self.check(self.plausible(pairs), sets), "ngram-new"))
            lo, hi = hi, LEADERS * hi + 1


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text_hash: bool = False) -> DataFrame:
    """One row per row of ``docs`` with an id: key, n_shingles, component_id (smallest linked key).

    ``with_text_hash`` adds text_hash, SHA-256 of the text ("" for a null one), where one id may have several texts.
    """
    join = _Join(docs, key, text, with_text_hash)
    join.links()
    named = join.nodes.join(join.parts, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "id")
    smallest = named.groupBy("class").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "class").select("node", "component_id")
    out = join.known.where("n > 0").join(named, "node").select("id", "n", "component_id", "text_hash")
    alone = join.known.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "text_hash")
    more = ["text_hash"] if with_text_hash else []
    return out.union(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", *more)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN []
        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS items FROM w),
classes AS (SELECT list_sort(items) AS items, min(doc_id) AS rep FROM s WHERE len(items) > 0 GROUP BY 1),
e AS (SELECT rep, len(items) AS n, unnest(items) AS item FROM classes),
p AS (SELECT x.rep AS a, y.rep AS b FROM e x JOIN e y ON x.item = y.item AND x.rep < y.rep
      WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
      GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT rep AS node, rep AS root FROM classes
          UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON both_.a = reach.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN classes ON list_sort(s.items) = classes.items LEFT JOIN comp ON comp.node = classes.rep
"""
QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLES = {"op10_ngram_join": ORACLE}
