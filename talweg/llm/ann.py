"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors are one class with its k + 1 smallest ids (no more can be among the k nearest of
anything), classes are dealt to shards of about ``SHARD`` by hash: as many as a task's memory allows
(some 15 MB for 64 components), since every query goes to every shard.  A shard's graph is built in
batches: a greedy beam search for each new point proposes neighbours, relaxed pruning keeps a
candidate unless one already kept is closer to it by the factor ``ALPHA``, and reverse edges are
added and pruned likewise.  Queries go to every shard in blocks, a beam search proposes candidates,
their cosines are computed in double precision on the original vectors, and the best per query are
merged by window.

Every vector is indexed.  A task holds one shard and one block of queries, both of bounded size.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor
do rows without an id; vectors of another length are never neighbours; repeated rows with one id are
one vector each of which stands once in the candidates, and a query's is the smallest of them; equal
scores go by the smaller id; components of any finite size are scaled before norms; fewer candidates
than k give fewer rows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talweg.storage import stored

K = 5
SHARD = 16_384
BLOCK = 4096
DEGREE, BEAM, ALPHA, WIDE, SEED = 32, 64, 1.2, 4, 11
QUERY_BEAM = 128


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision, scaled first so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _without_repeats(ids: np.ndarray) -> np.ndarray:
    """Rows with every id that stands twice replaced by -1 but once."""
    order = np.sort(ids, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    return order


class Graph:
    """Directed graph over unit vectors; edges[i] holds neighbour numbers, -1 where there is none."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, start: int):
        self.x, self.edges, self.start = x, edges, start

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
        n = len(x)
        start = int((x @ x.mean(axis=0)).argmax())
        if n <= degree + 1:
            all_ = np.tile(np.arange(n), (n, 1))
            edges = all_[~np.eye(n, dtype=bool)].reshape(n, n - 1) if n > 1 else np.full((1, 1), -1)
            return cls(x, edges.astype(np.int32), start)
        r = np.random.default_rng(SEED)
        edges = np.full((n, degree), -1, dtype=np.int32)
        half = degree // 2
        edges[:, :half] = r.integers(0, n - 1, (n, half))
        edges[:, :half] += edges[:, :half] >= np.arange(n)[:, None]
        g = cls(x, edges, start)
        order = r.permutation(n)
        step = max(64, min(512, n // 8))
        for at in range(0, n, step):
            g._insert(order[at : at + step], degree, beam, alpha)
        return g

    def _insert(self, rows: np.ndarray, degree: int, beam: int, alpha: float) -> None:
        ids, _ = self.search(self.x[rows], beam)
        pool = np.concatenate((ids, self.edges[rows]), axis=1)
        self.edges[rows] = self._pruned(rows, pool, degree, alpha)
        source = np.repeat(rows, degree)
        target = self.edges[rows].reshape(-1)
        ok = target >= 0
        self._add(target[ok], source[ok], degree, alpha)

    def _add(self, at: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
        """Edges at -> new; a point whose list overflows is pruned."""
        order = np.argsort(at, kind="stable")
        at, new = at[order], new[order]
        points, first, count = np.unique(at, return_index=True, return_counts=True)
        wide = np.full((len(points), count.max()), -1, dtype=np.int64)
        wide[np.repeat(np.arange(len(points)), count), np.arange(len(at)) - np.repeat(first, count)] = new
        pool = _without_repeats(np.concatenate((self.edges[points], wide), axis=1))
        pool.sort(axis=1)
        pool = pool[:, ::-1]
        over = (pool >= 0).sum(axis=1) > degree
        self.edges[points[~over]] = pool[~over][:, :degree]
        full = points[over]
        for i in range(0, len(full), 256):
            self.edges[full[i : i + 256]] = self._pruned(full[i : i + 256], pool[over][i : i + 256], degree, alpha)

    def _pruned(self, rows: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """Nearest first, leaving out what a kept neighbour covers by the relaxed distance."""
        pool = _without_repeats(pool)
        x = self.x[pool]
        d = 2 - 2 * np.einsum("bpd,bd->bp", x, self.x[rows])
        d[(pool < 0) | (pool == rows[:, None])] = np.inf
        out = np.full((len(rows), degree), -1, dtype=np.int32)
        each = np.arange(len(rows))
        for j in range(degree):
            best = d.argmin(axis=1)
            near = d[each, best]
            ok = np.isfinite(near)
            if not ok.any():
                break
            out[ok, j] = pool[each, best][ok]
            between = 2 - 2 * np.einsum("bpd,bd->bp", x, x[each, best])
            d[(alpha * alpha * between <= d) & ok[:, None]] = np.inf
            d[each, best] = np.inf
        return out

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: ids (-1 for none) and similarities, best first."""
        b, n = len(q), len(self.x)
        beam = min(beam, n)
        seen = np.zeros((b, n + 1), dtype=bool)
        ids = np.full((b, beam), -1, dtype=np.int64)
        sim = np.full((b, beam), -np.inf, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        ids[:, 0], sim[:, 0], done[:, 0] = self.start, q @ self.x[self.start], False
        seen[:, self.start] = True
        each = np.arange(b)[:, None]
        while not done.all():
            # the WIDE best that are not expanded yet
            pick = np.argsort(done, axis=1, kind="stable")[:, :WIDE]
            fresh = ~done[each, pick]
            done[each, pick] = True
            at = np.where(fresh, ids[each, pick], -1)
            near = np.where(at[..., None] >= 0, self.edges[at], -1).reshape(b, -1).astype(np.int64)
            near = _without_repeats(near)
            near[seen[each, near]] = -1
            seen[each, near] = True
            seen[:, -1] = False
            s = np.einsum("bpd,bd->bp", self.x[near], q)
            s[near < 0] = -np.inf
            ids, sim = np.concatenate((ids, near), axis=1), np.concatenate((sim, s), axis=1)
            done = np.concatenate((done, near < 0), axis=1)
            top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
            ids, sim, done = ids[each, top], sim[each, top], done[each, top]
        return ids, sim


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


INDEX = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("x", pa.binary()), ("edges", pa.binary()), ("start", pa.int32()), ("ids", pa.binary()), ("held", pa.binary())])


def _graph_of(keep: int):
    """One row per shard: unit vectors, edges, and up to ``keep`` ids of each class."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        table = table.sort_by("id")
        x = _unit(_matrix(table.column("v"), dim))
        g = Graph.build(x.astype(np.float32))
        ids = table.column("ids").to_pylist()
        members = np.full((len(ids), keep), -1, dtype=np.int64)
        held = np.zeros((len(ids), keep), dtype=bool)
        for i, m in enumerate(ids):
            members[i, : len(m)] = m
            held[i, : len(m)] = True
        row = (table.column("shard")[0].as_py(), dim, x.tobytes(), g.edges.astype(np.int32).tobytes(), g.start, members.tobytes(), held.tobytes())
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, INDEX, strict=True)], schema=INDEX)

    return run


def _answers(k: int, beam: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        row = {c: index.column(c)[0].as_py() for c in ("dim", "x", "edges", "start", "ids", "held")}
        x = np.frombuffer(row["x"]).reshape(-1, row["dim"])
        ids = np.frombuffer(row["ids"], dtype=np.int64).reshape(-1, k + 1)
        held = np.frombuffer(row["held"], dtype=bool).reshape(-1, k + 1)
        g = Graph(x.astype(np.float32), np.frombuffer(row["edges"], dtype=np.int32).reshape(len(x), -1), row["start"])
        own = queries.column("query_id").to_numpy()
        q = _unit(_matrix(queries.column("v"), row["dim"]))
        out: list[tuple] = []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            found, _ = g.search(part.astype(np.float32), beam)
            found = found[:, : 4 * (k + 1)]
            exact = np.einsum("bpd,bd->bp", x[found], part)
            for i, me in enumerate(own[at : at + 256].tolist()):
                rows = [(-s, v) for c, s in zip(found[i], exact[i].tolist(), strict=True) if c >= 0 for v, h in zip(ids[c].tolist(), held[c], strict=True) if h and v != me]
                rows.sort()
                out += [(me, v, -s) for s, v in rows[:k]]
        return pa.table(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema=schema) if out else schema.empty_table()

    return run


def valid_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", column: str = "embedding", k: int = K, shard: int = SHARD, beam: int = QUERY_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine that beam search finds, own id excepted."""
    rows = valid_vectors(vectors, key, column).dropDuplicates(["id", "v"])
    by = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("i", F.row_number().over(by)).where(F.col("i") <= k + 1)
    classes = few.groupBy("v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0])
    classes = stored(classes, "ann-classes")
    asked = valid_vectors(queries, key, column).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("one"))
    asked = stored(asked.select("id", "one.v", "one.dim"), "ann-queries")
    shards = max(1, -(-classes.count() // shard))
    parts = max(1, -(-asked.count() // BLOCK))
    keyed = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)) * 100_003 + F.col("dim"))
    graph_rows = "shard long, dim int, x binary, edges binary, start int, ids binary, held binary"
    index = stored(keyed.groupBy("shard").applyInArrow(_graph_of(k + 1), graph_rows), "ann-index")
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    asked = asked.select(F.col("id").alias("query_id"), "v", "dim", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    asked = asked.withColumn("shard", F.col("shard") * 100_003 + F.col("dim"))
    found = asked.groupBy("shard", "part").cogroup(index.groupBy("shard", "part"))
    found = found.applyInArrow(_answers(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


QUERIES = {"op1_ann": op1_ann}
ORACLES: dict[str, str] = {}
