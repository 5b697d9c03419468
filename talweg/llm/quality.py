"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of eight bytes run over the whole text at every second byte, and
their outputs are max-pooled over chunks of 512 bytes that begin at every 256th, so every stretch of up
to 256 bytes lies whole within a chunk.  The mean and the maximum of the chunks' pooled outputs, over
all chunks of the text, give one probability through a logistic layer.

It is fitted on the driver from a bounded sample of labelled rows: ``SAMPLE`` per class, taken in the
order of a hash of doc_id among the rows that the caller allows; that is a fixed cost, whatever the
size of the table.  Fitting and scoring read whole texts, in pieces of bounded size.

Defined results: null and empty texts are scored as an empty text (one chunk of padding); labels that
are null are not learned from; without labels of both classes every score is 0.5; repeated rows get
equal scores; further columns pass through ``kept``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.llm.words import text_blocks

SAMPLE = 2500
THRESHOLD = 0.3
DIM, WIDTH, STRIDE, CHUNK, FILTERS = 8, 8, 2, 512, 24
TAIL = WIDTH - STRIDE
CELL = CHUNK // 2
PER_CELL = CELL // STRIDE
ROWS = 4096
PIECE = 1 << 18
BLOCK = 1 << 19
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 7
CROPPED = 0.4
_LOWEST = np.float32(-1e30)


def _cropped(text: bytes, r: np.random.Generator) -> bytes:
    """Now and then a short stretch of the text instead of all, so that short texts are learned too."""
    if r.random() >= CROPPED or len(text) < 64:
        return text
    n = int(np.exp(r.uniform(np.log(24), np.log(len(text)))))
    at = int(r.integers(0, len(text) - n + 1))
    return text[at : at + n]


class Net:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": (r.standard_normal((256, DIM)) * 0.5).astype(np.float32),
            "w": (r.standard_normal((WIDTH * DIM, FILTERS)) * 0.15).astype(np.float32),
            "b": np.zeros(FILTERS, dtype=np.float32),
            "v": (r.standard_normal(2 * FILTERS) * 0.1).astype(np.float32),
            "c": np.zeros(1, dtype=np.float32),
        }
        self.p["e"][0] = 0
        self.trained = False

    def _layout(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Padded bytes, first position of each cell (half a chunk; with one stop per piece) and cells per piece."""
        places = [max(1, -(-min(len(t), PIECE + CELL) // STRIDE)) for t in pieces]
        size = [n * STRIDE + TAIL for n in places]
        begin = np.concatenate(([0], np.cumsum(size)))
        data = np.zeros(begin[-1], dtype=np.uint8)
        cuts, count = [], []
        for t, n, at in zip(pieces, places, begin[:-1], strict=True):
            part = t[: n * STRIDE + TAIL]
            data[at : at + len(part)] = np.frombuffer(part, dtype=np.uint8)
            first = at // STRIDE
            cuts.append(np.append(np.arange(first, first + n, PER_CELL), first + n))
            count.append(-(-n // PER_CELL))
        return data, np.concatenate(cuts), np.array(count)

    def _convolved(self, data: np.ndarray) -> np.ndarray:
        x = np.take(self.p["e"], data, axis=0).reshape(len(data) // STRIDE, STRIDE * DIM)
        steps = WIDTH // STRIDE
        n = len(x) - steps + 1
        w = self.p["w"].reshape(steps, STRIDE * DIM, FILTERS)
        z = x[:n] @ w[0]
        for j in range(1, steps):
            z += x[j : j + n] @ w[j]
        return z

    @staticmethod
    def _chunks(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second cell of each chunk, and its piece; a single cell is a chunk."""
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        chunks = np.maximum(count - 1, 1)
        piece = np.repeat(np.arange(len(count)), chunks)
        inner = np.arange(chunks.sum()) - np.repeat(np.concatenate(([0], np.cumsum(chunks)[:-1])), chunks)
        first = begin[piece] + inner
        return first, first + (count[piece] > 1), piece

    @staticmethod
    def _pieces(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Groups of pieces of about ``BLOCK`` bytes with their texts' numbers; pieces overlap by a cell."""
        group, owner, size = [], [], 0
        for i, t in enumerate(texts):
            for k in range(0, max(1, len(t)), PIECE):
                if k and len(t) - k <= CELL:
                    continue  # the piece before has it
                group.append(t[k : k + PIECE + CELL + TAIL])
                owner.append(i)
                size += len(group[-1])
                if size > BLOCK:
                    yield group, np.array(owner)
                    group, owner, size = [], [], 0
        if group:
            yield group, np.array(owner)

    def _pooled(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Largest output per chunk, and the piece of each chunk."""
        data, cuts, count = self._layout(pieces)
        z = self._convolved(data)
        z = np.concatenate((z, np.full((1, FILTERS), _LOWEST, dtype=np.float32)))
        top = np.maximum.reduceat(z, np.minimum(cuts, len(z) - 1), axis=0)
        cells = np.delete(top, np.cumsum(count + 1) - 1, axis=0)
        first, second, piece = self._chunks(count)
        return np.maximum(np.maximum(cells[first], cells[second]) + self.p["b"], 0), piece

    def scores(self, texts: list[bytes]) -> np.ndarray:
        best = np.zeros((len(texts), FILTERS), dtype=np.float32)
        total = np.zeros((len(texts), FILTERS))
        chunks = np.zeros(len(texts))
        for group, owner in self._pieces(texts):
            h, piece = self._pooled(group)
            doc = owner[piece]
            np.maximum.at(best, doc, h)
            np.add.at(total, doc, h)
            np.add.at(chunks, doc, 1)
        mean = total / np.maximum(chunks, 1)[:, None]
        return self._out(np.concatenate((mean, best), axis=1))

    def _out(self, h: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(h), 0.5)
        logit = (h * self.p["v"]).sum(axis=1, dtype=np.float64) + float(self.p["c"][0])
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def fit(self, texts: list[bytes], labels: np.ndarray) -> Net:
        if len(set(labels.tolist())) < 2:
            return self
        r = np.random.default_rng(SEED)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
        self.trained, step = True, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(texts))
            rate = RATE * (1 - epoch / EPOCHS)
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                grads = self._gradients([_cropped(texts[i], r) for i in rows], labels[rows], weight[rows])
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.01 * (g * g - s[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
                self.p["e"][0] = 0
        return self

    def _peaks(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest output per chunk, the bytes under the filter there, and the piece of each chunk."""
        data, cuts, count = self._layout(pieces)
        z = self._convolved(data)
        inner = np.delete(np.arange(len(cuts)), np.cumsum(count + 1) - 1)
        where = np.empty((len(inner), FILTERS), dtype=np.int64)
        for i, c in enumerate(inner):
            where[i] = cuts[c] + z[cuts[c] : min(cuts[c + 1], len(z))].argmax(axis=0)
        first, second, piece = self._chunks(count)
        columns = np.arange(FILTERS)
        later = z[where[second], columns] > z[where[first], columns]
        where = np.where(later, where[second], where[first])
        return z[where, columns], data[where[..., None] * STRIDE + np.arange(WIDTH)], piece

    def _gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        parts = [(z, under, owner[piece]) for group, owner in self._pieces(texts) for z, under, piece in [self._peaks(group)]]
        z, under, doc = (np.concatenate(c) for c in zip(*parts, strict=True))
        h = np.maximum(z + self.p["b"], 0)
        count = np.bincount(doc, minlength=len(texts))
        mean = np.zeros((len(texts), FILTERS), dtype=np.float32)
        np.add.at(mean, doc, h)
        mean /= count[:, None]
        best = np.zeros_like(mean)
        np.maximum.at(best, doc, h)
        feats = np.concatenate((mean, best), axis=1)
        d = ((self._out(feats) - y) * weight / len(texts)).astype(np.float32)
        dh = d[doc, None] * self.p["v"][:FILTERS] / count[doc, None]
        # the maximum passes its share on to the first chunk that reaches it
        order = np.arange(len(doc))[:, None]
        top = np.full((len(texts), FILTERS), len(doc))
        np.minimum.at(top, doc, np.where(h == best[doc], order, len(doc)))
        dh = dh + np.where(order == top[doc], d[doc, None] * self.p["v"][FILTERS:], 0)
        dh = np.where(h > 0, dh, 0).astype(np.float32)
        dw, de = np.zeros_like(self.p["w"]), np.zeros_like(self.p["e"])
        for at in range(0, len(doc), ROWS):
            some = slice(at, at + ROWS)
            window = self.p["e"][under[some]].reshape(-1, FILTERS, WIDTH * DIM)
            dw += np.einsum("cf,cfk->kf", dh[some], window)
            back = dh[some][..., None] * self.p["w"].T[None]
            np.add.at(de, under[some].reshape(-1), back.reshape(-1, DIM))
        decay = 1e-4 * self.p["v"]
        return {"e": de, "w": dw, "b": dh.sum(axis=0), "v": d @ feats + decay, "c": np.array([d.sum()], dtype=np.float32)}


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of either class, in the order of a hash of the key."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("k").isNotNull())
    known = known.withColumnRenamed("k", key).where(allowed).withColumnRenamed(key, "k")
    rows: list[tuple[str, int]] = []
    for y in (0, 1):
        some = known.where(F.col("y") == y).select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(per_class)
        texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
        # a bounded number of ids, so this side is small by definition
        found = texts.join(F.broadcast(some), "k").orderBy(F.xxhash64("k"), "k", "t").limit(per_class)
        rows += [(r["t"], y) for r in found.select("t").toLocalIterator()]
    return rows


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "quality", allowed: Column | None = None, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE) -> Net:
    """A network fitted on the labelled rows for which ``allowed`` (over the key) holds."""
    rows = sample(docs, labels, label, F.lit(True) if allowed is None else allowed, key=key, text=text, per_class=per_class)
    texts = [t.encode("utf-8", "surrogatepass") for t, _ in rows]
    return Net().fit(texts, np.array([y for _, y in rows], dtype=np.int64))


def _score_column(batch: pa.RecordBatch, at: int, net: Net) -> np.ndarray:
    parts = [net.scores(texts) for _, texts in text_blocks(batch.column(at), 4_000_000)]
    return np.concatenate(parts) if parts else np.empty(0)


def scored(docs: DataFrame, net: Net, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_score_column(batch, 1, model.value))], ["k", "score"])

    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, score double")
    return rows.select(F.col("k").alias(key), "score")


def kept(docs: DataFrame, net: Net, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; all columns pass through."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_column(batch, at, model.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fitted(docs, labels, allowed=~held_out(F.col("doc_id")))
    out = scored(docs, net)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
