"""Toxic passages by maximum-scoring segments over token log-odds.

Every token of the labelled sample has a score: the log-odds of its occurrences between toxic and
clean documents with an informative Dirichlet prior (``PRIOR`` tokens' worth of the pooled
frequencies), shrunk by its own uncertainty, z^2 / (1 + z^2) with z the log-odds over their standard
deviation; a token of a single document tells nothing and has 0, like one never seen.  Every token
costs ``DRIFT`` besides, so that a clean text drifts down.  A linear-time scan finds all maximal
segments of a text.  A segment of score S in a text of n tokens is expected K n exp(-lambda S) times by
chance (extreme-value statistics): lambda is the positive root of sum p exp(lambda s) = 1 over clean
tokens, or what the spread of clean texts' best segments says where that is less (texts of several
languages are not drawn from one distribution), and ``STEEP`` at most (1 would be right for exact
log-odds), and K fits the mean of these segments.  Segments expected less than ``EXPECTED`` times
are significant passages.  A document's evidence is the sum of -log10 of the expectations of its
significant passages, and a logistic curve of its logarithm gives the probability.

The sample is halved by a hash of doc_id: lambda, K and the curve come from either half's texts under
the scores of the other half, so no text is judged by tokens that were learned from it.

The sample is bounded: ``SAMPLE`` labelled rows per class in the order of a hash of doc_id, and with it
the number of tokens.  Scoring reads whole texts of all rows.

Defined results: null, empty and wordless texts have no passages and the score of no evidence; null
labels are not learned from; without labels of both classes no token is toxic and every score is the
same; repeated rows get equal scores; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
PRIOR = 5_000.0
SPAN = 50
DRIFT = 1.0
STEEP = 4.0
EXPECTED = 0.05
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def fresh(ts: list[str]) -> np.ndarray:
    """Marks occurrences whose token does not stand among the ``SPAN`` before: repeating a token says nothing new."""
    last: dict[str, int] = {}
    out = np.empty(len(ts), dtype=bool)
    for i, t in enumerate(ts):
        out[i] = i - last.get(t, -SPAN - 1) > SPAN
        last[t] = i
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text's token scores.

    Candidates keep the sum before them, the sum at their end and the last earlier candidate with a
    smaller sum before it, so that the scan is linear.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    places = np.flatnonzero(scores > 0)
    found: list[list] = []  # first, last, sum before, sum at the end, link
    for place, before, end in zip(places.tolist(), total[places].tolist(), total[places + 1].tolist(), strict=True):
        new = [place, place, before, end, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            new[4] = j
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            old = found[j]
            new = [old[0], new[1], old[2], new[3], old[4]]
            del found[j:]
    return [(a, b, end - before) for a, b, before, end, _ in found]


def log_odds(toxic: np.ndarray, clean: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Shrunken log-odds of tokens from their occurrences in either class and the number of documents that hold them."""
    n_t, n_c = toxic.sum(), clean.sum()
    if not n_t or not n_c:
        return np.zeros(len(toxic))
    prior = (toxic + clean) * (PRIOR / (n_t + n_c))
    t, c = toxic + prior, clean + prior
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.log(t / (n_t + PRIOR - t)) - np.log(c / (n_c + PRIOR - c))
        z = odds / np.sqrt(1 / t + 1 / c)
        out = odds * z * z / (1 + z * z)
    return np.where((held > 1) & np.isfinite(out), out, 0.0)


def _root(share: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum share exp(lambda score) = 1, for scores of negative mean."""
    lo, hi = 1e-3, STEEP
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (share * np.exp(np.minimum(mid * scores, 700))).sum() < 1 else (lo, mid)
    return lo


class Lexicon:
    """Token scores with the constants of the extreme-value distribution and the logistic curve."""

    def __init__(self, scores: dict[str, float], drift: float = DRIFT):
        self.scores, self.drift = scores, drift
        self.rate, self.log_k = 1.0, 0.0
        self.a, self.b = -3.0, 0.0

    def token_scores(self, ts: list[str]) -> np.ndarray:
        get = self.scores.get
        return np.fromiter((get(t, 0.0) for t in ts), dtype=np.float64, count=len(ts)) * fresh(ts) - self.drift

    def expected(self, n: np.ndarray | int, score: np.ndarray | float):
        """Log of the number of segments of that score in a clean text of ``n`` tokens."""
        return self.log_k + np.log(n) - self.rate * score

    def fit_chance(self, n: np.ndarray, best: np.ndarray) -> None:
        """K and an upper bound of lambda from clean texts' tokens and best segments: the extreme-value
        distribution has the mean (log(K n) + gamma) / lambda and the deviation pi / (lambda sqrt(6))."""
        if best.std() > 0:
            self.rate = min(self.rate, math.pi / (math.sqrt(6) * float(best.std())))
        self.log_k = float(np.mean(self.rate * best - np.log(n))) - 0.5772

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Number of tokens, and (first, last, score, log of the expectation) of significant passages."""
        ts = tokens(text)
        if not ts or not self.scores:
            return len(ts), []
        least = (self.log_k + math.log(len(ts)) - math.log(EXPECTED)) / self.rate
        found = [p for p in maximal_segments(self.token_scores(ts)) if p[2] > least]
        return len(ts), [(a, b, s, float(self.expected(len(ts), s))) for a, b, s in found]

    def evidence(self, passages: list[tuple[int, int, float, float]]) -> float:
        return -sum(p[3] for p in passages) / math.log(10)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic curve of log(1 + evidence) by Newton steps with a little shrinkage; it never falls with the evidence."""
        if len(x) == 0 or y.min() == y.max():
            return
        design = np.stack((np.ones_like(x), np.log1p(x)), axis=1)
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            g = design.T @ (p - y) + 0.01 * w
            h = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
            w = w - np.linalg.solve(h, g)
        self.a, self.b = float(w[0]), max(0.0, float(w[1]))


#: Occurrences of a token by class and half of the sample, and documents that hold it by half.
COUNTED = ("toxic_0", "toxic_1", "clean_0", "clean_1", "held_0", "held_1")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = list(by.items())
        by.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), *(pa.array([c[i] for _, c in rows], pa.int64()) for i in range(6))], ["word", *COUNTED])

    for batch in batches:
        for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("t", "y", "half")), strict=True):
            ts = tokens(text)
            for w, n in Counter(t for t, new in zip(ts, fresh(ts), strict=True) if new).items():
                c = by.setdefault(w, [0] * 6)
                c[2 * (1 - y) + half] += n
                c[4 + half] += 1
            if len(by) > 200_000:
                yield out()
    if by:
        yield out()


def _best(batches: Iterator[pa.RecordBatch], models: list[Lexicon]) -> Iterator[pa.RecordBatch]:
    """(y, half, n, best): a text's tokens and its best segment under the scores of the other half."""
    for batch in batches:
        n, best = [], []
        for text, half in zip(batch.column("t").to_pylist(), batch.column("half").to_pylist(), strict=True):
            ts = tokens(text)
            n.append(len(ts))
            best.append(max((s for _, _, s in maximal_segments(models[1 - half].token_scores(ts))), default=0.0) if ts else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("half"), pa.array(n, pa.int64()), pa.array(best, pa.float64())], ["y", "half", "n", "best"])


def _chosen(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, key: str, text: str, per_class: int) -> DataFrame:
    known = labels.where(allowed).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("k").isNotNull()).groupBy("k").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)]
    # a bounded number of ids, so this side is small by definition
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(parts[0].union(parts[1])), "k")


def learned(words: list[str], count: dict[str, np.ndarray]) -> tuple[Lexicon, list[Lexicon]]:
    """Scores from the whole sample and from either half, with lambda where it can be known; K and the curve are to come."""

    def made(halves: tuple[int, ...]) -> tuple[Lexicon, np.ndarray]:
        toxic, clean, held = (sum(count[f"{c}_{h}"] for h in halves) for c in ("toxic", "clean", "held"))
        scores = log_odds(toxic, clean, held)
        some = np.flatnonzero(scores)
        return Lexicon({words[i]: float(scores[i]) for i in some}), scores

    halves = [made((0,)), made((1,))]
    for h, (model, scores) in enumerate(halves):
        other = count[f"clean_{1 - h}"]  # frequencies of clean texts that the scores have not seen
        if other.sum() and len(model.scores):
            model.rate = _root(other / other.sum(), scores - model.drift)
    whole = made((0, 1))[0]
    whole.rate = (halves[0][0].rate + halves[1][0].rate) / 2
    return whole, [m for m, _ in halves]


def fitted(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", allowed: Column | None = None, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE) -> Lexicon:
    rows = _chosen(docs, labels, label, F.lit(True) if allowed is None else allowed, key, text, per_class)
    rows = rows.select("k", "t", "y", F.pmod(F.xxhash64("k", F.lit(1)), F.lit(2)).cast("int").alias("half"))
    counted = rows.select("t", "y", "half").mapInArrow(_counts, f"word string, {', '.join(f'{c} bigint' for c in COUNTED)}")
    # the sample's size is bounded, and so is the number of its tokens
    table = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTED]).where("held_0 + held_1 > 1").toArrow()
    model, halves = learned(table.column("word").to_pylist(), {c: table.column(c).to_numpy() for c in COUNTED})
    shared = docs.sparkSession.sparkContext.broadcast(halves)
    best = rows.select("t", "y", "half").mapInArrow(lambda batches: _best(batches, shared.value), "y int, half int, n bigint, best double").toArrow()
    y, half, n, top = (best.column(c).to_numpy() for c in ("y", "half", "n", "best"))
    known = (y == 0) & (n > 0)
    if not known.any() or known.all() or not model.scores:
        return Lexicon({})
    for m in (model, *halves):
        m.fit_chance(n[known], top[known])
    parts = [_evidence(rows.where(F.col("half") == h).select(F.col("y").alias("k"), "t"), halves[1 - h], "int") for h in (0, 1)]
    pairs = parts[0].union(parts[1]).select("k", "evidence").toArrow()
    model.calibrate(pairs.column("evidence").to_numpy(), pairs.column("k").to_numpy().astype(float))
    return model


def _evidence(rows: DataFrame, model: Lexicon, kind: str) -> DataFrame:
    """(k, evidence, n_tokens, passages) for rows (k, t)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("log_expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.passages(t) for t in (x.as_py() for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.evidence(p) for _, p in found], pa.float64()),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([[dict(zip(("first", "last", "score", "log_expected"), x, strict=True)) for x in p] for _, p in found], pa.list_(fields)),
                ],
                ["k", "evidence", "n_tokens", "passages"],
            )

    return rows.mapInArrow(run, f"k {kind}, evidence double, n_tokens bigint, passages array<struct<first:int,last:int,score:double,log_expected:double>>")


def scored(docs: DataFrame, model: Lexicon, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_tokens, passages) of every row; passages are ranges of tokens."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = _evidence(rows, model, rows.schema[0].dataType.simpleString())
    score = F.lit(1.0) / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * F.log1p("evidence"))))
    return out.select(F.col("k").alias(key), score.alias("score"), "n_tokens", "passages")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fitted(docs, labels, allowed=~held_out(F.col("doc_id")))
    out = scored(docs, model)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages")
    )


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
