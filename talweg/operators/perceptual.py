"""Perceptual hashes of sound and the join of hashes that differ in few bits.

The join is multi-index hashing: prints are cut into blocks, and if two prints differ in at most t bits,
one of m blocks differs in at most t // m.  References stand under the value of each block, candidates ask
for every value within that radius.  How many blocks is a matter of cost: long blocks cost more probes a
candidate, short ones more chance pairs, whose number is the product of both tables over the number of
values of a block.  ``block_plan`` weighs both, so that pairs stay in proportion to the rows.

Neighbouring bits of a print say much the same, so a block takes bits from all over it.  The prints under
one block value are compared as packed words, a crowded value in squares of bounded size, each a task's own
run of rows.  Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talweg.storage import stored

# Fixed values of the print: sampling rate, frame, hop, transform, bands and bins, frequencies, least speech.
RATE, FRAME, HOP, FFT, PARTS, LOW_HZ, HIGH_HZ, LEAST = 16_000, 400, 160, 512, 16, 80.0, 7_600.0, 400
THRESHOLD, RATIO = 12, 0.15
HOT = 8_192
MOST_PROBES = 12_000
FRAMES_AT_ONCE, PLACES_AT_ONCE, PAIRS_AT_ONCE = 4_096, 65_536, 262_144
CLASSES = 64


# ---- prints ------------------------------------------------------------------------------------------


def _band_levels(x: np.ndarray) -> np.ndarray:
    """Logarithmic energy of each frame in each geometric band."""
    window, cut = np.hanning(FRAME), np.searchsorted(np.fft.rfftfreq(FFT, 1.0 / RATE), np.geomspace(LOW_HZ, HIGH_HZ, PARTS + 1))
    frames, out = sliding_window_view(x, FRAME)[::HOP], []
    for begin in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[begin : begin + FRAMES_AT_ONCE] * window, FFT, axis=1)
        power = np.square(np.abs(spectrum))
        out.append(np.log1p(np.column_stack([power[:, a:b].sum(axis=1) for a, b in zip(cut, cut[1:], strict=False)])))
    return np.concatenate(out)


def spectral_fingerprint(samples: np.ndarray) -> str:
    """256 bits as hexadecimal digits: 16 bins of time by 16 bands, each 1 where its mean level is above its band's median.

    ``samples`` are 16-bit values at 16 kHz; fewer than one frame are padded with silence, so an empty
    waveform has the print of silence (all zeros).
    """
    x = np.asarray(samples, dtype=np.float64) / 32_768.0
    levels = _band_levels(np.pad(x, (0, max(0, FRAME - x.size))))
    n = len(levels)
    edges = np.linspace(0.0, float(n), PARTS + 1)
    begin = np.minimum(np.floor(edges[:-1]).astype(int), n - 1)
    end = np.minimum(np.maximum(begin + 1, np.ceil(edges[1:]).astype(int)), n)
    pooled = np.array([levels[a:b].mean(axis=0) for a, b in zip(begin, end, strict=True)])
    return np.packbits((pooled > np.median(pooled, axis=0)).ravel()).tobytes().hex()


@F.pandas_udf(StringType())
def fingerprint_udf(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: None if x is None else spectral_fingerprint(np.asarray(x)))


def active_samples(samples: Column, segments: Column) -> Column:
    """Samples inside the segments (structs of start and end), or all where those are fewer than 400."""
    inside = F.flatten(F.transform(F.filter(segments, lambda s: s["end"] > s["start"]), lambda s: F.slice(samples, s["start"] + 1, s["end"] - s["start"])))
    return F.when(F.size(inside) >= LEAST, inside).otherwise(samples)


# ---- the join ----------------------------------------------------------------------------------------


def block_plan(candidates: int, references: int, digits: int, threshold: int) -> tuple[int, int]:
    """(blocks, radius) of the least expected rows, for prints of so many hexadecimal digits."""

    def cost(m: int) -> float:
        bits, radius = 4 * (digits // m), threshold // m
        probes = m * sum(comb(4 * -(-digits // m), i) for i in range(radius + 1))
        if -(-digits // m) > 15 or probes > MOST_PROBES and m < min(threshold + 1, digits):
            return float("inf")
        return candidates * probes + references * m + float(candidates) * references * probes / 2.0**bits

    m = min(range(1, min(threshold + 1, digits) + 1), key=cost)
    return m, threshold // m


def _spans(digits: int, m: int) -> list[tuple[int, int]]:
    edges = [digits * i // m for i in range(m + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _masks(bits: int, radius: int) -> list[int]:
    """All values of at most ``radius`` ones among ``bits``."""
    out = [0]
    for _ in range(radius):
        out = sorted({m | 1 << i for m in out for i in range(bits)} | set(out))
    return out


def _block_bits(digits: int, m: int) -> list[np.ndarray]:
    """The places of each block's bits: bits at a fixed step, so that no block is one bin of time or one band alone."""
    bits = 4 * digits
    step = next(s for s in range(round(bits * 0.381966), 2 * bits) if gcd(s, bits) == 1)
    order = np.arange(bits) * step % bits
    return [order[4 * a : 4 * b] for a, b in _spans(digits, m)]


def _words(hexed: list[str], digits: int) -> np.ndarray:
    """Prints as rows of 64-bit words."""
    wide = -(-digits // 16) * 16
    return np.frombuffer(bytes.fromhex("".join([h.rjust(wide, "0") for h in hexed])), ">u8").reshape(len(hexed), wide // 16).astype(np.uint64)


def _bits(words: np.ndarray, digits: int) -> np.ndarray:
    return np.unpackbits(words.astype(">u8").view(np.uint8), axis=1)[:, -4 * digits :]


def _placed(batches: Iterator[pa.RecordBatch], digits: int, m: int, radius: int) -> Iterator[pa.RecordBatch]:
    """(pos, value, f, candidate, reference): references under their blocks' values, candidates under all within the radius."""
    blocks = _block_bits(digits, m)
    masks = [np.array(_masks(len(at), radius), dtype=np.int64) for at in blocks]
    for batch in batches:
        most = max(1, PLACES_AT_ONCE // max(len(x) for x in masks))
        for begin in range(0, batch.num_rows, most):
            part = batch.slice(begin, most)
            bits = _bits(_words(part.column("f").to_pylist(), digits), digits)
            asks, is_asked = (part.column(c).to_numpy(zero_copy_only=False) for c in ("candidate", "reference"))
            for pos, at in enumerate(blocks):
                own = bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                sides = [(np.arange(len(own)), own, asks, is_asked)]
                if radius:
                    who, known = np.flatnonzero(asks), np.flatnonzero(is_asked)
                    around = (own[who, None] ^ masks[pos]).ravel()
                    who = np.repeat(who, len(masks[pos]))
                    sides = [(who, around, np.ones(len(who), bool), np.zeros(len(who), bool)), (known, own[known], np.zeros(len(known), bool), np.ones(len(known), bool))]
                for who, value, c, r in sides:
                    columns = [pa.array(np.full(len(who), pos, np.int32)), pa.array(value), part.column("f").take(pa.array(who)), pa.array(c), pa.array(r)]
                    yield pa.RecordBatch.from_arrays(columns, names=["pos", "value", "f", "candidate", "reference"])


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of equal keys from sorted batches: tables and where their runs begin and end."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        keys = [table.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if len(cuts):
            yield table.slice(0, cuts[-1]), np.concatenate(([0], cuts))
        rest = table.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _compared(batches: Iterator[pa.RecordBatch], digits: int, m: int, radius: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Near pairs of different prints in each square; the first block that is near enough reports a pair."""
    ones = np.zeros((m, 4 * digits), np.uint8)
    for i, at in enumerate(_block_bits(digits, m)):
        ones[i, at] = 1
    masks = _words([f"{int(''.join(map(str, o)), 2):0{digits}x}" for o in ones.tolist()], digits)
    for table, edges in _runs(batches, ["pos", "value", "i", "j"]):
        names = table.column("f").to_pylist()
        words, pos = _words(names, digits), table.column("pos").to_numpy()
        asks, is_asked = (table.column(c).to_numpy() for c in ("candidate", "reference"))
        left, right, gaps = [], [], []
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            c, r = begin + np.flatnonzero(asks[begin:end]), begin + np.flatnonzero(is_asked[begin:end])
            step = max(1, PAIRS_AT_ONCE // max(1, len(r)))
            other = words[r]
            for a in range(0, len(c) if len(r) else 0, step):
                own = words[c[a : a + step]]
                distance = np.bitwise_count(own[:, :1] ^ other[:, 0]).astype(np.uint16)
                for k in range(1, words.shape[1]):
                    distance += np.bitwise_count(own[:, k : k + 1] ^ other[:, k])
                x, y = np.nonzero(distance <= threshold)
                if not len(x):
                    continue
                differing = own[x] ^ other[y]
                before = np.zeros(len(x), bool)
                for q in range(pos[begin]):
                    before |= np.bitwise_count(differing & masks[q]).sum(axis=1) <= radius
                x, y, d = x[~before], y[~before], distance[x, y][~before]
                for u, v, n in zip(c[a + x].tolist(), r[y].tolist(), d.tolist(), strict=True):
                    if u != v and names[u] != names[v]:
                        left.append(names[u])
                        right.append(names[v])
                        gaps.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(gaps, pa.int32())], names=["f_candidate", "f_reference", "distance"])


def near_prints(candidates: DataFrame, references: DataFrame, *, fingerprint: str = "fingerprint", threshold: int = THRESHOLD, blocks: int | None = None, hot: int = HOT) -> DataFrame:
    """(f_candidate, f_reference, distance): pairs of distinct prints within ``threshold`` bits, equal ones included.

    Prints are hexadecimal strings of one length; null prints have no partner.  ``blocks`` fixes the
    number of blocks, else it follows from the numbers of prints.  Of a block value at most about ``hot``
    candidates and references are compared at once.
    """
    sides = [df.select(F.col(fingerprint).alias("f"), F.lit(i == 0).alias("candidate"), F.lit(i == 1).alias("reference")).where("f IS NOT NULL") for i, df in enumerate((candidates, references))]
    every = stored(sides[0].unionByName(sides[1]).groupBy("f").agg(F.bool_or("candidate").alias("candidate"), F.bool_or("reference").alias("reference")), "distinct-prints")
    sizes = every.agg(F.count_if("candidate").alias("asked"), F.count_if("reference").alias("known"), F.min(F.length("f")).alias("least"), F.max(F.length("f")).alias("most")).first()
    equal = every.where("candidate AND reference").select(F.col("f").alias("f_candidate"), F.col("f").alias("f_reference"), F.lit(0).alias("distance"))
    if not sizes.known or not sizes.asked:
        return equal
    if sizes.least != sizes.most:
        raise ValueError("prints of different lengths")
    digits = sizes.least
    m = blocks or block_plan(sizes.asked, sizes.known, digits, threshold)[0]
    if m > digits or -(-digits // m) > 15:
        raise ValueError("blocks have 1 to 15 digits")
    radius, at = threshold // m, ["pos", "value"]
    places = every.mapInArrow(lambda b: _placed(b, digits, m, radius), "pos int, value bigint, f string, candidate boolean, reference boolean")
    parts = [F.ceil(F.count_if(c) / hot).cast("int").alias(n) for c, n in (("candidate", "n_i"), ("reference", "n_j"))]
    shared = places.groupBy(*at).agg(*parts, F.count("*").alias("n")).where("n > 1 AND n_i > 0 AND n_j > 0").drop("n")
    # a crowded value is a table of squares: a candidate stands in each square of its line, a reference in each of its column
    kind = "array<struct<i:int,j:int,candidate:boolean,reference:boolean>>"
    square = lambda i, j, c, r: F.struct(i.alias("i"), j.alias("j"), c.alias("candidate"), r.alias("reference"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    own = lambda n: F.pmod(F.xxhash64("f"), F.col(n)).cast("int")
    line = F.transform(F.sequence(zero, F.col("n_j") - 1), lambda j: square(own("n_i"), j, yes, no))
    column = F.transform(F.sequence(zero, F.col("n_i") - 1), lambda i: square(i, own("n_j"), no, yes))
    none = F.array().cast(kind)
    split = F.concat(F.when(F.col("candidate"), line).otherwise(none), F.when(F.col("reference"), column).otherwise(none))
    squares = F.when((F.col("n_i") == 1) & (F.col("n_j") == 1), F.array(square(zero, zero, F.col("candidate"), F.col("reference")))).otherwise(split)
    # sizes behind Python and explosions can't be estimated, so nothing of them is broadcast
    dealt = places.join(shared.hint("merge"), at).select(*at, "f", F.inline(squares))
    dealt = dealt.repartition(*at, "i", "j").sortWithinPartitions(*at, "i", "j")
    return equal.unionByName(dealt.mapInArrow(lambda b: _compared(b, digits, m, radius, threshold), "f_candidate string, f_reference string, distance int"))


def _near_enough(a: Column, b: Column, ratio: float) -> Column:
    """An unknown duration is near none."""
    return F.abs(a - b) <= ratio * F.greatest(a, b)


def near_matches(
    candidates: DataFrame, references: DataFrame, *, key: str = "identity", fingerprint: str = "fingerprint", seconds: str = "speech_seconds",
    threshold: int = THRESHOLD, ratio: float = RATIO, blocks: int | None = None,
) -> DataFrame:
    """(candidate, reference, distance): every pair of different identities with near prints and durations within ``ratio``.

    As many rows as there are such pairs; ``near_counts`` gives their numbers without making them.
    """
    prints = near_prints(candidates, references, fingerprint=fingerprint, threshold=threshold, blocks=blocks)
    own = candidates.select(F.col(key).alias("candidate"), F.col(fingerprint).alias("f_candidate"), F.col(seconds).alias("s_candidate"))
    other = references.select(F.col(key).alias("reference"), F.col(fingerprint).alias("f_reference"), F.col(seconds).alias("s_reference"))
    out = own.join(prints, "f_candidate").join(other, "f_reference")
    return out.where((F.col("candidate") != F.col("reference")) & _near_enough(F.col("s_candidate"), F.col("s_reference"), ratio)).select("candidate", "reference", "distance")


def near_counts(
    candidates: DataFrame, references: DataFrame, *, key: str = "identity", fingerprint: str = "fingerprint", seconds: str = "speech_seconds", digest: str = "digest",
    threshold: int = THRESHOLD, ratio: float = RATIO, blocks: int | None = None,
) -> DataFrame:
    """(key, n_near): near references of another digest, counted over classes of equal (print, duration, digest).

    All near references are counted over classes without the digest, then those of the own digest are
    taken off: equal sounds of many digests are counted, not paired.
    """
    prints = near_prints(candidates, references, fingerprint=fingerprint, threshold=threshold, blocks=blocks)
    parts = {"f": F.col(fingerprint), "s": F.col(seconds), "d": F.col(digest)}

    def classes(df: DataFrame, side: str, names: str) -> DataFrame:
        return df.where(F.col(fingerprint).isNotNull() & F.col(seconds).isNotNull()).groupBy(*[parts[n].alias(f"{n}_{side}") for n in names]).agg(F.count("*").alias(f"n_{side}"))

    # sizes behind Python can't be estimated, so neither prints nor what is joined with them is broadcast
    prints, near = stored(prints, "near-prints").select("f_candidate", "f_reference").hint("merge"), _near_enough(F.col("s_candidate"), F.col("s_reference"), ratio)
    every = classes(candidates, "candidate", "fs").join(prints, "f_candidate").hint("merge").join(classes(references, "reference", "fs"), "f_reference")
    every = every.where(near).groupBy("f_candidate", "s_candidate").agg(F.sum("n_reference").alias("n_every"))

    own, other = classes(candidates, "candidate", "fsd"), classes(references, "reference", "fsd")
    wide = other.groupBy("d_reference").agg(F.count("*").alias("n")).where(F.col("n") > CLASSES).select("d_reference")
    equal = F.col("d_candidate").eqNullSafe(F.col("d_reference"))
    inside = F.col("d_reference").eqNullSafe(F.col("d_wide"))
    wide = wide.withColumnRenamed("d_reference", "d_wide")
    small, large = (other.hint("merge").join(wide, inside, how) for how in ("left_anti", "left_semi"))
    large = large.withColumnRenamed("f_reference", "f_other")
    words = lambda c: F.transform(F.sequence(F.lit(1), F.length(c), F.lit(15)), lambda i: F.conv(F.substring(F.col(c), i, F.lit(15)), 16, 10).cast("long"))
    distance = F.aggregate(F.zip_with(words("f_candidate"), words("f_reference"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, g: t + g)
    same = own.join(small.hint("merge"), equal).where(near).where(distance <= threshold)
    # a digest of many classes goes by the near prints: its classes are not all paired
    same = same.select("f_candidate", "s_candidate", "d_candidate", "n_reference").unionByName(
        own.join(prints, "f_candidate").hint("merge").join(large, (F.col("f_reference") == F.col("f_other")) & equal).where(near).select("f_candidate", "s_candidate", "d_candidate", "n_reference")
    )
    same = same.groupBy(F.col("f_candidate").alias("f"), F.col("s_candidate").alias("s"), F.col("d_candidate").alias("d")).agg(F.sum("n_reference").alias("n_same"))

    rows = candidates.select(F.col(key).alias("key"), *[c.alias(f"own_{n}") for n, c in parts.items()])
    rows = rows.hint("merge").join(every, (F.col("own_f") == F.col("f_candidate")) & (F.col("own_s") == F.col("s_candidate")))
    rows = rows.hint("merge").join(same, (F.col("own_f") == F.col("f")) & (F.col("own_s") == F.col("s")) & F.col("own_d").eqNullSafe(F.col("d")), "left")
    n = F.col("n_every") - F.coalesce("n_same", F.lit(0))
    return rows.select(F.col("key").alias(key), n.alias("n_near")).where("n_near > 0")
