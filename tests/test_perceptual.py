from __future__ import annotations

import cmath
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F


def plain_print(samples: list[int]) -> str:
    """The print by loops and a discrete Fourier transform written out, without the operator's code."""
    x = [s / 32768 for s in samples] + [0.0] * max(0, 400 - len(samples))
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 399) for i in range(400)]
    edges = [80.0 * (7600.0 / 80.0) ** (i / 16) for i in range(17)]
    rows = []
    for begin in range(0, len(x) - 399, 160):
        frame = [x[begin + i] * window[i] for i in range(400)]
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / 512) for i, v in enumerate(frame) if v)) ** 2 for k in range(257)]
        rows.append([math.log1p(sum(p for k, p in enumerate(power) if low <= k * 31.25 < high)) for low, high in zip(edges, edges[1:], strict=False)])
    n, pooled = len(rows), []
    for i in range(16):
        a = min(math.floor(n * i / 16), n - 1)
        b = min(max(a + 1, math.ceil(n * (i + 1) / 16)), n)
        pooled.append([sum(r[j] for r in rows[a:b]) / (b - a) for j in range(16)])
    median = [sorted(r[j] for r in pooled) for j in range(16)]
    bits = "".join("1" if r[j] > (median[j][7] + median[j][8]) / 2 else "0" for r in pooled for j in range(16))
    return f"{int(bits, 2):064x}"


@pytest.mark.parametrize("n", [1200, 3100])
def test_print_is_that_of_loops(n):
    from talweg.operators.perceptual import spectral_fingerprint

    r = random.Random(n)
    samples = [int(6000 * math.sin(i * (0.02 + i * 0.00004)) + r.gauss(0, 400)) for i in range(n)]
    assert spectral_fingerprint(np.array(samples)) == plain_print(samples)
    louder = spectral_fingerprint(np.array(samples) * 2)
    assert (int(louder, 16) ^ int(plain_print(samples), 16)).bit_count() < 40  # gain changes few bits


def test_print_of_little_and_of_much():
    from talweg.operators.perceptual import FRAMES_AT_ONCE, spectral_fingerprint

    assert spectral_fingerprint(np.array([])) == "0" * 64 and spectral_fingerprint(np.zeros(5000)) == "0" * 64
    long = np.random.default_rng(1).normal(0, 900, FRAMES_AT_ONCE * 160 + 5000)
    assert len(spectral_fingerprint(long)) == 64


def test_active_samples(spark):
    from talweg.operators.perceptual import active_samples

    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(999)).alias("s"), F.expr("array(struct(10 as start, 310 as end), struct(5 as start, 5 as end), struct(500 as start, 700 as end))").alias("g"))
    got = df.select(active_samples(F.col("s"), F.col("g")), active_samples(F.col("s"), F.slice("g", 1, 1))).first()
    assert got[0] == [*range(10, 310), *range(500, 700)] and len(got[1]) == 1000


def flipped(r: random.Random, v: int, bits: int, most: int) -> int:
    for b in r.sample(range(bits), r.randint(0, most)):
        v ^= 1 << b
    return v


@pytest.mark.parametrize(("digits", "threshold", "blocks", "hot"), [(16, 7, None, 1000), (16, 7, 4, 3), (64, 12, 16, 5), (64, 12, None, 1000), (64, 12, 8, 2), (5, 3, None, 1), (6, 0, None, 2)])
def test_near_prints_are_all_pairs(spark, digits, threshold, blocks, hot):
    from talweg.operators.perceptual import near_prints

    r, bits = random.Random(digits * threshold), digits * 4
    base = [r.getrandbits(bits) for _ in range(12)] + [0, (1 << bits // 2) - 1]
    values = [flipped(r, v, bits, threshold + 3) for v in base for _ in range(14)]
    values += [r.getrandbits(bits) >> bits // 2 << bits // 2 for _ in range(60)]  # the same low half: crowded blocks
    hexed = [f"{v:0{digits}x}" for v in values]
    left, right = hexed[::2] + [None, hexed[0]], hexed[1::2] + [hexed[0], None]
    a, b = (spark.createDataFrame([(x,) for x in xs], "fingerprint string") for xs in (left, right))
    got = [tuple(x) for x in near_prints(a, b, threshold=threshold, blocks=blocks, hot=hot).collect()]
    gap = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    want = {(x, y, gap(x, y)) for x in set(left) - {None} for y in set(right) - {None} if gap(x, y) <= threshold}
    assert len(got) == len(set(got)) and set(got) == want
    assert near_prints(a, b.limit(0)).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        near_prints(a, b.withColumn("fingerprint", F.concat("fingerprint", F.lit("0"))))


def test_near_counts_are_those_of_pairs(spark):
    from talweg.operators import dedupe as D
    from talweg.operators import perceptual as P

    r = random.Random(8)
    data = [(i, f"{flipped(r, r.choice([0, 77 << 40]), 64, 5):016x}" if i % 9 else None, r.choice([1.0, 1.1, 3.0, None]), r.choice(["a", "b", None])) for i in range(150)]
    df = spark.createDataFrame(data, "identity long, fingerprint string, speech_seconds double, digest string")
    counts = {x["identity"]: x["n_near"] for x in P.near_counts(df, df, threshold=7).collect()}
    pairs = P.near_matches(df, df, threshold=7).collect()
    digest = {d[0]: d[3] for d in data}
    assert counts == Counter(p["candidate"] for p in pairs if digest[p["candidate"]] != digest[p["reference"]])
    assert D.near_of_other_digests(P.near_matches(df, df, threshold=7), df, key="identity", digest="digest").count() > 0


def operators(df):
    """(name, rows out) of the operators of a plan that has run."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        metrics = node.metrics()
        yield name, metrics.get("numOutputRows").get().value() if metrics.contains("numOutputRows") else 0
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]


def test_equal_sounds_of_many_digests_are_counted_not_paired(spark):
    from talweg.operators.perceptual import near_counts, near_prints

    n, hexed = 1500, F.when(F.col("id") % 3 == 0, F.lit("0" * 64)).when(F.col("id") % 3 == 1, F.lit("0" * 63 + "1")).otherwise(F.sha2(F.col("id").cast("string"), 256))
    df = spark.range(n).select(F.col("id").alias("identity"), hexed.alias("fingerprint"), F.lit(3.0).alias("speech_seconds"), F.col("id").alias("digest"))
    counts = near_counts(df, df, blocks=16)
    assert {tuple(r) for r in counts.collect()} == {(i, n * 2 // 3 - 1) for i in range(n) if i % 3 < 2}
    ran = list(operators(counts))
    assert max(rows for _, rows in ran) <= 20 * n and not any("Broadcast" in name and "Join" in name for name, _ in ran)
    pairs = near_prints(df, df, blocks=16)
    assert pairs.count() == n // 3 + 2 + 2
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()  # what explodes can't be estimated


def test_same_digests_are_no_near_ones(spark):
    from talweg.operators import perceptual as P

    r = random.Random(3)
    data = [(i, f"{flipped(r, 0, 64, 4):016x}", r.choice([3.0, 3.1, None]), r.choice(["all", None, str(i % 40)])) for i in range(400)]  # digests of few and of many classes
    df = spark.createDataFrame(data, "identity long, fingerprint string, speech_seconds double, digest string")
    gap = lambda x, y: (int(x, 16) ^ int(y, 16)).bit_count()
    want = {a[0]: sum(gap(a[1], b[1]) <= 7 and None not in (a[2], b[2]) and a[3] != b[3] for b in data) for a in data}
    assert {x["identity"]: x["n_near"] for x in P.near_counts(df, df, threshold=7).collect()} == {k: v for k, v in want.items() if v}


def test_waves_are_measured_as_columns_were(spark):
    from talweg.operators import composed, timeseries
    from talweg.operators.perceptual import spectral_fingerprint

    r = random.Random(5)
    waves = [[int(r.gauss(0, 9000)) for _ in range(1500)], [32767, -32768] * 300, [], None, [5, None, 40000, -7] * 200]
    data = [(i, w, [(100, 700)] if i == 0 else []) for i, w in enumerate(waves)]
    df = spark.createDataFrame(data, "k long, samples array<int>, segments array<struct<start:int,end:int>>")
    q, text = timeseries.array_quality(F.col("samples")), F.array_join(F.transform("samples", lambda v: v.cast("string")), ",")
    want = {x["k"]: x for x in df.where("size(samples) > 0").select("k", q.alias("q"), F.sha2(text, 256).alias("digest")).collect()}
    got = {x["k"]: x for x in composed.measured(df, ["k"]).withColumn("rms", timeseries.decibels(F.col("power"))).collect()}
    assert [got[k]["digest"] for k in (2, 3)] == [None, None] == [got[k]["fingerprint"] for k in (2, 3)]
    assert all(got[k]["digest"] == w["digest"] and got[k]["clipped_fraction"] == w["q"]["clipped_fraction"] for k, w in want.items())
    assert all(got[k]["rms"] == want[k]["q"]["rms_dbfs"] for k in (0, 1)) and got[4]["power"] is None
    assert [got[0]["fingerprint"], got[1]["fingerprint"]] == [spectral_fingerprint(np.array(w)) for w in (waves[0][100:700], waves[1])]


def test_plan_keeps_pairs_in_proportion():
    from talweg.operators.perceptual import _masks, block_plan

    for digits, threshold in ((16, 7), (64, 12)):
        for n in (10**3, 10**5, 10**7, 10**9):
            m, radius = block_plan(n, n, digits, threshold)
            assert radius == threshold // m and -(-digits // m) <= 15
            width = 4 * (digits // m)
            pairs = n * m * sum(math.comb(4 * -(-digits // m), i) for i in range(radius + 1)) / 2**width
            probes = m * sum(math.comb(4 * -(-digits // m), i) for i in range(radius + 1))
            assert pairs + probes <= 14_000, (digits, n, m)  # work for each candidate, however many there are
    assert len(_masks(16, 2)) == 1 + 16 + 120


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_registered_prints_are_those_of_numpy(spark):
    from talweg.operators.perceptual import spectral_fingerprint
    from talweg.plans import QUERIES
    from talweg.plans.evaluation import _waveforms

    d = "/root/testdata/sf0.001"
    waves = {f"{w['user_id']}/{w['day']}": w["active"] for w in _waveforms(spark, d).collect()}
    prints = {f"{p['user_id']}/{p['day']}": p["fingerprint"] for p in QUERIES["spectral_prints"](spark, d).collect()}
    assert len(waves) == len(prints) > 100 and all(spectral_fingerprint(np.array(w)) == prints[k] for k, w in waves.items())
    some = sorted(waves)[:2]
    assert [plain_print(list(waves[k])) for k in some] == [prints[k] for k in some]
    ints, seconds = {k: int(p, 16) for k, p in prints.items()}, {k: len(w) / 16000 for k, w in waves.items()}
    near = lambda x, y: (ints[x] ^ ints[y]).bit_count() <= 12 and abs(seconds[x] - seconds[y]) <= 0.15 * max(seconds[x], seconds[y])
    want = {x: sum(near(x, y) for y in ints if y != x) for x in ints}
    got = {r["identity"]: r["n_near"] for r in QUERIES["spectral_near_dups"](spark, d).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_decode_to_freeze_is_that_of_plain_python(spark):
    import hashlib

    from talweg.operators.perceptual import spectral_fingerprint
    from talweg.plans import QUERIES
    from talweg.plans.evaluation import _waveforms

    d = "/root/testdata/sf0.001"
    pool, old = {}, []
    for w in _waveforms(spark, d).collect():
        samples = [0 if w["user_id"] % 13 == 3 else v for v in w["samples"]]
        inside = [v for s in w["segments"] for v in samples[s["start"] : s["end"]]]
        active = inside if len(inside) >= 400 else samples
        row = (hashlib.sha256(",".join(map(str, samples)).encode()).hexdigest(), int(spectral_fingerprint(np.array(active)), 16), w["n_events"] * 1.25, not any(samples))
        if w["user_id"] % 10 == 0:
            old.append(row)
        else:
            pool[f"{w['user_id']}/{w['day']}"] = (w["user_id"] % 3, *row)
    every = [(g, f, s) for g, f, s, _ in old] + [(g, f, s) for _, g, f, s, _ in pool.values()]
    status = {k: "rejected_quality" if quiet else "insufficient_speech" if s < 2.5 else "ready" for k, (_, _, _, s, quiet) in pool.items()}
    rank = lambda k: (hashlib.sha256(k.encode()).hexdigest(), k)
    owner: dict = {}
    for k in sorted((k for k in pool if status[k] == "ready"), key=rank):
        owner.setdefault(pool[k][1], k)
    want, taken = {}, Counter()
    for k in sorted(pool, key=rank):
        route, g, f, s, _ = pool[k]
        near = sum(h != g and (f ^ p).bit_count() <= 12 and abs(s - t) <= 0.15 * max(s, t) for h, p, t in every)
        known = g in {x[0] for x in old}
        made = "not_ready" if status[k] != "ready" else "historical_exact" if known else "pool_exact" if owner[g] != k else "near_pending" if near else "eligible"
        position = None
        if made == "eligible" and taken[route] < 20:
            taken[route] += 1
            position = taken[route]
        want[k] = (route, status[k], made, near, position)
    got = {r["sample"]: (r["route"], r["status"], r["decision"], r["n_near"], r["position"]) for r in QUERIES["decode_to_freeze"](spark, d).collect()}
    assert got == want and {w[2] for w in want.values()} >= {"not_ready", "eligible"}
