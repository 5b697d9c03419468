from __future__ import annotations

import hashlib
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def plain_fraction(*parts) -> float:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big") / 2.0**64


def plain_chain(x: list[float], gain_db: float, codec_rate: int, delay_ms: float, echo: float, rate: int, bits: int) -> list[float]:
    """By loops, in double precision."""

    def resample(v: list[float], size: int) -> list[float]:
        out = []
        for i in range(size):
            at = max(0.0, (i + 0.5) * len(v) / size - 0.5)
            left = min(int(at), len(v) - 1)
            right = min(left + 1, len(v) - 1)
            out.append(v[left] + (v[right] - v[left]) * (at - left))
        return out

    y = [v * 10 ** (gain_db / 20) for v in x]
    y = resample(resample(y, max(1, round(len(y) * codec_rate / rate))), len(y))
    levels = 2**bits - 1
    y = [round((min(1, max(-1, v)) + 1) * levels / 2) * 2 / levels - 1 for v in y]
    lag = max(1, round(delay_ms * rate / 1000))
    if lag < len(y):
        y = [v + (echo * y[i - lag] if i >= lag else 0) for i, v in enumerate(y)]
    return [min(1, max(-1, v)) for v in y]


@pytest.mark.parametrize("n", [1, 2, 7, 900, 4001])
def test_chain_is_that_of_loops(n):
    from talweg.operators.augment import augmented

    r = random.Random(n)
    x = [math.sin(i / 9) * 0.8 + r.uniform(-0.1, 0.1) for i in range(n)]
    for gain, codec, delay, echo, bits in ((-3.0, 8000, 20.0, 0.2, 8), (6.0, 5512, 0.01, 0.0, 12), (0.0, 16000, 10_000.0, 0.3, 16)):
        got, want = augmented(np.array(x), gain, codec, delay, echo, rate=16000, bits=bits), plain_chain(x, gain, codec, delay, echo, 16000, bits)
        step = 2 / (2**bits - 1)
        gap = np.abs(got - np.array(want))
        # single against double precision: a sample may fall to the neighbouring level
        assert len(got) == n and gap.max() <= step * 1.4 + 1e-5 and (gap > 1e-3).mean() <= 0.01
        assert got.min() >= -1 and got.max() <= 1


def test_parameters_depend_on_the_identity_alone(spark):
    from talweg.operators.augment import Policy, augment, parameters

    p = Policy("p1", "ns", gain_db=(-4.0, 2.0), codec_rates=(4000, 8000, 12000), delay_ms=(5.0, 9.0), echo=(0.1, 0.1))
    data = [(f"s{i}", e, [0.1 * ((i * k) % 7 - 3) for k in range(50)], "bonafide" if i % 2 else "spoof") for i in range(20) for e in range(2)]
    data += [("", 0, [0.1], "x"), (None, 0, [0.1], "x"), ("s", -1, [0.1], "x"), ("e", 0, [], "x"), ("n", 0, None, "x")]
    df = spark.createDataFrame(data, "id string, epoch int, x array<float>, label string")
    out = df.select("id", "epoch", parameters(p, F.col("id"), F.col("epoch")).alias("p"), augment(p, F.col("x"), F.col("id"), F.col("epoch")).alias("y"))
    one = {(r["id"], r["epoch"]): (r["p"], r["y"]) for r in out.repartition(5).collect()}
    two = {(r["id"], r["epoch"]): (r["p"], r["y"]) for r in out.orderBy(F.desc("id")).coalesce(1).collect()}
    assert one == two
    for (sample, epoch), (got, y) in one.items():
        if not sample or epoch < 0:
            assert got is None and y is None
            continue
        draw = lambda step, s=sample, e=epoch: plain_fraction("ns", "p1", e, s, step)
        assert got["gain_db"] == pytest.approx(-4.0 + 6.0 * draw("channel_gain_db")) and got["delay_ms"] == pytest.approx(5 + 4 * draw("replay_delay_ms"))
        assert got["codec_rate"] == (4000, 8000, 12000)[int(draw("codec_resample_rate") * 3)] and got["echo"] == 0.1
        assert y is None if sample in ("e", "n") else len(y) == 50
    assert len({v[0]["gain_db"] for v in one.values() if v[0]}) > 35


def test_wrong_policies():
    from talweg.operators.augment import Policy

    for wrong in ({"policy_id": ""}, {"gain_db": (1.0, 0.0)}, {"codec_rates": (8000, 4000)}, {"codec_rates": ()}, {"bits": 1}, {"delay_ms": (0.0, 1.0)}, {"echo": (0.1, 1.0)}):
        with pytest.raises(ValueError, match="a policy needs"):
            Policy(**{"policy_id": "p", "namespace": "n"} | wrong)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_augmented_days_are_those_of_loops(spark):
    from talweg.operators import augment
    from talweg.plans import QUERIES
    from talweg.plans.evaluation import POLICY, _waveforms

    d = "/root/testdata/sf0.001"
    half_up = lambda v: int(math.copysign(math.floor(abs(v) + 0.5), v))
    days = QUERIES["augmented_waveforms"](spark, d)
    got = {r["sample"]: r for r in days.collect()}
    waves = {f"{w['user_id']}/{w['day']}": w["active"] for w in _waveforms(spark, d).collect()}
    params = {r["s"]: r["p"] for r in spark.createDataFrame([(k,) for k in waves], "s string").select("s", augment.parameters(POLICY, F.col("s"), F.lit(0)).alias("p")).collect()}
    assert got.keys() == waves.keys()
    for k in sorted(waves)[::7]:
        y = augment.augmented(np.array(waves[k]) / 32768.0, *params[k], rate=16000, bits=8).tolist()
        text = ",".join(str(half_up(v * 32767.0)) for v in y)
        square = 0.0
        for v in y:
            square += float(np.float32(v) * np.float32(v))
        assert got[k]["digest"] == hashlib.sha256(text.encode()).hexdigest() and got[k]["n_samples"] == len(y) and got[k]["power"] == pytest.approx(square / len(y), abs=6e-7)
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "REPARTITION_BY_NUM" in plan  # sound is made and used up in one pass, by a fixed number of tasks


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_tones_are_those_of_the_engine(spark):
    from talweg.plans.evaluation import _tones

    hz = [90.0 + 37.31 * i for i in range(150)]
    df = spark.createDataFrame([(h,) for h in hz], "hz double")
    wave = F.transform(F.sequence(F.lit(0), F.lit(479)), lambda i: F.round(F.sin(i * F.col("hz") * 3.926990816987241e-4) * 8000.0).cast("int"))
    assert [v for r in df.select(wave).collect() for v in r[0]] == _tones(np.array(hz)).tolist()
    assert _tones(np.array([0.0])).tolist() == [0] * 480
