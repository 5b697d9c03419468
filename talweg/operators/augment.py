"""Waveform augmentation whose parameters are hashes: no generator state, so partitioning and order do not matter.

Each step draws its parameter from (namespace, policy, epoch, sample, step); a label is no input.  The chain
is fixed: gain, linear resampling down and up with quantisation, one echo, clamping.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talweg.functions.keys import unit_hash
from talweg.operators.digest import joined_digest

# The steps' names inside the hashed identity.
GAIN, CODEC, DELAY, ECHO = "channel_gain_db", "codec_resample_rate", "replay_delay_ms", "replay_attenuation"
KEPT = 16_384


@dataclass(frozen=True)
class Policy:
    """Ranges of the steps: decibels, rates of the codec, bits, milliseconds and strength of the echo."""

    policy_id: str
    namespace: str
    gain_db: tuple[float, float] = (-6.0, 6.0)
    codec_rates: tuple[int, ...] = (8_000,)
    bits: int = 8
    delay_ms: tuple[float, float] = (10.0, 50.0)
    echo: tuple[float, float] = (0.05, 0.3)

    def __post_init__(self) -> None:
        checks = {
            "an id and a namespace": bool(self.policy_id and self.namespace),
            "ordered gains": self.gain_db[0] <= self.gain_db[1],
            "ascending, different, positive codec rates": bool(self.codec_rates) and self.codec_rates[0] > 0 and all(a < b for a, b in zip(self.codec_rates, self.codec_rates[1:], strict=False)),
            "2 to 16 bits": 2 <= self.bits <= 16,
            "ordered, positive delays": 0 < self.delay_ms[0] <= self.delay_ms[1],
            "ordered echoes from 0 to below 1": 0 <= self.echo[0] <= self.echo[1] < 1,
        }
        if wrong := [name for name, ok in checks.items() if not ok]:
            raise ValueError("a policy needs " + ", ".join(wrong))


def fraction(policy: Policy, sample: Column, epoch: Column, step: str) -> Column:
    """A number from 0 to below 1 by the first 64 bits of the SHA-256 of what identifies the draw."""
    return unit_hash(policy.namespace, policy.policy_id, epoch, sample, step)


def parameters(policy: Policy, sample: Column, epoch: Column) -> Column:
    """struct<gain_db, codec_rate, delay_ms, echo>; null for a null or empty sample id or a negative epoch."""

    def between(bounds: tuple[float, float], step: str) -> Column:
        low, high = bounds
        return F.lit(low) if low == high else F.lit(low) + (high - low) * fraction(policy, sample, epoch, step)

    n = len(policy.codec_rates)
    at = F.least(F.lit(n - 1), F.floor(fraction(policy, sample, epoch, CODEC) * n)).cast("int")
    rate = F.get(F.array(*[F.lit(r) for r in policy.codec_rates]), at)
    drawn = F.struct(between(policy.gain_db, GAIN).alias("gain_db"), rate.alias("codec_rate"), between(policy.delay_ms, DELAY).alias("delay_ms"), between(policy.echo, ECHO).alias("echo"))
    return F.when((F.length(sample.cast("string")) > 0) & (epoch >= 0), drawn)


def _between(n: int, size: int) -> tuple[np.ndarray, ...]:
    """Left and right neighbours of the middles of ``size`` equal parts of ``n`` samples, and their shares."""
    at = np.maximum((np.arange(size, dtype=np.float32) + np.float32(0.5)) * np.float32(n / size) - np.float32(0.5), np.float32(0))
    left = np.minimum(at.astype(np.int64), n - 1)
    part = (at - left).astype(np.float32)
    return left, np.minimum(left + 1, n - 1), 1 - part, part


_between_often = lru_cache(64)(_between)


def resampled(x: np.ndarray, size: int) -> np.ndarray:
    """Linear interpolation at the middles of ``size`` equal parts; beyond the first and last middle the end value holds."""
    n = x.shape[-1]
    left, right, less, part = (_between_often if max(n, size) <= KEPT else _between)(n, size)
    return x.take(left, axis=-1) * less + x.take(right, axis=-1) * part


def augmented(x: np.ndarray, gain_db: float, codec_rate: int, delay_ms: float, echo: float, *, rate: int, bits: int) -> np.ndarray:
    """The chain on samples from -1 to 1, in single precision; the length stays."""
    return augmented_alike(np.asarray(x, dtype=np.float32)[None], [gain_db], codec_rate, [delay_ms], [echo], rate=rate, bits=bits)[0]


def augmented_alike(x: np.ndarray, gain_db: Sequence[float], codec_rate: int, delay_ms: Sequence[float], echo: Sequence[float], *, rate: int, bits: int) -> np.ndarray:
    """The chain on waveforms of one length and codec rate, a row each."""
    n = x.shape[1]
    y = x * np.array([10.0 ** (g / 20.0) for g in gain_db], dtype=np.float32)[:, None]
    y = resampled(resampled(y, max(1, round(n * codec_rate / rate))), n)
    levels = np.float32((1 << bits) - 1)
    y = np.round((np.clip(y, -1, 1) + 1) * levels / 2) * 2 / levels - 1
    out = y.copy()
    for row, dry, ms, strength in zip(out, y, delay_ms, echo, strict=True):
        lag = max(1, round(ms * rate / 1000.0))
        if lag < n:
            row[lag:] += np.float32(strength) * dry[:-lag]
    return np.clip(out, -1, 1)


def powers(y: np.ndarray) -> list[float]:
    """Mean of the squares of each row (each square in single precision), added in order."""
    return (np.add.accumulate(np.square(y), axis=1, dtype=np.float64)[:, -1] / y.shape[1]).tolist()


def digests(y: np.ndarray) -> list[str]:
    """SHA-256 of each row's samples as 16-bit numbers (a half rounded away from zero) with commas between."""
    x = y.astype(np.float64) * 32767.0
    whole = np.trunc(x)
    return [joined_digest(ints) for ints in (whole + np.copysign(np.abs(x - whole) >= 0.5, x)).astype(np.int64)]


def augment(policy: Policy, samples: Column, sample: Column, epoch: Column, rate: int = 16_000) -> Column:
    """Augmented samples (array<float>, from -1 to 1); null where there are none or no parameters."""
    bits = policy.bits

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def chain(x: pd.Series, p: pd.DataFrame) -> pd.Series:
        rows = zip(x, p["gain_db"], p["codec_rate"], p["delay_ms"], p["echo"], strict=True)
        return pd.Series([None if x is None or not len(x) or pd.isna(g) else augmented(np.asarray(x), g, int(c), d, e, rate=rate, bits=bits) for x, g, c, d, e in rows])

    return chain(samples, parameters(policy, sample, epoch))
