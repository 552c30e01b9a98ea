"""Seeded, layout-independent hashing.

Every random choice in the package (which series are sampled, which noise a
point receives) is a function of the row's own keys and a seed, so results do
not move when the partitioning does.  ``hash32`` (a Column) and ``hash32_np``
(numpy, used inside Arrow kernels) give the same number for the same keys.  All
intermediate values are non-negative 63-bit integers, so any SQL engine with
BIGINT can restate them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixing steps: every key half takes STEP, then FINAL runs once.
# A step is (shift, multiplier): y = h + key; h = ((y xor (y >> shift)) * multiplier) mod 2^32.
MASK = 4294967295
HASH_SPACE = 4294967296
STEP = (16, 2146121005)
FINAL = ((15, 739982445), (16, 2146121005), (15, 1))


def _as_long(part) -> Column:
    return part.cast("bigint") if isinstance(part, Column) else F.lit(int(part)).cast("bigint")


def hash32(seed: int, *parts) -> Column:
    """32-bit hash of a seed and BIGINT parts (columns or ints), as a BIGINT column."""
    mask = F.lit(MASK).cast("bigint")

    def step(key: Column, shift: int, multiplier: int) -> Column:
        return F.struct(
            key.alias("key"), F.lit(shift).alias("shift"), F.lit(multiplier).cast("bigint").alias("mult")
        )

    steps = []
    for part in map(_as_long, parts):
        steps.append(step(part.bitwiseAND(mask), *STEP))
        steps.append(step(F.shiftright(part, 32).bitwiseAND(mask), *STEP))
    steps += [step(F.lit(0).cast("bigint"), *final) for final in FINAL]

    def mix(h: Column, s: Column) -> Column:
        y = (h + s.getField("key")).bitwiseAND(mask)
        shifted = F.call_function("shiftright", y, s.getField("shift"))
        return (y.bitwiseXOR(shifted) * s.getField("mult")).bitwiseAND(mask)

    return F.aggregate(F.array(*steps), F.lit(int(seed) & MASK).cast("bigint"), mix)


def hash32_np(seed: int, *parts) -> np.ndarray:
    """The numpy form of :func:`hash32`; parts broadcast against each other."""
    mask = np.int64(MASK)

    def mix(h, key, shift, multiplier):
        y = (h + key) & mask
        return ((y ^ (y >> np.int64(shift))) * np.int64(multiplier)) & mask

    h = np.asarray(int(seed) & MASK, dtype=np.int64)
    for part in parts:
        p = np.asarray(part, dtype=np.int64)
        h = mix(h, p & mask, *STEP)
        h = mix(h, (p >> np.int64(32)) & mask, *STEP)
    for final in FINAL:
        h = mix(h, np.int64(0), *final)
    return h


def uniform_np(seed: int, *parts) -> np.ndarray:
    """Uniform draw in the open interval (0, 1)."""
    return (hash32_np(seed, *parts) + 0.5) / float(HASH_SPACE)


def sample_threshold(fraction: float) -> int:
    """Rows whose hash is below this value form a Bernoulli sample of ``fraction``."""
    return int(np.floor(min(1.0, max(0.0, fraction)) * HASH_SPACE))
