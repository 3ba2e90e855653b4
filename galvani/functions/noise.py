"""Reproducible noise: a value depends on (seed, projection, key) alone, not on partitions or retries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def projections(factor: float, n: int) -> int:
    """How many projections: factor * ln n, rounded half to even, at least one."""
    return max(1, round(factor * float(np.log(max(n, 1)))))


def sign(seed: int, t: int | Column, *keys: str) -> Column:
    """+1 or -1 for each row, from one bit of a hash of seed, projection and keys."""
    bit = F.xxhash64(F.lit(seed), F.lit(t).cast("int"), *keys).bitwiseAND(F.lit(1))
    return F.when(bit == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
