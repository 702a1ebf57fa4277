"""Draws keyed on (seed, id): the same on every partitioning and every retry."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX32 = 16**8


def digest(seed: int | str | Column, key: str | Column) -> Column:
    """md5 of ``seed:key`` as lower-case hex."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), key.cast("string")))


def hex_prefix(digest_col: Column, digits: int) -> Column:
    """First ``digits`` hex digits of a digest as a long."""
    return F.conv(F.substring(digest_col, 1, digits), 16, 10).cast("long")


def bucket(seed: int | str | Column, key: str | Column, n: int) -> Column:
    """Uniform bucket in ``[0, n)``."""
    return hex_prefix(digest(seed, key), 8) % n


def uniform(seed: int | str | Column, key: str | Column) -> Column:
    """Uniform draw in ``[0, 1)``."""
    return hex_prefix(digest(seed, key), 8) / F.lit(float(HEX32))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_uniform(keys: np.ndarray, seed: int, stream: int) -> np.ndarray:
    """Uniform draws in ``[0, 1)`` of 64-bit row keys inside a task."""
    with np.errstate(over="ignore"):
        salt = _mixed(np.array([seed * 1_000_003 + stream * 7_919 + 1], dtype=np.int64).view(np.uint64))[0]
        bits = _mixed(_mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ salt)
    return (bits >> np.uint64(11)).astype(np.float64) / 2.0**53
