"""Repeatable pseudo-random choices.

A choice is a hash of (seed, id, position): the same under any partitioning, after a lost
executor, and in any engine that has md5 and 64-bit integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 1 << 32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_hash(*key: Column | str, seed: int = 0) -> Column:
    """32 uniform bits of md5 over the seed and key columns, as a bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def mix(value: Column) -> Column:
    """One step of a 32-bit multiply, add and fold."""
    x = F.pmod(value * F.lit(1664525) + F.lit(1013904223), F.lit(SPACE))
    return x.bitwiseXOR(F.shiftright(x, 15))


def at(hash_: Column, position: Column | int) -> Column:
    """32 bits for one position under a row hash."""
    position = F.lit(position) if isinstance(position, int) else position
    start = F.pmod(hash_ + position.cast("bigint") * F.lit(2654435761), F.lit(SPACE))
    return mix(mix(start))


def unit(hash_: Column) -> Column:
    """The hash as a number in [0, 1)."""
    return hash_.cast("double") / F.lit(float(SPACE))


def between(hash_: Column, low: Column | int, high: Column | int) -> Column:
    """An integer in [low, high], both ends included."""
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return (low + F.pmod(hash_, (high - low + 1).cast("bigint"))).cast("int")
