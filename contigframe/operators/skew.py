"""Joins whose large side may hold one key in a large share of its rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str],
    how: str = "inner", salts: int = 16,
) -> DataFrame:
    """Join where each key of ``big`` is spread over ``salts`` tasks; null keys are equal.

    ``small`` is copied once per salt, so it should have few rows per key. Only join types that
    keep unmatched rows of ``big`` at most are safe.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type not supported with salts: {how}")
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    return null_safe_join(
        big.withColumn("_salt", salt), small.withColumn("_salt", F.explode(copies)), [*on, "_salt"], how
    ).drop("_salt")


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where two nulls are equal. Columns of ``left`` come first, keys once."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    equal = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    return left.join(renamed, reduce(and_, equal), how).drop(*[f"_right_{c}" for c in on])


def with_single(df: DataFrame, single: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (an aggregate without groups) to every row."""
    return (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(single.withColumn("_one", F.lit(1))), "_one")
        .drop("_one")
    )
