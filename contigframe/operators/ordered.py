"""Operators that follow an order: runs, moving sums, merged ranges, running totals.

Positions are cut into chunks of fixed length and every step works per (key, chunk), so one
key with very many rows is spread over many tasks. What has to cross a chunk border crosses it
as a copied border row (``with_halo``) or as one value per chunk (``carry``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import VIRAL_NAMES
from ..functions.scores import window_letter
from .skew import null_safe_join, salted_join

CHUNK = 1 << 14


def chunk_of(order: str, chunk: int) -> Column:
    return F.floor(F.col(order) / chunk).cast("bigint")


def with_halo(
    df: DataFrame, order: str, before: int, after: int, chunk: int = CHUNK
) -> DataFrame:
    """Place every row in its chunk, and also in a neighbour chunk whose frames reach it.

    Adds ``_chunk`` (where the copy lives) and ``_home`` (true for the original). A frame of
    ``before`` rows back and ``after`` rows ahead is then complete inside a chunk. Positions
    must be dense: 0, 1, 2, ... within a key.
    """
    first = F.floor(F.greatest(F.col(order) - after, F.lit(0)) / chunk)
    last = F.floor((F.col(order) + before) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_home", F.col("_chunk") == chunk_of(order, chunk)
    )


def frame_over(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    frames: dict[str, tuple[str, Column, int, int]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Aggregates over a fixed frame of rows around each position.

    ``frames`` maps an output name to (function name, column, rows before, rows after).
    """
    before = max(b for _, _, b, _ in frames.values())
    after = max(a for _, _, _, a in frames.values())
    data = with_halo(df, order, before, after, chunk)
    base = Window.partitionBy(*keys, "_chunk").orderBy(order)
    data = data.select(
        "*",
        *[
            getattr(F, fn)(col).over(base.rowsBetween(-b, a)).alias(name)
            for name, (fn, col, b, a) in frames.items()
        ],
    )
    return data.where("_home").drop("_chunk", "_home")


def neighbours(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, tuple[Column, int]],
    chunk: int = CHUNK,
) -> DataFrame:
    """Values of other rows at a fixed distance: ``{out: (column, offset)}``, null outside."""
    back = max([0, *[-o for _, o in values.values()]])
    ahead = max([0, *[o for _, o in values.values()]])
    data = with_halo(df, order, back, ahead, chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(order)
    data = data.select(
        "*", *[F.lag(col, -offset).over(w).alias(out) for out, (col, offset) in values.items()]
    )
    return data.where("_home").drop("_chunk", "_home")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, tuple[str, str]],
    chunk: int = CHUNK,
    inclusive: bool = True,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Running ``sum`` or ``max`` along the order: ``{out: (function, column)}``.

    Each chunk is aggregated once, the chunk values are carried along, and the rows of a chunk
    only add what comes before them inside it. Positions need not be dense; ``tie`` orders rows
    that share a position.
    """
    keys = list(keys)
    data = df.withColumn("_chunk", chunk_of(order, chunk))
    per = data.groupBy(*keys, "_chunk").agg(
        *[getattr(F, fn)(c).alias(f"_{out}") for out, (fn, c) in values.items()]
    )
    prior = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(
        *keys,
        "_chunk",
        *[getattr(F, fn)(f"_{out}").over(prior).alias(f"_{out}") for out, (fn, _) in values.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(order, *tie)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    joined = null_safe_join(data, carry, [*keys, "_chunk"])
    cols = []
    for out, (fn, c) in values.items():
        here, past = getattr(F, fn)(c).over(inside), F.col(f"_{out}")
        if fn == "sum":
            # Null only where nothing precedes the row at all.
            both = F.when(here.isNull(), past).otherwise(here + F.coalesce(past, F.lit(0)))
        else:
            both = F.greatest(here, past)
        cols.append(both.alias(out))
    return joined.select("*", *cols).drop("_chunk", *[f"_{out}" for out in values])


def last_position(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(order).alias("_last"))


def find_runs(
    df: DataFrame, keys: Sequence[str], order: str, value: str, chunk: int = CHUNK
) -> DataFrame:
    """Runs of equal neighbours: ``run_start, run_length, run_value`` per key.

    Only the first row of each run goes on; its length is the distance to the next run start,
    found in the same chunk or as the first start of a later chunk.
    """
    keys = list(keys)
    rows = df.select(*keys, order, value)
    prev = neighbours(rows, keys, order, {"_prev": (F.col(value), -1)}, chunk)
    starts = prev.where((F.col(order) == 0) | ~F.col("_prev").eqNullSafe(F.col(value))).select(
        *keys,
        F.col(order).alias("run_start"),
        F.col(value).alias("run_value"),
        chunk_of(order, chunk).alias("_chunk"),
    )
    # One row per chunk: its first run start, and the end of the key after the last chunk.
    per = starts.groupBy(*keys, "_chunk").agg(F.min("run_start").alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_chunk")
    bounds = (
        per.withColumn("_next", F.lead("_first").over(later))
        .join(last_position(rows, keys, order), keys)
        .select(*keys, "_chunk", F.coalesce("_next", F.col("_last") + 1).alias("_end"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("run_start")
    return (
        starts.join(bounds, [*keys, "_chunk"])
        .withColumn(
            "run_length",
            (F.coalesce(F.lead("run_start").over(inside), F.col("_end")) - F.col("run_start")).cast(
                "int"
            ),
        )
        .select(*keys, "run_start", "run_length", "run_value")
    )


def window_summary(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    label: str,
    viral: tuple[str, ...] = VIRAL_NAMES,
    chunk: int = CHUNK,
) -> DataFrame:
    """Run-length string per key, such as ``5P1b2P``.

    Runs are joined into text per chunk first; a key then only joins its chunk texts.
    """
    runs = find_runs(df, keys, order, label, chunk)
    text = F.concat(F.col("run_length").cast("string"), window_letter(F.col("run_value"), viral))
    return join_text(runs.withColumn("_text", text), keys, "run_start", "_text", chunk).select(
        *keys, F.col("joined").alias("window_summary")
    )


def join_text(
    df: DataFrame, keys: Sequence[str], order: str, text: str, chunk: int = CHUNK
) -> DataFrame:
    """Concatenate ``text`` along the order into ``joined``, chunk by chunk."""

    def joined(position: str, value: str) -> Column:
        items = F.array_sort(F.collect_list(F.struct(F.col(position), F.col(value))))
        return F.array_join(F.transform(items, lambda s: s[value]), "")

    pieces = (
        df.withColumn("_chunk", chunk_of(order, chunk))
        .groupBy(*keys, "_chunk")
        .agg(joined(order, text).alias("_piece"))
    )
    return pieces.groupBy(*keys).agg(joined("_chunk", "_piece").alias("joined"))


def viral_summary(
    df: DataFrame, keys: Sequence[str], order: str, label: str, viral: str, chunk: int = CHUNK
) -> DataFrame:
    """Two-letter form: ``V`` for windows of the viral class, ``n`` for all others."""
    flagged = df.withColumn("_viral", F.col(label) == viral)
    runs = find_runs(flagged, keys, order, "_viral", chunk)
    text = F.concat(
        F.col("run_length").cast("string"),
        F.when(F.col("run_value"), F.lit("V")).otherwise(F.lit("n")),
    )
    return join_text(runs.withColumn("_text", text), keys, "run_start", "_text", chunk).select(
        *keys, F.col("joined").alias("window_summary")
    )


def consecutive_groups(
    df: DataFrame, keys: Sequence[str], order: str, value: str, step: int = 1, chunk: int = CHUNK
) -> DataFrame:
    """Number the stretches of rows (dense ``order``) whose ``value`` rises by ``step``."""
    prev = neighbours(df, keys, order, {"_prev": (F.col(value), -1)}, chunk)
    breaks = prev.withColumn(
        "_break",
        F.when(F.col("_prev").isNull() | (F.col(value) - F.col("_prev") == step), 0).otherwise(1),
    )
    return running(breaks, keys, order, {"group_idx": ("sum", "_break")}, chunk).drop(
        "_prev", "_break"
    )


def merge_ranges(
    df: DataFrame,
    keys: Sequence[str],
    start: str = "start",
    end: str = "end",
    chunk: int = 1 << 20,
) -> DataFrame:
    """Merge ranges that overlap or touch; ``chunk`` is a width on the start axis.

    A range opens a new island when it starts after the largest end so far. The last opening
    at or before a range names its island.
    """
    keys = list(keys)
    distinct = df.select(*keys, start, end).groupBy(*keys, start).agg(F.max(end).alias(end))
    seen = running(distinct, keys, start, {"_reach": ("max", end)}, chunk, inclusive=False)
    opened = seen.withColumn(
        "_open",
        F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start)),
    ).drop("_reach")
    named = running(opened, keys, start, {"_island": ("max", "_open")}, chunk)
    return named.groupBy(*keys, F.col("_island").alias(start)).agg(F.max(end).alias(end))


def scale_range(
    df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, out: str
) -> DataFrame:
    """Min-max scale per key; a constant key maps to ``low``."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    scaled = F.try_divide(F.col(value) - F.col("_min"), F.col("_max") - F.col("_min")) * (
        high - low
    ) + F.lit(float(low))
    return (
        salted_join(df, bounds, keys, df.columns)
        .withColumn(out, F.coalesce(scaled, F.lit(float(low))))
        .drop("_min", "_max")
    )


def smooth(
    df: DataFrame, keys: Sequence[str], order: str, value: str, width: int, out: str,
    mean: bool = True, chunk: int = CHUNK,
) -> DataFrame:
    """Centred moving sum or mean with zeros beyond both ends (always divided by ``width``)."""
    before, after = width // 2, width - 1 - width // 2
    framed = frame_over(df, keys, order, {"_sum": ("sum", F.col(value), before, after)}, chunk)
    total = F.col("_sum") / F.lit(float(width)) if mean else F.col("_sum")
    return framed.withColumn(out, total).drop("_sum")


def local_peaks(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """True for a row that is the larger of an adjacent pair (the earlier one on a tie)."""
    near = neighbours(
        df, keys, order, {"_prev": (F.col(value), -1), "_next": (F.col(value), 1)}, chunk
    )
    peak = F.coalesce(F.col(value) > F.col("_prev"), F.lit(False)) | F.coalesce(
        F.col(value) >= F.col("_next"), F.lit(False)
    )
    return near.withColumn(out, peak).drop("_prev", "_next")


def mark_ends(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Flags for the first and the last row of each key."""
    return (
        salted_join(df, last_position(df, keys, order), keys, [order])
        .withColumn("is_first", F.col(order) == 0)
        .withColumn("is_last", F.col(order) == F.col("_last"))
        .drop("_last")
    )
