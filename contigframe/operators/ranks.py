"""Exact ranks, running totals and quantiles without one task per group.

A window over ``partitionBy(group)`` sorts a whole group in one task. Here every group is cut
into ordered buckets: rows are counted per bucket (a map-side combined aggregate), the bucket
counts (a small table) are summed along the order, and rows are only sorted inside a bucket.
A group holding a third of all rows is spread over as many tasks as it has buckets; how many
there are follows from the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .skew import null_safe_join, salted_join

HASH_BITS = 32
#: Rows that one task sorts, about.
BUCKET_ROWS = 1 << 16
#: Parts into which a round of ``exact_quantiles`` cuts a bracket.
PARTS = 128


def bits_of(n_rows: int) -> int:
    """Leading hash bits that cut so many rows into buckets of about ``BUCKET_ROWS``."""
    return min(HASH_BITS, max(0, (n_rows // BUCKET_ROWS).bit_length()))


def hash_bucket(hash_col: str, bits: int) -> Column:
    """Ordered bucket of a 32-bit hash: its leading bits."""
    return F.shiftright(F.col(hash_col), HASH_BITS - bits).cast("bigint")


def _carry(partial: DataFrame, keys: Sequence[str], bucket: str, sums: dict[str, str]):
    """Totals of all buckets before each one. ``partial`` has one row per group and bucket."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return partial.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(out) for out, c in sums.items()],
    )


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "rank"
) -> DataFrame:
    """0-based rank of each row within its group by ``order``.

    ``bucket`` must not decrease along the order. With no keys the rank is global. Rows whose key
    is null are a group like any other.
    """
    keys = list(keys)
    data = df.withColumn("_bucket", bucket)
    if not keys:
        data = data.withColumn("_all", F.lit(0))
        keys = ["_all"]
    per = data.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    carry = _carry(per, keys, "_bucket", {"_before": "_n"})
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = null_safe_join(data, carry, [*keys, "_bucket"]).withColumn(
        out, (F.col("_before") + F.row_number().over(w) - 1).cast("bigint")
    )
    return ranked.drop("_bucket", "_before", "_all")


def group_sizes(df: DataFrame, keys: Sequence[str], out: str = "n_rows") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def with_group_size(df: DataFrame, keys: Sequence[str], out: str = "n_rows") -> DataFrame:
    return null_safe_join(df, group_sizes(df, keys, out), list(keys))


def totals_before(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]
) -> DataFrame:
    """For each row, the sums over all rows of its group with a smaller ``value``.

    ``value`` must be distinct within a group (aggregate first, which also folds ties). Adds
    ``<sum>_before`` columns and ``<sum>_total``. Rows whose key is null are a group like any other.

    Buckets are ranges of (keys, value) of about ``BUCKET_ROWS`` rows, whatever the groups.
    """
    keys = list(keys)
    data = df
    if not keys:
        data = data.withColumn("_all", F.lit(0))
        keys = ["_all"]
    data = cut(data)
    parts = 1 + data.count() // BUCKET_ROWS
    if parts > 1:
        # Written out: a range shuffle draws its borders anew when it runs again.
        data = cut(data.repartitionByRange(parts, *keys, value).withColumn("_bucket", F.spark_partition_id()))
    else:
        data = data.withColumn("_bucket", F.lit(0))
    per = data.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(c) for c in sums])
    w = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = per.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_{c}_carry") for c in sums],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = null_safe_join(data, carry, [*keys, "_bucket"])
    for c in sums:
        out = out.withColumn(
            f"{c}_before",
            F.col(f"_{c}_carry") + F.coalesce(F.sum(c).over(inside), F.lit(0)),
        )
    return out.drop("_bucket", "_all", *[f"_{c}_carry" for c in sums])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]
) -> DataFrame:
    """Linearly interpolated quantiles: one row per group and probability.

    Equal values are folded into one counted row first. Every wanted row lies in a bracket of its
    group's values, at first all of them. A round cuts the brackets that are still large at about
    equal shares, counts their parts exactly, and keeps the part with the wanted row; all brackets
    of all groups are narrowed together, until a task can sort any one of them. Cut points come from
    a sketch, but only counts decide, so the result is exact. Null values do not count; rows whose
    key is null are a group like any other.
    """
    by = [*keys] or ["_every"]
    data = df.where(F.col(value).isNotNull())
    if not keys:
        data = data.withColumn("_every", F.lit(0))
    folded = cut(data.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    place = F.col("_pos")
    targets = F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("n") - 1) * float(p)).alias("_pos")) for p in probs])
    sizes = folded.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    wanted = (
        sizes.withColumn("_t", F.explode(targets)).select("*", "_t.*").drop("_t")
        .withColumn("_at", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
        .withColumn("_before", F.lit(0).cast("bigint"))
    )
    wanted = cut(wanted)
    columns = wanted.columns
    while (wanted.agg(F.max("_rows").alias("m")).first()["m"] or 0) > BUCKET_ROWS:
        large = wanted.where(F.col("_rows") > BUCKET_ROWS)
        brackets = large.select(*by, "_low", "_high").distinct()
        points = [i / PARTS for i in range(1, PARTS)]
        cuts = _inside(folded, brackets, by).groupBy(*by, "_low", "_high").agg(F.percentile_approx("_v", points).alias("_cuts"))
        parts = _inside(folded, cut(cuts), by).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))))
        parts = parts.groupBy(*by, "_low", "_part").agg(
            F.sum("_n").alias("_held"), F.count(F.lit(1)).alias("_part_rows"), F.min("_v").alias("_part_low"), F.max("_v").alias("_part_high")
        )
        w = Window.partitionBy(*by, "_low").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_ahead", F.coalesce(F.sum("_held").over(w), F.lit(0)))
        first = F.col("_before") + F.col("_ahead")
        narrowed = null_safe_join(large, parts, [*by, "_low"]).where((F.col("_at") >= first) & (F.col("_at") < first + F.col("_held")))
        new = {"_low": F.col("_part_low"), "_high": F.col("_part_high"), "_rows": F.col("_part_rows"), "_before": first}
        narrowed = narrowed.select(*[new.get(c, F.col(c)).alias(c) for c in columns])
        wanted = cut(wanted.where(F.col("_rows") <= BUCKET_ROWS).unionByName(narrowed))
    run = Window.partitionBy(*by, "_low").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    brackets = wanted.select(*by, "_low", "_high", "_before").distinct()
    counted = _inside(folded, brackets, by).select(
        *by, "_low", "_v", "_n", (F.col("_before") + F.coalesce(F.sum("_n").over(run), F.lit(0))).alias("_from")
    )
    found = null_safe_join(wanted.drop("_before"), counted, [*by, "_low"])
    found = found.where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_from") + F.col("_n")))
    # The wanted row below a position and the one above it, which may be the same.
    picked = found.groupBy(*by, "prob", "_pos", "n").agg(F.min("_v").alias("_down"), F.max("_v").alias("_up"))
    part = F.col("_pos") - F.floor("_pos")
    return picked.select(*keys, "prob", (F.col("_down") + (F.col("_up") - F.col("_down")) * part).alias("value"), "n")


def _inside(folded: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows of each bracket; a group has few brackets but may have very many rows."""
    met = salted_join(folded, brackets, by, ["_v"])
    return met.where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))
