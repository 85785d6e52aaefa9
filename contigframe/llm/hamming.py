"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments; the index holds every distinct code under the value of each
segment. In round r a query looks up all segment values that differ from its own in r bits. A pair
is met first in the segment and round of its smallest segment distance, so each pair is taken once,
there. After round r all codes within ``segments * (r + 1) - 1`` bits have been met: a query whose
kth verified distance is within that bound is done, the others go on.

Equal codes are one index entry with a count, so a very common code is one row. Of each code the
``k`` smallest ids are enough for the answer. Rounds are written to the shared folder.

Defined cases: rows without id or code are not found and ask nothing; fewer than ``k`` rows give
all of them; equal distances go by the smaller id; repeated rows of one id and code are one row. A
query that is itself a row finds itself.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

BITS = 64


def sign_code(vector: Column, size: int = BITS) -> Column:
    """Bit i tells whether element i is above 0; null for a null vector or one of another size."""
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(size - 1)),
        F.lit(0).cast("bigint"),
        lambda acc, i: acc.bitwiseOR(F.when(F.get(vector, i) > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
    )
    return F.when(F.size(vector) == size, total)


def _borders(segments: int) -> list[tuple[int, int]]:
    """Shift and width of each segment."""
    cuts = [round(k * BITS / segments) for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, flips: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(width), flips)]


def _probes(segment: int, shift: int, width: int, flips: int) -> Column:
    """The index entries that differ from a query in ``flips`` bits of a segment."""
    masks = F.split(F.lit(",".join(map(str, _masks(width, flips)))), ",").cast("array<bigint>")
    value = _segment(F.col("query"), shift, width)
    return F.transform(masks, lambda m: F.struct(F.lit(segment).alias("segment"), value.bitwiseXOR(m).alias("value")))


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """``query_id, rank, id, distance``: the k nearest rows of each query. Both have ``id, code``."""
    spark = rows.sparkSession
    rows = cut(rows.select(F.col("id").cast("bigint"), F.col("code").cast("bigint")).dropna().distinct())
    queries = cut(queries.select(F.col("id").cast("bigint").alias("query_id"), F.col("code").cast("bigint").alias("query")).dropna().distinct())
    codes = cut(rows.groupBy("code").agg(F.count("*").alias("copies")))
    size = codes.agg(F.count("*").alias("codes"), F.sum("copies").alias("rows")).first()
    total, k = size["rows"] or 0, min(k, size["rows"] or 0)
    if segments is None:
        # About one code for each segment value.
        segments = min(16, max(4, math.ceil(BITS / math.log2(max(2, size["codes"])))))
    if not 4 <= segments <= 16:
        raise ValueError("4 to 16 segments are possible: the values of a segment are listed")
    borders = _borders(segments)
    parts = [F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), *b).alias("value")) for s, b in enumerate(borders)]
    index = cut(codes.select("code", "copies", F.inline(F.array(*parts))))
    active = cut(queries.select("query").distinct().withColumn("bound", F.lit(BITS)))
    found = None
    for flips in range(max(width for _, width in borders) + 1 if total else 0):
        probes = [_probes(s, *b, flips) for s, b in enumerate(borders) if flips <= b[1]]
        differ = F.col("query").bitwiseXOR(F.col("code"))
        apart = [F.bit_count(_segment(differ, *b)) for b in borders]
        mine = F.lit(True)
        for s, distance in enumerate(apart):
            mine = mine & F.when(F.col("segment") > s, distance > flips).otherwise(distance >= flips)
        met = (
            active.select("query", "bound", F.inline(F.concat(*probes)))
            .join(index.hint("shuffle_hash"), ["segment", "value"])  # the probes are many: never broadcast
            .where(mine & (F.bit_count(differ) <= F.col("bound")))
            .select("query", "code", "copies", F.bit_count(differ).alias("distance"))
        )
        met = cut(met)
        found = met if found is None else found.unionAll(met)
        # At most one row for each distance of a query.
        counts = found.groupBy("query", "distance").agg(F.sum("copies").alias("n"))
        below = F.sum("n").over(Window.partitionBy("query").orderBy("distance"))
        kth = counts.withColumn("below", below).where(F.col("below") >= k).groupBy("query").agg(F.min("distance").alias("kth"))
        covered = segments * (flips + 1) - 1
        active = cut(
            active.join(kth, "query", "left")
            .select("query", F.coalesce("kth", F.lit(BITS)).alias("bound"))
            .where(F.col("bound") > covered)
        )
        if active.isEmpty():
            break
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance int")
    members = _first(rows, "code", ["id"], k)
    reached = found.groupBy("query", "distance").agg(F.sum("copies").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("query").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    useful = reached.withColumn("before", below).where(F.col("before") < k).select("query", "distance")
    answers = cut(_first(found.join(useful, ["query", "distance"]).join(members, "code"), "query", ["distance", "id"], k))
    return queries.join(answers, "query").select("query_id", F.col("nth").alias("rank"), "id", "distance")


def _first(rows: DataFrame, key: str, by: list[str], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k of them in each task before it shuffles."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*by))
    return rows.drop("nth").withColumn("nth", nth).where(F.col("nth") <= k)
