"""Removal of boilerplate lines by their frequency within a site.

Pages are grouped by host. A line is boilerplate on a host if the pages of the host that contain it
are more than ``ratio`` of all the host's pages; a line on one page alone is never boilerplate. Such
lines are removed from all pages of that host; the others stay as they are, in their order. Lines are compared with
surrounding white space (space, tab, carriage return) stripped; lines that are then empty count for
nothing and stay.

Scale: a line travels as a 128-bit hash. Counting is a sum with partial sums, so a line on a third
of all pages is a few rows. Occurrences meet the boilerplate table in a plain join of two written
tables, whose large partitions Spark splits; the text itself is shuffled once, by page.

Defined cases: rows without a text keep it null, with no lines. Rows without a host are one host of
their own. Rows without a page id, or repeating one, are told apart by their text; rows that repeat
both count as one page and are returned as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def _key(line: Column) -> Column:
    """128 bits of a line, null for an empty one."""
    line = _stripped(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), F.reverse(line)).alias("g")))


def remove_boilerplate(
    pages: DataFrame, ratio: float = 0.1, page_id: str = "doc_id", host: str = "source", text: str = "text"
) -> DataFrame:
    """``row, text, n_lines, n_dropped`` for each page: what is left of its text, its lines before
    and the lines dropped. ``row`` holds all other columns of the page."""
    others = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != text])
    site = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    mine = F.xxhash64(F.col(page_id), F.col(page_id).isNull(), site)
    base = pages.select(
        others.alias("row"), site.alias("host"), F.struct(mine.alias("id"), F.xxhash64(text).alias("hash")).alias("page"),
        F.col(text).cast("string").alias("text"),
    )
    keys = F.array_compact(F.array_distinct(F.transform(_lines(F.col("text")), _key)))
    found = cut(base.select("host", "page", keys.alias("keys")).dropDuplicates(["page"]))
    total = found.groupBy("host").agg(F.count("*").alias("pages"))
    lines = found.select("host", "page", F.explode("keys").alias("key"))
    often = lines.groupBy("host", "key").agg(F.count("*").alias("held")).where(F.col("held") > 1)
    # A page accounts for at most 1 / ratio times its lines of these.
    often = cut(cut(often).join(cut(total), "host").where(F.col("held") > F.col("pages") * F.lit(ratio)).select("host", "key"))
    dropped = cut(lines.join(often, ["host", "key"]).select("page", "key")).groupBy("page").agg(F.collect_list("key").alias("dropped"))
    kept = F.filter(_lines(F.col("text")), lambda line: ~F.coalesce(F.array_contains("dropped", _key(line)), F.lit(False)))
    whole = F.col("dropped").isNull()
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    return (
        base.join(dropped.hint("merge"), "page", "left")  # by sorting at every size, so that disk grows evenly
        .withColumn("kept", F.when(~whole, kept))
        .select(
            "row",
            F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"),
            n_lines.cast("bigint").alias("n_lines"),
            F.when(whole, 0).otherwise(n_lines - F.size("kept")).cast("bigint").alias("n_dropped"),
        )
    )
