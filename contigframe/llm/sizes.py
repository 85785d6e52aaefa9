"""Partition counts that follow the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total bytes of a text column; one pass over that column."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def bucket_count(docs: DataFrame, bytes_each: int, text: str = "text") -> int:
    """Buckets of about ``bytes_each`` bytes of text, two for each shuffle partition at least."""
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-text_bytes(docs, text) // bytes_each))
