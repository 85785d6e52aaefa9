"""Checks on sequences before work starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import invalid_letters, is_valid_dna, n_fraction


def validate_sequences(df: DataFrame, key: str = "seq_id", seq: str = "seq") -> DataFrame:
    """``is_valid, error`` per sequence."""
    name = F.trim(F.col(key).cast("string"))
    error = (
        F.when(F.coalesce(name, F.lit("")) == "", F.lit("empty header"))
        .when(F.coalesce(F.col(seq), F.lit("")) == "", F.lit("empty sequence"))
        .when(
            ~is_valid_dna(seq),
            F.concat(F.lit("invalid characters: "), F.array_join(invalid_letters(seq), "")),
        )
    )
    return df.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())


def length_report(df: DataFrame, min_len: int, seq: str = "seq") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.length(seq) >= min_len).alias("long_enough"),
    )


def assert_min_length(df: DataFrame, min_len: int, seq: str = "seq") -> int:
    """Number of sequences of at least ``min_len``; an error when there is none."""
    report = length_report(df, min_len, seq).first()
    if report["long_enough"] == 0:
        raise ValueError(f"none of {report['entries']} sequences has {min_len} bases")
    return report["long_enough"]


def has_long_n_run(seq: str, max_run: int):
    return F.col(seq).rlike("[Nn]{%d,}" % (max_run + 1))


def filter_n_runs(df: DataFrame, max_run: int, seq: str = "seq") -> DataFrame:
    return df.where(~has_long_n_run(seq, max_run))


def n_run_report(df: DataFrame, max_run: int, label: str, seq: str = "seq") -> DataFrame:
    """Kept and removed rows per class, and over all classes under ``TOTAL``."""
    rows = df.select(label, has_long_n_run(seq, max_run).alias("_bad"))
    per = rows.groupBy(label).agg(
        F.count_if(~F.col("_bad")).alias("kept"), F.count_if(F.col("_bad")).alias("removed")
    )
    total = per.agg(F.sum("kept").alias("kept"), F.sum("removed").alias("removed")).select(
        F.lit("TOTAL").alias(label), "kept", "removed"
    )
    both = per.withColumn(label, F.col(label).cast("string")).unionByName(total)
    return both.withColumn(
        "percent_removed", F.col("removed") * 100.0 / (F.col("kept") + F.col("removed"))
    )


def crop_mismatch(df: DataFrame, trained: int, codons: str = "codons") -> DataFrame:
    """Flag windows whose codon count is not the trained one."""
    return df.withColumn("length_mismatch", F.col(codons) != trained)


def ood_label(
    df: DataFrame,
    correct: DataFrame | None,
    n_threshold: float,
    original: str | None = None,
    key: str = "seq_id",
    seq: str = "seq",
) -> DataFrame:
    """1 for a sequence called correctly and not too rich in N, else 0 (also when empty).

    Without predictions: the ``original`` label where one is named, 0 for all rows otherwise;
    the N rule applies in either case.
    """
    too_many = (n_fraction(seq) > n_threshold) | (F.length(seq) == 0)
    if correct is None:
        base = F.col(original) if original else F.lit(0)
        return df.withColumn("ood_label", F.when(too_many, 0).otherwise(base))
    known = correct.select(key).distinct().withColumn("_known", F.lit(1))
    return (
        df.join(known, key, "left")
        .withColumn(
            "ood_label", F.when(too_many, 0).otherwise(F.coalesce("_known", F.lit(0)))
        )
        .drop("_known")
    )


def correct_prediction_ids(
    summary: DataFrame, classes: list[str], header: str = "contig_id"
) -> DataFrame:
    """Ids whose ``__class=<n>`` names the predicted class."""
    parts = F.split(F.col(header), "__class=", 2)
    names = F.array(*[F.lit(c) for c in classes])
    index = F.get(parts, F.lit(1)).try_cast("int")
    return summary.where(F.get(names, index) == F.col("prediction")).select(
        F.get(parts, F.lit(0)).alias("seq_id")
    )
