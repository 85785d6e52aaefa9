"""Per-class thresholds, merged and withheld calls, and aggregation of refined windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import MERGED_PAIRS
from ..functions.scores import names_of, second_index, top2, top_index
from .ranks import exact_quantiles

NO_LIMIT = float("-inf")
MIN_ROWS = 30


def add_score_features(df: DataFrame, classes: Sequence[str], scores: str = "scores") -> DataFrame:
    return df.withColumns(top2(scores, list(classes)))


def class_frame(df: DataFrame, classes: Sequence[str], name: str = "class") -> DataFrame:
    """One row per class, made from a literal."""
    spark = df.sparkSession
    return spark.range(1).select(F.explode(names_of(list(classes))).alias(name))


def fit_thresholds(
    df: DataFrame, classes: Sequence[str], quantile: float = 0.05,
    prediction: str = "prediction", truth: str = "truth",
) -> DataFrame:
    """Low quantile of top score and margin over the correct rows of each class.

    A class with fewer than 30 correct rows gets no limit.
    """
    measures = F.array(
        F.struct(F.lit("tau_logit").alias("measure"), F.col("top_score").alias("x")),
        F.struct(F.lit("tau_margin").alias("measure"), F.col("margin").alias("x")),
    )
    # Tested while the rows are generated: a filter would be pushed below the projections that
    # compute the scores and evaluate them again.
    right = F.when(F.col(prediction) == F.col(truth), measures)
    correct = df.select(F.col(truth).alias("class"), F.inline_outer(right)).where(
        "measure IS NOT NULL"
    )
    limits = (
        exact_quantiles(correct, ["class", "measure"], "x", [quantile])
        .groupBy("class")
        .agg(
            *[
                F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m)
                for m in ("tau_logit", "tau_margin")
            ],
            F.max("n").alias("n"),
        )
    )
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return (
        class_frame(df, classes)
        .join(limits, "class", "left")
        .select(
            "class",
            F.when(n >= MIN_ROWS, F.col("tau_logit")).otherwise(NO_LIMIT).alias("tau_logit"),
            F.when(n >= MIN_ROWS, F.col("tau_margin")).otherwise(NO_LIMIT).alias("tau_margin"),
            n.alias("n"),
        )
    )


def _is_pair(first: str, second: str, a: str, b: str) -> Column:
    x, y = F.col(first), F.col(second)
    return ((x == a) & (y == b)) | ((x == b) & (y == a))


def refine_windows(
    df: DataFrame, taus: DataFrame, pairs: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Merge an ambiguous pair first, then withhold a call below its class limits.

    ``taus`` has one row per class, so its size is that of the class list: it is copied to the
    windows, which stay where they are. A called class without a row is an error.
    """
    pairs = MERGED_PAIRS if pairs is None else pairs
    limits = taus.select(F.col("class").alias("top_class"), "tau_logit", "tau_margin", F.lit(True).alias("_known"))
    close = F.col("margin") < F.col("tau_margin")
    merged = F.lit(None).cast("string")
    for name, (a, b) in pairs.items():
        both = _is_pair("top_class", "second_class", a, b)
        merged = F.when(both & close, F.lit(name)).otherwise(merged)
    low = (F.col("top_score") < F.col("tau_logit")) | close
    refined = F.coalesce(merged, F.when(low, F.lit("unknown")).otherwise(F.col("top_class")))
    without = F.raise_error(F.concat(F.lit("no limits for class "), F.coalesce("top_class", F.lit("null")))).cast("string")
    return (
        df.join(F.broadcast(limits), "top_class", "left")
        .withColumn("refined", F.when(F.col("_known"), refined).otherwise(without))
        .drop("tau_logit", "tau_margin", "_known")
    )


def aggregate_refined(
    df: DataFrame,
    classes: Sequence[str],
    key: str = "seq_id",
    mode: str = "gated",
    min_windows: int = 3,
    merge_split: str = "half",
    allow_merged: bool = False,
    hedge: float = 1.0,
) -> DataFrame:
    """Sum the class scores of refined windows per contig and call the largest.

    ``gated`` drops withheld windows, ``weighted`` also weighs by margin, ``unweighted`` keeps
    all. A merged window counts only for the classes of its pair, at half or full weight.
    """
    if mode not in ("gated", "weighted", "unweighted"):
        raise ValueError(f"unknown mode: {mode}")
    # Withheld windows are left out inside the aggregate: as a filter the test would be pushed
    # below the projections that compute the scores.
    used = F.lit(True) if mode == "unweighted" else F.col("refined") != "unknown"
    weight: Column = (
        F.greatest(F.col("margin"), F.lit(0.0)) if mode == "weighted" else F.lit(1.0)
    )
    part = 0.5 if merge_split == "half" else 1.0
    # Share of a window that counts for each class, as one of three fixed arrays.
    shares = F.array(*[F.lit(1.0) for _ in classes])
    for label, members in MERGED_PAIRS.items():
        inside = F.array(*[F.lit(part if c in members else 0.0) for c in classes])
        shares = F.when(F.col("refined") == label, inside).otherwise(shares)
    rows = df.select(
        key, "scores", F.when(used, weight).alias("_w"), shares.alias("_shares"),
        (used & F.col("refined").isin(*MERGED_PAIRS)).alias("_merged"),
    ).select(
        key,
        "_merged",
        "_w",
        F.zip_with("scores", "_shares", lambda x, m: x * m * F.col("_w")).alias("_parts"),
    )
    per = (
        rows.groupBy(key)
        .agg(
            F.array(*[F.sum(F.get("_parts", F.lit(i))) for i in range(len(classes))]).alias(
                "_sums"
            ),
            F.count("_w").alias("n_windows_used"),
            F.sum("_w").alias("total_weight"),
            F.count_if("_merged").alias("n_merged_windows"),
        )
        .where(F.col("n_windows_used") >= max(min_windows, 1))
    )
    names = names_of(list(classes))
    top, second = top_index(F.col("_sums")), second_index(F.col("_sums"))
    out = per.select(
        F.col(key).alias("contig_id"),
        *[F.get("_sums", F.lit(i)).alias(f"{c}_score") for i, c in enumerate(classes)],
        "n_windows_used",
        "total_weight",
        "n_merged_windows",
        F.get(names, top).alias("contig_top_class"),
        F.get(names, second).alias("contig_second_class"),
        F.get("_sums", top).alias("contig_top_logit"),
        (F.get("_sums", top) - F.get("_sums", second)).alias("contig_margin"),
    )
    call = F.col("contig_top_class")
    if allow_merged:
        for label, (a, b) in MERGED_PAIRS.items():
            pair = _is_pair("contig_top_class", "contig_second_class", a, b)
            call = F.when(pair & (F.col("contig_margin") < hedge), F.lit(label)).otherwise(call)
    return out.withColumn("contig_call", call)
