"""From window scores to one row per contig."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import unescape_id
from ..functions.scores import (
    binary_entropy,
    energy,
    names_of,
    second_index,
    sigmoid,
    softmax,
    softmax_entropy,
    top_index,
)
from .ordered import viral_summary, window_summary


def reliability_fraction(reliability: Column) -> Column:
    """Share of windows whose sigmoid is above one half, at two decimals; null without a head."""
    return F.round(F.avg((sigmoid(reliability) > 0.5).cast("int")), 2)


def _composition(size: int, by_window_length: bool) -> tuple[Column, Column]:
    length = F.length("window") if by_window_length else F.lit(size)
    known = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    return (F.col("g") + F.col("c")) / length, (length - known) / length


def contig_summary(
    scored: DataFrame,
    classes: Sequence[str],
    size: int,
    key: str = "seq_id",
    viral_index: int = 1,
    label: str | None = None,
    reliability: str | None = None,
    by_window_length: bool = False,
) -> DataFrame:
    """Means, variances, call, counts and flags per contig.

    One aggregate over the windows: those of a contig that sit in one task are combined before
    the shuffle. ``label`` names a column of decoded class indices that replaces the largest
    score in the window counts (not in the contig call). ``N%`` divides by the window size, also
    for a contig shorter than one window, unless ``by_window_length``.
    """
    n = len(classes)
    scores = F.col("scores")
    element = [F.get(scores, F.lit(i)) for i in range(n)]
    gc, ns = _composition(size, by_window_length)
    window_label = F.col(label) if label else top_index(scores)
    rows = scored.select(
        key, "seq_len", *[e.alias(f"_s{i}") for i, e in enumerate(element)],
        softmax_entropy(scores).alias("_entropy"), energy(scores).alias("_energy"),
        window_label.alias("_label"), gc.alias("_gc"), ns.alias("_ns"),
        (F.col(reliability) if reliability else F.lit(None).cast("double")).alias("_rel"),
    )
    per = rows.groupBy(key).agg(
        F.max("seq_len").alias("length"),
        F.array(*[F.avg(f"_s{i}") for i in range(n)]).alias("_mean"),
        F.array(*[F.var_pop(f"_s{i}") for i in range(n)]).alias("_var"),
        F.avg("_entropy").alias("entropy"),
        F.avg("_energy").alias("energy"),
        reliability_fraction(F.col("_rel")).alias("reliability_score"),
        F.avg("_gc").alias("G+C"),
        F.avg("_ns").alias("N%"),
        *[F.count_if(F.col("_label") == i).alias(f"#_{c}_windows") for i, c in enumerate(classes)],
    )
    call = top_index(F.col("_mean"))
    unstable = F.get("_mean", F.lit(viral_index)) < F.get("_var", F.lit(viral_index))
    return per.select(
        F.col(key).alias("contig_id"),
        "length",
        F.get(names_of(list(classes)), call).alias("prediction"),
        "entropy",
        "energy",
        "reliability_score",
        (unstable & (call == viral_index)).alias("host_contam"),
        (unstable & (call == 0)).alias("prophage_contam"),
        "`G+C`",
        "`N%`",
        *[f"`#_{c}_windows`" for c in classes],
        *[
            part
            for i, c in enumerate(classes)
            for part in (
                F.get("_mean", F.lit(i)).alias(f"{c}_score"),
                F.get("_var", F.lit(i)).alias(f"{c}_var"),
            )
        ],
    )


def binary_contig_summary(
    scored: DataFrame, classes: Sequence[str], key: str = "seq_id", score: str = "score"
) -> DataFrame:
    """The one-logit form: the call is sigmoid(mean) > 0.5."""
    z = F.col(score)
    rows = scored.select(
        key, "seq_len", z.alias("_z"), binary_entropy(z).alias("_entropy"),
        energy(F.array(z)).alias("_energy"), (sigmoid(z) > 0.5).cast("int").alias("_label"),
    )
    per = rows.groupBy(key).agg(
        F.max("seq_len").alias("length"),
        F.avg("_z").alias("score"),
        F.var_pop("_z").alias("var"),
        F.avg("_entropy").alias("entropy"),
        F.avg("_energy").alias("energy"),
        *[F.count_if(F.col("_label") == i).alias(f"#_{c}_windows") for i, c in enumerate(classes)],
    )
    call = (sigmoid(F.col("score")) > 0.5).cast("int")
    unstable = F.col("score") < F.col("var")
    return per.select(
        F.col(key).alias("contig_id"),
        "length",
        F.get(names_of(list(classes)), call).alias("prediction"),
        "entropy",
        "energy",
        (unstable & (call == 1)).alias("host_contam"),
        (unstable & (call == 0)).alias("prophage_contam"),
        *[f"`#_{c}_windows`" for c in classes],
        "score",
        "var",
    )


def class_window_counts(
    scored: DataFrame, classes: Sequence[str], key: str = "seq_id", label: str = "label_idx"
) -> DataFrame:
    return scored.groupBy(key).agg(
        *[F.count_if(F.col(label) == i).alias(f"n_{c}") for i, c in enumerate(classes)]
    )


def legacy_summary(
    scored: DataFrame,
    key: str = "seq_id",
    classes: Sequence[str] = ("bacteria", "phage", "eukarya", "archaea"),
    viral_index: int = 1,
    reliability: str = "ood_prob",
) -> DataFrame:
    """The four-class form: collapsed labels, the runner-up of a phage call, mean OOD score."""
    n = len(classes)
    rows = scored.select(
        key, "seq_len", "window_idx",
        *[F.get("scores", F.lit(i)).alias(f"_s{i}") for i in range(n)],
        softmax_entropy(F.col("scores")).alias("_entropy"),
        F.get(names_of(list(classes)), top_index(F.col("scores"))).alias("_label"),
        F.col(reliability).alias("_rel"),
    )
    per = rows.groupBy(key).agg(
        F.max("seq_len").alias("length"),
        F.array(*[F.avg(f"_s{i}") for i in range(n)]).alias("_mean"),
        F.array(*[F.var_pop(f"_s{i}") for i in range(n)]).alias("_var"),
        F.avg("_entropy").alias("entropy"),
        F.avg("_rel").alias("reliability_score"),
        *[F.count_if(F.col("_label") == c).alias(f"#_{c}_windows") for c in classes],
    )
    call = top_index(F.col("_mean"))
    viral = call == viral_index
    text = viral_summary(rows, [key], "window_idx", "_label", classes[viral_index])
    return per.join(text, key).select(
        F.col(key).alias("contig_id"),
        "length",
        F.when(viral, F.lit("phage")).otherwise(F.lit("non-phage")).alias("prediction"),
        F.when(viral, F.get(names_of(list(classes)), second_index(F.col("_mean"))))
        .otherwise(F.lit(""))
        .alias("prediction_2"),
        "entropy",
        "reliability_score",
        *[f"`#_{c}_windows`" for c in classes],
        *[F.get("_mean", F.lit(i)).alias(f"{c}_score") for i, c in enumerate(classes)],
        *[F.get("_var", F.lit(i)).alias(f"{c}_var") for i, c in enumerate(classes)],
        "window_summary",
    )


def add_window_summary(
    summary: DataFrame, scored: DataFrame, label: str, key: str = "seq_id"
) -> DataFrame:
    text = window_summary(scored, [key], "window_idx", label)
    return summary.join(text.withColumnRenamed(key, "contig_id"), "contig_id", "left")


def add_repeats(summary: DataFrame, repeats: DataFrame) -> DataFrame:
    cols = ["contig_id", "terminal_repeats", "repeat_length"]
    return summary.join(repeats.select(*cols), "contig_id", "left")


def add_refined(summary: DataFrame, refined: DataFrame) -> DataFrame:
    cols = [
        "contig_id", "contig_call", "contig_top_logit", "contig_margin", "n_windows_used",
        "n_merged_windows",
    ]
    return summary.join(refined.select(*cols), "contig_id", "left")


def restore_ids(summary: DataFrame) -> DataFrame:
    return summary.withColumn("contig_id", unescape_id("contig_id"))


def drop_ambiguous(summary: DataFrame, limit: float = 0.3) -> DataFrame:
    return summary.where(F.col("`N%`") < limit)


def viral_label(classes: Sequence[str]) -> str:
    """``phage`` if the model has it, else ``virus``, in the model's own spelling."""
    lower = [c.lower() for c in classes]
    for name in ("phage", "virus"):
        if name in lower:
            return classes[lower.index(name)]
    return "phage"


def select_viral(
    summary: DataFrame,
    classes: Sequence[str],
    min_score: float = 1.0,
    min_reliability: float | None = 0.5,
) -> DataFrame:
    """Contigs called viral, above both cut-offs; reliability is skipped when unavailable."""
    label = viral_label(classes)
    keep = (F.col("prediction") == label) & (F.col(f"{label}_score") > min_score)
    if min_reliability is not None and "reliability_score" in summary.columns:
        keep &= F.col("reliability_score") > min_reliability
    return summary.where(keep)


def softmax_scores(scored: DataFrame) -> DataFrame:
    return scored.withColumn("probs", softmax(F.col("scores")))


def format_doubles(df: DataFrame, decimals: int = 3) -> DataFrame:
    """Double columns as fixed-decimal text, the rest unchanged."""
    return df.select(
        *[
            F.format_string(f"%.{decimals}f", F.col(f"`{n}`")).alias(n)
            if t in ("double", "float")
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
