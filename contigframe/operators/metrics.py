"""Evaluation of calls and scores against truth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.dna import share
from .ranks import exact_quantiles, totals_before
from .refine import class_frame

VIRAL_FRACTIONS = ("phage", "virus", "viral")
EPSILON = 1e-7


def class_distribution(df: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Count, percent and inverse-frequency weight per class, zero-filled."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    full = class_frame(df, classes).join(counts, "class", "left").select(
        "class", F.coalesce("n", F.lit(0)).alias("n")
    )
    total = full.agg(F.sum("n").alias("_total")).withColumn("_one", F.lit(1))
    return (
        full.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(
            "class",
            "n",
            (share(F.col("n"), F.col("_total")) * 100).alias("percent"),
            (F.col("_total") / (len(classes) * F.greatest("n", F.lit(1)))).alias("weight"),
        )
    )


def count_ratios(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ratio of two class distributions, class by class."""
    other = second.select("class", F.col("n").alias("n_other"))
    return first.select("class", "n").join(other, "class").withColumn(
        "ratio", F.col("n") / F.greatest("n_other", F.lit(1))
    )


def class_log_prior(df: DataFrame, label: str, remap: dict[int, int] | None = None) -> DataFrame:
    """Log share of each label, after an optional remap (unknown labels become 0)."""
    value = remap_labels(F.col(label), remap) if remap else F.col(label)
    counts = df.groupBy(value.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_one", F.lit(1))
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select("label", "n", F.ln(F.col("n") / F.col("_total")).alias("log_prior"))
    )


def positive_logit(df: DataFrame, label: str) -> DataFrame:
    """Logit of the share of positives (binary prior)."""
    p = F.avg((F.col(label) == 1).cast("int"))
    return df.agg(F.ln(p / (1 - p)).alias("logit_prior"))


def remap_labels(label: Column, remap: dict[int, int]) -> Column:
    pairs = [F.lit(x) for item in remap.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(0))


def confusion_matrix(
    df: DataFrame, classes: Sequence[str], truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """Counts for every pair of classes, zeros included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = F.array(*[F.lit(c) for c in classes])
    grid = class_frame(df, classes, "truth").withColumn("prediction", F.explode(names))
    return grid.join(counts, ["truth", "prediction"], "left").select(
        "truth", "prediction", F.coalesce("n", F.lit(0)).alias("n")
    )


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return share(tp * 2, tp * 2 + fp + fn)


def _class_counts(
    df: DataFrame, keys: Sequence[str], truth: str, prediction: str
) -> DataFrame:
    """True positives, predicted and actual rows per class.

    Both labels of a row become one row each, after the pairs have been counted.
    """
    pairs = df.groupBy(*keys, F.col(truth).alias("_t"), F.col(prediction).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    sides = F.array(
        F.struct(F.col("_t").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(F.col("_p").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )
    long = pairs.select(*keys, "_t", "_p", "_n", F.inline(sides))
    return long.groupBy(*keys, "class").agg(
        F.sum(F.when((F.col("t") == 1) & (F.col("_t") == F.col("_p")), F.col("_n")).otherwise(0))
        .alias("tp"),
        F.sum(F.col("_n") * F.col("p")).alias("predicted"),
        F.sum(F.col("_n") * F.col("t")).alias("support"),
    )


def per_class_metrics(
    df: DataFrame, truth: str = "truth", prediction: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support over the union of seen classes."""
    c = _class_counts(df, keys, truth, prediction)
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return c.select(
        *keys,
        "class",
        share(tp, predicted).alias("precision"),
        share(tp, support).alias("recall"),
        share(tp * 2, predicted + support).alias("f1"),
        "support",
    )


def viral_truth(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.isin(*VIRAL_FRACTIONS)


def binary_metrics(
    df: DataFrame,
    truth: str = "fraction",
    prediction: str = "prediction",
    reliability: str | None = None,
    cutoff: float = 0.0,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Viral detection; a call below the reliability cut-off counts as negative."""
    p = viral_truth(prediction)
    if reliability and cutoff > 0:
        p = p & F.coalesce(F.col(reliability) >= cutoff, F.lit(False))
    rows = df.select(*keys, viral_truth(truth).alias("_t"), p.alias("_p"))
    agg = rows.groupBy(*keys).agg(
        F.count_if(F.col("_t") & F.col("_p")).alias("tp"),
        F.count_if(~F.col("_t") & F.col("_p")).alias("fp"),
        F.count_if(F.col("_t") & ~F.col("_p")).alias("fn"),
        F.count_if(~F.col("_t") & ~F.col("_p")).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (share(tp, tp + fn) + share(tn, tn + fp)) / 2
    # With one class absent, balanced accuracy is the recall of the other.
    balanced = (
        F.when(tp + fn == 0, share(tn, tn + fp)).when(tn + fp == 0, share(tp, tp + fn))
        .otherwise(both)
    )
    return agg.select(
        *keys,
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        (tp + fp + fn + tn).alias("num_contigs"),
        (tp + fn).alias("num_viral_true"),
        (tn + fp).alias("num_cellular_true"),
        (tp + fp).alias("num_viral_pred"),
    )


def smoothed_metrics(
    df: DataFrame, classes: Sequence[str], truth: str = "truth", prediction: str = "prediction"
) -> DataFrame:
    """Precision, recall, specificity and F1 per class with a small constant below the line."""
    counts = _class_counts(df, (), truth, prediction)
    total = df.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    full = class_frame(df, classes).join(counts, "class", "left").na.fill(0)
    rows = full.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
    tp = F.col("tp")
    fp, fn = F.col("predicted") - tp, F.col("support") - tp
    tn = F.col("_total") - tp - fp - fn
    precision, recall = tp / (tp + fp + EPSILON), tp / (tp + fn + EPSILON)
    return rows.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        (tn / (tn + fp + EPSILON)).alias("specificity"),
        (2 * tp / (2 * tp + fp + fn + EPSILON)).alias("f1"),
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("f1").alias("macro_f1"))


def binary_f1(df: DataFrame, logit: str, truth: str, threshold: float = 0.0) -> DataFrame:
    """F1 of the positive class from raw logits."""
    p, t = F.col(logit) > threshold, F.col(truth) == 1
    counts = df.agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
    )
    twice = 2 * F.col("tp")
    return counts.select((twice / (twice + F.col("fp") + F.col("fn") + EPSILON)).alias("f1"))


def reliability_stats(df: DataFrame, reliability: str, cutoff: float) -> DataFrame:
    """Mean, exact median and share at or above the cut-off."""
    plain = df.agg(
        F.avg(reliability).alias("mean_reliability"),
        F.avg((F.col(reliability) >= cutoff).cast("int")).alias("frac_above_cutoff"),
    ).withColumn("_one", F.lit(1))
    median = exact_quantiles(df.select(reliability), [], reliability, [0.5]).select(
        F.col("value").alias("median_reliability"), F.lit(1).alias("_one")
    )
    return plain.join(median, "_one").select(
        "mean_reliability", "median_reliability", "frac_above_cutoff"
    )


SWEEP_METRICS = {"f1-id": "f1_id", "f1-ood": "f1_ood", "youden": "youden_j", "mcc": "mcc"}


def threshold_sweep(
    df: DataFrame, score: str, label: str, low: float = 0.0, high: float = 0.95, step: float = 0.05
) -> DataFrame:
    """Quality of ``score >= t`` for every threshold of a grid.

    Each score is put on the highest threshold it reaches; the grid is then a table of a few
    rows, and counts at or above a threshold are sums over that table.
    """
    n = int(np.floor((high - low) / step + 1e-9)) + 1
    grid = [low + i * step for i in range(n)]
    points = F.array(*[F.lit(float(round(g, 10))) for g in grid])
    reached = F.size(F.filter(points, lambda t: F.col(score) >= t)) - 1
    per = df.groupBy(reached.alias("_slot")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    table = (
        per.agg(F.collect_list(F.struct("_slot", "_pos", "_neg")).alias("_slots"))
        .select("_slots", F.posexplode(points).alias("_i", "threshold"))
    )

    def add_up(field: str, reach: Column | None) -> Column:
        return F.aggregate(
            "_slots",
            F.lit(0).cast("bigint"),
            lambda acc, s: acc
            + F.when(F.lit(True) if reach is None else s["_slot"] >= reach, s[field]).otherwise(0),
        )

    counted = table.select(
        "threshold",
        add_up("_pos", F.col("_i")).alias("tp"),
        add_up("_neg", F.col("_i")).alias("fp"),
        add_up("_pos", None).alias("pos"),
        add_up("_neg", None).alias("neg"),
    )
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    mcc = share(
        tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    )
    return counted.select(
        "threshold",
        f1_of(tp, fp, fn).alias("f1_id"),
        f1_of(tn, fn, fp).alias("f1_ood"),
        (share(tp, tp + fn) + share(tn, tn + fp) - 1.0).alias("youden_j"),
        mcc.alias("mcc"),
    )


def best_threshold(sweep: DataFrame, metric: str = "f1-id") -> DataFrame:
    """The lowest threshold with the largest value of the metric."""
    if metric not in SWEEP_METRICS:
        raise ValueError(f"unknown metric: {metric}")
    col = SWEEP_METRICS[metric]
    return sweep.agg(
        F.max_by("threshold", F.struct(F.col(col), -F.col("threshold"))).alias("threshold"),
        F.max(col).alias("value"),
    )


def require_both_labels(df: DataFrame, label: str) -> None:
    seen = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if seen["lo"] is None or seen["lo"] == seen["hi"]:
        raise ValueError("both labels (1 and 0) are needed")


def tuned_threshold(
    df: DataFrame, score: str, label: str, metric: str = "f1-id", low: float = 0.0, high: float = 0.95, step: float = 0.05
) -> DataFrame:
    """The best threshold of a grid; an error where only one label occurs."""
    require_both_labels(df, label)
    return best_threshold(threshold_sweep(df, score, label, low, high, step), metric)


def ranking_quality(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve (ties count half) and average precision; NaN with one class.

    Rows are folded into one row per distinct score, and the running counts over scores are
    spread over many tasks.
    """
    scores = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    run = totals_before(scores, [], "_score", ["_pos", "_neg"])
    pos, neg = F.col("_pos"), F.col("_neg")
    above_pos = F.col("_pos_total") - F.col("_pos_before")
    above_neg = F.col("_neg_total") - F.col("_neg_before")
    sums = run.agg(
        F.sum(pos * (F.col("_neg_before") + neg / 2)).alias("u"),
        F.sum(pos * share(above_pos, above_pos + above_neg)).alias("ap"),
        F.max("_pos_total").alias("p"),
        F.max("_neg_total").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    nan = F.lit(float("nan"))
    return sums.select(
        F.when(both, F.try_divide(F.col("u"), F.col("p") * F.col("n"))).otherwise(nan)
        .alias("auroc"),
        F.when(both, F.try_divide(F.col("ap"), F.col("p"))).otherwise(nan).alias("auprc"),
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Per equal-width bin (the last one closed): mean score, empirical rate and count."""
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    per = df.where((F.col(score) >= 0) & (F.col(score) <= 1)).groupBy(slot.alias("bin")).agg(
        F.avg(score).alias("mean_pred"),
        F.avg(F.col(label).cast("double")).alias("empirical_rate"),
        F.count(F.lit(1)).alias("count"),
    )
    full = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    nan = F.lit(float("nan"))
    return full.join(per, "bin", "left").select(
        "bin",
        ((F.col("bin") + 0.5) / bins).alias("bin_center"),
        F.coalesce("mean_pred", nan).alias("mean_pred"),
        F.coalesce("empirical_rate", nan).alias("empirical_rate"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    slots = calibration(df, score, label, bins)
    gap = F.abs(F.col("empirical_rate") - F.col("mean_pred")) * F.col("count")
    ece = slots.agg(
        (F.sum(F.when(F.col("count") > 0, gap).otherwise(0.0)) / F.sum("count")).alias("ece"),
    ).withColumn("_one", F.lit(1))
    diff = F.col(score) - F.col(label)
    brier = df.agg(F.avg(diff * diff).alias("brier")).withColumn("_one", F.lit(1))
    return ece.join(brier, "_one").select("ece", "brier")


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    from math import lgamma

    log_beta = np.array([lgamma(p + q) - lgamma(p) - lgamma(q) for p, q in zip(a, b)])
    tiny = 1e-300
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(log_beta + p * np.log(y) + q * np.log1p(-y)) / p
        c = np.ones_like(y)
        d = 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for odd in (False, True):
                if odd:
                    num = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
                else:
                    num = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.nanmax(np.abs(step - 1)) < 1e-14:
                break
        value = front * h
    value = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, value))
    return np.where(flip, 1 - value, value)


def _upper_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        half = 0.5 * _betainc(df / 2, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(t >= 0, half, 1 - half)


@F.pandas_udf(DoubleType())
def student_upper_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T > t) of Student's t; null where t or the degrees of freedom are missing."""
    ok = t.notna() & df.notna() & np.isfinite(t) & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = _upper_tail(t[ok].to_numpy(float), df[ok].to_numpy(float))
    return out.astype(object).where(ok, None)


def welch(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column):
    """(t, degrees of freedom) of two summaries; null below two rows or without variance."""
    a, b = v1 / n1, v2 / n2
    enough = (n1 > 1) & (n2 > 1)
    t = F.when(enough, F.try_divide(m1 - m2, F.sqrt(a + b)))
    df = F.when(
        enough,
        F.try_divide(
            (a + b) * (a + b),
            F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1),
        ),
    )
    return t, df


def welch_top2(summary: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Is the best class of a contig significantly above the second? One row per contig."""
    pairs = F.array(
        *[
            F.struct(
                F.col(f"{c}_score").alias("mean"),
                F.lit(-i).alias("rank"),
                F.col(f"{c}_var").alias("var"),
            )
            for i, c in enumerate(classes)
        ]
    )
    n = sum((F.col(f"`#_{c}_windows`") for c in classes), F.lit(0)).cast("double")
    rows = summary.select(
        "contig_id", "prediction", F.sort_array(pairs, asc=False).alias("_s"), n.alias("n_windows")
    )
    one, two = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    t, df = welch(
        one["mean"], one["var"], F.col("n_windows"), two["mean"], two["var"], F.col("n_windows")
    )
    return rows.select("contig_id", "prediction", "n_windows", t.alias("t_stat"), df.alias("df"))


def with_p_value(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    return tests.withColumn("p_value", student_upper_tail("t_stat", "df")).withColumn(
        "significant", F.col("p_value") < alpha
    )


def paired_t_top2(
    scored: DataFrame, top: Column, second: Column, keys: Sequence[str]
) -> DataFrame:
    """One-sample t statistic of the per-window difference of two class scores."""
    diff = top - second
    per = scored.groupBy(*keys).agg(
        F.avg(diff).alias("_m"), F.stddev_samp(diff).alias("_s"), F.count(F.lit(1)).alias("n")
    )
    return per.select(
        *keys,
        "n",
        F.try_divide(F.col("_m"), F.col("_s") / F.sqrt(F.col("n"))).alias("t_stat"),
        (F.col("n") - 1).cast("double").alias("df"),
    )


def paired_t_of_best(
    scored: DataFrame, n_classes: int, keys: Sequence[str], scores: str = "scores"
) -> DataFrame:
    """``paired_t_top2`` of the two classes with the largest mean scores of each group.

    On a tie the lower class goes first. All pairs of classes are summed in one pass.
    """
    if n_classes < 2:
        raise ValueError("two classes are needed")
    score = [F.get(scores, F.lit(i)) for i in range(n_classes)]
    pairs = [(i, j) for i in range(n_classes) for j in range(i + 1, n_classes)]
    stats = [
        F.struct(F.avg(score[i] - score[j]).alias("m"), F.stddev_samp(score[i] - score[j]).alias("s"))
        for i, j in pairs
    ]
    means = F.array(*[F.struct(F.avg(c).alias("mean"), F.lit(-i).alias("neg")) for i, c in enumerate(score)])
    per = scored.groupBy(*keys).agg(
        F.sort_array(means, asc=False).alias("_best"), F.array(*stats).alias("_stats"),
        F.count(F.lit(1)).alias("n"),
    )
    one, two = -F.get("_best", F.lit(0))["neg"], -F.get("_best", F.lit(1))["neg"]
    low, high = F.least(one, two), F.greatest(one, two)
    # Pairs are in order of the lower class, then of the higher one.
    at = (low * (2 * n_classes - 1 - low) / 2 + high - low - 1).cast("int")
    found = F.get("_stats", at)
    t = F.try_divide(found["m"], found["s"] / F.sqrt(F.col("n")))
    return per.select(
        *keys, "n", F.when(one < two, t).otherwise(-t).alias("t_stat"),
        (F.col("n") - 1).cast("double").alias("df"),
    )


def share_table(df: DataFrame, group: str, passed: Column) -> DataFrame:
    """Percent of all rows by group and by whether they pass."""
    counts = df.groupBy(
        group, F.when(passed, F.lit("passed")).otherwise(F.lit("failed")).alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_one", F.lit(1))
    return (
        counts.withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(group, "status", "n", (F.col("n") * 100 / F.col("_total")).alias("percent"))
    )


def distributions(
    df: DataFrame, group: str, values: Sequence[str],
    probs: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0),
) -> DataFrame:
    """Exact quantiles of several columns per group, in long form."""
    long = df.select(
        group,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("measure"), F.col(f"`{v}`").cast("double").alias("x"))
                    for v in values
                ]
            )
        ),
    )
    return exact_quantiles(long, [group, "measure"], "x", probs).select(
        group, "measure", "prob", "value"
    )


def scores_long(summary: DataFrame, classes: Sequence[str]) -> DataFrame:
    return summary.select(
        "contig_id",
        "prediction",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("class"), F.col(f"{c}_score").alias("score"))
                    for c in classes
                ]
            )
        ),
    )


def by_length_bins(summary: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """Mean and count of ``value`` in equally filled length bins; edges are exact quantiles."""
    probs = [i / bins for i in range(bins + 1)]
    edges = (
        exact_quantiles(summary.select(F.col("length").cast("double").alias("x")), [], "x", probs)
        .agg(F.array_sort(F.collect_list("value")).alias("_edges"))
        .withColumn("_one", F.lit(1))
    )
    below = F.size(F.filter("_edges", lambda e: e < F.col("length")))
    return (
        summary.withColumn("_one", F.lit(1))
        .join(F.broadcast(edges), "_one")
        .withColumn("length_bin", F.greatest(below - 1, F.lit(0)))
        .groupBy("length_bin")
        .agg(
            F.min("length").alias("min_length"), F.max("length").alias("max_length"),
            F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"),
        )
    )


def accuracy_by_length(df: DataFrame, keys: Sequence[str], truth: str, prediction: str):
    """Accuracy, balanced accuracy and macro F1 per group, in long form."""
    per_class = per_class_metrics(df, truth, prediction, keys).where("support > 0")
    balanced = per_class.groupBy(*keys).agg(
        F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1")
    )
    plain = df.groupBy(*keys).agg(
        F.avg((F.col(truth) == F.col(prediction)).cast("int")).alias("overall_accuracy")
    )
    return plain.join(balanced, list(keys)).unpivot(
        list(keys), ["overall_accuracy", "balanced_accuracy", "macro_f1"], "measure", "value"
    )


def run_name_parts(name: Column | str) -> tuple[Column, Column]:
    """(fragment length, input type) out of a run name such as ``x_500bp_trans``."""
    name = F.col(name) if isinstance(name, str) else name
    length = F.regexp_extract(name, r"(\d+)bp", 1)
    kind = F.when(F.contains(name, F.lit("_trans")), "translated").otherwise("nucleotide")
    return F.when(length != "", length.cast("int")), kind
