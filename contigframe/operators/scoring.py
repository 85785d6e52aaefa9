"""Scoring windows and working on their score arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import product
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.dna import BASES, let, share
from ..functions.frames import letter_parts
from ..functions.scores import log_softmax, sigmoid, softmax, top_index
from .lineage import cut
from .skew import with_single


def composition(size: Column | None = None) -> list[Column]:
    """Features of a window: shares of G, C, A, T and the skew."""
    size = F.length("window") if size is None else size
    return [share(F.col(b), size) for b in ("g", "c", "a", "t")] + [F.col("gc_skew")]


def linear_scores(features: Sequence[Column], weights: Sequence[Sequence[float]],
                  bias: Sequence[float]) -> Column:
    """Score array: one dot product plus bias per class, as plain arithmetic."""
    out = []
    for row, b in zip(weights, bias):
        score = F.lit(float(b))
        for w, x in zip(row, features):
            score = score + F.lit(float(w)) * x
        out.append(score)
    return F.array(*out)


def score_windows(
    df: DataFrame,
    make_scorer: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    inputs: Sequence[str],
    outputs: dict[str, str],
) -> DataFrame:
    """Apply a user model batch by batch.

    ``make_scorer`` is called once per task and returns a function from a frame of the
    ``inputs`` columns to a frame of the ``outputs`` (name to Spark type), row by row.
    """
    schema = StructType(
        df.schema.fields
        + [StructField(n, df.sparkSession.createDataFrame([], f"x {t}").schema[0].dataType)
           for n, t in outputs.items()]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scored = scorer(batch[list(inputs)])
            yield batch.assign(**{name: scored[name].to_numpy() for name in outputs})

    return df.mapInPandas(run, schema)


def _counted(codes: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Text number, k-mer and count of the distinct k-mers of A C G T in each of many texts."""
    digit = np.full(129, 4, np.int64)
    digit[[ord(b) for b in BASES]] = range(4)
    digits = digit[np.minimum(codes, 128)]
    own, n = np.repeat(np.arange(len(sizes)), sizes), max(len(codes) - k + 1, 0)
    ids, good = np.zeros(n, np.int64), own[:n] == own[len(own) - n :]
    for j in range(k):
        if j and j % 16 == 0:
            ids = np.unique(ids, return_inverse=True)[1]
        ids = ids * 4 + digits[j : j + n]
        good &= digits[j : j + n] < 4
    at, all_mers = np.flatnonzero(good), 4**k
    if len(sizes) * all_mers <= 1 << 22:
        counts = np.bincount(own[at] * all_mers + ids[at], minlength=len(sizes) * all_mers)
        found = np.flatnonzero(counts)
        names = np.array(["".join(m) for m in product(BASES, repeat=k)], object)
        return found // all_mers, names[found % all_mers], counts[found]
    ids = np.unique(ids[at], return_inverse=True)[1]
    wide = len(ids) + 1
    found, first, counts = np.unique(own[at] * wide + ids, return_index=True, return_counts=True)
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    return found // wide, [text[i : i + k] for i in at[first]], counts


def kmer_counts(seq: Column | str, k: int) -> Column:
    """Distinct k-mers of A C G T of each text, with their counts: array of ``kmer, n``.

    An entry with an empty k-mer holds the number of all.
    """
    kind = StructType([StructField("kmer", StringType()), StructField("n", LongType())])

    @F.arrow_udf(ArrayType(kind))
    def counts(texts: pa.Array) -> pa.Array:
        made = []
        for _, codes, sizes in letter_parts(texts):
            own, mers, n = _counted(codes, sizes, k)
            every = np.arange(len(sizes))
            total = np.bincount(own, n, len(sizes)).astype(np.int64)
            order = np.argsort(np.concatenate([every, own]), kind="stable")
            names = np.array([*[""] * len(sizes), *mers], object)[order]
            values = pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate([total, n])[order], pa.int64())], ["kmer", "n"]
            )
            offsets = np.concatenate([[0], np.cumsum(1 + np.bincount(own, minlength=len(sizes)))])
            made.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values))
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.struct([("kmer", pa.string()), ("n", pa.int64())])))

    return counts(F.col(seq) if isinstance(seq, str) else seq)


def fit_kmer_profile(df: DataFrame, k: int, label: str = "label", seq: str = "window"):
    """Log share of every k-mer within its class, with one added count: ``label, kmer, weight,
    unseen``, the last the weight of any k-mer the class has not.

    K-mers are counted inside each window, then inside the map tasks: what is shuffled is at most
    one row per task, class and k-mer.
    """
    counts = (
        df.select(label, F.inline(kmer_counts(seq, k)))
        .where("kmer <> ''")
        .groupBy(label, "kmer")
        .agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy(label).agg((F.sum("n") + 4**k).alias("total"))
    return counts.join(totals, label).select(
        label, "kmer", F.ln((F.col("n") + 1) / F.col("total")).alias("weight"), F.ln(1 / F.col("total")).alias("unseen")
    )


#: K-mers up to this length make a profile small enough to be copied to the windows.
COPIED_K = 6


def score_kmer_profile(
    df: DataFrame, profile: DataFrame, k: int, keys: Sequence[str], label: str = "label",
    seq: str = "window",
) -> DataFrame:
    """Mean log share of the k-mers of each window under every class: ``keys, label, score``.

    K-mers with other letters than A C G T are left out; one the class has not counts with the
    class's ``unseen`` weight. A window without any k-mer has the score null in every class, as has
    one with a null key. The windows are read once: their distinct k-mers meet the profile, in
    which each class has an empty k-mer that every window holds.
    """
    profile = cut(profile)
    classes = profile.groupBy(label).agg(F.first("unseen").alias("unseen"))
    empty = classes.select(label, F.lit("").alias("kmer"), F.col("unseen").alias("weight"), "unseen")
    known = profile.select(label, "kmer", "weight", "unseen").unionByName(empty)
    met = df.select(*keys, F.inline(kmer_counts(seq, k))).join(F.broadcast(known) if k <= COPIED_K else known, "kmer")
    whole = F.col("kmer") == ""
    per = met.groupBy(*keys, label).agg(
        F.count_if(whole).cast("int").alias("_rows"), F.sum(F.when(whole, F.col("n"))).alias("_all"),
        F.sum(F.col("n") * (F.col("weight") - F.col("unseen"))).alias("_above"), F.max("unseen").alias("unseen"),
    )
    named = reduce(and_, [F.col(c).isNotNull() for c in keys])
    score = F.when((F.col("_all") > 0) & named, F.col("_above") / F.col("_all") + F.col("unseen"))
    # A row for each window, also where keys repeat.
    return per.select(*keys, label, score.alias("score"), F.explode(F.array_repeat(F.lit(1), F.col("_rows"))).alias("_one")).drop("_one")


def combine_models(
    df: DataFrame, keys: Sequence[str], method: str, classes: int, scores: str = "scores"
) -> DataFrame:
    """Combine the rows (models) of each window: ``mean``, ``sum`` or ``vote``.

    A vote keeps one class: the one most models rank first (the lowest on a tie), with the mean
    of its non-zero scores; all other classes are 0.
    """
    elements = [F.get(scores, F.lit(i)) for i in range(classes)]
    if method in ("mean", "sum"):
        agg = F.avg if method == "mean" else F.sum
        return df.groupBy(*keys).agg(F.array(*[agg(e) for e in elements]).alias(scores))
    if method != "vote":
        raise ValueError(f"unknown method: {method}")
    top = df.withColumn("_top", top_index(F.col(scores)))
    votes = top.groupBy(*keys).agg(
        F.array(*[F.count_if(F.col("_top") == i) for i in range(classes)]).alias("_votes"),
        F.array(
            *[
                F.coalesce(F.avg(F.when(e != 0, e)), F.lit(0.0))
                for e in elements
            ]
        ).alias("_means"),
    )
    won = F.array_position("_votes", F.array_max("_votes")) - 1
    return votes.select(
        *keys,
        F.transform("_means", lambda m, i: F.when(i == won, m).otherwise(0.0)).alias(scores),
    )


def channel_means(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean of each channel over all vectors, as one array."""
    return (
        df.select(F.posexplode(vector).alias("channel", "x"))
        .groupBy("channel")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .agg(F.array_sort(F.collect_list(F.struct("channel", "mean"))).alias("_m"))
        .select(F.transform("_m", lambda s: s["mean"]).alias("reference_mean"))
    )


def update_means(old: Column, new: Column, momentum: float) -> Column:
    """Exponential update of stored channel means."""
    return F.zip_with(old, new, lambda a, b: a * momentum + b * (1.0 - momentum))


def mean_discrepancy(df: DataFrame, reference: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each vector minus the reference mean (a single row, hence broadcast)."""
    one = reference.select("reference_mean", F.lit(1).alias("_one"))
    return (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(one), "_one")
        .withColumn(
            "nmd",
            F.zip_with(vector, "reference_mean", lambda x, m: x.cast("double") - m),
        )
        .drop("_one", "reference_mean")
    )


def ood_share(df: DataFrame, keys: Sequence[str], score: str, threshold: float) -> DataFrame:
    """Share of windows below the threshold."""
    return df.groupBy(*keys).agg(
        F.avg((F.col(score) < threshold).cast("int")).alias("ood_share"),
    )


def keep_confident(df: DataFrame, scores: Column, threshold: float) -> DataFrame:
    """Rows whose largest class probability reaches the threshold, with it as ``confidence``.

    The test is made while the row is generated: as a filter it would be pushed below the
    projections that compute the scores, and they would be evaluated twice.
    """
    kept = let(
        F.array_max(softmax(scores)),
        lambda p: F.when(p >= threshold, F.array(F.struct(p.alias("confidence")))),
    )
    return df.select("*", F.inline_outer(kept)).where("confidence IS NOT NULL")


def select_id_ood(df: DataFrame, threshold: float, scores: str = "scores", label: str = "label"):
    """Confident rows only: 1 where the class is right, 0 where it is wrong."""
    return keep_confident(df, F.col(scores), threshold).withColumn(
        "id_label", (top_index(F.col(scores)) == F.col(label)).cast("int")
    )


def loss_and_accuracy(df: DataFrame, scores: str = "scores", label: str = "label") -> DataFrame:
    """Mean cross-entropy of score arrays against class indices, and accuracy."""
    loss = -F.get(log_softmax(F.col(scores)), F.col(label))
    return df.agg(
        F.avg(loss).alias("loss"),
        F.avg((top_index(F.col(scores)) == F.col(label)).cast("int")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def logits_to_prob_if_needed(df: DataFrame, score: str, out: str = "prob") -> DataFrame:
    """Sigmoid of all scores when any of them lies outside [0, 1]; else the scores."""
    bounds = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi")).withColumn(
        "_one", F.lit(1)
    )
    outside = (F.col("_lo") < 0) | (F.col("_hi") > 1)
    return (
        df.withColumn("_one", F.lit(1))
        .join(F.broadcast(bounds), "_one")
        .withColumn(out, F.when(outside, sigmoid(F.col(score))).otherwise(F.col(score)))
        .drop("_one", "_lo", "_hi")
    )

