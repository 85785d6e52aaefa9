"""Training sets: fragments, encoded arrays, reliability and out-of-distribution sets."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import (
    codon_frames,
    dicodon_frames,
    frame_length,
    narrow_type,
    nucleotide_tokens,
    one_hot,
    pad_frames,
)
from ..functions.picks import row_hash
from ..operators.datasets import (
    assign_shards,
    downsample_to_match,
    interleave_classes,
    shuffle_rows,
    split_dataset,
    split_val_first,
    stratified_sample,
)
from ..operators.dedup import non_redundant, representatives
from ..operators.lineage import cut
from ..operators.perturb import (
    filter_synthetic,
    perturb,
    perturbation_plan,
    shuffle_bases,
    tandem_repeats,
)
from ..operators.refine import add_score_features, fit_thresholds
from ..operators.scoring import select_id_ood
from ..operators.validate import ood_label
from ..operators.windows import fragments_tail_aligned, multi_crops

VOCABULARY = {"codon_id": 65, "aa_id": 22, "pc2_id": 4, "pc5_id": 7, "murphy10_id": 12,
              "synonym_rank": 8}


def fragment_set(
    sequences: DataFrame, size: int, overlap: int, shares: tuple[float, float, float],
    k: int = 14, min_identity: float = 0.6, min_coverage: float = 0.6, seed: int = 0,
) -> DataFrame:
    """Fragments, one per cluster of similar ones, split by exact shares."""
    pieces = fragments_tail_aligned(sequences, size, overlap)
    rows = pieces.select("frag_name", F.col("fragment").alias("seq"), "label")
    clusters = non_redundant(
        rows, k, min_identity=min_identity, min_coverage=min_coverage, key="frag_name"
    )
    kept = representatives(rows, clusters, "frag_name")
    return split_dataset(kept, "frag_name", *shares, seed=seed)


def encode_dataset(
    sequences: DataFrame,
    sizes: Sequence[int],
    strides: Sequence[int] | None = None,
    kind: str = "both",
    alphabet: str = "codon_id",
    dicodons: bool = False,
    padded: bool = True,
    shards: int = 1,
    interleave: bool = False,
    one_hot_depth: int | None = None,
    key: str = "seq_id",
) -> DataFrame:
    """Crops of every sequence as token arrays with label, lengths and shard.

    A record is dealt to a shard with all its crops.
    """
    if kind not in ("nucleotide", "translated", "both"):
        raise ValueError(f"unknown input type: {kind}")
    dealt = assign_shards(sequences.select(key, "seq", "label"), key, "label", shards)
    crops = multi_crops(dealt, sizes, strides)
    widest = max(sizes)
    columns: dict[str, Column] = {"length": F.col("crop_len")}
    if kind in ("translated", "both"):
        frames = codon_frames("crop", alphabet)
        vocabulary = 4097 if dicodons else VOCABULARY[alphabet]
        codons = frame_length(F.col("crop_len"))
        width = widest // 3 - 1
        if dicodons:
            frames, width = dicodon_frames(frames), width - 1
            codons = F.greatest(codons - 1, F.lit(0))
        if padded:
            frames = pad_frames(frames, width)
        if one_hot_depth:
            frames = F.transform(frames, lambda f: one_hot(f, one_hot_depth))
        else:
            frames = frames.cast(f"array<array<{narrow_type(vocabulary)}>>")
        columns |= {"translated": frames, "translated_length": codons}
    if kind in ("nucleotide", "both"):
        tokens = nucleotide_tokens("crop")
        if padded:
            tokens = pad_frames(tokens, widest)
        columns["nucleotide"] = tokens.cast("array<array<tinyint>>")
    out = crops.withColumns(columns).drop("crop", "crop_len", "seq_len", "piece_idx")
    if interleave:
        sample = F.concat_ws(":", key, "crop_size", "start")
        out = interleave_classes(out.withColumn("sample_id", sample), "sample_id", "label")
    return out


Scores = Callable[[DataFrame], DataFrame]


def reliability_set(
    real: DataFrame,
    scorer: Scores,
    threshold: float,
    sample: int,
    multiplier: float,
    config: dict,
    seed: int = 0,
) -> DataFrame:
    """Rows to train a reliability head on: confident real rows and altered copies.

    ``scorer`` adds ``scores`` to rows with ``seq``. Real rows are labelled 1 where the class is
    right; altered rows the scorer is still confident about are labelled 0; real rows are cut
    to the number of altered ones, label by label.
    """
    sources = cut(stratified_sample(real, "label", "seq_id", sample, seed))
    # The sample bounds the sources of altered copies, not how many there are.
    plan = perturbation_plan(real.count(), multiplier, config)
    # Written out before scoring: the scorer's filter would otherwise be pushed into the
    # expressions that build the altered sequences, and both sets are used twice.
    altered = cut(perturb(sources, plan, seed))
    named = altered.withColumn("seq_id", F.concat_ws("_", "kind", F.col("i").cast("string")))
    synthetic = cut(
        filter_synthetic(scorer(named), F.col("scores"), threshold).select(
            "seq_id", "seq", F.col("label").alias("reliable")
        )
    )
    chosen = cut(
        select_id_ood(scorer(real), threshold).select(
            F.col("seq_id").cast("string").alias("seq_id"), "seq",
            F.col("id_label").alias("reliable"),
        )
    )
    matched = downsample_to_match(
        chosen, "reliable", "seq_id", synthetic.agg(F.count(F.lit(1)).alias("n")), seed
    )
    return matched.select("seq_id", "seq", "reliable").unionByName(synthetic)


def split_reliability_set(
    real: DataFrame, scorer: Scores, threshold: float, sample: int, multiplier: float, config: dict,
    validation: DataFrame | None = None, val_fraction: float = 0.1, seed: int = 0,
) -> DataFrame:
    """``reliability_set`` with a column ``split`` (train, val).

    With ``validation``, a set of its own is made of those rows; otherwise an exact share of all
    rows, ``val_fraction`` rounded down, is set aside.
    """
    rows = reliability_set(real, scorer, threshold, sample, multiplier, config, seed)
    if validation is None:
        return split_val_first(rows, "seq_id", val_fraction, seed)
    held = reliability_set(validation, scorer, threshold, sample, multiplier, config, seed + 1)
    return rows.withColumn("split", F.lit("train")).unionByName(held.withColumn("split", F.lit("val")))


def stored_set(spark: SparkSession, path: str, settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The set at ``path`` if it was made with the same settings, else a new one from ``build``.

    Settings are written after the rows, so a set that was not finished is made again; one made
    with other settings is refused.
    """
    text = json.dumps(settings, sort_keys=True)
    jvm, place = spark._jvm, f"{path.rstrip('/')}/settings"
    files = jvm.org.apache.hadoop.fs.Path(place).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")):
        found = spark.read.text(place).first()["value"]
        if found != text:
            raise ValueError(f"the set at {path} was made with {found}, not {text}")
    else:
        build().write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(place)
    return spark.read.parquet(f"{path}/rows")


def ood_set(
    sequences: DataFrame, correct: DataFrame | None, n_threshold: float = 0.3, seed: int = 0,
    tandem: bool = True,
) -> DataFrame:
    """Originals (1 if called correctly), shuffled copies (0) and tandem repeats (0), mixed."""
    originals = ood_label(sequences, correct, n_threshold).select(
        F.col("seq_id").cast("string").alias("seq_id"), "seq", F.col("ood_label").alias("label")
    )
    shuffled = sequences.select(
        F.concat(F.col("seq_id").cast("string"), F.lit("_shuffled")).alias("seq_id"),
        shuffle_bases("seq", row_hash("seq_id", seed=seed)).alias("seq"),
        F.lit(0).alias("label"),
    )
    every = originals.unionByName(shuffled)
    if tandem:
        every = every.unionByName(tandem_repeats(sequences, seed=seed).drop("motif"))
    return shuffle_rows(every, "seq_id", seed)


def calibrate_refinement(
    scored: DataFrame, classes: Sequence[str], truth: str, quantile: float = 0.05
) -> DataFrame:
    """Thresholds from scored validation windows."""
    features = add_score_features(scored, classes)
    return fit_thresholds(features, classes, quantile, "top_class", truth)
