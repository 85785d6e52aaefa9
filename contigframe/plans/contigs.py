"""From sequences to called contigs, regions and taxa."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import names_of, top_index
from ..operators.decode import transition_costs, viterbi_labels
from ..operators.lineage import cut
from ..operators.metrics import binary_metrics, per_class_metrics, reliability_stats
from ..operators.refine import add_score_features, aggregate_refined, refine_windows
from ..operators.regions import (
    orf_intervals,
    region_coordinates,
    score_track,
    segment_regions,
    snap_boundaries,
)
from ..operators.repeats import att_sites, terminal_repeats
from ..operators.scoring import composition, linear_scores
from ..operators.summary import (
    add_refined,
    add_repeats,
    add_window_summary,
    contig_summary,
    drop_ambiguous,
)
from ..operators.taxonomy import ancestors, attach_taxid, lineage_string, majority_lca, resolve_merged
from ..operators.vector_index import CELL_ROWS, build_index, nearest_in_index, nearest_vectors, open_index
from ..operators.windows import make_windows

Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Scorer:
    """A scorer over base composition that stays inside the JVM."""

    def score(windows: DataFrame) -> DataFrame:
        return windows.withColumn("scores", linear_scores(composition(), weights, bias))

    return score


def score_sequences(
    sequences: DataFrame, scorer: Scorer, size: int, stride: int, min_len: int | None = None, **kw
) -> DataFrame:
    """Scored windows of every sequence. The sequence itself is dropped at windowing."""
    return scorer(make_windows(sequences, size, stride, min_len=min_len, **kw))


def call_contigs(
    sequences: DataFrame,
    scorer: Scorer,
    classes: Sequence[str],
    size: int,
    stride: int,
    min_len: int | None = None,
    switch_cost: float | None = None,
    taus: DataFrame | None = None,
    repeats: bool = False,
    repeat_min_len: int | None = None,
    mask: bool = True,
) -> DataFrame:
    """The contig table. Optional steps: joint decoding, refinement, terminal repeats.

    Repetitive stretches are masked before windowing unless ``mask`` is false.

    The scored windows are written once, without their text: every step reads them from there,
    and the scorer runs once for each window.
    """
    scored = cut(score_sequences(sequences, scorer, size, stride, min_len, mask=mask).drop("window"))
    names = names_of(list(classes))
    if switch_cost is None:
        labelled = scored.withColumn("decoded", top_index(F.col("scores")))
    else:
        path = viterbi_labels(scored, transition_costs(classes, switch_cost))
        labelled = scored.join(path, ["seq_id", "window_idx"])
    labelled = labelled.withColumn("label_name", F.get(names, F.col("decoded")))
    summary = contig_summary(labelled, classes, size, label="decoded")
    table = add_window_summary(summary, labelled, "label_name")
    if repeats:
        found = terminal_repeats(sequences, repeat_min_len or size)
        table = add_repeats(table, found)
    if taus is not None:
        refined = refine_windows(add_score_features(scored, classes), taus)
        table = add_refined(table, aggregate_refined(refined, classes))
    return drop_ambiguous(table)


def call_regions(
    sequences: DataFrame,
    scored: DataFrame,
    classes: Sequence[str],
    target: str,
    size: int,
    stride: int,
    min_length: int,
    sensitivity: float = 1.5,
    genes: DataFrame | None = None,
) -> DataFrame:
    """Regions of one class on long contigs, snapped to genes, with their border repeats."""
    track = score_track(scored, classes, size, stride, min_length)
    regions = segment_regions(track, target, sensitivity)
    lengths = track.groupBy("seq_id").agg(F.max("seq_len").alias("seq_len"))
    placed = cut(region_coordinates(regions.join(lengths, "seq_id"), size, stride))
    if genes is None:
        long_only = sequences.where(F.length("seq") >= min_length)
        genes = orf_intervals(long_only)
    snapped = snap_boundaries(placed, genes, 2 * size)
    bounds = snapped.select(
        "seq_id", F.col("refined_start").alias("start"), F.col("refined_end").alias("end"), "score"
    )
    return att_sites(bounds, sequences)


def assign_taxa(
    windows: DataFrame, refs: DataFrame, closure: DataFrame, nodes: DataFrame, names: DataFrame,
    k: int = 1, fraction: float = 0.6,
) -> DataFrame:
    """Taxon and lineage per contig. ``windows``: seq_id, query_id, embedding."""
    found = nearest_vectors(windows.select("query_id", "embedding"), refs, k)
    return _voted(found, windows, closure, nodes, names, fraction)


def _voted(
    found: DataFrame, windows: DataFrame, closure: DataFrame, nodes: DataFrame, names: DataFrame, fraction: float
) -> DataFrame:
    hits = found.join(windows.select("query_id", "seq_id"), "query_id")
    calls = majority_lca(hits.select("seq_id", "taxid"), closure, "seq_id", fraction)
    lineages = lineage_string(calls.select(F.col("lca").alias("taxid")), closure, nodes, names)
    return calls.join(lineages.withColumnRenamed("taxid", "lca"), "lca", "left")


def build_taxonomy(
    windows: DataFrame, accessions: DataFrame, nodes: DataFrame, names: DataFrame, path: str,
    model: str, version: str, merged: DataFrame | None = None, cell_rows: int = CELL_ROWS,
) -> None:
    """Write reference vectors with their taxa, the tree and the names to a new folder ``path``.

    ``windows``: vec_id, accession, embedding; windows of an accession without a taxon are left out.
    Taxa merged into others are resolved by ``merged`` (old, new).
    """
    placed = attach_taxid(windows, accessions, "accession").where("taxid IS NOT NULL")
    if merged is not None:
        placed = resolve_merged(placed, merged)
    build_index(placed, f"{path}/index", model, version, cell_rows)
    nodes.select("taxid", "parent", "rank").write.parquet(f"{path}/nodes")
    names.select("taxid", "name").write.parquet(f"{path}/names")
    ancestors(nodes).write.parquet(f"{path}/ancestors")


def predict_taxa(windows: DataFrame, path: str, model: str, version: str, k: int = 1, fraction: float = 0.6) -> DataFrame:
    """``assign_taxa`` from what ``build_taxonomy`` wrote; another model or version is refused."""
    spark = windows.sparkSession
    found = nearest_in_index(windows.select("query_id", "embedding"), open_index(spark, f"{path}/index", model, version), k)
    nodes, names, closure = (spark.read.parquet(f"{path}/{t}") for t in ("nodes", "names", "ancestors"))
    return _voted(found, windows, closure, nodes, names, fraction)


def evaluate_sample(
    predictions: DataFrame, truth: DataFrame, cutoff: float = 0.0
) -> dict[str, DataFrame]:
    """Metrics over the ids both sides have; reliability figures over all predictions."""
    both = truth.join(predictions, "contig_id")
    if both.isEmpty():
        raise ValueError("predictions and labels share no contig id")
    has_reliability = "reliability_score" in predictions.columns
    out = {
        "binary": binary_metrics(
            both, reliability="reliability_score" if has_reliability else None, cutoff=cutoff
        ),
        "per_class": per_class_metrics(both, "fraction", "prediction"),
    }
    if has_reliability:
        out["reliability"] = reliability_stats(predictions, "reliability_score", cutoff)
    return out


def argmax_name(scores: Column, classes: Sequence[str]) -> Column:
    return F.get(names_of(list(classes)), top_index(scores))
