"""Regions of one class along long contigs, and their borders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dna import rounded_skew, share
from ..functions.scores import names_of, softmax, top_index
from .lineage import cut
from .ordered import CHUNK, frame_over, neighbours, running, scale_range
from .skew import null_safe_join, salted_join
from .windows import blocks, make_windows

STOPS = ("TAA", "TAG", "TGA")
CODON_BLOCK = 3 << 11
# Blocks whose codons are held at once.
SLICE = 256
# Numbers of the letters; a codon with OTHER is above all others.
OTHER = 64
LETTER_OF = np.full(256, OTHER, np.int16)
LETTER_OF[list(b"ACGT")] = range(4)


def host_class(scored: DataFrame, classes: Sequence[str], key: str, probs: str) -> DataFrame:
    """Class with the largest mean probability per contig."""
    means = scored.groupBy(key).agg(
        F.array(*[F.avg(F.get(probs, F.lit(i))) for i in range(len(classes))]).alias("_m")
    )
    return means.select(key, F.get(names_of(list(classes)), top_index(F.col("_m"))).alias("host"))


def score_track(
    scored: DataFrame,
    classes: Sequence[str],
    size: int,
    stride: int,
    min_length: int = 500_000,
    key: str = "seq_id",
    chunk: int = CHUNK,
) -> DataFrame:
    """Smoothed class tracks of long contigs: moving sums over four windows of class
    probabilities, GC share, and the skew averaged over ten windows and scaled to [-1, 1]."""
    # Both are read more than once: written, so that no window is scored or framed again.
    rows = cut(
        scored.where(F.col("seq_len") >= min_length).select(
            key, "window_idx", "seq_len", softmax(F.col("scores")).alias("_p"),
            share(F.col("g") + F.col("c"), F.lit(size)).alias("gc"), "gc_skew",
        )
    )
    frames = {
        c: ("sum", F.get("_p", F.lit(i)), 2, 1) for i, c in enumerate(classes)
    }
    frames["_skew"] = ("sum", F.col("gc_skew"), 5, 4)
    framed = frame_over(rows, [key], "window_idx", frames, chunk)
    tracks = cut(framed.withColumn("_skew", F.col("_skew") / 10.0).drop("_p", "gc_skew"))
    scaled = scale_range(tracks, [key], "_skew", -1.0, 1.0, "skew_track")
    hosts = host_class(rows, classes, key, "_p")
    return salted_join(scaled, hosts, [key], ["window_idx"]).select(
        key, "window_idx", F.least(F.col("window_idx") * stride, "seq_len").alias("position"),
        "seq_len", "host", *classes, "gc", "skew_track",
    )


def segment_regions(
    track: DataFrame,
    score: str,
    sensitivity: float = 1.5,
    min_windows: int = 3,
    key: str = "seq_id",
    order: str = "window_idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Stretches of at least ``min_windows`` windows whose smoothed score is above
    ``sensitivity``: ``first_window, end_window`` (exclusive) and the mean ``score``."""
    rows = track.select(key, order, F.col(score).alias("_score")).withColumn(
        "_high", F.col("_score") > sensitivity
    )
    prev = neighbours(rows, [key], order, {"_prev": (F.col("_high"), -1)}, chunk)
    opened = cut(
        prev.withColumn(
            "_open", F.when(F.col("_high") & ~F.coalesce("_prev", F.lit(False)), F.col(order))
        )
    )
    named = running(opened, [key], order, {"first_window": ("max", "_open")}, chunk)
    return (
        named.where("_high")
        .groupBy(key, "first_window")
        .agg(F.count(F.lit(1)).alias("_n"), F.avg("_score").alias("score"))
        .where(F.col("_n") >= min_windows)
        .select(key, "first_window", (F.col("first_window") + F.col("_n")).alias("end_window"),
                "score")
    )


def region_coordinates(regions: DataFrame, size: int, stride: int, length: str = "seq_len"):
    """Base coordinates of window ranges, clipped to the contig."""
    start = F.col("first_window") * stride
    end = (F.col("end_window") - 1) * stride + size
    return regions.withColumns(
        {
            "start": F.greatest(F.lit(0), F.least(start, F.col(length))).cast("bigint"),
            "end": F.greatest(F.lit(0), F.least(end, F.col(length))).cast("bigint"),
        }
    )


def snap_boundaries(
    regions: DataFrame,
    genes: DataFrame,
    max_extension: int | None,
    key: str = "seq_id",
    length: str = "seq_len",
    bucket: int = 1 << 14,
) -> DataFrame:
    """Move a border that lies in a gene out to the end of the gene.

    Left borders go to the gene start and right borders to its end, by ``max_extension`` bases
    at most. Positions are cut into buckets, so the range condition becomes an equal join and a
    contig with very many genes is spread over its buckets.
    """
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.col("start").alias("pos")),
        F.struct(F.lit("right").alias("side"), F.col("end").alias("pos")),
    )
    borders = regions.select(key, "start", "end", F.inline(sides)).withColumn(
        "_bucket", F.floor(F.col("pos") / bucket)
    )
    spans = (
        genes.select(key, F.col("start").alias("_gs"), F.col("end").alias("_ge"))
        .where("_ge > _gs")
        .distinct()
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(F.floor(F.col("_gs") / bucket), F.floor((F.col("_ge") - 1) / bucket))
            ),
        )
    )
    inside = borders.distinct().join(spans, [key, "_bucket"]).where("pos >= _gs AND pos < _ge")
    first = inside.groupBy(key, "start", "end", "side", "pos").agg(
        F.min(F.struct("_gs", "_ge")).alias("_gene")
    )
    target = F.when(F.col("side") == "left", F.col("_gene._gs")).otherwise(F.col("_gene._ge"))
    moved = target
    if max_extension is not None:
        moved = F.when(F.col("side") == "left", F.greatest(target, F.col("pos") - max_extension))
        moved = moved.otherwise(F.least(target, F.col("pos") + max_extension))
    by_region = (
        first.withColumn("_to", moved)
        .groupBy(key, "start", "end")
        .agg(
            F.max(F.when(F.col("side") == "left", F.col("_to"))).alias("_left"),
            F.max(F.when(F.col("side") == "right", F.col("_to"))).alias("_right"),
        )
    )
    return (
        regions.join(by_region, [key, "start", "end"], "left")
        .withColumn("refined_start", F.greatest(F.lit(0), F.coalesce("_left", "start")))
        .withColumn("refined_end", F.least(F.col(length), F.coalesce("_right", "end")))
        .drop("_left", "_right")
    )


def _codon_kinds() -> np.ndarray:
    """For each strand and codon number, 1 for a start and 2 for a stop; others 0."""
    kinds = np.zeros((2, OTHER * 21 + 1), np.uint8)
    for codon in ("ATG", *STOPS):
        back = codon[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for strand, word in enumerate((codon, back)):
            x, y, z = ("ACGT".index(c) for c in word)
            kinds[strand, 16 * x + 4 * y + z] = 1 if codon == "ATG" else 2
    return kinds


def _codon_events(texts: Sequence[str], begins: np.ndarray, lengths: np.ndarray, whole: np.ndarray, min_len: int):
    """Starts and stops of some blocks that a frame over a block border can need, and the frames
    that lie between two stops of one block.

    Yields per strand: block number, place along the strand, whether it is a stop, and the end
    of the frame (-1 for a start or stop). Blocks with ``whole`` give every start and stop.
    """
    data = np.frombuffer(b"##".join([*[t.encode("ascii", "replace") for t in texts], b""]), np.uint8)
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    letters = LETTER_OF[data]
    codes = letters[:-2] * 16 + letters[1:-1] * 4 + letters[2:]
    for strand, kinds in enumerate(_codon_kinds()):
        kind = kinds[codes]
        hits = np.flatnonzero(kind)
        block = np.searchsorted(firsts, hits, "right") - 1
        at = begins[block] + hits - firsts[block]
        at = lengths[block] - at - 3 if strand else at
        order = np.argsort((block * 3 + at % 3) << 32 | at, kind="stable")
        block, at, stop = block[order], at[order], kind[hits][order] == 2
        # A stretch holds starts, then the stop that closes it, if it lies in this block.
        group = block * 3 + at % 3
        fresh = np.ones(len(at) + 1, bool)
        fresh[1:-1] = group[1:] != group[:-1]
        head = fresh[:-1].copy()
        head[1:] |= stop[:-1]
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        opened, closed, started = ~fresh[first], stop[last], ~stop[first]
        inside = opened & closed & ~whole[block[first]]
        keep = whole[block]
        keep[first[started & ~inside]] = True
        keep[last[closed & (~opened | fresh[last + 1])]] = True
        keep[first[opened & ~closed] - 1] = True
        orf = inside & started & (at[last] + 3 - at[first] >= min_len)
        rows = np.concatenate([np.flatnonzero(keep), first[orf]])
        ends = np.concatenate([np.full(keep.sum(), -1), at[last[orf]] + 3])
        yield block[rows], at[rows], stop[rows], ends


def orf_intervals(
    df: DataFrame, min_len: int = 90, key: str = "seq_id", seq: str = "seq", chunk: int = 1 << 18
) -> DataFrame:
    """Open reading frames, ATG to stop, on both strands: 0-based half-open ``start, end``.

    A frame between two stops of one block is found there. Of the others, only the outer starts
    and stops of a block become rows: the last stop before a codon names its open stretch; the
    first ATG of the stretch and the stop that closes it are the frame. The rows of a key that
    comes more than once are one sequence; there, all starts and stops become rows.
    """
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = cut(ids.select(key, F.lit(True).alias("_whole")))
    rows = blocks(
        null_safe_join(df.select(key, F.col(seq).alias("_seq"), F.length(seq).alias("_len")), repeated, [key], "left"),
        "_seq", 2, CODON_BLOCK,
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                own, length, begin, whole, text = batch.slice(i, SLICE).columns
                length, begin, whole = (np.array(x.to_pylist(), np.int64) for x in (length, begin, whole))
                found = _codon_events(text.to_pylist(), begin, length, whole.astype(bool), min_len)
                for strand, (block, at, stop, end) in zip("+-", found, strict=True):
                    none = end < 0
                    columns = [
                        own.take(pa.array(block)), pa.array(length[block].astype(np.int32)), pa.array([strand] * len(at), pa.string()),
                        pa.array((at % 3).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(stop),
                        pa.array(end.astype(np.int32), mask=none),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["_key", "_len", "strand", "frame", "at", "_is_stop", "_to"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, _len int, strand string, frame int, at int, _is_stop boolean, _to int"
    cols = [key, "_len", "block_start", F.coalesce("_whole", F.lit(False)).cast("int").alias("_whole"), "block"]
    # Read twice: written, so that no codon is cut again.
    found = cut(rows.select(*cols).mapInArrow(find, schema).withColumnRenamed("_key", key))
    events = found.where("_to IS NULL").drop("_to").withColumn("_stop", F.when(F.col("_is_stop"), F.col("at")))
    keys = [key, "strand", "frame"]
    named = running(events, keys, "at", {"_after": ("max", "_stop")}, chunk, inclusive=False)
    across = (
        named.groupBy(*keys, F.coalesce("_after", F.lit(-1)).alias("_after"))
        .agg(
            F.min(F.when(~F.col("_is_stop"), F.col("at"))).alias("_from"),
            (F.min("_stop") + 3).alias("_to"),
            F.max("_len").alias("_len"),
        )
        .where((F.col("_to") - F.col("_from")) >= min_len)
    )
    within = found.where("_to IS NOT NULL").withColumnRenamed("at", "_from")
    orfs = across.drop("_after").unionByName(within.drop("_is_stop"))
    plus = F.col("strand") == "+"
    return orfs.select(
        key, "strand", "frame",
        F.when(plus, F.col("_from")).otherwise(F.col("_len") - F.col("_to")).alias("start"),
        F.when(plus, F.col("_to")).otherwise(F.col("_len") - F.col("_from")).alias("end"),
    )


def gc_skew_profile(
    df: DataFrame, window: int = 2048, key: str = "seq_id", seq: str = "seq", chunk: int = CHUNK
) -> DataFrame:
    """Skew of adjoining windows (ten-window mean, scaled) and its running sum (scaled)."""
    rows = make_windows(df.select(key, F.col(seq).alias("seq")), window, window, counts=False, mask=False)
    counted = rows.select(
        key, "window_idx", F.col("start").alias("position"),
        rounded_skew(F.regexp_count("window", F.lit("G")), F.regexp_count("window", F.lit("C")))
        .alias("_skew"),
    )
    framed = frame_over(
        counted, [key], "window_idx", {"_sum": ("sum", F.col("_skew"), 5, 4)}, chunk
    ).withColumn("_mean", F.col("_sum") / 10.0)
    scaled = scale_range(framed, [key], "_mean", -1.0, 1.0, "gc_skew")
    summed = running(scaled, [key], "window_idx", {"_cum": ("sum", "gc_skew")}, chunk)
    return scale_range(summed, [key], "_cum", -1.0, 1.0, "cum_gc").select(
        key, "window_idx", "position", "gc_skew", "cum_gc"
    )


