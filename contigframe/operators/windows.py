"""Row generators: windows, fragments, crops and k-mers of sequences.

A long sequence is never sliced again and again from its full text: it is cut once into
blocks, with an overlap of one window, and every window is sliced from its own small block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dna import base_counts, let, low_complexity_mask, piece, rounded_skew
from ..functions.picks import at, between, row_hash

MIN_BLOCK = 4096


def blocks(
    df: DataFrame, seq: str, overlap: int, size: int | None = None, keep: Column | None = None
) -> DataFrame:
    """Explode ``seq`` into ``block_start`` and ``block``: ``size`` letters plus ``overlap``.

    Rows where ``keep`` is false give none. The explodes are outer ones with a test of what came
    out: for an inner one the optimizer would first test the array in a filter of its own, which
    evaluates the whole expression below it a second time.
    """
    size = size or max(MIN_BLOCK, 4 * overlap)
    parts = F.regexp_extract_all(F.col(seq), F.lit("(?s).{1,%d}" % size), F.lit(0))
    parts = parts if keep is None else F.when(keep, parts)
    reach = -(-overlap // size)

    def overlapped(all_parts: Column) -> Column:
        # The overlap may reach over several following blocks when they are shorter than it.
        return F.transform(
            all_parts,
            lambda x, i: F.concat(
                x,
                F.left(
                    F.concat(
                        *[
                            F.coalesce(F.get(all_parts, i + n), F.lit(""))
                            for n in range(1, reach + 1)
                        ]
                    ),
                    F.lit(overlap),
                ),
            ),
        )

    rows = df.withColumn("_blocks", let(parts, overlapped) if reach else parts).drop(seq)
    return (
        rows.select("*", F.posexplode_outer("_blocks").alias("_block_no", "block"))
        .where("block IS NOT NULL")
        .withColumn("block_start", F.col("_block_no") * size)
        .drop("_block_no", "_blocks")
    )


def span_pieces(
    df: DataFrame, spans: DataFrame, key: str = "seq_id", seq: str = "seq", size: int = 1 << 14
) -> DataFrame:
    """The text of spans (``key, start, end, ...``; half-open) of any length, in pieces of up to
    ``size`` letters: adds ``block_start`` and ``text``; the pieces of a span follow each other.

    A span meets only the blocks it lies in, by an equal join, so neither the sequence is copied
    to its spans nor the list of spans to its blocks. Empty spans give no piece.
    """
    texts = blocks(df.select(key, seq), seq, 0, size).withColumn(
        "_block", F.floor(F.col("block_start") / size)
    )
    inside = F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))
    covered = spans.withColumn(
        "_block", F.explode(F.when(F.col("end") > F.col("start"), inside))
    )
    low = F.greatest(F.col("start") - F.col("block_start"), F.lit(0))
    high = F.least(F.col("end") - F.col("block_start"), F.lit(size))
    return (
        covered.join(texts, [key, "_block"])
        .withColumn("text", piece("block", low, high - low))
        .drop("_block", "block")
    )


def cut_regular(
    df: DataFrame,
    seq: str,
    size: Column,
    max_size: int,
    stride: Column,
    count: Column,
    tail: Column | None = None,
    out: str = "piece",
    block: int | None = None,
) -> DataFrame:
    """Pieces at 0, stride, 2 * stride, ... (``count`` of them), plus one at ``tail`` if not null.

    Adds ``start``, ``piece_idx`` and ``out``; drops ``seq``. Every other column is kept.
    """
    width = block or max(MIN_BLOCK, 4 * max_size)
    planned = df.withColumns(
        {
            "_size": size.cast("int"),
            "_stride": stride.cast("int"),
            "_count": count.cast("int"),
            "_tail": (tail if tail is not None else F.lit(None)).cast("int"),
        }
    )
    wanted = (F.col("_count") > 0) | F.col("_tail").isNotNull()
    rows = blocks(planned, seq, max_size, width, wanted)
    begin, stop = F.col("block_start"), F.col("block_start") + width
    first = F.ceil(begin / F.col("_stride"))
    last = F.least(F.ceil(stop / F.col("_stride")), F.col("_count")) - 1
    none = F.array().cast("array<int>")
    regular = F.when(
        first <= last,
        F.transform(F.sequence(first, last), lambda k: (k * F.col("_stride")).cast("int")),
    ).otherwise(none)
    tail_here = F.when(
        (F.col("_tail") >= begin) & (F.col("_tail") < stop), F.array(F.col("_tail"))
    ).otherwise(none)
    is_tail = F.coalesce(F.col("start") == F.col("_tail"), F.lit(False))
    return (
        rows.withColumn("start", F.explode_outer(F.concat(regular, tail_here)))
        .where("start IS NOT NULL")
        .withColumn(
            "piece_idx",
            F.when(is_tail, F.col("_count"))
            .otherwise(F.floor(F.col("start") / F.col("_stride")))
            .cast("int"),
        )
        .withColumn(out, piece("block", F.col("start") - F.col("block_start"), F.col("_size")))
        .drop("block", "block_start", "_size", "_stride", "_count", "_tail")
    )


def fixed_count(length: Column, size: int, stride: int) -> Column:
    """Number of full windows at a fixed stride; the tail is dropped."""
    return F.when(length >= size, F.floor((length - size) / stride) + 1).otherwise(0)


def window_starts(
    length: Column, size: int, stride: int | None = None, dynamic: bool = False,
    threshold: float = 10.0,
) -> Column:
    """Array of window starts of a sequence at least ``size`` long.

    Dynamic, for sequences below ``threshold`` windows: ceil(length / size) starts spread
    evenly (half to even), the last one flush with the end.
    """
    stride = stride or size
    fixed = F.when(
        length >= size, F.sequence(F.lit(0), (length - size).cast("int"), F.lit(stride))
    ).otherwise(F.array().cast("array<int>"))
    if not dynamic:
        return fixed
    n = F.greatest(F.lit(1), F.ceil(length / size)).cast("int")
    spread = F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.when(i == n - 1, length - size)
            .otherwise(F.bround(i * (length - size) / F.greatest(n - 1, F.lit(1)), 0))
            .cast("int"),
        )
    )
    even = F.when(n == 1, F.array(F.lit(0))).otherwise(spread)
    return F.when(length >= threshold * size, fixed).otherwise(even)


def make_windows(
    df: DataFrame,
    size: int,
    stride: int | None = None,
    min_len: int | None = None,
    max_len: int | None = None,
    dynamic: bool = False,
    threshold: float = 10.0,
    seq: str = "seq",
    counts: bool = True,
    mask: bool = True,
) -> DataFrame:
    """Windows of every sequence with their base counts and skew.

    With ``mask``, repetitive stretches are lower-cased first, so they count as no base.

    Sequences from ``min_len`` up to ``size - 1`` give one whole window; shorter ones, and those
    above ``max_len``, give none. Adds ``seq_len, start, window_idx, is_last, window`` and, with
    ``counts``, ``g, c, a, t, gc_skew``; drops the sequence.
    """
    stride = stride or size
    min_len = size if min_len is None else min_len
    rows = (df.withColumn(seq, low_complexity_mask(seq)) if mask else df).withColumn("seq_len", F.length(seq))
    length = F.col("seq_len")
    count = F.when(length >= size, fixed_count(length, size, stride)).when(
        length >= min_len, F.lit(1)
    ).otherwise(0)
    if max_len is not None:
        count = F.when(length <= max_len, count).otherwise(0)

    if dynamic:
        few = (length >= size) & (length < threshold * size)
        if max_len is not None:
            few &= length <= max_len
        # At most ``threshold`` windows: sliced from the whole sequence.
        starts = F.when(few, window_starts(length, size, stride, True, threshold))
        spread = (
            rows.withColumn("_starts", starts)
            .select("*", F.posexplode_outer("_starts").alias("window_idx", "start"))
            .where("start IS NOT NULL")
            .withColumn("_n", F.size("_starts"))
            .withColumn("window", piece(seq, F.col("start"), size))
            .drop("_starts", seq)
        )
        count = F.when(few, 0).otherwise(count)
    regular = cut_regular(
        rows.withColumn("_n", count.cast("int")), seq, F.lit(size), size, F.lit(stride), count,
        out="window",
    ).withColumnRenamed("piece_idx", "window_idx")
    if dynamic:
        regular = regular.unionByName(spread)
    out = regular.withColumn("is_last", F.col("window_idx") == F.col("_n") - 1).drop("_n")
    if counts:
        out = out.withColumns(base_counts("window")).withColumn(
            "gc_skew", rounded_skew(F.col("g"), F.col("c"))
        )
    return out


def length_bands(df: DataFrame, size: int, stride: int, min_len: int, **kw) -> DataFrame:
    """Long and short sequences in one pass, marked by ``band``."""
    windows = make_windows(df, size, stride, min_len=min_len, **kw)
    return windows.withColumn(
        "band", F.when(F.col("seq_len") >= size, F.lit("long")).otherwise(F.lit("short"))
    )


def fragments_tail_aligned(
    df: DataFrame, size: int, overlap: int, key: str = "seq_id", label: str = "label",
    seq: str = "seq",
) -> DataFrame:
    """Sliding fragments; the last one is shifted left to full length. Short inputs give none."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than the fragment")
    length = F.col("seq_len")
    rows = df.withColumn("seq_len", F.length(seq))
    # Starts k * step that do not yet reach the end, then the one flush with it.
    count = F.greatest(F.ceil((length - size) / step), F.lit(0))
    tail = F.when(length >= size, length - size)
    cut = cut_regular(rows, seq, F.lit(size), size, F.lit(step), count, tail, "fragment")
    return cut.withColumnRenamed("piece_idx", "frag_idx").withColumn(
        "frag_name",
        F.concat(
            F.col(key).cast("string"), F.lit("_frag"), F.col("frag_idx").cast("string"),
            F.lit("_start"), F.col("start").cast("string"), F.lit("_len"),
            F.length("fragment").cast("string"), F.lit("_cls="), F.col(label).cast("string"),
        ),
    )


def crop_plan(length: Column, size: Column, stride: Column, pad: bool = True):
    """(count of regular crops, tail start or null) for sliding crops."""
    single = (stride == 0) | (length <= size)
    if not pad:
        return F.when(single, 1).otherwise(F.ceil(length / stride)), F.lit(None)
    count = F.when(single, 1).otherwise(F.floor((length - size) / stride) + 1)
    covered = (count - 1) * stride + size
    return count, F.when(~single & (covered < length), length - size)


def crop_starts(length: Column, size: int, stride: int, pad: bool = True) -> Column:
    count, tail = crop_plan(length, F.lit(size), F.lit(stride), pad)
    regular = F.transform(
        F.sequence(F.lit(0), count.cast("int") - 1), lambda k: (k * stride).cast("int")
    )
    return F.concat(regular, F.when(tail.isNotNull(), F.array(tail.cast("int"))).otherwise(
        F.array().cast("array<int>")
    ))


def crop_strides(
    sizes: Sequence[int], strides: Sequence[int] | None = None, overlap: float | None = None
) -> list[int]:
    """Strides for crop sizes: given, from an overlap share, or the sizes themselves."""
    if strides is not None:
        if len(strides) != len(sizes):
            raise ValueError("one stride per crop size is needed")
        return list(strides)
    if overlap is not None:
        return [max(1, int(s * (1 - overlap))) for s in sizes]
    return list(sizes)


def multi_crops(
    df: DataFrame,
    sizes: Sequence[int],
    strides: Sequence[int] | None = None,
    overlap: float | None = None,
    pad: bool = True,
    seq: str = "seq",
) -> DataFrame:
    """Every crop size at every start: ``crop_size, start, crop_len, crop``."""
    steps = crop_strides(sizes, strides, overlap)
    plans = F.array(
        *[F.struct(F.lit(a).alias("size"), F.lit(b).alias("stride")) for a, b in zip(sizes, steps)]
    )
    rows = df.withColumn("seq_len", F.length(seq)).withColumn("_plan", F.explode(plans))
    size, stride = F.col("_plan.size"), F.col("_plan.stride")
    count, tail = crop_plan(F.col("seq_len"), size, stride, pad)
    cut = cut_regular(
        rows.withColumn("crop_size", size), seq, size, max(sizes),
        F.when(stride == 0, size).otherwise(stride), count, tail, "crop",
    )
    return cut.withColumn("crop_len", F.length("crop")).drop("_plan")


def training_crops(
    df: DataFrame,
    sizes: Sequence[int],
    strides: Sequence[int] | None = None,
    mode: str = "all",
    epoch: int = 0,
    seed: int = 0,
    pad: bool = True,
    key: str = "seq_id",
    seq: str = "seq",
) -> DataFrame:
    """Crops of each sequence for one epoch: ``crop_size, start, crop_len, crop``.

    ``all`` gives every crop size at every start, as ``multi_crops``. ``sample`` gives one of
    these, each as likely as any other. ``range`` gives one crop of any length from the smallest
    to the largest size (or the whole of a shorter sequence) at any start. Choices follow from
    seed, key and epoch.
    """
    if mode == "all":
        return multi_crops(df, sizes, strides, pad=pad, seq=seq)
    if mode not in ("sample", "range"):
        raise ValueError(f"unknown crop mode: {mode}")
    rows = df.withColumn("seq_len", F.length(seq)).withColumn("_h", row_hash(key, F.lit(epoch), seed=seed))
    if mode == "range":
        size = F.least(between(at(F.col("_h"), 1), min(sizes), max(sizes)), "seq_len")
        start = between(at(F.col("_h"), 2), 0, F.col("seq_len") - F.col("crop_size"))
        rows = rows.withColumn("crop_size", size).withColumn("start", start)
    else:
        plans = []
        for size, stride in zip(sizes, crop_strides(sizes, strides, None)):
            count, tail = crop_plan(F.col("seq_len"), F.lit(size), F.lit(stride), pad)
            plans.append(F.struct(F.lit(size).alias("size"), F.lit(stride).alias("stride"), count.cast("bigint").alias("n"), tail.cast("bigint").alias("tail")))
        each = F.transform(F.col("_plans"), lambda p: p["n"] + F.when(p["tail"].isNotNull(), 1).otherwise(0))
        # The place of the choice among all crops, size by size.
        rows = rows.withColumn("_plans", F.array(*plans)).withColumn("_each", each)
        total = F.aggregate("_each", F.lit(0).cast("bigint"), lambda a, x: a + x)
        rows = rows.withColumn("_nth", F.pmod(at(F.col("_h"), 0), total))
        before = F.transform("_each", lambda x, i: F.aggregate(F.slice(F.col("_each"), F.lit(1), i), F.lit(0).cast("bigint"), lambda a, y: a + y))
        which = F.size(F.filter(before, lambda b: b <= F.col("_nth"))) - 1
        rows = rows.withColumn("_plan", F.get("_plans", which)).withColumn("_nth", F.col("_nth") - F.get(before, which))
        start = F.when(F.col("_nth") < F.col("_plan.n"), F.col("_nth") * F.col("_plan.stride")).otherwise(F.col("_plan.tail"))
        rows = rows.withColumn("crop_size", F.col("_plan.size")).withColumn("start", start.cast("int")).drop("_plans", "_each", "_nth", "_plan")
    cut = rows.withColumn("crop", piece(seq, F.col("start"), F.col("crop_size"))).drop(seq, "_h")
    return cut.withColumn("crop_len", F.length("crop"))


def fixed_fragments(
    df: DataFrame, size: int, stride: int, label: int, seq: str = "seq"
) -> DataFrame:
    """Upper-case fragments at regular starts, labelled."""
    rows = df.withColumn(seq, F.upper(seq)).withColumn("seq_len", F.length(seq))
    count = fixed_count(F.col("seq_len"), size, stride)
    return cut_regular(
        rows, seq, F.lit(size), size, F.lit(stride), count, out="fragment"
    ).withColumn("label", F.lit(label))


def kmers(df: DataFrame, k: int, seq: str = "seq", step: int = 1) -> DataFrame:
    """All k-mers with their positions: ``start, kmer``."""
    rows = df.withColumn("seq_len", F.length(seq))
    count = fixed_count(F.col("seq_len"), k, step)
    return cut_regular(
        rows, seq, F.lit(k), k, F.lit(step), count, out="kmer", block=MIN_BLOCK
    ).drop("piece_idx", "seq_len")


def prefix_crop(df: DataFrame, lengths: Sequence[int], seq: str = "seq") -> DataFrame:
    """For each length, the sequences at least that long, cut to it."""
    wanted = F.array(*[F.lit(n) for n in lengths])
    return (
        df.withColumn("crop_size", F.explode(wanted))
        .where(F.length(seq) >= F.col("crop_size"))
        .withColumn(seq, F.left(F.col(seq), F.col("crop_size")))
    )
