"""Sampling, splitting, balancing and ordering of labelled rows.

Random order is the order of a row hash. Exact sizes come from ranks within hash buckets
(``ranks.rank_rows``), so a class that holds most rows is still cut into many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import count_of, piece, share
from ..functions.picks import at, between, row_hash
from .lineage import cut
from .ordered import running
from .ranks import bits_of, hash_bucket, rank_rows
from .skew import null_safe_join, salted_join, with_single
from .windows import MIN_BLOCK, blocks

# Blocks, and fragments cut from them, that a task holds as Python objects at once.
BLOCKS_HELD = 256
FRAGMENTS_HELD = 4096


def hash_rank(
    df: DataFrame, keys: Sequence[str], key: str, seed: int, out: str = "rank"
) -> DataFrame:
    """Rank of each row in the hash order of its group.

    Only ids are ranked; the number is joined back by a sort join, since rows that hold texts must
    not be copied to the few tasks of the ranks. Rows that repeat an id have ranks that follow each
    other.
    """
    by = [*dict.fromkeys([*keys, key])]
    ids = cut(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_h", row_hash(key, seed=seed)))
    total = ids.agg(F.sum("_copies").alias("n"), F.max("_copies").alias("most")).first()
    bits = bits_of(total["n"] or 0)
    if (total["most"] or 0) > 1:
        one_each = ids.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
        ranked = rank_rows(one_each, keys, ["_h", key, "_copy"], hash_bucket("_h", bits), out)
        ranked = ranked.groupBy(*by).agg(F.min(out).alias("_first"))
        order = Window.partitionBy(*by).orderBy(key)
        rows = null_safe_join(df.hint("merge"), ranked, by).withColumn(out, F.col("_first") + F.row_number().over(order) - 1)
        return rows.drop("_first")
    ranked = rank_rows(ids, keys, ["_h", key], hash_bucket("_h", bits), out)
    return null_safe_join(df.hint("merge"), ranked.select(*by, out), by)


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_h", row_hash(key, seed=seed)).orderBy("_h", key).drop("_h")


def split_dataset(
    df: DataFrame, key: str, train: float, val: float, test: float, seed: int = 0
) -> DataFrame:
    """Exact shares of all rows: int(train * n) and int(val * n); the rest is test."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("train, val and test must sum to 1")
    ranked = hash_rank(df, [], key, seed, "_rank")
    rows = with_single(ranked, df.agg(F.count(F.lit(1)).alias("_total")))
    n_train = F.floor(F.col("_total") * train)
    n_val = F.floor(F.col("_total") * val)
    name = F.when(F.col("_rank") < n_train, "train").when(F.col("_rank") < n_train + n_val, "val")
    return rows.withColumn("split", name.otherwise("test")).drop("_rank", "_total")


def split_val_first(df: DataFrame, key: str, val: float, seed: int = 0) -> DataFrame:
    ranked = hash_rank(df, [], key, seed, "_rank")
    rows = with_single(ranked, df.agg(F.count(F.lit(1)).alias("_total")))
    is_val = F.col("_rank") < F.floor(F.col("_total") * val)
    return rows.withColumn("split", F.when(is_val, "val").otherwise("train")).drop(
        "_rank", "_total"
    )


def assign_shards(df: DataFrame, key: str, label: str, shards: int, seed: int = 0) -> DataFrame:
    """Deal the rows of each class over the shards: floor or ceil of every class per shard."""
    ranked = hash_rank(df, [label], key, seed, "_rank")
    return ranked.withColumn("shard", F.pmod("_rank", F.lit(shards)).cast("int")).drop("_rank")


def interleave_classes(df: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Spread every class evenly over the whole order: adds ``position``.

    Row r of a class of n rows sorts at (r + 1/2) / n, ties by class.
    """
    ranked = hash_rank(df, [label], key, seed, "_rank")
    # The places of a class follow from its size alone: no row is needed to number them.
    sizes = cut(df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")))
    bits = bits_of(sizes.agg(F.sum("_size").alias("n")).first()["n"] or 0)
    places = sizes.withColumn("_rank", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1)))
    places = places.withColumn("_at", (F.col("_rank") + 0.5) / F.col("_size"))
    bucket = F.floor(F.col("_at") * (1 << bits))
    numbered = rank_rows(places, [], ["_at", label], bucket, "position").select(label, "_rank", "position")
    return null_safe_join(ranked, numbered, [label, "_rank"]).drop("_rank")


def batch_sizes(sizes: dict[int, int], default: int, replicas: int = 1) -> tuple[dict, int]:
    """Sizes rounded down to a multiple of the replicas; 0 falls back to the default."""
    base = default // replicas * replicas
    if base == 0:
        raise ValueError("the default batch size is smaller than the number of replicas")
    return {n: (s // replicas * replicas) or base for n, s in sizes.items()}, base


def length_batches(
    df: DataFrame, key: str, length: str, sizes: dict[int, int], default: int,
    replicas: int = 1, seed: int = 0,
) -> DataFrame:
    """Batches of rows of one exact length; an incomplete batch is dropped."""
    per_length, base = batch_sizes(sizes, default, replicas)
    size: Column = F.lit(base)
    for n, s in per_length.items():
        size = F.when(F.col(length) == n, s).otherwise(size)
    ranked = hash_rank(df, [length], key, seed, "_rank").withColumn("_size", size)
    counts = df.groupBy(length).agg(F.count(F.lit(1)).alias("_n"))
    batch = F.floor(F.col("_rank") / F.col("_size"))
    return (
        salted_join(ranked, counts, [length], [key])
        .withColumn("batch_idx", batch)
        .where((F.col("batch_idx") + 1) * F.col("_size") <= F.col("_n"))
        .withColumnRenamed("_size", "batch_size")
        .drop("_rank", "_n")
    )


def _targets(df: DataFrame, label: str, size: Column, extra: DataFrame) -> DataFrame:
    """Rounded share of ``size`` per label, with the gap of rounding down filled up by the
    labels with the largest remainders. One row per label."""
    counts = with_single(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), extra)
    total = with_single(counts, counts.agg(F.sum("_n").alias("_all")))
    exact = size * F.col("_n") / F.col("_all")
    base = total.withColumn("_exact", exact).withColumn("_base", F.bround("_exact", 0))
    gap = with_single(base, base.agg((F.max(size) - F.sum("_base")).alias("_gap")))
    # The window runs over the list of labels, one row each.
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("_base") - F.col("_exact")), label)
    return gap.withColumn("_pos", F.row_number().over(order))


def downsample_to_match(
    df: DataFrame, label: str, key: str, size: DataFrame, seed: int = 0
) -> DataFrame:
    """Rows of ``df`` cut to the size of another set (one row, column ``n``), by label share.

    Nothing is cut when ``df`` is not larger or the other set is empty.
    """
    other = size.select(F.col("n").alias("_m"))
    plan = _targets(df, label, F.col("_m"), other)
    keep_all = (F.col("_all") <= F.col("_m")) | (F.col("_m") == 0)
    target = F.col("_base") + (F.col("_pos") <= F.col("_gap")).cast("int")
    plan = plan.select(label, F.when(keep_all, F.col("_n")).otherwise(target).alias("_target"))
    ranked = hash_rank(df, [label], key, seed, "_rank")
    return salted_join(ranked, plan, [label], [key]).where("_rank < _target").drop("_rank", "_target")


def stratified_sample(
    df: DataFrame, label: str, key: str, size: int, seed: int = 0
) -> DataFrame:
    """``size`` rows by label share, at least one per label.

    Overshoot from rounding up is trimmed by hash; the first row of a label goes last.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    plan = with_single(counts, counts.agg(F.sum("_n").alias("_all")))
    target = F.greatest(F.lit(1.0), F.bround(F.lit(size) * F.col("_n") / F.col("_all"), 0))
    plan = plan.select(
        label, F.when(F.col("_all") <= size, F.col("_n")).otherwise(target).alias("_target")
    )
    ranked = hash_rank(df, [label], key, seed, "_rank")
    kept = salted_join(ranked, plan, [label], [key]).where("_rank < _target")
    # Order of the trim: first rows of labels, then the rest by rank.
    rows = kept.withColumn("_h", row_hash(key, seed=seed)).withColumn(
        "_order", F.when(F.col("_rank") == 0, F.lit(0)).otherwise(F.lit(1))
    )
    bits = bits_of(size)
    bucket = F.col("_order") * (1 << bits) + hash_bucket("_h", bits)
    trimmed = rank_rows(rows, [], ["_order", "_h", key], bucket, "_at")
    return trimmed.where(F.col("_at") < size).drop("_at", "_h", "_order", "_rank", "_target")


def replace_class(
    existing: DataFrame, new: DataFrame, label: str, value, key: str, seed: int = 0
) -> DataFrame:
    """Put ``new`` rows in place of as many existing rows of one class."""
    mine = existing.where(F.col(label) == value)
    n_old, n_new = mine.count(), new.count()
    if n_new > n_old:
        raise ValueError(f"{n_new} new rows cannot replace {n_old} existing ones")
    kept = hash_rank(mine, [], key, seed, "_rank").where(F.col("_rank") < n_old - n_new)
    others = existing.where(~F.col(label).eqNullSafe(F.lit(value)))
    return others.unionByName(kept.drop("_rank")).unionByName(new, allowMissingColumns=True)


def cut_spans(
    df: DataFrame, spans: DataFrame, key: str, max_len: int, seq: str = "seq"
) -> DataFrame:
    """Text of irregular spans (``key, start, length, ...``): adds ``fragment``.

    A span meets the one block it starts in, which overlaps the next by ``max_len``: the work is
    linear in the blocks and in the spans, however long the sequence.
    """
    extra = [c for c in spans.columns if c != key]
    width = max(MIN_BLOCK, 4 * max_len)
    texts = blocks(df.select(key, seq), seq, max_len, width)
    texts = texts.withColumn("_block", F.floor(F.col("block_start") / width))
    return (
        spans.withColumn("_block", F.floor(F.col("start") / width))
        .join(texts, [key, "_block"])
        .select(
            key, *extra,
            piece("block", F.col("start") - F.col("block_start"), F.col("length")).alias("fragment"),
        )
    )


def _pair_shuffled(df: DataFrame, key: str, seq: str, seed: int) -> DataFrame:
    """Written, since fragments are cut from it more than once."""
    from .perturb import dinuc_shuffle  # which builds on this module

    return cut(df.withColumn(seq, dinuc_shuffle(seq, row_hash(key, seed=seed))))


def random_tiling(
    df: DataFrame, min_len: int, max_len: int, overlap: int = 0, max_n: float = 0.3,
    seed: int = 0, shuffle: bool = False, key: str = "seq_id", seq: str = "seq",
) -> DataFrame:
    """Walk along each sequence in fragments of random length; the number of a fragment counts
    dropped ones too. Dropped are those with too many N or shorter than ``min_len``.

    With ``shuffle``, sequences are shuffled first with their letter pairs kept.
    """
    if shuffle:
        df = _pair_shuffled(df, key, seq, seed)
    if min_len <= 0 or max_len < min_len:
        raise ValueError("0 < min_len <= max_len is needed")
    if overlap >= min_len:
        raise ValueError("overlap must be smaller than the shortest fragment")
    base = df.select(key, F.length(seq).alias("_len"), row_hash(key, seed=seed).alias("_h"))
    steps = F.ceil(F.col("_len") / (min_len - overlap))
    walk = (
        base.withColumn(
            "frag_idx",
            F.explode(F.when(F.col("_len") >= min_len, F.sequence(F.lit(0), steps))),
        )
        .withColumn("length", between(at(F.col("_h"), F.col("frag_idx")), min_len, max_len))
        .withColumn("_step", F.col("length") - overlap)
    )
    placed = running(walk, [key], "frag_idx", {"_at": ("sum", "_step")}, inclusive=False)
    start = F.coalesce(F.col("_at"), F.lit(0)).cast("int")
    # A walk ends with the fragment that reaches the end of the sequence.
    spans = (
        placed.withColumn("start", start)
        .where((F.col("start") == 0) | (F.col("start") + overlap < F.col("_len")))
        .withColumn("length", F.least("length", F.col("_len") - F.col("start")).cast("int"))
        .where(F.col("length") >= min_len)
        .select(key, "frag_idx", "start", "length")
    )
    texts = cut_spans(df.select(key, seq), spans, key, max_len, seq)
    return texts.where(share(count_of("fragment", "N"), F.col("length")) <= max_n)


def _admissible(block: str, lengths: Sequence[int], begin: int, last: Sequence[int], width: int, max_n: float) -> Iterator[np.ndarray]:
    """For each length, whether a fragment from each start of a block holds few enough N."""
    held = np.zeros(len(block) + 1, np.int32)
    np.cumsum(np.frombuffer(block.encode("ascii", "replace"), np.uint8) == ord("N"), out=held[1:])
    for length, end in zip(lengths, last, strict=True):
        n = max(0, min(width, end - begin + 1, len(held) - length))
        yield held[length : length + n] - held[:n] <= math.floor(length * max_n)


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of a few rows at a time. An Arrow batch is compact; its blocks, lists and fragments
    as Python objects are many times as large."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCKS_HELD):
            yield batch.slice(i, BLOCKS_HELD).columns


def _list_bounds(lists: pa.Array) -> np.ndarray:
    return np.cumsum([0, *pc.list_value_length(lists).to_pylist()])


def _counted_places(source: DataFrame, wanted: DataFrame, key: str, max_len: int, circular: bool, max_n: float) -> DataFrame:
    """``key, length, block_start, n``: the admissible starts of each block and wanted length.

    ``source`` has ``key, _len, seq``; ``wanted`` has ``key, length``, at most one row per length
    between the shortest and the longest.
    """
    width = max(MIN_BLOCK, 4 * max_len)
    kind = source.schema[key].dataType.simpleString()
    lists = wanted.groupBy(key).agg(F.array_sort(F.collect_set("length")).alias("_lengths"))
    texts = blocks(source.join(lists, key), "seq", max_len, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, long, lists, begin, block in _in_slices(batches):
            lengths, bounds, found = lists.flatten().to_numpy(), _list_bounds(lists), []
            for i, (n, b, text) in enumerate(zip(long.to_pylist(), begin.to_pylist(), block.to_pylist(), strict=True)):
                wanted = lengths[bounds[i] : bounds[i + 1]].tolist()
                last = [n - (1 if circular else x) for x in wanted]
                found += [np.count_nonzero(x) for x in _admissible(text, wanted, b, last, width, max_n)]
            row = pa.array(np.repeat(np.arange(len(own)), np.diff(bounds)))
            columns = [own.take(row), pa.array(lengths.astype(np.int32)), begin.take(row), pa.array(found, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "length", "block_start", "n"])

    rows = texts.select(key, "_len", "_lengths", "block_start", "block")
    counted = rows.mapInArrow(count, f"_key {kind}, length int, block_start int, n int")
    return counted.withColumnRenamed("_key", key).where("n > 0")


def coverage_sampling(
    df: DataFrame, min_len: int, max_len: int, coverage: float, circular: bool = False,
    max_n: float = 0.3, seed: int = 0, shuffle: bool = False, key: str = "seq_id", seq: str = "seq",
) -> DataFrame:
    """Random fragments of each sequence until their bases reach ``coverage`` times it.

    Every fragment is drawn among the admissible places of its length, those with a share of N
    of at most ``max_n``: places are counted per block, the counts are summed along the
    sequence, and the j-th place is found by its block and then inside it. A length without any
    place is replaced by one that has some, drawn among all of them; so a sequence with a single
    admissible place reaches its target. One without any, or shorter than ``min_len``, has no
    fragments. With ``shuffle``, sequences are shuffled first with their letter pairs kept.
    """
    if shuffle:
        df = _pair_shuffled(df, key, seq, seed)
    if min_len <= 0 or max_len < min_len:
        raise ValueError("0 < min_len <= max_len is needed")
    width = max(MIN_BLOCK, 4 * max_len)
    text = F.concat(F.col(seq), F.left(F.col(seq), F.lit(max_len))) if circular else F.col(seq)
    source = df.where(F.length(seq) >= min_len).select(key, F.length(seq).alias("_len"), text.alias("seq"))
    lengths = source.select(key, "_len", row_hash(key, seed=seed).alias("_h")).withColumn("_target", F.col("_len") * coverage)
    number = F.ceil(F.col("_target") / min_len)
    draws = (
        lengths.withColumn("draw", F.explode(F.when(number > 0, F.sequence(F.lit(1), number.cast("int")))))
        .withColumn("_one", at(F.col("_h"), F.col("draw") * 2))
        .withColumn("_two", at(F.col("_h"), F.col("draw") * 2 + 1))
        .withColumn("length", F.least(between(F.col("_one"), min_len, max_len), "_len"))
        .drop("_h")
    )
    places = cut(_counted_places(source, draws.select(key, "length"), key, max_len, circular, max_n))
    sums = places.groupBy(key, "length").agg(F.sum("n").alias("_places"))
    draws = cut(draws.join(sums, [key, "length"], "left"))
    # Lengths without a place, where there are any: all lengths of those sequences are counted.
    barren = draws.where("_places IS NULL").select(key, "_len").distinct()
    every = barren.select(key, F.explode(F.sequence(F.lit(min_len), F.least(F.lit(max_len), "_len"))).alias("length"))
    more = cut(_counted_places(source, every, key, max_len, circular, max_n))
    listed = more.groupBy(key, "length").agg(F.sum("n").alias("_places")).groupBy(key)
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("length", "_places"))).alias("_listed"))
    pick = F.get("_listed", F.pmod("_one", F.size("_listed")).cast("int"))
    again = draws.where("_places IS NULL").join(listed, key).select(
        *[{"length": pick["length"], "_places": pick["_places"]}.get(c, F.col(c)).alias(c) for c in draws.columns]
    )
    drawn = draws.where("_places IS NOT NULL").unionByName(again)
    summed = running(drawn, [key], "draw", {"_before": ("sum", "length")}, inclusive=False)
    kept = summed.where(F.coalesce("_before", F.lit(0)) < F.col("_target"))
    kept = cut(kept.select(key, "draw", "length", F.pmod("_two", F.col("_places")).alias("_at")))
    # The block of the j-th place: the last one that has fewer places before it.
    places = places.unionByName(more).distinct()
    before = running(places, [key, "length"], "block_start", {"_at": ("sum", "n")}, inclusive=False)
    mark = F.struct("block_start", F.coalesce("_at", F.lit(0)).alias("_at"))
    marks = before.select(key, "length", F.coalesce("_at", F.lit(0)).alias("_at"), F.lit(0).alias("draw"), mark.alias("_mark"))
    asked = kept.withColumn("_mark", F.lit(None).cast(marks.schema["_mark"].dataType))
    met = running(marks.unionByName(asked), [key, "length"], "_at", {"_block": ("max", "_mark")}, width, tie=["draw"])
    found = met.where("draw > 0").select(
        key, F.col("_block.block_start").alias("_begin"),
        F.struct("draw", "length", (F.col("_at") - F.col("_block._at")).alias("nth")).alias("_draw"),
    )
    per_block = found.groupBy(key, "_begin").agg(F.array_sort(F.collect_list("_draw")).alias("_draws"))
    texts = blocks(source, "seq", max_len, width)
    kind = source.schema[key].dataType.simpleString()

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, long, begin, block, lists in _in_slices(batches):
            draw, length, nth = (c.to_numpy() for c in lists.flatten().flatten())
            bounds, texts, start = _list_bounds(lists), block.to_pylist(), np.empty(len(draw), np.int64)
            begins = begin.to_numpy()
            for i, (n, text) in enumerate(zip(long.to_pylist(), texts, strict=True)):
                here = length[bounds[i] : bounds[i + 1]]
                wanted = np.unique(here).tolist()
                last = [n - (1 if circular else x) for x in wanted]
                for x, ok in zip(wanted, _admissible(text, wanted, int(begins[i]), last, width, max_n), strict=True):
                    of = bounds[i] + np.flatnonzero(here == x)
                    start[of] = np.flatnonzero(ok)[nth[of]]
            row = np.repeat(np.arange(len(own)), np.diff(bounds))
            # One block may hold very many draws.
            for i in range(0, len(row), FRAGMENTS_HELD):
                r, s, n = (x[i : i + FRAGMENTS_HELD] for x in (row, start, length))
                columns = [
                    own.take(pa.array(r)), pa.array(draw[i : i + FRAGMENTS_HELD].astype(np.int32)), pa.array((begins[r] + s).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array([texts[k][x : x + y] for k, x, y in zip(r, s, n, strict=True)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "draw", "start", "length", "fragment"])

    chosen = texts.withColumnRenamed("block_start", "_begin").join(per_block, [key, "_begin"]).select(key, "_len", "_begin", "block", "_draws")
    return chosen.mapInArrow(select, f"_key {kind}, draw int, start int, length int, fragment string").withColumnRenamed("_key", key)
