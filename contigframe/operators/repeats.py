"""Repeats shared by two ends of a sequence.

With +2 per match and -100 per mismatch the best ungapped alignment of two ends is a common run,
or a chain of long runs on one diagonal. Runs are found by a join of k-mers: a pair of equal
k-mers is kept only where the letters before them differ, and that condition is part of the join
key, so a long run (or a low-complexity stretch) yields its first pair and not one per position.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dna import (
    _col,
    count_of,
    let,
    piece,
    reverse_complement,
    share,
)
from .lineage import cut
from .windows import span_pieces

SEED = 13
MATCH = 2
MISMATCH = 100
LONG_REPEAT = 250
LETTERS = "ACGT"
LETTER_OF = np.full(256, 4, np.int32)
LETTER_OF[list(LETTERS.encode())] = range(4)
# Texts whose k-mers are held at once.
SLICE = 64
# Letters between runs that are compared at once.
GAPS = 1 << 21


def _kmers(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """K-mers of A C G T: text number, position, the letters as a number, and the letter before
    (its place in LETTERS; 4 for none)."""
    data = np.frombuffer(b"#".join([b"", *[(t or "").encode("ascii", "replace") for t in texts], b"#" * SEED]), np.uint8)
    sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
    letters = LETTER_OF[data]
    n = len(data) - SEED + 1
    codes, bad = np.zeros(n, np.int32), np.cumsum(np.append(0, letters == 4))
    for i in range(SEED):
        codes = codes * 4 + letters[i : i + n]
    at = np.flatnonzero(bad[SEED:] == bad[:n])
    firsts = np.cumsum(sizes) - sizes + 1
    text = np.searchsorted(firsts, at, "right") - 1
    return text, (at - firsts[text]).astype(np.int32), codes[at], letters[at - 1]


def _seeds(df: DataFrame, id_: str, text: str, edge: str) -> DataFrame:
    """K-mers of A C G T, as numbers, with their position and the letter before (``edge`` if none)."""
    before = pa.array([*LETTERS, edge])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                own, kind, texts = batch.slice(i, SLICE).columns
                row, pos, kmer, prev = _kmers(texts.to_pylist())
                row = pa.array(row)
                columns = [own.take(row), kind.take(row), pa.array(pos), pa.array(kmer), before.take(pa.array(prev))]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "kind", "pos", "kmer", "prev"])

    schema = f"_id {df.schema[id_].dataType.simpleString()}, kind string, pos int, kmer int, prev string"
    return df.select(id_, "kind", text).mapInArrow(find, schema).withColumnRenamed("_id", id_)


def _common_length(a: Column, i: Column, b: Column, j: Column) -> Column:
    """Length of the common run at a[i:], b[j:], by halving steps."""
    room = F.least(F.length(a) - i, F.length(b) - j)
    steps = F.array(*[F.lit(1 << p) for p in range(13, -1, -1)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda acc, p: F.when(
            (acc + p <= room) & (piece(a, i + acc, p) == piece(b, j + acc, p)), acc + p
        ).otherwise(acc),
    )


def _matches(a: Column, b: Column) -> Column:
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int"))
    return F.when(F.length(a) == 0, F.lit(0)).otherwise(
        F.aggregate(same, F.lit(0), lambda acc, x: acc + x)
    )


def _shared_kmers(fronts: Sequence[str | None], rears: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal k-mers of a front and its rear with different letters before them: text number and both positions."""
    text, i, kmer, prev = _kmers(fronts)
    other, j, k, before = _kmers(rears)
    left, right = text << 2 * SEED | kmer, other << 2 * SEED | k
    order = np.lexsort((before, right))
    right, before, j = right[order], before[order], j[order]
    low, high = np.searchsorted(right, left, "left"), np.searchsorted(right, left, "right")
    held = np.flatnonzero(high > low)
    low, high, prev = low[held], high[held], prev[held]
    # Those with the same letter before lie together; none is like no other.
    both = right * 8 + before
    same = np.where(prev < 4, right[low] * 8 + prev, -1)
    skip, go_on = np.searchsorted(both, same, "left"), np.searchsorted(both, same, "right")
    skip, go_on = np.where(prev < 4, skip, low), np.where(prev < 4, go_on, low)
    out = []
    for first, end in ((low, skip), (go_on, high)):
        n = end - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((np.repeat(text[held], n), np.repeat(i[held], n), j[at]))
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))


def _letters_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts (4: other ones) in a row, where each text begins and its length."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    data = "".join(t or "" for t in texts).encode("ascii", "replace")
    return LETTER_OF[np.frombuffer(data, np.uint8)], np.cumsum(sizes) - sizes, sizes


def _best_of(fronts: Sequence[str | None], rears: Sequence[str | None]) -> tuple[np.ndarray, ...]:
    """The best alignment of each front with its rear: text number, ``a_start, b_start, length, identities, score``."""
    text, i, j = _shared_kmers(fronts, rears)
    a, a_first, a_size = _letters_of(fronts)
    b, b_first, b_size = _letters_of(rears)
    order = np.lexsort((i, j - i, text))
    text, i, j = text[order], i[order], j[order]
    # Each run from its first k-mer on, letter by letter, all runs together.
    length = np.full(len(i), SEED, np.int64)
    on = np.arange(len(i))
    while len(on):
        x, y = i[on] + length[on], j[on] + length[on]
        on, x, y = (v[(x < a_size[text[on]]) & (y < b_size[text[on]])] for v in (on, x, y))
        x, y = a[a_first[text[on]] + x], b[b_first[text[on]] + y]
        on = on[(x == y) & (x < 4)]
        length[on] += 1
    # Along a diagonal, two neighbouring runs may be joined over the mismatches between them.
    new = np.ones(len(i), bool)
    new[1:] = (text[1:] != text[:-1]) | ((j - i)[1:] != (j - i)[:-1])
    gap = np.zeros(len(i), np.int64)
    gap[1:] = np.where(new[1:], 0, i[1:] - i[:-1] - length[:-1])
    same = np.zeros(len(i), np.int64)
    for part in np.array_split(np.flatnonzero(gap), int(gap.sum()) // GAPS + 1):
        n = gap[part]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x = a[np.repeat(a_first[text[part]] + i[part] - n, n) + inside]
        y = b[np.repeat(b_first[text[part]] + j[part] - n, n) + inside]
        same[part] = np.bincount(np.repeat(np.arange(len(part)), n), weights=(x == y) & (x < 4), minlength=len(part))
    own = np.cumsum(new) - 1

    def running(values: np.ndarray) -> np.ndarray:
        total = np.cumsum(values)
        return total - (total - values)[np.flatnonzero(new)][own]

    total = running(MATCH * same - MISMATCH * (gap - same) + MATCH * length)
    equal = running(same + length)
    # The least total before a run of the diagonal up to here, and where it was first: each diagonal lies below the last.
    base = total - MATCH * length - (own << 40)
    least = np.minimum.accumulate(base)
    lower = np.append(True, base[1:] < least[:-1]) if len(base) else new
    start = np.maximum.accumulate(np.where(lower, np.arange(len(base)), 0))
    score = total - (total - MATCH * length)[start]
    identities = equal - (equal - length)[start]
    # Of equal scores the first start; of these the longest.
    order = np.lexsort((np.arange(len(i)), -j[start], -i[start], score, text))
    order = order[np.append(text[order][1:] != text[order][:-1], True)] if len(order) else order
    first = start[order]
    return text[order], i[first], j[first], (i + length)[order] - i[first], identities[order], score[order]


def _best_of_rows(ends: DataFrame, id_: str) -> DataFrame:
    """``best_runs`` of rows that share their id and kind with no other, row by row."""
    names = ["a_start", "b_start", "length", "identities", "score"]
    kinds = dict(zip(names, ("int", "int", "int", "int", "bigint")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                own, kind, fronts, rears = batch.slice(i, SLICE).columns
                text, *values = _best_of(fronts.to_pylist(), rears.to_pylist())
                columns = [own.take(pa.array(text)), kind.take(pa.array(text))]
                columns += [pa.array(v, pa.int64() if kinds[n] == "bigint" else pa.int32()) for n, v in zip(names, values)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "kind", *names])

    schema = f"_id {ends.schema[id_].dataType.simpleString()}, kind string, " + ", ".join(f"{n} {t}" for n, t in kinds.items())
    rows = ends.where(F.col(id_).isNotNull() & F.col("kind").isNotNull()).select(id_, "kind", "front", "rear")
    return rows.mapInArrow(find, schema).withColumnRenamed("_id", id_)


def best_runs(ends: DataFrame, id_: str) -> DataFrame:
    """Best alignment per id and kind of the columns ``front`` and ``rear``.

    Both texts are bounded by the caller (a few thousand letters), so each row is searched whole where it
    lies. Rows that share their id and kind are searched together, by a join of their k-mers.
    Returns ``a_start, b_start, length, identities, score``.
    """
    again = cut(ends.groupBy(id_, "kind").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_).distinct())
    if again.isEmpty():
        return _best_of_rows(ends, id_)
    alone = _best_of_rows(ends.join(again, id_, "left_anti"), id_)
    return alone.unionByName(_joined_runs(ends.join(again, id_, "left_semi"), id_))


def _joined_runs(ends: DataFrame, id_: str) -> DataFrame:
    """``best_runs`` by a join of k-mers."""
    # Letters outside A C G T match nothing, not even themselves.
    safe = ends.select(
        id_, "kind", F.regexp_replace("front", f"[^{LETTERS}]", "#").alias("front"),
        F.regexp_replace("rear", f"[^{LETTERS}]", "~").alias("rear"),
    )
    left = _seeds(ends, id_, "front", "^")
    options = F.array(*[F.lit(c) for c in LETTERS + "$"])
    left = left.select(
        id_, "kind", "kmer", F.col("pos").alias("i"),
        F.explode(F.filter(options, lambda c: c != F.col("prev"))).alias("prev"),
    )
    right = _seeds(ends, id_, "rear", "$").withColumnRenamed("pos", "j")
    pairs = left.join(right, [id_, "kind", "kmer", "prev"]).select(id_, "kind", "i", "j")
    runs = (
        pairs.join(safe, [id_, "kind"])
        .withColumn(
            "len", _common_length(F.col("front"), F.col("i"), F.col("rear"), F.col("j"))
        )
        .withColumn("diag", F.col("j") - F.col("i"))
    )
    # Along a diagonal, two neighbouring runs may be joined over the mismatches between them.
    w = Window.partitionBy(id_, "kind", "diag").orderBy("i")
    last_end = F.lag(F.col("i") + F.col("len")).over(w)
    gap = F.col("i") - F.col("_end")
    between = _matches(
        piece("front", F.col("_end"), gap), piece("rear", F.col("_end") + F.col("diag"), gap)
    )
    linked = (
        runs.withColumn("_end", last_end)
        .withColumn("_same", F.when(F.col("_end").isNull(), 0).otherwise(between))
        .withColumn(
            "_gap",
            F.when(F.col("_end").isNull(), 0).otherwise(
                MATCH * F.col("_same") - MISMATCH * (gap - F.col("_same"))
            ),
        )
        .drop("front", "rear")
    )
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = linked.withColumn(
        "_sum", F.sum(F.col("_gap") + MATCH * F.col("len")).over(up_to)
    ).withColumn("_ids", F.sum(F.col("_same") + F.col("len")).over(up_to))
    base = F.struct(
        (F.col("_sum") - MATCH * F.col("len")).alias("sum"), F.col("i").alias("i"),
        (F.col("_ids") - F.col("len")).alias("ids"),
    )
    chains = sums.withColumn("_from", F.min(base).over(up_to)).select(
        id_,
        "kind",
        F.col("_from.i").alias("a_start"),
        (F.col("_from.i") + F.col("diag")).alias("b_start"),
        (F.col("i") + F.col("len") - F.col("_from.i")).alias("length"),
        (F.col("_ids") - F.col("_from.ids")).alias("identities"),
        (F.col("_sum") - F.col("_from.sum")).alias("score"),
    )
    values = F.struct("a_start", "b_start", "length", "identities", "score")
    rank = F.struct("score", -F.col("a_start"), -F.col("b_start"))
    return chains.groupBy(id_, "kind").agg(F.max_by(values, rank).alias("_r")).select(
        id_, "kind", "_r.*"
    )


def choose_kind(runs: DataFrame, id_: str) -> DataFrame:
    """The kind with the higher score per id; a direct repeat on a tie."""
    values = F.struct("kind", "a_start", "b_start", "length", "identities", "score")
    return (
        runs.groupBy(id_)
        .agg(F.max_by(values, F.struct("score", F.col("kind") == "DTR")).alias("_r"))
        .select(id_, "_r.*")
    )


def both_kinds(rear: Column | str) -> Column:
    rear = _col(rear)
    return F.array(
        F.struct(F.lit("DTR").alias("kind"), rear.alias("rear")),
        F.struct(F.lit("ITR").alias("kind"), reverse_complement(rear).alias("rear")),
    )


def scan_length(length: Column) -> Column:
    wide = F.least(F.greatest(F.floor(length * 0.04), F.lit(400)), F.lit(4000))
    return F.least(wide, length).cast("int")


def terminal_repeats(
    df: DataFrame, min_len: int, key: str = "seq_id", seq: str = "seq"
) -> DataFrame:
    """Direct or inverted repeat of the two ends of every contig of at least ``min_len``.

    One row per contig; all null where nothing longer than 12 bases is shared.
    """
    n = scan_length(F.col("seq_len"))
    long = F.col("seq_len") >= min_len
    tips = (
        df.select(key, F.col(seq).alias("_seq"), F.length(seq).alias("seq_len"))
        .withColumn("n", n)
        .select(
            key, "seq_len", "n", F.when(long, F.left("_seq", F.col("n"))).alias("front"),
            F.when(long, F.right("_seq", F.col("n"))).alias("_rear"),
        )
    )
    # Used three times. Short rows go here: a filter before would be moved to the scan, with all that makes the sequence.
    tips = cut(tips).where(long)
    ends = tips.select(key, "front", F.inline(both_kinds("_rear")))
    best = choose_kind(best_runs(ends, key), key)
    rows = tips.join(best, key, "left")
    length, last = F.col("length"), F.col("b_start") + F.col("length") - 1
    offset = F.col("seq_len") - F.col("n")
    inverted = F.col("kind") == "ITR"
    send = F.col("a_start") + length
    back = F.when(inverted, F.greatest(F.col("n") - last, F.lit(0))).otherwise(
        F.greatest(last - length, F.lit(0))
    )
    estart = F.when(length.isNotNull(), offset + back)
    rear = F.when(inverted, reverse_complement("_rear")).otherwise(F.col("_rear"))
    # The rear text is given in the direction in which it lies in the contig.
    rear = let(rear, lambda r: piece(r, F.col("b_start"), length))
    long = (F.col("kind") == "DTR") & (length >= LONG_REPEAT)
    return rows.select(
        F.col(key).alias("contig_id"),
        length.cast("int").alias("repeat_length"),
        F.col("identities").cast("int").alias("identities"),
        F.round(share(F.col("identities"), length), 2).alias("_identity"),
        F.col("score").cast("int").alias("score"),
        F.when(long, F.lit("LTR_DTR")).otherwise(F.col("kind")).alias("terminal_repeats"),
        F.when(length.isNotNull(), 0).alias("fgaps"),
        F.when(length.isNotNull(), 0).alias("rgaps"),
        F.col("a_start").cast("int").alias("sstart"),
        send.cast("int").alias("send"),
        estart.cast("int").alias("estart"),
        F.when(inverted, estart + length).otherwise(offset + last).cast("int").alias("eend"),
        "seq_len",
        piece("front", F.col("a_start"), length).alias("front"),
        F.when(inverted, reverse_complement(rear)).otherwise(rear).alias("rear"),
    ).withColumn(
        "identity", F.when(F.col("repeat_length").isNotNull(), F.col("_identity"))
    ).drop("_identity")


def att_sites(
    regions: DataFrame, sequences: DataFrame, key: str = "seq_id", seq: str = "seq"
) -> DataFrame:
    """Repeats around the two borders of each region (``start, end, score``).

    A region is identified by key, start and end. Without a hit the attachment columns are null
    and the region borders are kept. Both ends (a few thousand letters) and the counts of the body
    come from the blocks of the sequence that they lie in; the sequence itself is never copied.
    """
    ids = [key, "start", "end"]
    lengths = sequences.select(key, F.length(seq).alias("seq_len"))
    width = F.col("end") - F.col("start")
    offset = F.when(F.floor(width / 2) >= 14000, 2000).otherwise(F.floor(width / 4))
    wide = F.least(F.greatest(F.floor(F.col("seq_len") * 0.04), F.lit(400)), F.lit(4000))
    placed = cut(
        regions.select(*ids, "score")
        .join(lengths, key)
        .withColumn("_off", offset.cast("int"))
        .withColumn("_from", F.greatest(F.col("start") - wide, F.lit(0)).cast("int"))
        .withColumn("_to", F.least(F.col("end") + wide, F.col("seq_len")).cast("int"))
        .withColumn("_right", (F.col("end") - F.col("_off")).cast("int"))
        .withColumn("region_id", F.concat_ws(":", *ids))
    )
    sides = F.array(
        F.struct(
            F.lit("front").alias("side"), F.col("_from").alias("start"),
            (F.col("start") + F.col("_off")).cast("int").alias("end"),
        ),
        F.struct(F.lit("rear").alias("side"), F.col("_right").alias("start"), F.col("_to").alias("end")),
    )
    tips = span_pieces(sequences, placed.select(key, "region_id", F.inline(sides)).distinct(), key, seq)

    def joined(side: str) -> Column:
        parts = F.collect_list(F.when(F.col("side") == side, F.struct("block_start", "text")))
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "")

    tips = tips.groupBy("region_id").agg(joined("front").alias("front"), joined("rear").alias("_rear"))
    near = cut(placed.join(tips, "region_id", "left").fillna("", ["front", "_rear"]))
    ends = near.select("region_id", "front", F.inline(both_kinds("_rear")))
    best = choose_kind(best_runs(ends, "region_id"), "region_id").withColumnRenamed(
        "score", "att_score"
    )
    rows = cut(near.join(best, "region_id", "left"))
    length = F.col("length")
    inverted = F.col("kind") == "ITR"
    a_last = F.col("a_start") + length - 1
    b_last = F.col("b_start") + length - 1
    send = F.when(inverted, F.col("_from") + a_last + 1).otherwise(F.col("_from") + a_last)
    sstart = F.when(inverted, send - length).otherwise(send - length + 1)
    eend_direct = F.col("_right") + b_last
    estart = F.when(inverted, F.col("_to") - b_last - 1).otherwise(eend_direct - length + 1)
    eend = F.when(inverted, estart + length).otherwise(eend_direct)
    hit = length.isNotNull()
    body_start = F.when(hit, sstart).otherwise(F.col("start")).cast("int")
    body_end = F.when(hit, eend).otherwise(F.col("end")).cast("int")
    bodies = rows.select(key, "region_id", body_start.alias("start"), body_end.alias("end")).distinct()
    body = span_pieces(sequences, bodies, key, seq).groupBy("region_id").agg(
        F.sum(count_of("text", "N")).alias("_n"), F.sum(F.length("text")).alias("_letters"),
        F.sum(count_of("text", "G") + count_of("text", "C")).alias("_gc"),
    )
    rows = rows.withColumns(
        {"sstart": body_start, "eend": body_end, "_send": send, "_estart": estart}
    ).join(body, "region_id", "left").fillna(0, ["_n", "_letters", "_gc"])
    n_share = share(F.col("_n"), F.col("_letters"))
    long = (F.col("kind") == "DTR") & ((F.col("_send") - F.col("sstart")) >= LONG_REPEAT)
    rear = F.when(inverted, reverse_complement("_rear")).otherwise(F.col("_rear"))
    return rows.select(
        F.col(key).alias("contig_id"),
        "seq_len",
        (F.col("eend") - F.col("sstart")).alias("region_len"),
        F.col("score").alias("phage_score"),
        F.when(hit, n_share).alias("n%"),
        share(F.col("_gc"), F.col("_letters")).alias("gc%"),
        F.when(hit, n_share > 0.20).alias("reject"),
        "sstart",
        F.when(hit, F.col("_send")).cast("int").alias("send"),
        F.when(hit, F.col("_estart")).cast("int").alias("estart"),
        "eend",
        length.cast("int").alias("att_alignment_length"),
        F.col("identities").cast("int").alias("att_identities"),
        F.when(hit, F.round(share(F.col("identities"), length), 2)).alias("att_identity"),
        F.col("att_score").cast("int").alias("att_score"),
        F.when(long, F.lit("LTR_DTR")).otherwise(F.col("kind")).alias("att_type"),
        F.when(hit, 0).alias("att_fgaps"),
        F.when(hit, 0).alias("att_rgaps"),
        piece("front", F.col("a_start"), length).alias("attL"),
        let(rear, lambda r: piece(r, F.col("b_start"), length)).alias("attR"),
        F.col("start").alias("raw_start"),
        F.col("end").alias("raw_end"),
    )
