"""Altered copies of sequences: shuffles, repeats, N stretches, mixes, mutations.

Every random choice is a hash of (seed, id, position). The rows are sequences of fragment size;
rebuilding one is a row-local expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.dna import _col, piece
from ..functions.frames import first_places, letter_parts, places_within
from ..functions.picks import SPACE, at, between, row_hash, unit
from .datasets import hash_rank
from .lineage import cut
from .scoring import keep_confident
from .skew import with_single

BASES = "ACGT"
#: Copies of one source made in a row.
COPIES = 1 << 5


def _by_hash(items: Column, hash_: Column) -> Column:
    """The items of a short array in the order of a hash of their position."""
    keyed = F.transform(items, lambda x, i: F.struct(at(hash_, i).alias("h"), i.alias("i"),
                                                     x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def _hashes(hash_: int | np.ndarray, positions: np.ndarray) -> np.ndarray:
    """``picks.at`` for each position."""
    space = np.uint64(SPACE - 1)
    x = (np.asarray(hash_).astype(np.uint64) + positions.astype(np.uint64) * np.uint64(2654435761)) & space
    for _ in range(2):
        x = (x * np.uint64(1664525) + np.uint64(1013904223)) & space
        x ^= x >> np.uint64(15)
    return x


def _hashes_at(hash_: int, n: int) -> np.ndarray:
    """``picks.at`` for positions 0 to n - 1."""
    return _hashes(hash_, np.arange(n))


def _permuted(text: str | None, hash_: int, k: int) -> str | None:
    if text is None:
        return None
    codes = _code_points(text)
    whole = len(codes) // k
    order = np.argsort(_hashes_at(hash_, whole), kind="stable")
    return _text(np.concatenate([codes[: whole * k].reshape(whole, k)[order].ravel(), codes[whole * k :]]))


def kmer_shuffle(seq: Column | str, hash_: Column, k: int) -> Column:
    """Permute blocks of k letters by a hash of their position; a short last block stays last.

    One array of numbers a sequence, whatever its length.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    @F.pandas_udf(StringType())
    def permute(texts: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([_permuted(t, int(h), k) for t, h in zip(texts, hashes, strict=True)], dtype=object)

    return permute(_col(seq), hash_)


def shuffle_bases(seq: Column | str, hash_: Column) -> Column:
    return kmer_shuffle(seq, hash_, 1)


def _doubled(n: int) -> range:
    return range(max(1, (n - 1).bit_length()))


def _sorted_by(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The order by group, then value (below 2^32), then place."""
    if groups.max(initial=0) >= 1 << 31:
        return np.lexsort((values, groups))
    keys = groups.astype(np.int64) << 32 | values.astype(np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    return order if (keys[1:] > keys[:-1]).all() else np.lexsort((values, groups))


def _pair_walks(codes: np.ndarray, sizes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """For each text, another order of the same letter pairs, found without walking from letter to letter.

    A pair is an edge between its letters, and one more edge leads from the last letter back to the
    first. Each edge into a letter is followed by an edge out of it, drawn at random; that gives
    cycles. Cycles that meet at a letter become one by exchanging what follows there. Doubled
    pointers give the cycle of every edge, and in the end its place on the only cycle left. All
    texts of a part take these steps together.
    """
    n = len(codes)
    if not n:
        return codes
    full = np.flatnonzero(sizes)
    first, size = first_places(sizes)[full], sizes[full]
    last, text = first + size - 1, np.repeat(np.arange(len(full)), size)
    letters, from_ = np.unique(codes, return_inverse=True)
    to = np.empty(n, np.int64)  # edge k leads from letter k to the one after; the last back to the first
    to[:-1] = from_[1:]
    to[last] = from_[first]
    into = _sorted_by(text * len(letters) + to, np.arange(n))
    follow = np.empty(n, np.int64)
    follow[into] = _sorted_by(text * len(letters) + from_, _hashes(np.repeat(seeds[full], size), places_within(size)))
    rounds = _doubled(int(size.max()))
    cycle, step = np.arange(n), follow
    for _ in rounds:
        cycle, step = np.minimum(cycle, cycle[step]), step[step]
    is_first = cycle == np.arange(n)
    cycle = (np.cumsum(is_first) - 1)[cycle]
    text_of, merged = text[is_first], np.arange(is_first.sum())
    letter = to[into]
    into = into[np.argsort(letter.astype(np.uint16) if len(letters) < 1 << 16 else letter, kind="stable")]
    seen = np.empty(len(merged), np.int64)
    for edges in np.split(into, np.cumsum(np.bincount(letter, minlength=len(letters)))[:-1]):
        if len(edges) < 2:
            continue
        met_at = merged[cycle[edges]]
        seen[merged] = -1
        seen[met_at[::-1]] = np.arange(len(edges))[::-1]  # the first edge of a cycle is written last
        met = np.flatnonzero((seen >= 0) & (merged == np.arange(len(merged))))
        own = text_of[met]
        begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(begins, len(met)))
        before = np.arange(len(met)) - 1
        before[begins] = begins + counts - 1
        at = edges[seen[met]]
        follow[at] = follow[at][before]
        one = np.arange(len(merged))
        one[met] = np.repeat(met[begins], counts)
        merged = one[merged]
    # Steps from each edge to the one that leads back.
    ahead, step = np.ones(n, np.int64), follow
    ahead[last], step[last] = 0, last
    for _ in rounds:
        ahead, step = ahead + ahead[step], step[step]
    out = np.empty(n, codes.dtype)
    out[last[text] - ahead] = codes
    return out


#: Letters of texts that are shuffled together; a longer text is taken alone.
WALKED = 1 << 18


@F.arrow_udf(StringType())
def dinuc_shuffle(seq: pa.Array, hash_: pa.Array) -> pa.Array:
    """Random sequence with the same letter pairs and the same first and last letter."""
    seeds, out = hash_.fill_null(0).to_numpy(zero_copy_only=False), []
    for rows, codes, sizes in letter_parts(seq, WALKED):
        whole, begin = _text(_pair_walks(codes, sizes, seeds[rows])), first_places(sizes)
        out += [whole[a:z] for a, z in zip(begin, begin + sizes, strict=True)]
    return pa.array(out, pa.string(), mask=seq.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(StringType())
def sorted_pairs(seq: pa.Array) -> pa.Array:
    """The letter pairs of each text in order, with commas between them."""
    out = []
    for _, codes, sizes in letter_parts(seq, WALKED):
        pairs = np.maximum(sizes - 1, 0)
        at = np.repeat(first_places(sizes), pairs) + places_within(pairs)
        letters, place = np.unique(codes, return_inverse=True)  # in order
        own = np.repeat(np.arange(len(sizes)), pairs)
        code = np.sort((own * len(letters) + place[at]) * len(letters) + place[at + 1]) if len(at) else at
        text = np.full((len(at), 3), ord(","), np.uint32)
        if len(at):
            text[:, 0], text[:, 1] = letters[code // len(letters) % len(letters)], letters[code % len(letters)]
        whole, begin = _text(text.ravel()), 3 * first_places(pairs)
        out += [whole[a : max(z - 1, a)] for a, z in zip(begin, begin + 3 * pairs, strict=True)]
    return pa.array(out, pa.string())


def repeat_window(seq: Column | str, hash_: Column, fraction: float = 0.25) -> Column:
    """Replace a random window by repeats of a random piece; the length is kept."""
    seq = _col(seq)
    n = F.length(seq)
    width = F.greatest(F.lit(1), F.floor(n * fraction)).cast("int")
    start = between(at(hash_, 1), 0, F.greatest(n - width, F.lit(0)))
    size = between(at(hash_, 2), 1, F.least(width, n))
    source = between(at(hash_, 3), 0, n - size)
    fill = F.left(F.repeat(piece(seq, source, size), F.ceil(width / size).cast("int")), width)
    body = F.concat(F.left(seq, start), fill, piece(seq, start + width, n - start - width))
    return F.when(n == 0, seq).otherwise(body)


def random_motif(hash_: Column, size: Column, max_size: int) -> Column:
    picked = [
        F.substring(F.lit(BASES), (F.pmod(at(hash_, 100 + i), F.lit(4)) + 1).cast("int"), F.lit(1))
        for i in range(max_size)
    ]
    return F.left(F.concat(*picked), size)


def tandem_window(
    seq: Column | str, hash_: Column, motif: tuple[int, int] = (3, 10), fraction: float = 0.25
) -> Column:
    """Replace a random window by a random motif repeated; the length is kept."""
    seq = _col(seq)
    n = F.length(seq)
    width = F.greatest(F.lit(1), F.floor(n * fraction)).cast("int")
    start = between(at(hash_, 1), 0, F.greatest(n - width, F.lit(0)))
    size = between(at(hash_, 2), motif[0], motif[1])
    text = random_motif(hash_, size, motif[1])
    fill = F.left(F.repeat(text, F.ceil(width / size).cast("int")), width)
    body = F.concat(F.left(seq, start), fill, piece(seq, start + width, n - start - width))
    return F.when(n == 0, seq).otherwise(body)


def n_stretch(
    seq: Column | str, hash_: Column, low: float = 0.3, high: float = 1.0,
    max_stretches: int = 3, point_share: float = 0.2,
) -> Column:
    """Replace an exact share of the letters by N: single points and disjoint stretches.

    Stretch lengths and the gaps between them are cuts of the two totals at hashed points. The
    points are the letters outside the stretches with the smallest hashes. Letters that are N
    already count towards neither.
    """
    seq = _col(seq)
    n = F.length(seq)
    level = F.lit(low) + unit(at(hash_, 1)) * (high - low)
    total = F.least(n, F.greatest(F.lit(1), F.bround(n * level, 0).cast("int")))
    points = F.least(total, F.bround(total * point_share, 0).cast("int"))
    stretch = total - points

    def hashed_cuts(offset: int, count: Column, top: Column) -> Column:
        drawn = F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda i: between(at(hash_, i + offset), 0, top),
        )
        return F.slice(F.array_sort(drawn), F.lit(1), count)

    count = between(at(hash_, 2), 1, F.greatest(F.lit(1), F.least(F.lit(max_stretches), stretch)))
    inner = hashed_cuts(20, count - 1, F.greatest(stretch - count, F.lit(0)))
    # Each stretch has one letter plus its part of the rest, so none is empty.
    bounds = F.concat(
        F.array(F.lit(0)), F.transform(inner, lambda c, i: c + i + 1), F.array(stretch)
    )
    gaps = hashed_cuts(40, count, n - stretch)

    @F.pandas_udf(StringType())
    def mask(texts: pd.Series, hashes: pd.Series, single: pd.Series, edges: pd.Series, starts: pd.Series) -> pd.Series:
        rows = zip(texts, hashes, single, edges, starts, strict=True)
        return pd.Series([t and _stretched(t, int(h), int(p), b, g) for t, h, p, b, g in rows], dtype=object)

    return mask(seq, hash_, points, bounds, gaps)


def _stretched(text: str, hash_: int, points: int, bounds: Sequence[int], gaps: Sequence[int]) -> str:
    """N in the stretches, and at the ``points`` other letters with the smallest hashes."""
    codes = _code_points(text).copy()
    for k, start in enumerate(gaps):
        codes[int(start + bounds[k]) : int(start + bounds[k + 1])] = ord("N")
    free = np.flatnonzero(codes != ord("N"))
    if 0 < points <= len(free):
        keys = _hashes(hash_, free + 1000).astype(np.int64) * (1 << 20) + free
        codes[free[keys <= np.partition(keys, points - 1)[points - 1]]] = ord("N")
    return _text(codes)


def _mutated(text: str | None, hash_: int, other: int, n: int, replace: bool) -> str | None:
    """The first ``n`` positions in the order of their hash, altered."""
    if text is None:
        return None
    codes = _code_points(text).copy()
    chosen = np.argsort(_hashes_at(hash_, len(codes)), kind="stable")[:n]
    if not replace:
        codes[chosen] = ord("N")
    else:
        bases = np.frombuffer(BASES.encode(), np.uint8).astype(np.uint32)
        place = np.full(128, -1)
        place[bases] = np.arange(4)
        old = place[np.minimum(codes[chosen], 127)]
        # One of the three that follow the base in a ring.
        new = (old + 1 + (_hashes_at(other, len(codes))[chosen] % np.uint64(3)).astype(np.int64)) % 4
        codes[chosen] = np.where(old < 0, ord("N"), bases[new])
    return _text(codes)


def mutation_series(
    df: DataFrame, low: float = 0.0, high: float = 1.0, step: float = 0.01,
    replace: bool = False, seed: int = 0, key: str = "seq_id", seq: str = "seq",
) -> DataFrame:
    """Copies of each sequence with more and more positions altered, level by level.

    Positions are ranked by a hash; level j alters the first j * int(length * step) of them,
    so every level contains the one before. ``replace`` puts one of the other three bases in
    place of N, by a hash of another seed; letters other than bases become N.
    """
    levels = int(np.floor((high - low) / step + 1e-9)) + 1

    @F.pandas_udf(StringType())
    def mutate(texts: pd.Series, hashes: pd.Series, others: pd.Series, counts: pd.Series) -> pd.Series:
        rows = zip(texts, hashes, others, counts, strict=True)
        return pd.Series([_mutated(t, int(h), int(o), int(n or 0), replace) for t, h, o, n in rows], dtype=object)

    length = F.coalesce(F.length(seq), F.lit(0))
    count = F.least(F.col("level") * F.floor(length * step).cast("int"), length)
    rows = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("n_altered", count)
    hashes = [row_hash(key, seed=seed), row_hash(key, seed=seed + 1)]
    return rows.withColumn(seq, mutate(F.col(seq), *hashes, F.col("n_altered"))).withColumn(
        "percent", F.round((F.lit(low) + F.col("level") * step) * 100, 2)
    )


def tandem_repeats(
    df: DataFrame, motif: tuple[int, int] = (3, 30), copies: int = 2000, max_len: int = 2048,
    seed: int = 0, key: str = "seq_id", seq: str = "seq",
) -> DataFrame:
    """One tandem repeat per sequence: a motif cut from its own bases, repeated and cut at ``max_len``.

    N is left out first; a sequence shorter than the motif is the motif, one without bases has no row.
    """
    bases = F.replace(F.upper(F.col(seq)), F.lit("N"), F.lit(""))
    rows = df.select(key, row_hash(key, seed=seed).alias("_h"), bases.alias("_bases")).where("_bases <> ''")
    size = F.least(between(at(F.col("_h"), 2), motif[0], motif[1]), F.length("_bases"))
    start = between(at(F.col("_h"), 3), 0, F.length("_bases") - F.col("_size"))
    times = F.least(F.lit(copies), F.ceil(F.lit(max_len) / F.col("_size")).cast("int"))
    return (
        rows.withColumn("_size", size)
        .withColumn("motif", piece("_bases", start, F.col("_size")))
        .withColumn("seq", F.left(F.repeat(F.col("motif"), times), F.lit(max_len)))
        .select(
            F.concat(F.lit("tandem_repeat_"), F.col(key).cast("string")).alias(key), "motif",
            "seq", F.lit(0).alias("label"),
        )
    )


def augment(
    seq: Column | str, hash_: Column, rate: float, shuffle: bool = False, letters_out: str = "ATGC"
) -> Column:
    """Replace each base with probability ``rate`` by a random letter (maybe the same one)."""
    choice = _code_points(letters_out)

    @F.arrow_udf(StringType())
    def change(texts: pa.Array, hashes: pa.Array) -> pa.Array:
        seeds = hashes.fill_null(0).to_numpy(zero_copy_only=False)
        out: list[str] = []
        for rows, codes, sizes in letter_parts(texts):
            own, place = np.repeat(seeds[rows], sizes), places_within(sizes)
            hit = np.flatnonzero(_hashes(own, place + 1) / float(SPACE) < rate)
            codes = codes.copy()
            codes[hit] = choice[_hashes(own[hit], place[hit] + (1 << 24)) % np.uint64(len(choice))]
            whole, begin = _text(codes), first_places(sizes)
            out += [whole[a:z] for a, z in zip(begin, begin + sizes, strict=True)]
        return pa.array(out, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    changed = change(_col(seq), hash_)
    return shuffle_bases(changed, at(hash_, 7)) if shuffle else changed


def shuffle_frames(frames: Column, hash_: Column) -> Column:
    return _by_hash(frames, hash_)


DEFAULT_KINDS = ("shuffle", "subseq_repeat", "tandem_repeat")
SHUFFLE_MODES = ("random", "dinuc", "kmer")


def perturbation_kinds(config: dict) -> list[dict]:
    """The enabled kinds with their options, in a fixed order."""
    out = []
    for kind in (*DEFAULT_KINDS, "n_stretch", "mix"):
        value = config.get(kind, kind in DEFAULT_KINDS)
        options = dict(value) if isinstance(value, dict) else {}
        enabled = options.pop("enabled", True) if isinstance(value, dict) else bool(value)
        if not enabled:
            continue
        modes = options.pop("mode", "random") if kind == "shuffle" else None
        for mode in [modes] if not isinstance(modes, (list, tuple)) else modes:
            if mode is not None and mode not in SHUFFLE_MODES:
                raise ValueError(f"unknown shuffle mode: {mode}")
            out.append({"kind": kind, "mode": mode, **options})
    return out


def perturbation_plan(n: int, multiplier: float, config: dict) -> list[dict]:
    """How many rows of each kind: an explicit ``count``, a ``multiplier`` of its own, or an
    equal part of the total, the remainder going to the first kinds."""
    kinds = perturbation_kinds(config)
    shared = [k for k in kinds if "count" not in k and "multiplier" not in k]
    total = int(n * multiplier)
    each, rest = divmod(total, len(shared)) if shared else (0, 0)
    plan = []
    for k in kinds:
        if "count" in k:
            count = int(k["count"])
        elif "multiplier" in k:
            count = int(n * k["multiplier"])
        else:
            count = each + (1 if rest > 0 else 0)
            rest -= 1
        plan.append({**k, "count": count})
    return plan


def apply_kind(kind: dict, seq: Column, hash_: Column) -> Column:
    name = kind["kind"]
    if name == "shuffle":
        if kind["mode"] == "dinuc":
            return dinuc_shuffle(seq, hash_)
        return (
            kmer_shuffle(seq, hash_, kind.get("k", 2))
            if kind["mode"] == "kmer"
            else shuffle_bases(seq, hash_)
        )
    if name == "subseq_repeat":
        return repeat_window(seq, hash_, kind.get("window_fraction", 0.25))
    if name == "tandem_repeat":
        return tandem_window(
            seq, hash_, tuple(kind.get("motif_length_range", (3, 10))),
            kind.get("window_fraction", 0.25),
        )
    if name == "n_stretch":
        low, high = kind.get("n_fraction_range", (0.3, 1.0))
        return n_stretch(
            seq, hash_, low, high, kind.get("max_stretches", 3), kind.get("point_n_share", 0.2)
        )
    raise ValueError(f"not a single-source kind: {name}")


def perturb(
    df: DataFrame, plan: Sequence[dict], seed: int = 0, key: str = "seq_id", seq: str = "seq",
    label: str = "label",
) -> DataFrame:
    """Rows of each kind, row i made from source i mod n (in key-hash order).

    A source gets one copy per multiple of n that falls to its rank, so nothing is joined by row
    number. A few sources with many copies each are dealt to tasks once per ``COPIES`` copies.
    """
    ranked = hash_rank(df, [], key, seed, "_rank")
    # Ranked once for all kinds.
    rows = cut(with_single(ranked, df.agg(F.count(F.lit(1)).alias("_n"))))
    n, parts = rows.count(), []
    for number, kind in enumerate(plan):
        if kind["count"] <= 0:
            continue
        if kind["kind"] == "mix":
            parts.append(
                chimera(df, kind.get("segments", 2), kind.get("output_length"), kind["count"],
                        seed + number, key, seq, label)
                .select(F.lit("mix").alias("kind"), F.col("chimera_id").alias("i"), "seq")
            )
            continue
        last = kind["count"] - 1
        mine = rows.where(F.col("_rank") <= last)
        first, end = F.col("_rank"), F.lit(last)
        if kind["count"] > COPIES * n:
            step = F.col("_n") * COPIES
            dealt = mine.withColumn("_first", F.explode(F.sequence(F.col("_rank"), end, step)))
            # A number given is kept as it is; these are few rows of much work.
            mine = dealt.repartition(min(-(-kind["count"] // (COPIES * 64)), 1 << 12), "_rank", "_first")
            first, end = F.col("_first"), F.least(end, F.col("_first") + step - 1)
        mine = mine.withColumn("i", F.explode(F.sequence(first, end, F.col("_n")))).withColumn(
            "_h", row_hash(key, "i", seed=seed + number)
        )
        parts.append(
            mine.select(
                F.lit(kind["kind"]).alias("kind"), "i",
                apply_kind(kind, F.col(seq), F.col("_h")).alias("seq"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("label", F.lit(0))


def chimera(
    df: DataFrame, segments: int, out_len: int | None, count: int, seed: int = 0,
    key: str = "seq_id", seq: str = "seq", label: str = "label",
) -> DataFrame:
    """Mixes of pieces of sequences from distinct classes: ``chimera_id, labels, seq``.

    Each mix picks its classes by hash and one row number within each; rows are numbered within
    their class, and the pick is an equal join on (class, number).
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    classes = sizes.agg(
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), F.col("_size").alias("n"))))
        .alias("_classes")
    )
    found = classes.select(F.size("_classes")).first()[0]
    if found < segments:
        raise ValueError(f"a mix of {segments} needs as many classes, found {found}")
    made = (
        df.sparkSession.range(count)
        .withColumnRenamed("id", "chimera_id")
        .withColumn("_h", row_hash("chimera_id", seed=seed))
    )
    picks = (
        with_single(made, classes)
        .withColumn("_order", F.slice(_by_hash(F.col("_classes"), F.col("_h")), 1, segments))
        .select("chimera_id", "_h", F.posexplode("_order").alias("part", "_class"))
        .select(
            "chimera_id", "_h", "part", F.col("_class.c").alias(label),
            F.pmod(at(F.col("_h"), F.col("part") + 50), F.col("_class.n")).alias("_rank"),
        )
    )
    numbered = hash_rank(df.select(key, label, seq), [label], key, seed, "_rank")
    sources = picks.join(numbered, [label, "_rank"])
    if out_len is None:
        cut = sources.withColumn("_piece", F.col(seq))
    else:
        # Cut points of the output, the same for all parts of a mix.
        drawn = F.transform(
            F.sequence(F.lit(1), F.lit(max(segments - 1, 1))),
            lambda i: between(at(F.col("_h"), i + 70), 0, out_len),
        )
        edges = F.concat(
            F.array(F.lit(0)), F.slice(F.array_sort(drawn), 1, segments - 1),
            F.array(F.lit(out_len)),
        )
        size = F.least(F.get(edges, F.col("part") + 1) - F.get(edges, "part"), F.length(seq))
        cut = (
            sources.withColumn("_size", size)
            .withColumn(
                "_from",
                between(at(F.col("_h"), F.col("part") + 90), 0, F.length(seq) - F.col("_size")),
            )
            .withColumn("_piece", piece(seq, F.col("_from"), F.col("_size")))
        )
    # One short list per mix: its segments.
    joined = cut.groupBy("chimera_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "_piece", F.col(label).alias("c"))))
        .alias("_parts")
    )
    text = F.array_join(F.transform("_parts", lambda p: p["_piece"]), "")
    if out_len is not None:
        text = F.left(F.rpad(text, out_len, "N"), F.lit(out_len))
    return joined.select(
        "chimera_id", F.transform("_parts", lambda p: p["c"]).alias("labels"), text.alias("seq")
    )


def filter_synthetic(
    df: DataFrame, scores: Column, threshold: float, label: str = "label"
) -> DataFrame:
    """Altered rows the scorer is still confident about, labelled 0."""
    return keep_confident(df, scores, threshold).withColumn(label, F.lit(0))
