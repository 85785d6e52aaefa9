"""Groups of near-duplicate documents by min-max hashing.

A document is the set of its 5-word shingles (lower-cased A-Z). Under each permutation of the hash
values both the smallest and the largest member are kept, so 64 permutations give 128 signature
values. Four values (the minima and maxima of two permutations) make a band; documents that share
a band are compared on their full sets, and linked at a Jaccard similarity of ``percent`` or more.
At similarity 0.8 a pair shares none of the 32 bands with probability 5e-8.

No link is lost inside a band however many documents it holds. Equal sets are collapsed first.
All documents of a band are compared with its smallest document, so rows grow with the band's
size, and components are formed. Where the rest of a band still has several components, its
documents go through an exact prefix join: sets that reach the similarity have a shingle in common
among the few rarest of both, how few following from their sizes. Rarity is a count in a table of
fixed size; any order gives the same links. Pairs inside a component are not formed,
and of each shingle only documents outside its largest component are paired with the others.

Before two full sets are fetched, four bits of every signature value are compared; a pair is left
out if they differ more than a pair of the wanted similarity does at six standard deviations.

Defined cases: documents without words (null or empty texts) have an empty set and are linked with
nothing. Fewer words than a shingle make one shingle of their own kind. Rows without doc_id keep
their set size, have no component and are kept. Rows that repeat a doc_id are one document with
several sets: it is linked with every document that is similar enough to any of them. Ids must be
whole numbers (or text of them); another text is an error under ANSI rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..operators.ranks import totals_before
from . import words as W
from .components import components

PERMUTATIONS = 64
COUNTERS = 1 << 20
_SPREAD = np.random.default_rng(20).integers(1, 1 << 63, (PERMUTATIONS, 2), dtype=np.uint64)
_SHORT, _TWIN = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, one text after the other, and where
    each text's begin."""
    words = W.split_words(texts, W.PLAIN_LOWER)
    hashes = W.word_hashes(words)
    start, text = W.window_starts(words, size)
    shingles = W.window_hashes(hashes, size)[start] if len(start) else np.zeros(0, np.uint64)
    counts = words.counts()
    for n in range(1, size):  # a text of n words is one sequence
        short = np.flatnonzero(counts == n)
        if len(short):
            whole = W.window_hashes(hashes, n)[words.first[short]]
            shingles = np.concatenate([shingles, W.mixed(whole ^ (_SHORT + np.uint64(n)))])
            text = np.concatenate([text, short])
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(counts) + 1))


def signatures(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (two columns), band hashes and sketches (four bits a signature value, sixteen
    values a number) of the sets; rows of empty sets are zero."""
    n = len(first) - 1
    sketch = np.zeros((n, PERMUTATIONS // 8), np.uint64)
    full = np.flatnonzero(np.diff(first))
    prints = np.zeros((n, 2), np.uint64)
    bands = np.zeros((n, PERMUTATIONS // 2), np.uint64)
    if not len(full):
        return prints, bands, sketch
    at = first[full]
    for k, values in enumerate((W.mixed(shingles), W.mixed(shingles ^ _TWIN))):
        prints[full, k] = np.add.reduceat(values, at)
    for k, (mask, factor) in enumerate(_SPREAD):
        values = (shingles ^ mask) * (factor | np.uint64(1))
        low, high = W.mixed(np.minimum.reduceat(values, at)), W.mixed(np.maximum.reduceat(values, at) ^ _TWIN)
        pair = low + np.uint64(3) * high
        sketch[full, k // 8] |= (low & np.uint64(15) | (high & np.uint64(15)) << np.uint64(4)) << np.uint64(k % 8 * 8)
        bands[full, k // 2] = W.mixed(bands[full, k // 2] * np.uint64(5) ^ pair)
    bands[full] = W.mixed(bands[full] ^ np.arange(bands.shape[1], dtype=np.uint64))
    return prints, bands, sketch


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _equal_lists(rows: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(_signed(rows.ravel())))


def document_signatures(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n, print1, print2, bands, sketch`` for each row of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column(1)):
                shingles, first = shingle_sets(batch.column(1)[i:j], size)
                prints, bands, sketch = signatures(shingles, first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], pa.array(np.diff(first), pa.int64()),
                        pa.array(_signed(prints[:, 0])), pa.array(_signed(prints[:, 1])),
                        *(_equal_lists(x) for x in (bands, sketch)),
                    ],
                    ["doc_id", "n", "print1", "print2", "bands", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, print1 bigint, print2 bigint, bands array<bigint>, sketch array<bigint>")


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, members`` (ascending shingle hashes) for each row of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column(1)):
                shingles, first = shingle_sets(batch.column(1)[i:j], size)
                members = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(_signed(shingles)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], members], ["doc_id", "members"])

    return docs.mapInArrow(run, "doc_id bigint, members array<bigint>")


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """Whether two sketches differ in no more values than a linked pair's can."""
    values = 2 * PERMUTATIONS
    equal = percent / 100 + (1 - percent / 100) / 16
    # The two values of a permutation may depend on each other, so half as many count as drawn.
    most = math.ceil(values * (1 - equal) + 6 * math.sqrt(2 * values * equal * (1 - equal)))
    different = F.lit(0)
    for k in range(PERMUTATIONS // 8):
        d = F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        different = different + F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    return different <= most


def likely_pairs(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` that sizes and sketches do not rule out. Joins are by sorting at
    every size, so plans and disk grow evenly."""
    sides = [
        signed.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge") for c in "ab"
    ]
    near = pairs.join(sides[0], "a").join(sides[1], "b")
    size = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return near.where(size & _may_link(F.col("sketch_a"), F.col("sketch_b"), percent)).select("a", "b")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets are similar enough."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")).hint("merge")
    two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")).hint("merge")
    common = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(one, "a").join(two, "b")
        .where(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
        .select("a", "b")
    )


def prefix_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Every pair ``a, b`` of different components that shares one of the rarest shingles of both.

    ``sets`` has ``doc_id, members``; no pair that reaches the similarity is left out.
    """
    parts = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            members = batch.column("members").flatten().to_numpy().view(np.uint64)
            held += np.bincount((W.mixed(members) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        blobs = [zstandard.compress(x.tobytes()) for x in np.split(held, parts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "held"])

    def total(table: pa.Table) -> pa.Table:
        held = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in table.column("held").to_pylist())
        return pa.table({"part": table.column("part")[:1], "held": pa.array([zstandard.compress(held.tobytes())], pa.binary())})

    kind = "part int, held binary"
    rows = sorted((r["part"], r["held"]) for r in sets.mapInArrow(count, kind).groupBy("part").applyInArrow(total, kind).collect())
    counters = np.concatenate([np.frombuffer(zstandard.decompress(x), np.int64) for _, x in rows]) if rows else np.zeros(COUNTERS, np.int64)
    shared = sets.sparkSession.sparkContext.broadcast(counters)  # COUNTERS numbers at every size

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, heads, sizes, places = [], [], [], []
            for doc, members in zip(batch.column("doc_id").to_pylist(), batch.column("members"), strict=True):
                own = members.values.to_numpy().view(np.uint64)
                keep = len(own) - -(-len(own) * percent // 100) + 1
                rarity = shared.value[(W.mixed(own) % np.uint64(COUNTERS)).astype(np.int64)]
                heads.append(own[np.lexsort((own, rarity))[:keep]])
                docs.append(np.full(len(heads[-1]), doc, np.int64))
                sizes.append(np.full(len(heads[-1]), len(own), np.int32))
                places.append(np.arange(len(heads[-1]), dtype=np.int32))
            if docs:
                columns = [np.concatenate(docs), _signed(np.concatenate(heads)), np.concatenate(sizes), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "shingle", "n", "place"])

    tokens = cut(_grouped(sets.mapInArrow(prefixes, "doc_id bigint, shingle bigint, n int, place int"), groups, "doc_id", "component"))
    mixed = tokens.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(
        F.max(F.struct("n", F.col("component").alias("main"))).alias("big"), F.count("*").alias("components")
    )
    mixed = cut(mixed.where("components > 1").select("shingle", "big.main"))
    open_ = cut(tokens.join(mixed, "shingle"))
    outside = open_.where("component <> main").select(
        "shingle", F.col("doc_id").alias("p"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("place").alias("at")
    )
    # Sets of n and m shingles must share `need`, so a common one is among the first n - need + 1 of
    # the one and the first m - need + 1 of the other, with enough to follow in both.
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    follow = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("at")) + F.least("place", "at")
    fits = (F.col("component") != F.col("c")) & (F.col("place") <= F.col("n") - need) & (F.col("at") <= F.col("m") - need) & (follow >= need)
    both = F.struct(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b"))
    inside = open_.drop("main")
    return outside.join(inside, (outside["shingle"] == inside["shingle"]) & fits).select(both.alias("pair")).distinct().select("pair.a", "pair.b")


def _grouped(rows: DataFrame, groups: DataFrame, node: str, name: str) -> DataFrame:
    """With the component of column ``node``; nodes without a link are their own."""
    found = groups.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(found, node, "left").withColumn(name, F.coalesce(name, node))


def _same_id(known: DataFrame, classes: DataFrame, prints: list[str]) -> DataFrame:
    """Links ``a, b`` of an id that stands for several sets with the representatives of all of them."""
    held = known.groupBy("doc_id").agg(F.min(F.struct(*prints)).alias("x"), F.max(F.struct(*prints)).alias("y"))
    several = held.where("x <> y").select("doc_id")
    reps = known.select("doc_id", *prints).join(several.hint("merge"), "doc_id", "left_semi").join(classes, prints)
    return reps.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each document.

    ``component_id`` is the smallest doc_id reachable over links of ``percent`` / 100 or more.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = cut(document_signatures(docs, size))
    known = signed.where("n > 0 AND doc_id IS NOT NULL")
    prints = ["n", "print1", "print2"]
    classes = cut(known.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # One row for each band of each distinct set.
    bands = cut(
        known.join(classes.select(F.col("rep").alias("doc_id"), *prints), ["doc_id", *prints])
        .select("doc_id", F.explode("bands").alias("band"))
        .distinct()
    )
    centres = cut(bands.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("held")).where("held > 1"))
    members = cut(bands.join(centres.select("band", "centre"), "band").where("doc_id <> centre"))
    star = cut(members.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct())
    wanted = star.select("a").unionAll(star.select("b")).distinct().select(F.col("a").alias("doc_id"))
    sets = document_sets(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), size)
    sets = cut(sets.withColumn("hash", F.xxhash64("members")).dropDuplicates(["doc_id", "hash"]).drop("hash"))
    sketches = known.select("doc_id", "n", "sketch")
    links = cut(linked_pairs(likely_pairs(star, sketches, percent), sets, percent).unionAll(_same_id(known, classes, prints)))
    groups = cut(components(links))
    own = cut(_grouped(members.select("band", "doc_id"), groups, "doc_id", "component"))
    open_ = cut(own.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("band"))
    rest = cut(own.join(open_, "band").select("doc_id").distinct())
    if not rest.isEmpty():
        left = cut(prefix_pairs(sets.join(rest, "doc_id", "left_semi"), groups, percent))
        links = cut(links.unionAll(linked_pairs(likely_pairs(left, sketches, percent), sets, percent)))
        groups = cut(components(links))
    return (
        signed.join(classes.where("copies > 1").select(*prints, "rep"), prints, "left")
        .withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
        .join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id")
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that are left when one of each group stays: that with the
    smallest doc_id.

    Rows that repeat doc_id and text are one row. Where ids repeat with other texts, or are missing
    (they come last), rows are numbered in the order of their ids first, so that each is compared.
    """
    ids = docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("n"))
    if ids.where("doc_id IS NULL OR n > 1").isEmpty():
        gone = near_duplicates(docs, size, percent, doc_id, text).where("NOT kept").select(F.col("doc_id").alias(doc_id)).distinct()
        return docs.join(gone.hint("merge"), doc_id, "left_anti").select(*docs.columns)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    place = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("bigint").alias("id"), F.sha2(body, 256).alias("print"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), place.alias("place")).dropDuplicates(["place"])
    rows = cut(rows)
    numbers = totals_before(rows.select("place", F.lit(1).alias("one")), [], "place", ["one"])
    rows = cut(rows.join(numbers.select("place", F.col("one_before").cast("bigint").alias("number")).hint("merge"), "place"))
    named = rows.select("number", F.col(f"row.`{text}`").alias("text"))
    gone = near_duplicates(named, size, percent, "number", "text").where("NOT kept").select(F.col("doc_id").alias("number"))
    return rows.join(gone.hint("merge"), "number", "left_anti").select("row.*")
