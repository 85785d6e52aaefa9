"""The best documents for many queries at once, sharing the sums that queries have in common.

A document's score for an item is a sum over the item's terms of a weight by rarity times a saturated
count. Items of one benchmark share many terms, so their sums share many parts. ``shared_sums`` mines
term sets that several items hold: the largest common set of two items (or of sets found before)
becomes a node, and stands in every item and node that holds it all, until no two share more than one
symbol. The nodes form a directed acyclic graph. For each batch of documents every node is summed once,
as one row of an accumulator matrix (symbols by documents), and the items are summed from nodes.

1. One pass over the texts keeps each document's length and its counts of the items' terms; that table
   is written. Numbers of documents, of terms, and documents by term come from it.
2. One pass over that table sums the graph, and each task keeps its ``k`` best documents an item.
3. The tasks' best meet in two steps, so no task reads more than about the root of their number.

Scale: texts are never shuffled, and no (item, document) pair leaves a task unless it is among the
task's best. Items go in passes of about ``PASS_TERMS`` (item, term) rows, which bounds what is
collected and broadcast; inside a pass, in blocks of ``BLOCK_ITEMS`` items to a graph, which bounds the
accumulators together with ``CELLS``. A term in every document costs one row of a matrix.

Defined cases: null and empty texts have no terms; such documents count for nothing, such items find
nothing. Rows of one item_id (or without any) are one item with the terms of all of them. Every row of
documents is a document, also if doc_id repeats or is null; null ids come last among equal scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import words as W

PASS_TERMS = 1_000_000
BLOCK_ITEMS = 256
#: Numbers in an accumulator matrix, and best documents held before they are sorted out.
CELLS, HELD = 4 << 20, 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _pieces(words: W.Words) -> np.ndarray:
    """Eight bytes from every place of the words' data."""
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


class Vocabulary:
    """Terms by number, found by hash and confirmed by their bytes."""

    def __init__(self, terms: list[str]) -> None:
        self.words = W.split_words(pa.array(terms, pa.string()), W.ALNUM_LOWER)
        self.seed = 0
        while len(np.unique(h := W.word_hashes(self.words, self.seed))) < len(terms):
            self.seed += 1
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def find(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that are terms, and their terms' numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = W.word_hashes(words, self.seed)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        rows = np.flatnonzero(self.hashes[at] == h)
        terms = self.order[at[rows]]
        mine, theirs = words.end - words.start, self.words.end - self.words.start
        same = mine[rows] == theirs[terms]
        ours, known = _pieces(words), _pieces(self.words)
        keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        live, step = np.flatnonzero(same), 0
        while len(live):
            r, t = rows[live], terms[live]
            left = np.minimum(mine[r] - step, 8)
            equal = ((ours[words.start[r] + step] ^ known[self.words.start[t] + step]) & keep[left]) == 0
            same[live[~equal]] = False
            live = live[equal & (mine[r] - step > 8)]
            step += 8
        return rows[same], terms[same]


def shared_sums(sets: list[set[int]], n_terms: int) -> tuple[list[tuple[int, list[int]]], list[list[int]]]:
    """Nodes (symbol, parts) in an order to sum them in, and the parts of each set.

    Symbols below ``n_terms`` are terms. The parts of a node or set never overlap.
    """
    masks = [sum(1 << t for t in own) for own in sets]
    symbol = [-1] * len(masks)  # a node's symbol; sets have none
    queue = []
    for b in range(len(masks)):
        for a in range(b):
            n = (masks[a] & masks[b]).bit_count()
            if n > 1:
                queue.append((-n, a, b))
    heapq.heapify(queue)
    used = n_terms
    while queue:
        size, a, b = heapq.heappop(queue)
        common = masks[a] & masks[b]
        n = common.bit_count()
        if n < -size:  # others took symbols meanwhile; sizes only fall
            if n > 1:
                heapq.heappush(queue, (-n, a, b))
            continue
        node = next((x for x in (a, b) if symbol[x] >= 0 and masks[x] == common), None)
        if node is None:
            node = len(masks)
            masks.append(common)
            symbol.append(used)
            used += 1
        bit = 1 << symbol[node]
        for x in range(len(masks)):
            if x != node and masks[x] & common == common:
                masks[x] = masks[x] & ~common | bit
        if node == len(masks) - 1:
            for x in range(node):
                n = (masks[x] & common).bit_count()
                if n > 1:
                    heapq.heappush(queue, (-n, x, node))
    parts = [[t for t in _bits(mask)] for mask in masks]
    index = {s: x for x, s in enumerate(symbol) if s >= 0}
    order: list[int] = []
    seen: set[int] = set()
    for s in index:
        stack = [(s, False)]
        while stack:
            t, done = stack.pop()
            if done:
                order.append(t)
            elif t not in seen:
                seen.add(t)
                stack.append((t, True))
                stack += [(p, False) for p in parts[index[t]] if p >= n_terms and p not in seen]
    return [(s, parts[index[s]]) for s in order], parts[: len(sets)]


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


@dataclass
class Graph:
    """A block of items: the rows of its terms in the accumulators, its nodes and its items' parts."""

    first_item: int
    row_of: np.ndarray  # by term of the vocabulary, -1 outside the block
    n_rows: int
    nodes: list[tuple[int, np.ndarray]]
    items: list[np.ndarray]

    @classmethod
    def of(cls, first_item: int, sets: list[set[int]], n_vocabulary: int) -> Graph:
        terms = sorted(set().union(*sets))
        local = {t: i for i, t in enumerate(terms)}
        nodes, items = shared_sums([{local[t] for t in own} for own in sets], len(terms))
        row_of = np.full(n_vocabulary, -1, np.int64)
        row_of[terms] = np.arange(len(terms))
        return cls(first_item, row_of, len(terms) + len(nodes), [(s, np.array(p)) for s, p in nodes], [np.array(p, int) for p in items])

    def scores(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """The score of every item (row) and document (column) from values of (term, document)."""
        row = self.row_of[term]
        mine = row >= 0
        sums = np.zeros((self.n_rows, n_docs), np.int64)
        sums[row[mine], doc[mine]] = value[mine]
        for symbol, parts in self.nodes:
            sums[parts].sum(axis=0, out=sums[symbol])
        return np.array([sums[parts].sum(axis=0) for parts in self.items]).reshape(len(self.items), n_docs)


def _count_terms(vocabulary):
    names = ["doc_id", "n", "terms", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = vocabulary.value
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                words = W.split_words(part.column("text"), W.ALNUM_LOWER)
                place, term = known.find(words)
                text = np.searchsorted(words.first, place, "right") - 1
                pair, tf = np.unique(text * max(1, len(known.order)) + term, return_counts=True)
                text, term = np.divmod(pair, max(1, len(known.order)))
                n = words.counts()
                some = np.flatnonzero(n)  # those without terms hold no place in pair
                borders = pa.array(np.append(np.searchsorted(text, some), len(text)), pa.int32())
                lists = [pa.ListArray.from_arrays(borders, pa.array(x, pa.int32())) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(n[some]), *lists], names)

    return run


class _Best:
    """The best ``k`` documents of every item, exact: highest score, then smallest id."""

    def __init__(self, n_items: int, k: int, kind: pa.DataType) -> None:
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.kept = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)], ["item", "score", "doc_id"])
        self.new: list[pa.Table] = []
        self.n_new = 0

    def add(self, first: int, scores: np.ndarray, doc_ids: pa.Array) -> None:
        item, doc = np.nonzero(scores >= self.floor[first : first + len(scores), None])
        if len(item):
            columns = [pa.array(item + first), pa.array(scores[item, doc]), doc_ids.take(pa.array(doc))]
            self.new.append(pa.table(columns, ["item", "score", "doc_id"]))
            self.n_new += len(item)
            if self.n_new > HELD:
                self.settle()

    def settle(self) -> pa.Table:
        rows = pa.concat_tables([self.kept, *self.new])
        rows = rows.sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
        item = rows["item"].to_numpy()
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.kept, self.new, self.n_new = rows.filter(pa.array(rank < self.k)), [], 0
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[item[last]] = rows["score"].to_numpy()[last]
        return self.kept


def _sum_graphs(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, weight, graphs = shared.value
        best = None
        for batch in batches:
            best = best or _Best(len(item_ids), k, batch.column("doc_id").type)
            terms, tfs = batch.column("terms"), batch.column("tf")
            term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            m = batch.column("m").to_numpy(zero_copy_only=False)
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            for graph in graphs:
                step = max(1, CELLS // max(1, graph.n_rows))
                for i in range(0, batch.num_rows, step):
                    j = min(i + step, batch.num_rows)
                    own = slice(begin[i], begin[j])
                    scores = graph.scores(term[own], doc[own] - i, value[own], j - i)
                    best.add(graph.first_item, scores, batch.column("doc_id").slice(i, j - i))
        if best:
            rows = best.settle()
            yield from pa.table([item_ids.take(rows["item"]), rows["doc_id"], rows["score"]], ["item_id", "doc_id", "score"]).to_batches()

    return run


def _top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0, or all."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lowered = F.translate(F.col(item_text).cast("string"), _UPPER, _LOWER)
    asked = items.select(
        F.col(item_id).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0)))).alias("term")
    )
    asked = cut(asked.distinct())
    passes = max(1, -(-asked.count() // PASS_TERMS))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    item_type = asked.schema["item_id"].dataType.simpleString()
    result = None
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).orderBy("item_id", "term").toArrow()
        terms = sorted(set(mine["term"].to_pylist()))
        number = {t: i for i, t in enumerate(terms)}
        sets: dict[object, set[int]] = {}
        for item, term in zip(mine["item_id"].to_pylist(), mine["term"].to_pylist(), strict=True):
            sets.setdefault(item, set()).add(number[term])
        item_ids = pa.array(list(sets), mine.schema.field("item_id").type)
        vocabulary = spark.sparkContext.broadcast(Vocabulary(terms))
        counts = cut(texts.mapInArrow(_count_terms(vocabulary), f"doc_id {id_type}, n bigint, terms array<int>, tf array<int>"))
        total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row a term
        weight = np.zeros(len(terms), np.int64)
        for r in held:
            weight[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["count"] + 1)))
        every = list(sets.values())
        graphs = [Graph.of(b, every[b : b + BLOCK_ITEMS], len(terms)) for b in range(0, len(every), BLOCK_ITEMS)]
        shared = spark.sparkContext.broadcast((item_ids, weight, graphs))
        length = f"(cast(90 AS decimal(38, 0)) * n * {total['n']}) div {total['l'] or 1}"
        rows = counts.where("size(terms) > 0").select("doc_id", F.expr(f"10 + {length}").cast("bigint").alias("m"), "terms", "tf")
        found = rows.mapInArrow(_sum_graphs(shared, k), f"item_id {item_type}, doc_id {id_type}, score bigint")
        tasks = rows.rdd.getNumPartitions()
        found = found.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(math.isqrt(max(1, tasks)))))
        found = _top(_top(found, ["item_id", "share"], k), ["item_id"], k).select("item_id", "rank", "doc_id", "score")
        result = found if result is None else result.unionAll(found)
    return result
