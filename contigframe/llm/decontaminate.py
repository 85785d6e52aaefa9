"""Documents that hold passages of a benchmark: Wu-Manber search for many word patterns at once.

A pattern is ``size`` consecutive words of an item, or all words of a shorter one. For each pattern
length m there is a shift table over blocks of two words (one word for m = 1): the block that ends
a window tells how far the window may move without missing a pattern. Where the shift is zero, the
bucket of that block lists the patterns it ends; their first word, all their words' hashes, and at
last their bytes are compared.

Texts are cut into overlapping stretches, and the windows of all stretches of a slice move together
as one array. Patterns go to the tasks in blocks of at most ``PATTERNS`` each, one pass over the
texts a block, so what is broadcast is bounded however large the benchmark is.

Defined cases: null and empty texts have no words; items without item_id or words have no pattern;
an empty benchmark hits nothing. A document is its (doc_id, text): rows that repeat both are one,
rows without doc_id are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

PATTERNS = 100_000
STRETCH = 64
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _block(hashes: np.ndarray, last: np.ndarray, width: int, mask: int) -> np.ndarray:
    """Table index of the block of ``width`` words that ends at word ``last``."""
    h = hashes[last]
    if width == 2:
        h = W.mixed(hashes[last - 1] * _PAIR ^ h)
    return (h & np.uint64(mask)).astype(np.int64)


@dataclass
class Patterns:
    """Patterns of one length, with their shift table and suffix buckets."""

    length: int
    hashes: np.ndarray  # one row a pattern, in bucket order
    texts: list[bytes]
    items: list[list[str]]
    shift: np.ndarray
    bucket: np.ndarray  # patterns of table index k: bucket[k] to bucket[k + 1]

    @property
    def width(self) -> int:
        return min(2, self.length)

    @classmethod
    def of(cls, length: int, texts: list[bytes], items: list[list[str]]) -> Patterns:
        words = W.split_words(pa.array([t.decode() for t in texts]), W.ALNUM_LOWER)
        flat, width = W.word_hashes(words), min(2, length)
        bits = max(12, (8 * len(flat)).bit_length())
        mask = (1 << bits) - 1
        starts = words.first[:-1]
        shift = np.full(1 << bits, length - width + 1, np.int32)
        for last in range(width - 1, length):
            np.minimum.at(shift, _block(flat, starts + last, width, mask), length - 1 - last)
        suffix = _block(flat, starts + length - 1, width, mask)
        order = np.argsort(suffix, kind="stable")
        bucket = np.searchsorted(suffix[order], np.arange((1 << bits) + 1)).astype(np.int32)
        rows = flat[starts[order][:, None] + np.arange(length)]
        return cls(length, rows, [texts[i] for i in order], [items[i] for i in order], shift, bucket)

    def search(self, words: W.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word index and pattern of every occurrence within a text."""
        m, mask = self.length, len(self.shift) - 1
        n = np.maximum(words.counts() - m + 1, 0)
        pieces = -(-n // STRETCH)
        text = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(text)) - (np.cumsum(pieces) - pieces)[text]
        at = words.first[text] + nth * STRETCH
        limit = np.minimum(at + STRETCH, words.first[text] + n[text])
        places, buckets = [], []
        while len(at):
            index = _block(hashes, at + m - 1, self.width, mask)
            step = self.shift[index]
            stop = step == 0
            places.append(at[stop])
            buckets.append(index[stop])
            at = at + np.maximum(step, 1)
            go = at < limit
            at, limit = at[go], limit[go]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, index = np.concatenate(places), np.concatenate(buckets)
        size = self.bucket[index + 1] - self.bucket[index]
        place, first = np.repeat(place, size), np.repeat(self.bucket[index], size)
        pattern = first + np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size)
        same = hashes[place] == self.hashes[pattern, 0]
        place, pattern = place[same], pattern[same]
        same = (hashes[place[:, None] + np.arange(m)] == self.hashes[pattern]).all(axis=1)
        place, pattern = place[same], pattern[same]
        equal = np.fromiter(
            (_text(words, i, m) == self.texts[p] for i, p in zip(place.tolist(), pattern.tolist(), strict=True)), bool, len(place)
        )
        return place[equal], pattern[equal]


def _text(words: W.Words, first: int, n: int) -> bytes:
    return b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[first : first + n], words.end[first : first + n], strict=True))


def item_patterns(items: DataFrame, size: int) -> DataFrame:
    """``pattern, n, items``: each distinct word window of the items and the sorted ids of its items."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            words = W.split_words(batch.column(1), W.ALNUM_LOWER)
            for t, n in enumerate(words.counts().tolist()):
                m = min(n, size)
                rows += [(ids[t], _text(words, int(words.first[t]) + i, m).decode(), m) for i in range(n - m + 1) if m]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32())], ["item", "pattern", "n"])

    return (
        items.where("item IS NOT NULL")
        .mapInArrow(windows, "item string, pattern string, n int")
        .groupBy("pattern", "n")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def _tables(items: DataFrame, size: int, item_id: str, item_text: str) -> Iterator[list[Patterns]]:
    """The search tables of each block of patterns; one empty block without any."""
    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    wanted = item_patterns(named, size)
    blocks = max(1, -(-wanted.count() // PATTERNS))
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()  # about PATTERNS rows
        lengths: dict[int, list] = {}
        for r in block:
            lengths.setdefault(r["n"], []).append(r)
        yield [Patterns.of(n, [r["pattern"].encode() for r in own], [r["items"] for r in own]) for n, own in sorted(lengths.items())]


def find_passages(
    docs: DataFrame, items: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, text_hash, n_words, hits, items`` for each document.

    ``hits`` are the distinct word numbers (from 0) inside occurrences, ``items`` the sorted
    distinct ids of the items with an occurrence. ``text_hash`` is ``xxhash64(text)``.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash bigint, n_words bigint, hits array<int>, items array<string>"
    rows = None
    for tables in _tables(items, size, item_id, item_text):
        found = texts.mapInArrow(_searcher(spark.sparkContext.broadcast(tables), everything=rows is None), schema)
        rows = found if rows is None else rows.unionAll(found)
    return rows.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def _searcher(tables, everything: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                part = batch.slice(i, j - i)
                words = W.split_words(part.column("text"), W.ALNUM_LOWER)
                hashes = W.word_hashes(words)
                hits: list = [None] * (j - i)
                items: list = [None] * (j - i)
                for table in tables.value:
                    place, pattern = table.search(words, hashes)
                    text = np.searchsorted(words.first, place, "right") - 1
                    order = np.argsort(text, kind="stable")
                    place, pattern, text = place[order], pattern[order], text[order]
                    heads = np.flatnonzero(np.diff(text, prepend=-1))
                    for a, b in zip(heads, np.append(heads, len(text))[1:], strict=True):
                        t = int(text[a])
                        inside = (place[a:b, None] + np.arange(table.length)).ravel() - words.first[t]
                        hits[t] = np.unique(inside if hits[t] is None else np.concatenate([hits[t], inside]))
                        items[t] = (items[t] or set()).union(*(table.items[p] for p in np.unique(pattern[a:b])))
                rows = np.arange(j - i) if everything else np.array([t for t in range(j - i) if hits[t] is not None], int)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(rows)),
                        part.column("text_hash").take(pa.array(rows)),
                        pa.array(words.counts()[rows], pa.int64()),
                        pa.array([[] if hits[t] is None else hits[t] for t in rows], pa.list_(pa.int32())),
                        pa.array([list(items[t] or ()) for t in rows], pa.list_(pa.string())),
                    ],
                    ["doc_id", "text_hash", "n_words", "hits", "items"],
                )

    return search


def drop_contaminated(
    docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows, with all their columns, without an occurrence of any pattern."""
    at = docs.columns.index(text)

    def without(tables):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j in W.slices(batch.column(at)):
                    part = batch.slice(i, j - i)
                    words = W.split_words(part.column(at), W.ALNUM_LOWER)
                    hashes = W.word_hashes(words)
                    clean = np.ones(j - i, bool)
                    for table in tables.value:
                        place, _ = table.search(words, hashes)
                        clean[np.searchsorted(words.first, place, "right") - 1] = False
                    yield part.filter(pa.array(clean))

        return run

    for tables in _tables(items, size, item_id, item_text):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(tables)), docs.schema)
    return docs
