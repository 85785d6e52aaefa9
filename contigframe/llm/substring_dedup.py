"""Removal of word passages that already occurred: Rabin-Karp hashes of every window of words.

Every window of ``size`` consecutive words of a text gets a rolling hash. Windows are gathered in
buckets by a second, independent hash; equal hashes in a bucket are occurrences of one word
sequence (64 bits compared among the windows of one bucket, so the bits grow with the number of
buckets). All occurrences but the first by (doc_id, start) are removed, merged into maximal
intervals.

Scale: a task finds the first occurrence of each hash in blocks of its own texts before anything is
shuffled, so a passage in a third of all texts reaches its bucket once a block, not once a text.
The windows of a block go to a bucket as one packed row, and the repeats found there go packed to
the bucket of their document. Buckets are counted from the bytes of text.

Defined cases: null and empty texts have no words. Rows without doc_id have no place in the order:
they are kept whole and make nothing else a repeat. Rows that repeat a doc_id are the same
document, whose windows at one start are one occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .sizes import bucket_count

BLOCK_WINDOWS = 1 << 20
BUCKET_BYTES = 12 << 20
_OTHER = np.uint64(0xA0761D6478BD642F)


def _packed(doc: np.ndarray, pos: np.ndarray) -> bytes:
    """Document numbers and positions in their order, as compressed differences."""
    parts = np.diff(doc, prepend=0).tobytes() + np.diff(pos, prepend=0).astype(np.int32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(parts)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.int64, n)), np.cumsum(np.frombuffer(raw, np.int32, n, 8 * n), dtype=np.int64)


def _later(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Marks windows whose key also occurs at a smaller (doc, pos); inputs in any order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    if other is not None:
        same &= other[order[1:]] == other[order[:-1]]
    later = np.zeros(len(key), bool)
    if not same.any():
        return later
    # Only windows that share their key with a neighbour are looked at further.
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    rows = order[shared]
    group = np.cumsum(~np.concatenate([[False], same])[shared])
    fine = np.lexsort((pos[rows], doc[rows], group))
    rows, group = rows[fine], group[fine]
    head = np.concatenate([[True], group[1:] != group[:-1]])
    first = rows[np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))]
    later[rows] = (doc[rows] != doc[first]) | (pos[rows] != pos[first])
    return later


def _dealt(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that gets rows, and the rows it gets in their order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(heads, np.append(heads, len(bucket))[1:], strict=True):
        yield int(bucket[i]), order[i:j]


def _windows(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed first occurrences for each bucket, and the repeats found inside each block."""

    def block(parts: list[tuple]) -> pa.RecordBatch:
        key, other, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((pos, doc)) if np.any(np.diff(doc) < 0) else slice(None)
        key, other, doc, pos = key[by], other[by], doc[by], pos[by]
        later = _later(key, doc, pos, other)
        rows: list[tuple] = []
        if later.any():
            rows.append((int(other[0] % np.uint64(buckets)), None, _packed(doc[later], pos[later])))
        kept = np.flatnonzero(~later)
        for bucket, at in _dealt(other[kept], buckets):
            at = kept[at]
            rows.append((bucket, key[at].tobytes(), _packed(doc[at], pos[at])))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
            ["bucket", "keys", "places"],
        )

    parts, held = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in W.slices(batch.column(1)):
            words = W.split_words(batch.column(1)[i:j], W.PLAIN)
            start, text = W.window_starts(words, size)
            if not len(start):
                continue
            hashes = W.word_hashes(words)
            key = W.window_hashes(hashes, size)[start]
            other = W.window_hashes(W.mixed(hashes ^ _OTHER), size)[start]
            parts.append((key, other, ids[i:j][text], start - words.first[text]))
            held += len(start)
            if held >= BLOCK_WINDOWS:
                yield block(parts)
                parts, held = [], 0
    if parts:
        yield block(parts)


def _spans(doc: np.ndarray, pos: np.ndarray, size: int) -> pa.Table:
    """Removed windows as merged word intervals, one row for each document."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    new_doc = np.diff(doc, prepend=doc[:1] - 1) != 0 if len(doc) else np.zeros(0, bool)
    head = np.flatnonzero(new_doc | (np.diff(pos, prepend=0) > size))
    tail = np.concatenate([head[1:], [len(doc)]])[: len(head)] - 1
    first = np.flatnonzero(np.diff(doc[head], prepend=doc[head][:1] - 1)) if len(head) else head
    offsets = pa.array(np.concatenate([first, [len(head)]]), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (pos[head], pos[tail] + size)]
    return pa.table([pa.array(doc[head][first], pa.int64()), *lists], ["doc_id", "starts", "ends"])


def repeated_spans(docs: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Maximal word intervals ``[start, end)`` to remove: ``doc_id, starts, ends``.

    Documents without a repeat have no row.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    buckets = bucket_count(docs, BUCKET_BYTES)

    def compare(table: pa.Table) -> pa.Table:
        keys, places, removed = [], [], []
        for key, place in zip(table.column("keys").to_pylist(), table.column("places").to_pylist(), strict=True):
            if key is None:
                removed.append(_unpacked(place))
            else:
                keys.append(np.frombuffer(key, np.uint64))
                places.append(_unpacked(place))
        if keys:
            doc, pos = (np.concatenate(x) for x in zip(*places, strict=True))
            later = _later(np.concatenate(keys), doc, pos)
            removed.append((doc[later], pos[later]))
        doc, pos = (np.concatenate(x) for x in zip(*removed, strict=True))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        rows = [(to, _packed(doc[at], pos[at])) for to, at in _dealt(W.mixed(doc.astype(np.uint64)), buckets)]
        return pa.table([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["home", "places"])

    def merge(table: pa.Table) -> pa.Table:
        doc, pos = (np.concatenate(x) for x in zip(*map(_unpacked, table.column("places").to_pylist()), strict=True))
        return _spans(doc, pos, size)

    return (
        docs.where("doc_id IS NOT NULL")
        .mapInArrow(lambda it: _windows(it, size, buckets), "bucket int, keys binary, places binary")
        .groupBy("bucket")
        .applyInArrow(compare, "home int, places binary")
        .groupBy("home")
        .applyInArrow(merge, "doc_id bigint, starts array<int>, ends array<int>")
    )


def remove_repeats(docs: DataFrame, size: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document without its repeated passages: ``doc_id, text, n_words, n_removed``.

    ``text`` holds the kept words, joined by one space ("" if none is left or the text is null).
    """
    spans = repeated_spans(docs, size, doc_id, text)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n_words, n_removed = [], [], []
            starts, ends = batch.column("starts"), batch.column("ends")
            for k, value in enumerate(batch.column("text")):
                found = (value.as_py() or "").encode().split()  # bytes: only ASCII white space splits
                total = len(found)
                if starts[k].is_valid:
                    change = np.zeros(total + 1, np.int64)
                    np.add.at(change, starts[k].values.to_numpy(), 1)
                    np.add.at(change, ends[k].values.to_numpy(), -1)
                    found = [found[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out.append(b" ".join(found).decode())
                n_words.append(total)
                n_removed.append(total - len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"],
            )

    return texts.join(spans, "doc_id", "left").mapInArrow(
        kept, "doc_id bigint, text string, n_words bigint, n_removed bigint"
    )
