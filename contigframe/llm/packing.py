"""Documents packed into training sequences of fixed length, each beside documents with like words.

Rows are taken in runs of about ``shard_bytes`` of text, as the partitions of the table give them. Each
run is one shard with an inverted index of its own: the documents of every word, weighted by BM25. A
seed document queries the index with its words; its unused neighbours fill its window best first, as
far as they fit whole, and the best of the others is cut to fill the rest. What is left of a cut
document is the next seed. Documents longer than a window give whole windows first. Whatever does not
fill a window goes on to the next shard; at the end of a partition it is cut into sequences whose
lengths are powers of two, so nothing is ever padded.

Scale: no shuffle, no collect. A task holds one shard and a cache of word ids (``WORDS_KEPT`` words at
most), so memory does not grow with the table, a source or a group of copies. A repeated task reads the
same rows and packs them alike; other partitions give another packing of the same ids.

Token ids are those of the given tokenizer file. A pre-token never holds white space, so words between
white space are encoded on their own; a distinct word once for each cache. Words of A-Z and a-z alone
are lower-cased first and lose a run of stops at their end, which is encoded by itself: the tokenizer's
file must lower-case and part letters from stops (``Encoder`` checks it).

Defined cases: a null or empty text has the end id alone. Rows without doc_id or repeating one are
packed like any other. A text of any length is packed whole. An empty table has no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SHARD_BYTES = 2 << 20
#: Words whose ids a task keeps at a time.
WORDS_KEPT = 1 << 20
#: Words given to the tokenizer in one call.
CALL = 256
#: Stops at the end of a word of letters that are encoded apart from it; with more it stays whole.
STOPS = 4
K1, B = 1.2, 0.75

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(W.SPACES)] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all ranges ``first[i]`` to ``first[i] + size[i]``, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Units:
    """The words of texts, parted further where the tokenizer parts them for certain.

    ``code[k]`` numbers the distinct unit k stands for, ``names`` their bytes; the units of text t are
    ``first[t]`` to ``first[t + 1]``.
    """

    def __init__(self, texts: pa.Array) -> None:
        words = W.split_words(texts, W.PLAIN)
        size = words.end - words.start
        raw = W.text_buffers(texts)[0]
        flat = raw[~_SPACE[raw]]
        end = np.cumsum(size)
        start = end - size
        body = end.copy()
        for _ in range(STOPS):
            body -= (body > start) & _STOP[flat[body - 1]]
        letters = np.concatenate([[0], np.cumsum(_LETTER[flat], dtype=np.int64)])
        plain = (letters[body] - letters[start] == body - start) & (body > start)
        flat = np.where(np.repeat(plain, size) & _LETTER[flat], flat | 32, flat)
        two = plain & (body < end)
        n = 1 + two
        place = np.cumsum(n) - n
        borders = np.empty(n.sum() + 1, np.int64)
        borders[0] = 0
        borders[place + 1] = np.where(plain, body, end)
        borders[place[two] + 2] = end[two]
        self.first = np.concatenate([[0], np.cumsum(n)])[words.first]
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(flat)])
        coded = column.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at, data = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist(), coded.dictionary.buffers()[2]
        data = data.to_pybytes() if data is not None else b""
        self.names: list[bytes] = [data[a:b] for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """Token ids of units, encoded once for as long as the cache keeps them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        for whole, parts in (("Ab.,", ["ab", ".,"]), ("AB cd\nEf", ["ab", "cd", "ef"])):
            if self._ids(whole) != [i for part in parts for i in self._ids(part)]:
                raise ValueError("the tokenizer does not part lower-cased words as assumed")
        alphabet = "abcdefghijklmnopqrstuvwxyz"
        for k in range(26):
            word = alphabet[k:] + alphabet[:k]
            if self._ids(word) != [token.id for token in self.tokenizer.model.tokenize(word)]:
                raise ValueError("the tokenizer changes lower-case letters before its model")
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _add(self, names: list[bytes]) -> None:
        # Letters pass the tokenizer's first steps as they are; its model alone is quicker.
        letters = [name for name in names if name.isalpha()]
        others = [name for name in names if not name.isalpha()]
        tokenize = self.tokenizer.model.tokenize
        coded = [[token.id for token in tokenize(name.decode())] for name in letters]
        sizes = [np.fromiter(map(len, coded), np.int64, len(coded))]
        ids = [self.pool, np.fromiter((i for own in coded for i in own), np.int32, int(sizes[0].sum()))]
        for k in range(0, len(others), CALL):
            units = [name.decode() for name in others[k : k + CALL]]
            heads = np.cumsum([0, *[len(u) + 1 for u in units[:-1]]])
            whole = self.tokenizer.encode(" ".join(units), add_special_tokens=False)
            ids.append(np.array(whole.ids, np.int32))
            unit = np.searchsorted(heads, [a for a, _ in whole.offsets], "right") - 1
            sizes.append(np.bincount(unit, minlength=len(units)))
        size = np.concatenate(sizes)
        begin = len(self.pool) + np.cumsum(size) - size
        self.slot.update(zip(letters + others, range(len(self.start), len(self.start) + len(names)), strict=True))
        self.start, self.size = np.concatenate([self.start, begin]), np.concatenate([self.size, size])
        self.pool = np.concatenate(ids)

    def encode(self, units: Units, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text followed by ``end``; the texts' offsets."""
        if len(self.slot) > WORDS_KEPT:
            self._clear()
        found = list(map(self.slot.get, units.names))
        new = [name for name, slot in zip(units.names, found, strict=True) if slot is None]
        if new:
            self._add(new)
            found = list(map(self.slot.get, units.names))
        slots = np.array(found, np.int64)[units.code]
        size = self.size[slots]
        before = np.concatenate([[0], np.cumsum(size)])[units.first]
        n_texts = len(units.first) - 1
        offsets = before + np.arange(n_texts + 1)
        ids = np.empty(offsets[-1], np.int32)
        ends = np.zeros(offsets[-1], bool)
        ends[offsets[1:] - 1] = True
        ids[ends] = end
        ids[~ends] = self.pool[spans(self.start[slots], size)]
        return ids, offsets


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


class Index:
    """BM25 over the documents of one shard: postings by word, each with its whole weight."""

    def __init__(self, units: Units) -> None:
        self.n, n_words = len(units.first) - 1, max(1, len(units.names))
        length = np.diff(units.first)
        doc = np.repeat(np.arange(self.n), length)
        pair, tf = np.unique(units.code * self.n + doc, return_counts=True)
        word, self.doc = np.divmod(pair, max(1, self.n))
        df = np.bincount(word, minlength=n_words)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9)) if self.n else length
        self.weight = idf[word] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.first, self.df = np.cumsum(df) - df, df
        by_doc = np.argsort(self.doc, kind="stable")
        self.words = word[by_doc]
        self.words_from = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The score of every document for the distinct words of ``seed``."""
        query = self.words[self.words_from[seed] : self.words_from[seed + 1]]
        rows = spans(self.first[query], self.df[query])
        return np.bincount(self.doc[rows], self.weight[rows], minlength=self.n)


def fill_windows(left: np.ndarray, index: Index, window: int, urgent: int = 0) -> tuple[list[list[tuple[int, int]]], np.ndarray]:
    """Windows of (document, tokens) that hold ``window`` tokens each, and the tokens still left.

    ``left`` has the tokens of each document. The first ``urgent`` documents are seeds before any
    other, so none stays left over again and again. Less than a window is left over in the end.
    """
    left, windows = left.copy(), []
    for d in np.flatnonzero(left >= window):
        windows += [[(int(d), window)]] * int(left[d] // window)
    left %= window
    total, seed, lowest = int(left.sum()), -1, 0
    while total >= window:
        if seed < 0 or left[:urgent].any():
            while not left[lowest]:
                lowest += 1
            seed = lowest
        own, room = [(seed, int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        unused = np.flatnonzero(left)
        ranked = unused[np.argsort(-index.scores(seed)[unused], kind="stable")]
        size = left[ranked]
        seed = -1
        while room:
            fits = size <= room
            k = int(fits.argmax())
            if fits[k]:
                own.append((int(ranked[k]), int(size[k])))
                left[ranked[k]] = 0
                room -= int(size[k])
                keep = np.arange(len(ranked)) != k
                ranked, size = ranked[keep], size[keep]
            else:
                seed = int(ranked[0])
                own.append((seed, room))
                left[seed] -= room
                room = 0
        windows.append(own)
        total -= window
    return windows, left


def power_windows(left: np.ndarray) -> list[list[tuple[int, int]]]:
    """What is left, cut into sequences of falling powers of two."""
    queue = [(int(d), int(left[d])) for d in np.flatnonzero(left)][::-1]
    total, windows = int(left.sum()), []
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            d, n = queue.pop()
            own.append((d, min(n, room)))
            if n > room:
                queue.append((d, n - room))
            room -= own[-1][1]
        windows.append(own)
    return windows


def _packer(path: str, window: int, end: int, shard_bytes: int):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = _encoder(path), TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, pa.Array]] = []
        carried = np.zeros(0, np.int64)  # tokens already packed of the first rows held
        size = 0

        def shard(last: bool) -> pa.RecordBatch:
            nonlocal held, carried, sequence, size
            doc_id, texts = (pa.concat_arrays(columns) for columns in zip(*held, strict=True))
            units = Units(texts)
            ids, offsets = encoder.encode(units, end)
            whole = np.diff(offsets)
            done = np.zeros(len(texts), np.int64)
            done[: len(carried)] = carried
            windows, left = fill_windows(whole - done, Index(units), window, len(carried))
            if last:
                windows += power_windows(left)
                left[:] = 0
            pieces = np.array([x for own in windows for x in own], np.int64).reshape(-1, 2)
            counts = np.array([len(own) for own in windows], np.int64)
            doc, length = pieces[:, 0], pieces[:, 1]
            nth = np.repeat(np.arange(len(windows)), counts)
            # Starts run on within a document, offsets within a sequence.
            order = np.argsort(doc, kind="stable")
            ahead = np.cumsum(length[order]) - length[order]
            head = np.searchsorted(doc[order], doc[order])
            start = np.empty(len(doc), np.int64)
            start[order] = ahead - ahead[head] + done[doc[order]] if len(doc) else ahead
            upto = np.cumsum(length) - length
            first = (np.cumsum(counts) - counts)[nth]
            flat = ids[spans(offsets[doc] + start, length)].astype("<u4")
            borders = np.concatenate([[0], np.cumsum(4 * length)])
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(borders), pa.py_buffer(flat)])
            out = pa.RecordBatch.from_arrays(
                [
                    doc_id.take(pa.array(doc)), pa.array(start), pa.array(length), binary.cast(pa.binary()),
                    pa.array(whole[doc]), pa.array(sequence + nth), pa.array(upto - upto[first]),
                ], names,
            )
            sequence += len(windows)
            rest = np.flatnonzero(left)
            carried = (whole - left)[rest]
            held = [(doc_id.take(pa.array(rest)), texts.take(pa.array(rest)))]
            size = 0
            return out

        for batch in batches:
            for i, j in W.slices(batch.column("text"), shard_bytes):
                part = batch.slice(i, j - i)
                held.append((part.column("doc_id"), part.column("text")))
                size += int(W.text_buffers(part.column("text"))[1][-1])
                if size >= shard_bytes // 2:
                    yield shard(last=False)
        if held:
            yield shard(last=True)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, shard_bytes: int = SHARD_BYTES,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset``: one row a piece.

    ``ids`` holds the piece's ids as little-endian 32-bit numbers, ``start`` its document's ids before
    it and ``offset`` the sequence's ids before it. ``tokenizer`` is the path of a tokenizer file that
    every worker can read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return rows.mapInArrow(_packer(tokenizer, window, end, shard_bytes), schema)
