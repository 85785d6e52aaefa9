"""Language of a text by unigram piece models summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language gives each piece a probability; a word
has the sum over all ways to cut it into pieces of the products of their probabilities, found by a
forward pass over its letters, many words at once. A text has the product over its words. The
probabilities are fitted by expectation maximisation: Spark counts the words of each training
language once, and each round sums the expected pieces of all (language, word) rows.

Words are runs of letters and marks, in lower case, with U+2581 in front, of any length: the sums of
a long run are rescaled as they go, so none is cut (in scripts without spaces a run is a clause). A
letter outside the vocabulary has a small fixed probability. The training texts are about
``TRAINING_DOCS`` documents of each language, picked by a hash of their id, and their runs of more
than ``LONGEST`` letters count in stretches of that length (documented bounds of the fit); every
document is scored on its whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if
there is no training language. Documents without a language teach nothing. Equal scores go to the
language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import words as W
from .quality import remainder

TRAINING_DOCS = 600
ROUNDS = 3
LONGEST = 20
#: Letters of a long run whose pieces are looked up at a time.
STRIP = 1 << 15
UNKNOWN = 1e-9
UNDECIDED = "und"
_MARK = "▁"
_RUNS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# Only words split at ASCII separators are told apart in bytes; letters are told apart in text.
_LETTERS = W._folding(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def runs(word: str) -> list[str]:
    """The runs of letters of a word."""
    return [_MARK + r.lower() for r in _RUNS.findall(word)]


def stretches(word: str) -> list[str]:
    """The same for training, cut at ``LONGEST`` letters."""
    return [r[k : k + LONGEST] for r in runs(word) for k in range(0, len(r), LONGEST)]


class PieceTable:
    """Finds pieces by the hashes of their letters; piece number len(pieces) stands for none."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        codes, inside = _codes(pieces)
        length = inside.sum(axis=1)
        keys = _substring(_sums(codes), 0, length)
        self.bits = (8 * len(pieces)).bit_length()
        n = 1 << self.bits
        self.keys, self.piece = np.zeros(n, np.uint64), np.full(n, len(pieces), np.int32)
        slot, left = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.piece[slot[left]] == len(pieces)]
            self.piece[slot[free]] = free  # the last of several keeps the slot
            self.keys[slot[free]] = keys[self.piece[slot[free]]]
            left = left[self.piece[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (n - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.piece[slot]
        open_ = np.flatnonzero((out < len(self.pieces)) & (self.keys[slot] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            out[open_] = self.piece[slot[open_]]
            open_ = open_[(out[open_] < len(self.pieces)) & (self.keys[slot[open_]] != keys[open_])]
        return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    inside = np.arange(length.max() if len(texts) else 0) < length[:, None]
    codes = np.zeros(inside.shape, np.uint64)
    codes[inside] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return codes, inside


_POWER = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(63, _FACTOR)))
_INVERSE = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(63, np.uint64(pow(int(_FACTOR), -1, 1 << 64)))))


def _sums(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(W.mixed(codes) * _POWER[: codes.shape[1]], axis=1, out=out[:, 1:])
    return out


def _substring(sums: np.ndarray, start: int, end: np.ndarray | int) -> np.ndarray:
    """Scrambled hash of letters ``start`` to ``end`` of each row."""
    last = sums[np.arange(len(sums)), end] if isinstance(end, np.ndarray) else sums[:, end]
    return W.mixed((last - sums[:, start]) * _INVERSE[start])


def _lattice(table: PieceTable, texts: list[str]) -> tuple[dict[tuple[int, int], np.ndarray], np.ndarray]:
    """The piece at letters i to j of every text, by (i, j), and the texts' lengths."""
    codes, inside = _codes(texts)
    sums, length = _sums(codes), inside.sum(axis=1)
    found = {}
    for j in range(1, codes.shape[1] + 1):
        for i in range(max(0, j - table.longest), j):
            piece = table.find(_substring(sums, i, j))
            piece[length < j] = len(table.pieces)
            found[i, j] = piece
    return found, length


def _forward(found: dict, length: np.ndarray, chances: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations of the first j letters, for each j: (texts, languages)."""
    alpha = [np.ones((len(length), chances.shape[1]))]
    for j in range(1, length.max() + 1 if len(length) else 1):
        alpha.append(sum(alpha[i] * chances[found[i, j]] for i in range(j) if (i, j) in found) + alpha[j - 1] * UNKNOWN)
    return alpha


def log_chances(table: PieceTable, texts: list[str], chances: np.ndarray) -> np.ndarray:
    """Log probability of each run in each language; ``chances`` ends in a row of zeros."""
    out = np.zeros((len(texts), chances.shape[1]))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for k in np.flatnonzero(size > LONGEST):
        out[k] = _long_log(table, texts[k], chances)
    order = np.flatnonzero(size <= LONGEST)
    order = order[np.argsort(size[order], kind="stable")]
    for part in np.array_split(order, max(1, len(order) // 8192)):
        if len(part):
            found, length = _lattice(table, [texts[k] for k in part])
            alpha = np.stack(_forward(found, length, chances))
            out[part] = np.log(alpha[length, np.arange(len(part))])
    return out


def _long_log(table: PieceTable, run: str, chances: np.ndarray) -> np.ndarray:
    """Log probability of one run of any length in each language.

    Only the sums of the last ``table.longest`` letters are kept, divided by their largest every few
    letters; the logarithms of the divisors add up.
    """
    codes = np.frombuffer(run.encode("utf-32-le"), np.uint32).astype(np.uint64)
    width = min(table.longest, len(codes))
    power, inverse = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(STRIP + width, x))) for x in (_FACTOR, _INVERSE[1]))
    recent = np.zeros((width, chances.shape[1]))  # the last row is the sum up to the letter before
    recent[-1] = 1
    log = np.zeros(chances.shape[1])
    for at in range(0, len(codes), STRIP):
        back = min(at, width - 1)
        part = codes[at - back : at + STRIP]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mixed(part) * power[: len(part)])])
        ends = np.arange(back + 1, len(part) + 1)
        pieces = np.full((len(ends), width), len(table.pieces), np.int64)  # of the last width to 1 letters
        for n in range(1, width + 1):
            whole = ends >= n
            start = ends[whole] - n
            pieces[whole, width - n] = table.find(W.mixed((sums[ends[whole]] - sums[start]) * inverse[start]))
        for k, row in enumerate(pieces):
            new = (recent * chances[row]).sum(axis=0) + recent[-1] * UNKNOWN
            recent[:-1] = recent[1:]
            recent[-1] = new
            if k % 16 == 15:
                scale = recent.max(axis=0)
                recent /= scale
                log += np.log(scale)
    return log + np.log(recent[-1])


def expected_pieces(table: PieceTable, texts: list[str], counts: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``counts`` copies of each stretch, in one language."""
    total = np.zeros(len(table.pieces) + 1)
    order = np.argsort(np.fromiter(map(len, texts), np.int64, len(texts)), kind="stable")
    for part in np.array_split(order, max(1, len(order) // 8192)):
        if not len(part):
            continue
        found, length = _lattice(table, [texts[k] for k in part])
        alpha = [a[:, 0] for a in _forward(found, length, chances)]
        whole = np.stack(alpha)[length, np.arange(len(part))]
        beta = [np.where(length == j, 1.0, 0.0) for j in range(len(alpha))]
        for i in range(len(alpha) - 2, -1, -1):
            beta[i] = beta[i] + beta[i + 1] * UNKNOWN + sum(
                chances[found[i, j], 0] * beta[j] for j in range(i + 1, len(alpha)) if (i, j) in found
            )
        for (i, j), piece in found.items():
            total += np.bincount(piece, alpha[i] * chances[piece, 0] * beta[j] / whole * counts[part], len(total))
    return total[:-1]


@dataclass
class Languages:
    names: list[str]
    pieces: list[str]
    chances: np.ndarray  # (pieces + 1, languages)


def load_pieces(model_path: str) -> list[str]:
    """The ordinary pieces of a public vocabulary, in lower case."""
    from .pieces import PieceModel

    return sorted({t.lower() for t in PieceModel.load(model_path).ids})


def train_languages(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """Piece probabilities of each language from documents whose remainder by 3 is not 1."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL"
    ).where(remainder(F.col("doc_id"), 3) != 1)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names, pieces = sorted(sizes), load_pieces(model_path)
    if not names:
        return Languages([], pieces, np.zeros((len(pieces) + 1, 0)))
    share = spark.createDataFrame([(n, min(1.0, TRAINING_DOCS / sizes[n])) for n in names], "lang string, share double")
    sample = rows.join(F.broadcast(share), "lang").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    )

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                count: dict[tuple[str, str], int] = {}
                for t, n in zip(batch.column("text")[i:j].to_pylist(), batch.column("lang")[i:j].to_pylist(), strict=True):
                    for r in stretches(t):
                        count[n, r] = count.get((n, r), 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    counted = cut(sample.mapInArrow(words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    chances = np.full((len(pieces) + 1, len(names)), 1 / len(pieces))
    chances[-1] = 0
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast((names, pieces, chances))  # pieces times languages numbers

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, pieces, chances = held.value
            table, total = PieceTable(pieces), {}
            for batch in batches:
                for k, name in enumerate(names):
                    mine = batch.filter(pa.compute.equal(batch.column("lang"), name))
                    if mine.num_rows:
                        new = expected_pieces(table, mine.column("word").to_pylist(), mine.column("n").to_numpy(), chances[:, [k]])
                        total[k] = total.get(k, 0) + new
            for k, found in total.items():
                used = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(found[used])], ["lang", "piece", "n"]
                )

        found = counted.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        sums = np.full((len(pieces), len(names)), 0.01)
        sums[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += np.round(found.column("n").to_numpy(), 6)
        chances = np.vstack([sums / sums.sum(axis=0), np.zeros(len(names))])
    return Languages(names, pieces, chances)


def identify(docs: DataFrame, model: Languages, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score``: the likeliest language and its share of all languages."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = PieceTable(model.pieces)
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                log, letters = _text_logs(batch.column("text")[i:j], table, model)
                names, scores = [UNDECIDED] * (j - i), np.zeros(j - i)
                if model.names:
                    best = log.argmax(axis=1)
                    share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                    scores = np.where(letters, share, 0.0)
                    names = [model.names[b] if ok else UNDECIDED for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _text_logs(texts: pa.Array, table: PieceTable, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each text in each language, and whether it has a letter."""
    words = W.split_words(texts, _LETTERS)
    _, first, which = np.unique(W.word_hashes(words), return_index=True, return_inverse=True)
    # The bytes are those of the text but for lower case, so a distinct word is text again.
    parts = [runs(words.data[s:e].tobytes().decode()) for s, e in zip(words.start[first], words.end[first], strict=True)]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    flat = [r for p in parts for r in p]
    index: dict[str, int] = {}
    place = np.array([index.setdefault(r, len(index)) for r in flat], np.int64)
    log = log_chances(table, list(index), model.chances)
    n = len(model.names)
    each = np.stack([np.bincount(owner, log[place, k], len(parts)) for k in range(n)], axis=1) if n else np.zeros((len(parts), 0))
    letters = np.bincount(owner, minlength=len(parts)) > 0
    of_word = words.texts()
    total = np.stack([np.bincount(of_word, each[which, k], len(texts)) for k in range(n)], axis=1) if n else np.zeros((len(texts), 0))
    return total, np.bincount(of_word, letters[which], len(texts)) > 0
