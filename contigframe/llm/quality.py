"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics come from array operations over slices of texts. Their values are binned at quantiles of
the training rows; each tree is grown level by level from sums of gradients in every (node,
feature, bin), and is kept as a complete binary tree in flat arrays, so scoring is ``depth`` array
look-ups a tree for all rows of a slice. Training rows are at most ``TRAINING_ROWS`` labelled
documents, the first by a hash of their id (a documented bound); every document is scored.

Defined cases: null and empty texts have zero statistics and a score like any other. Label rows
without a label or without a document teach nothing; a document labelled twice counts twice. With
fewer than two kinds of labels every score is their mean (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

TRAINING_ROWS = 20_000
STATISTICS = [
    "log_words", "log_bytes", "word_length", "word_length_spread", "upper", "digit", "space", "stop_marks", "loud_marks",
    "symbols", "bars", "other_marks", "beyond_ascii", "breaks", "line_words", "distinct_words", "top_word", "distinct_triples",
    "shouted_words", "marked_words",
]

# Class of each byte: 0 lower-case letters, then the shares above in this order.
_CLASSES = ["upper", "digit", "space", "stop_marks", "loud_marks", "symbols", "bars", "other_marks", "beyond_ascii", "breaks"]
_BYTE_CLASS = np.zeros(256, np.uint8)
for _name, _bytes in {
    "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "stop_marks": b".,;:'\"()-", "loud_marks": b"!?",
    "symbols": b"#$%&*+=<>@^~\\/", "bars": b"|_[]{}`", "beyond_ascii": range(128, 256), "breaks": b"\n",
    "other_marks": [*range(9), *range(14, 32), 127],
}.items():
    _BYTE_CLASS[list(_bytes)] = 1 + _CLASSES.index(_name)


def _per(amount: np.ndarray, of: np.ndarray) -> np.ndarray:
    return amount / np.maximum(of, 1)


def _runs(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and the count of the commonest."""
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])])) if len(keys) else np.zeros(0, int)
    most = np.zeros(n)
    np.maximum.at(most, text[head], np.diff(head, append=len(keys)))
    return np.bincount(text[head], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text."""
    raw, offsets = W.text_buffers(texts)
    n, size = len(texts), np.diff(offsets)
    of_byte = np.repeat(np.arange(n), size)
    width = len(_CLASSES) + 1
    classes = np.bincount(of_byte * width + _BYTE_CLASS[raw], minlength=n * width).reshape(n, width)[:, 1:]
    words = W.split_words(texts, W.PLAIN)
    of_word, counts = words.texts(), words.counts()
    length = (words.end - words.start).astype(float)
    mean = _per(np.bincount(of_word, length, n), counts)
    spread = np.sqrt(np.maximum(_per(np.bincount(of_word, length**2, n), counts) - mean**2, 0))
    hashes = W.word_hashes(words)
    distinct, top = _runs(hashes, of_word, n)
    start, text = W.window_starts(words, 3)
    triples, _ = _runs(W.window_hashes(hashes, 3)[start] if len(start) else hashes[:0], text, n)
    kind = _BYTE_CLASS[words.data[np.stack([words.start, words.end - 1])]] if len(of_word) else np.zeros((2, 0), np.uint8)
    second = _BYTE_CLASS[words.data[np.minimum(words.start + 1, words.end - 1)]] if len(of_word) else kind[0]
    shouted = np.bincount(of_word[(kind[0] == 1) & (second == 1) & (length > 1)], minlength=n)
    marked = np.bincount(of_word[(kind[1] >= 5) & (kind[1] <= 8)], minlength=n)
    shares = dict(zip(_CLASSES, (_per(c, size) for c in classes.T), strict=True))
    shares |= {
        "log_words": np.log1p(counts), "log_bytes": np.log1p(size), "word_length": mean, "word_length_spread": spread,
        "line_words": _per(counts, classes[:, _CLASSES.index("breaks")] + 1), "distinct_words": _per(distinct, counts), "top_word": _per(top, counts),
        "distinct_triples": _per(triples, np.bincount(text, minlength=n)), "shouted_words": _per(shouted, counts), "marked_words": _per(marked, counts),
    }
    return np.stack([shares[name] for name in STATISTICS], axis=1)


@dataclass
class Trees:
    """Boosted trees as arrays of shape (trees, nodes); the children of node k are 2k + 1, 2k + 2."""

    start: float
    feature: np.ndarray
    above: np.ndarray
    leaf: np.ndarray
    depth: int

    def margins(self, rows: np.ndarray) -> np.ndarray:
        total, each = np.full(len(rows), self.start), np.arange(len(rows))
        for feature, above, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (rows[each, feature[node]] > above[node])
            total += leaf[node - (2**self.depth - 1)]
        return total

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -500, 500)))

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 2.0) -> Trees:
        mean = labels.mean() if len(labels) else 0.5
        inner = 2**depth - 1
        if mean in (0.0, 1.0) or len(labels) < 2:
            start = 0.0 if not len(labels) else np.log((mean + 1e-9) / (1 - mean + 1e-9))
            return cls(start, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), depth)
        cuts = np.quantile(rows, np.linspace(0, 1, bins + 1)[1:-1], axis=0, method="lower")
        binned = np.stack([np.searchsorted(cuts[:, f], rows[:, f], "left") for f in range(rows.shape[1])], axis=1)
        n_features = rows.shape[1]
        start = float(np.log(mean / (1 - mean)))
        margin, each = np.full(len(rows), start), np.arange(len(rows))
        out: tuple[list, list, list] = ([], [], [])
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - labels, p * (1 - p)
            node = np.zeros(len(rows), np.int64)
            feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
            at_bin = np.full(inner, bins)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                cell = (node - first) * bins
                sums = np.empty((2, n_features, width, bins))
                for f in range(n_features):
                    for k, weight in enumerate((g, h)):
                        sums[k, f] = np.bincount(cell + binned[:, f], weight, width * bins).reshape(width, bins)
                left = np.cumsum(sums, axis=3)
                whole = left[:, :, :, -1:]
                right = whole - left
                gain = (left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - whole[0] ** 2 / (whole[1] + ridge))[:, :, :-1]
                gain = np.where((left[1] > 1e-3)[:, :, :-1] & (right[1] > 1e-3)[:, :, :-1], gain, 0)
                flat = gain.transpose(1, 0, 2).reshape(width, -1)
                best = flat.argmax(axis=1)
                ok = flat[np.arange(width), best] > 1e-6
                f, b = best // (bins - 1), best % (bins - 1)
                feature[first : first + width] = np.where(ok, f, 0)
                above[first : first + width] = np.where(ok, cuts[b, f], np.inf)
                at_bin[first : first + width] = np.where(ok, b, bins)
                node = 2 * node + 1 + (binned[each, feature[node]] > at_bin[node])
            place = node - inner
            leaf = -rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + ridge)
            margin += leaf[place]
            for held, new in zip(out, (feature, above, leaf), strict=True):
                held.append(new)
        return cls(start, *map(np.array, out), depth)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; null without an id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, wanted: Column | None = None) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents whose remainder by 5 is not 0."""
    picked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        "doc_id IS NOT NULL AND label IS NOT NULL"
    ).where(remainder(F.col("doc_id"), 5) != 0)
    if wanted is not None:
        picked = picked.where(wanted)
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most `rows` small rows


def scored(docs: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``doc_id, score`` for every row of ``doc_id, text``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                values = score(batch.column("text")[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.array(values, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees from the labelled documents outside the held-out fifth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                found = statistics(batch.column("text")[i:j])
                offsets = pa.array(np.arange(j - i + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j].cast(pa.string()), batch.column("label")[i:j], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))],
                    ["doc_id", "label", "found"],
                )

    rows = labelled(_named(docs, doc_id, text), labels, label, TRAINING_ROWS).mapInArrow(run, "doc_id string, label int, found array<double>")
    held = sorted(rows.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["label"], r["found"]))
    return Trees.fit(np.array([r["found"] for r in held]).reshape(len(held), len(STATISTICS)), np.array([r["label"] == 1 for r in held], float))


def score_quality(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: better) for every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of small trees
    return scored(_named(docs, doc_id, text), lambda texts: held.value.scores(statistics(texts)))
