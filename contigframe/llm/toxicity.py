"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of its words (letters and digits, lower-cased A-Z) and of their beginnings of 3
to 8 bytes. Spark counts in how many toxic and other training texts each of these occurs; the
``FEATURES`` with the largest chi-square are kept, and logistic regression weighs them. For every
training text that names a group of people, a copy is made that names another group of the same
kind. A text that names none gets a mention: one group's word is set behind it, and it is paired with
its copy that mentions another group of that kind, and with itself. The squared differences of the
margins of all pairs are added to the loss, so neither the group named nor the mention moves a score.
Words for groups are always among the features.

Training texts are at most ``TOXIC_ROWS`` toxic and ``OTHER_ROWS`` other labelled documents, the
first by a hash of their id (a documented bound), equal texts once; both kinds are weighted back
to their share among all labelled documents. Every document is scored on its whole text.

Defined cases: null and empty texts have no features and get the score of the intercept. Labels
without a value or a document teach nothing. With one kind of label only, every score is the mean
label; without labels it is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from . import words as W
from .quality import labelled, remainder, scored

TOXIC_ROWS, OTHER_ROWS = 4_000, 8_000
FEATURES = 2_000
BEGINNINGS = range(3, 9)

# Words for groups of people, by kind. Any word of a row may stand for another.
GROUPS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male", "transgender"],
    ["gay", "lesbian", "straight", "bisexual", "queer"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"],
    ["black", "white", "asian", "latino", "african", "arab"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["old", "young", "elderly"],
    ["disabled", "blind", "deaf"],
    # German
    ["frauen", "männer", "mädchen", "jungen"],
    ["frau", "mann"],
    ["schwul", "lesbisch", "bisexuell", "heterosexuell"],
    ["muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch", "katholisch"],
    ["muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"],
    ["einwanderer", "flüchtlinge", "ausländer", "einheimische"],
    # French
    ["femmes", "hommes", "filles", "garçons"],
    ["femme", "homme", "fille", "garçon"],
    ["lesbienne", "homosexuel", "hétérosexuel", "bisexuel"],
    ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée", "catholique"],
    ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"],
    ["noirs", "blancs", "asiatiques", "arabes"],
    ["immigrés", "réfugiés", "étrangers", "autochtones"],
    # Spanish
    ["mujeres", "hombres", "niñas", "niños"],
    ["mujer", "hombre", "niña", "niño"],
    ["lesbiana", "homosexual", "heterosexual"],
    ["musulmán", "cristiano", "judío", "hindú", "budista", "ateo", "católico"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"],
    ["negros", "blancos", "asiáticos", "árabes"],
    ["inmigrantes", "refugiados", "extranjeros", "nativos"],
]
_NEXT = {word: row[(k + 1) % len(row)] for row in GROUPS for k, word in enumerate(row)}
_NAMES = re.compile(r"(?<![0-9A-Za-z\x80-\U0010ffff])(" + "|".join(_NEXT) + r")(?![0-9A-Za-z\x80-\U0010ffff])", re.IGNORECASE | re.ASCII)


def swapped(text: str) -> str:
    """The text with each word for a group replaced by the next one of its kind."""
    return _NAMES.sub(lambda m: _NEXT[m[1].lower()], text)


def counterfactuals(text: str) -> list[tuple[str, str]]:
    """Pairs of texts that should score alike; the group of an inserted mention follows from the text."""
    if _NAMES.search(text):
        return [(text, swapped(text))]
    k = zlib.crc32(text.encode())
    row = GROUPS[k % len(GROUPS)]
    word = row[k // len(GROUPS) % len(row)]
    return [(f"{text} {word}", f"{text} {_NEXT[word]}"), (f"{text} {word}", text)]


def text_features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, by text. Features are 64-bit hashes, or positions in the
    ascending ``wanted``."""
    words = W.split_words(texts, W.ALNUM_LOWER)
    of_word, length = words.texts(), words.end - words.start
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    head = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))[words.start]
    sieve = None
    if wanted is not None:
        sieve = np.zeros(1 << 16, bool)
        sieve[wanted & np.uint64(0xFFFF)] = True
    found, owners = [], []
    for n in (0, *BEGINNINGS):
        if n:
            rows = np.flatnonzero(length >= n)
            keys = W.mixed((head[rows] & np.uint64((1 << 8 * n) - 1 & (1 << 64) - 1)) ^ W.mixed(np.array([n], np.uint64)))
        else:
            rows, keys = np.arange(len(length)), W.word_hashes(words, 5)
        if sieve is not None:
            rows, keys = (x[sieve[keys & np.uint64(0xFFFF)]] for x in (rows, keys))
            at = np.searchsorted(wanted, keys)
            known = wanted[np.minimum(at, len(wanted) - 1)] == keys if len(wanted) else np.zeros(len(keys), bool)
            rows, keys = rows[known], at[known].astype(np.uint64)
        found.append(keys)
        owners.append(of_word[rows])
    key, text = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return text[new], key[new]


def group_features() -> np.ndarray:
    return np.unique(text_features(pa.array([" ".join(_NEXT)]))[1])


@dataclass
class Linear:
    wanted: np.ndarray  # ascending feature hashes
    weights: np.ndarray
    intercept: float
    n_pairs: int = 0  # counterfactual pairs that differed in the fit

    def scores(self, texts: pa.Array) -> np.ndarray:
        text, feature = text_features(texts, self.wanted)
        margin = self.intercept + np.bincount(text, self.weights[feature.astype(np.int64)], len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def loss_and_gradient(
    weights: np.ndarray, intercept: float, text: np.ndarray, feature: np.ndarray, labels: np.ndarray, importance: np.ndarray,
    pairs: Pairs | None, fairness: float, ridge: float,
) -> tuple[float, np.ndarray]:
    """Weighted log loss, half the ridge and the mean squared margin difference of the pairs.

    ``text, feature`` are the set entries of the rows; ``pairs`` are (pair, feature, +1 or -1): what
    one side has and the other has not, and the reverse. The gradient ends with the intercept's.
    """
    total, width = importance.sum(), len(weights)
    margin = np.bincount(text, weights[feature], len(labels)) + intercept
    loss = float((importance * (np.logaddexp(0, margin) - labels * margin)).sum() / total + ridge / 2 * (weights**2).sum())
    error = importance * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) / total
    gradient = np.append(np.bincount(feature, error[text], width) + ridge * weights, error.sum())
    if pairs is not None and len(pairs[0]):
        n_pairs = int(pairs[0].max()) + 1
        apart = np.bincount(pairs[0], weights[pairs[1]] * pairs[2], n_pairs)
        loss += fairness / n_pairs * float((apart**2).sum())
        gradient[:-1] += 2 * fairness / n_pairs * np.bincount(pairs[1], apart[pairs[0]] * pairs[2], width)
    return loss, gradient


def fit_linear(
    text: np.ndarray, feature: np.ndarray, labels: np.ndarray, importance: np.ndarray, width: int,
    pairs: Pairs | None = None, fairness: float = 5.0, ridge: float = 2e-4, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch steps of adaptive size."""
    weights, intercept = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        _, gradient = loss_and_gradient(weights, intercept, text, feature, labels, importance, pairs, fairness, ridge)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        change = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights, intercept = weights - change[:-1], intercept - change[-1]
    return weights, float(intercept)


def _lists(of_text: np.ndarray, key: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of_text, np.arange(n + 1)), pa.int32()), pa.array(key.astype(np.int32)))


def encoded_rows(texts: pa.Array, wanted: np.ndarray) -> list[pa.Array]:
    """For each text, lists of its features, and of both sides' own features in each of two pairs."""
    n, width = len(texts), len(wanted)
    out = [_lists(*text_features(texts, wanted), n)]
    made = [counterfactuals(t or "") for t in texts.to_pylist()]
    for k in range(2):
        sides = []
        for side in range(2):
            of_text, key = text_features(pa.array([m[k][side] if k < len(m) else "" for m in made], pa.string()), wanted)
            sides.append(of_text * width + key.astype(np.int64))
        for one, two in (sides, sides[::-1]):
            out.append(_lists(*np.divmod(np.setdiff1d(one, two), max(1, width)), n))
    return out


def pair_entries(sides: list[list[tuple[np.ndarray, np.ndarray]]], n: int) -> Pairs | None:
    """(pair, feature, sign) of the pairs whose sides differ, numbered without gaps."""
    pair = np.concatenate([row.astype(np.int64) + k * n for k, both in enumerate(sides) for row, _ in both])
    feature = np.concatenate([values for both in sides for _, values in both])
    sign = np.concatenate([np.full(len(values), 1 - 2 * side, np.int8) for both in sides for side, (_, values) in enumerate(both)])
    if not len(pair):
        return None
    return np.unique(pair, return_inverse=True)[1], feature, sign


def _flat(column: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all entries of a list column, rows taken in ``order``, as flat arrays."""
    lists = column.combine_chunks().take(pa.array(order))
    lists = lists if isinstance(lists, pa.ListArray) else lists.combine_chunks()
    size = np.diff(np.asarray(lists.offsets))
    return np.repeat(np.arange(len(size), dtype=np.int32), size), lists.flatten().to_numpy(zero_copy_only=False)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> Linear:
    """The classifier from labelled documents outside the held-out fifth."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.where(remainder(F.col("doc_id"), 5) != 0).where(F.col(label).isNotNull())
    totals = {r["kind"]: r["n"] for r in known.groupBy((F.col(label) == 1).alias("kind")).agg(F.count("*").alias("n")).collect()}
    toxic, other = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not other:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), 30.0 if toxic else -30.0)
    sample = cut(
        labelled(docs, labels, label, TOXIC_ROWS, F.col("label") == 1)
        .unionAll(labelled(docs, labels, label, OTHER_ROWS, F.col("label") != 1))
        .withColumn("label", (F.col("label") == 1).cast("int"))
        .dropDuplicates(["text", "label"])
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                of_text, key = text_features(batch.column("text")[i:j])
                toxic_rows = batch.column("label")[i:j].to_numpy() == 1
                keys, where = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.view(np.int64)), pa.array(np.bincount(where, minlength=len(keys)), pa.int64()),
                        pa.array(np.bincount(where, toxic_rows[of_text], len(keys)).astype(np.int64)),
                    ],
                    ["feature", "held", "toxic"],
                )

    sizes = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, positive = float(sizes["n"] or 0), float(sizes["toxic"] or 0)
    if not 0 < positive < n:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), float(np.log(toxic / other)))
    held, hit = F.col("held").cast("double"), F.col("toxic").cast("double")
    # Chi-square of the two-by-two table of having the feature and being toxic.
    chi = (hit * n - held * positive) ** 2 * n / (held * (n - held + 1e-9) * positive * (n - positive))
    best = (
        sample.mapInArrow(counted, "feature bigint, held bigint, toxic bigint")
        .groupBy("feature").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic"))
        .where("held >= 3").withColumn("chi", chi).orderBy(F.desc("chi"), "feature").limit(FEATURES).select("feature")
    )
    chosen = np.array([r["feature"] for r in best.collect()], np.int64).view(np.uint64)
    wanted = np.unique(np.concatenate([chosen, group_features()]))

    names = ["label", "hash", "own", "plus0", "minus0", "plus1", "minus1"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column("text")):
                columns = [batch.column("label")[i:j], batch.column("hash")[i:j], *encoded_rows(batch.column("text")[i:j], wanted)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "label int, hash bigint, " + ", ".join(f"{c} array<int>" for c in names[2:])
    # A bounded number of rows, kept as flat arrays.
    rows = sample.select("text", "label", F.xxhash64("text").alias("hash")).mapInArrow(encoded, schema).toArrow()
    order = np.lexsort((rows["hash"].to_numpy(), rows["label"].to_numpy()))
    labels_ = rows["label"].to_numpy()[order].astype(float)
    in_text, feature = _flat(rows["own"], order)
    pairs = pair_entries([[_flat(rows[f"{side}{k}"], order) for side in ("plus", "minus")] for k in range(2)], len(order))
    importance = np.where(labels_ == 1, toxic / max(labels_.sum(), 1), other / max((1 - labels_).sum(), 1))
    weights, intercept = fit_linear(in_text, feature, labels_, importance, len(wanted), pairs)
    return Linear(wanted, weights, intercept, 0 if pairs is None else int(pairs[0].max()) + 1)


def score_toxicity(docs: DataFrame, model: Linear, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: toxic) for every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return scored(rows, lambda texts: held.value.scores(texts))


def reject_toxic(docs: DataFrame, model: Linear, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in W.slices(batch.column(at)):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(held.value.scores(part.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
