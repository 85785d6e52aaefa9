"""Joint decoding of the window classes of a contig.

The best class path is found by dynamic programming along the windows. Windows are packed into
chunks of fixed length, so that a contig of any number of windows is decoded by many tasks:

1. per chunk, the best score from every entry class to every exit class (one small matrix);
2. the best class at every chunk border, from the matrices alone, by a tree of their products;
3. per chunk, the path between its two border classes.

A contig that fits in one chunk only takes the last step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    CHEAP_PAIRS,
    CHEAP_SWITCH,
    DEAR_PAIRS,
    DEAR_SWITCH,
)
from .lineage import cut

CHUNK = 1 << 12
#: Chunk matrices that one task multiplies at a time.
RUN = 64
PADDED_SCORES = 1 << 20


def transition_costs(
    classes: Sequence[str],
    cost: float,
    prior: str = "biological",
    user: dict[str, dict[str, float]] | None = None,
) -> list[list[float]]:
    """Symmetric cost of each class change: a global cost times a prior (or user) weight."""
    names = [c.lower() for c in classes]
    weight = {}
    if user:
        for a, row in user.items():
            for b, value in row.items() if isinstance(row, dict) else ():
                weight[frozenset((a.lower(), b.lower()))] = float(value)
    elif prior != "uniform":
        weight = {frozenset(p): CHEAP_SWITCH for p in CHEAP_PAIRS}
        weight.update({frozenset(p): DEAR_SWITCH for p in DEAR_PAIRS})
    return [
        [0.0 if a == b else cost * weight.get(frozenset((a, b)), 1.0) for b in names]
        for a in names
    ]


def _emissions(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log-softmax of a batch of chunks, padded to the longest: [chunk, window, class]."""
    sizes = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), sizes.max(), rows[0].shape[1]))
    for n, r in enumerate(rows):
        top = r.max(axis=1, keepdims=True)
        out[n, : len(r)] = r - top - np.log(np.exp(r - top).sum(axis=1, keepdims=True))
    return out, sizes


def _stack(batch: pd.Series, classes: int) -> list[np.ndarray]:
    # The windows of a chunk arrive as one flat list of scores.
    return [np.asarray(chunk, dtype=float).reshape(-1, classes) for chunk in batch]


def _alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut batches into parts of similar chunk length, bounding the padded size of each."""
    for batch in batches:
        batch = batch.iloc[batch["windows"].map(len).to_numpy().argsort(kind="stable")]
        sizes = batch["windows"].map(len).to_numpy()
        start = 0
        for n in range(1, len(batch) + 1):
            if n == len(batch) or (n + 1 - start) * sizes[n] > PADDED_SCORES:
                yield batch.iloc[start:n].reset_index(drop=True)
                start = n


def _transfer(batches: Iterator[pd.DataFrame], costs: np.ndarray) -> Iterator[pd.DataFrame]:
    c = len(costs)
    for batch in _alike(batches):
        em, sizes = _emissions(_stack(batch["windows"], len(costs)))
        first = (batch["_chunk"].to_numpy() == 0)[:, None, None]
        # best[chunk, entry class, current class]; the first chunk is entered at no cost
        best = np.where(first, 0.0, -costs[None]) + em[:, 0][:, None, :]
        for t in range(1, em.shape[1]):
            step = (best[:, :, :, None] - costs).max(axis=2) + em[:, t][:, None, :]
            best = np.where((t < sizes)[:, None, None], step, best)
        yield batch.drop(columns="windows").assign(matrix=list(best.reshape(len(batch), c * c)))


def _product(rows: pd.DataFrame, classes: int) -> pd.DataFrame:
    """The (max, +) product of the matrices of consecutive chunks, as one longer chunk."""
    rows = rows.sort_values("_chunk")
    mats = [np.asarray(m).reshape(classes, classes) for m in rows["matrix"]]
    whole = mats[0]
    for m in mats[1:]:
        whole = (whole[:, :, None] + m[None]).max(axis=1)
    return rows[:1].assign(_chunk=rows["_up"].iloc[0], matrix=[whole.ravel()]).drop(columns="_up")


def _borders(rows: pd.DataFrame, classes: int) -> pd.DataFrame:
    """Exit class of every chunk of a run of chunks, from the chunk matrices alone.

    The run is entered by class ``_entry`` (-1 at the start of a contig) and left by class ``_exit``
    (-1 for the best one).
    """
    rows = rows.sort_values("_chunk")
    mats = [np.asarray(m).reshape(classes, classes) for m in rows["matrix"]]
    entry, exit_ = int(rows["_entry"].iloc[0]), int(rows["_exit"].iloc[0])
    score = mats[0][max(entry, 0)]  # the first chunk of a contig has equal rows
    back = []
    for m in mats[1:]:
        through = score[:, None] + m
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    exits = [int(score.argmax()) if exit_ < 0 else exit_]
    for pointers in reversed(back):
        exits.append(int(pointers[exits[-1]]))
    exits.reverse()
    return rows.drop(columns=["matrix", "_up", "_entry", "_exit"]).assign(exit_class=exits, entry_class=[entry, *exits[:-1]])


def _border_classes(moved: DataFrame, classes: int, key: str, kind: str) -> DataFrame:
    """``key, _chunk, exit_class, entry_class`` of all chunks of long contigs.

    A tree of products: runs of ``RUN`` matrices are multiplied into one, level by level, until
    a contig has a single run; then the classes at the borders are found from the top down. No group
    holds more than ``RUN`` matrices. Where paths are equal, borders of a higher level choose first.
    """
    levels = [cut(moved)]
    while (levels[-1].agg(F.max("_chunk").alias("m")).first()["m"] or 0) >= RUN:
        runs = levels[-1].withColumn("_up", F.floor(F.col("_chunk") / RUN))
        up = runs.groupBy(key, "_up").applyInPandas(lambda r: _product(r, classes), f"{key} {kind}, _chunk bigint, matrix array<double>")
        levels.append(cut(up))
    schema = f"{key} {kind}, _chunk bigint, exit_class int, entry_class int"
    found = None
    for level in reversed(levels):
        runs = level.withColumn("_up", F.floor(F.col("_chunk") / RUN))
        if found is None:
            runs = runs.withColumns({"_entry": F.lit(-1), "_exit": F.lit(-1)})
        else:
            above = found.select(key, F.col("_chunk").alias("_up"), F.col("entry_class").alias("_entry"), F.col("exit_class").alias("_exit"))
            runs = runs.join(above, [key, "_up"]).select(*runs.columns, "_entry", "_exit")
        found = runs.groupBy(key, "_up").applyInPandas(lambda r: _borders(r, classes), schema)
        found = cut(found) if level is not levels[0] else found
    return found


def _paths(batches: Iterator[pd.DataFrame], costs: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in _alike(batches):
        em, sizes = _emissions(_stack(batch["windows"], len(costs)))
        n, steps, c = em.shape
        entry = batch["entry_class"].to_numpy()
        score = em[:, 0] - np.where((entry >= 0)[:, None], costs[np.maximum(entry, 0)], 0.0)
        back = np.zeros((n, steps, c), dtype=np.int16)
        for t in range(1, steps):
            through = score[:, :, None] - costs
            back[:, t] = through.argmax(axis=1)
            score = np.where((t < sizes)[:, None], through.max(axis=1) + em[:, t], score)
        path = np.zeros((n, steps), dtype=np.int32)
        ends = batch["exit_class"].to_numpy()
        here = np.where(ends >= 0, ends, score.argmax(axis=1))
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[:, t] = here
            here = np.where(t < sizes, back[rows, t, here], here)
        yield batch.drop(columns=["windows", "entry_class", "exit_class"]).assign(
            path=[list(p[:s]) for p, s in zip(path, sizes)]
        )


def viterbi_labels(
    scored: DataFrame,
    costs: Sequence[Sequence[float]],
    key: str = "seq_id",
    order: str = "window_idx",
    scores: str = "scores",
    chunk: int = CHUNK,
) -> DataFrame:
    """Class index per window of the best path: ``key, order, decoded``.

    ``order`` must be dense. Equal paths are resolved towards the lower class index.
    """
    matrix = np.asarray(costs, dtype=float)
    classes = len(matrix)
    key_type = dict(scored.dtypes)[key]
    packed = (
        scored.withColumn("_chunk", F.floor(F.col(order) / chunk))
        .groupBy(key, "_chunk")
        .agg(F.array_sort(F.collect_list(F.struct(order, scores))).alias("_rows"))
        .select(
            key, "_chunk", F.flatten(F.transform("_rows", lambda r: r[scores])).alias("windows")
        )
    )
    # Only a full chunk or a later one can belong to a contig of several chunks.
    long = packed.where((F.col("_chunk") > 0) | (F.size("windows") >= chunk * classes))
    moved = long.mapInPandas(
        lambda it: _transfer(it, matrix), f"{key} {key_type}, _chunk bigint, matrix array<double>"
    )
    # One row of classes squared numbers per chunk: a few thousandths of the windows.
    borders = _border_classes(moved, classes, key, key_type)
    either = packed.join(borders, [key, "_chunk"], "left").na.fill(
        -1, ["exit_class", "entry_class"]
    )
    decoded = either.mapInPandas(
        lambda it: _paths(it, matrix), f"{key} {key_type}, _chunk bigint, path array<int>"
    )
    return decoded.select(key, "_chunk", F.posexplode("path").alias("_at", "decoded")).select(
        key, (F.col("_chunk") * chunk + F.col("_at")).cast("int").alias(order), "decoded"
    )


def binary_as_two(score: str) -> Column:
    """The score array [0, z] of one logit, so that the same decoder serves it."""
    return F.array(F.lit(0.0), F.col(score))
