"""Change points of a track: the best cut of each contig into stretches of constant level.

A cut into segments costs the squared deviations from each segment's mean, plus a penalty for every
change point. The least cost is found exactly by dynamic programming over positions with pruned
candidates: a start that a later change point beats can never win again, so the candidates stay few.
Sums of scores and squares give the cost of any segment at once.

Long contigs are worked through in chunks of positions, one wave of chunks after the other, each
with its contig's state (the candidates left and their sums) from the wave before; the way back is
walked in the same waves. All contigs and penalties are rows of their own, so a wave is spread over
as many tasks as there are (contig, penalty) pairs. Only contigs longer than a chunk need a second wave.

Costs are compared at ``DIGITS`` decimals. Of equally good cuts the one whose last change point is
latest is taken, at every step. A contig shorter than ``min_size`` windows is one segment.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ordered import merge_ranges

CHUNK = 1 << 16
DIGITS = 9
#: Steps after which the candidates are packed anew.
STRIP = 64
#: Cells of the matrices of tracks that take steps together.
CELLS = 1 << 16
#: Windows that one task sorts to join them to ranges.
SORTED = 1 << 18
_NEVER = np.iinfo(np.int64).max


def _packed(state: list[np.ndarray], live: np.ndarray) -> list[np.ndarray]:
    """The live candidates of each row, moved to the front in their order."""
    order = np.argsort(~live, axis=1, kind="stable")[:, : max(1, int(live.sum(axis=1).max(initial=0)))]
    return [np.take_along_axis(x, order, axis=1) for x in state]


def _matrices(states: Sequence[Sequence[np.ndarray]], room: int) -> list[np.ndarray]:
    """States of different sizes as matrices, one row each, with room for more candidates."""
    width = max(len(s[0]) for s in states) + room
    out = [np.zeros((len(states), width), kind) for kind in (np.int64, float, float, float, np.int64)]
    out[4][:] = -1
    for n, state in enumerate(states):
        for into, x in zip(out, state, strict=True):
            into[n, : len(x)] = x
    return out


def advance(
    scores: Sequence[np.ndarray], at: np.ndarray, states: Sequence[Sequence[np.ndarray]], penalties: np.ndarray, min_size: int
) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each track: the start of the last segment of the best cut up to each position, and the
    state after them.

    ``at`` positions came before. The state holds, for each candidate start, its position, cost,
    sums of scores and of squares up to it, and the position at which it is dropped. All tracks take
    a step together; after ``STRIP`` steps dropped candidates are left out.
    """
    order = np.argsort([-len(x) for x in scores], kind="stable")
    sizes = np.array([len(scores[n]) for n in order])
    at, penalties = at[order], penalties[order]
    padded = np.zeros((len(order), sizes[0]))
    for row, n in enumerate(order):
        padded[row, : sizes[row]] = scores[n]
    sums, squares = np.cumsum(padded, axis=1), np.cumsum(padded * padded, axis=1)
    back = np.zeros(padded.shape, np.int64)
    state = _matrices([states[n] for n in order], 0)
    done: list[list[np.ndarray]] = [[]] * len(order)
    for begin in range(0, sizes[0], STRIP):
        rows = int((sizes > begin).sum())  # longer tracks come first
        state = [x[:rows] for x in _packed(state, state[4] > (at[: len(state[4])] + begin)[:, None])]
        old, steps = state[0].shape[1], min(STRIP, int(sizes[0]) - begin)
        state = [np.concatenate([x, np.full((rows, steps), -1 if k == 4 else 0, x.dtype)], axis=1) for k, x in enumerate(state)]
        for k in range(steps):
            on = int((sizes > begin + k).sum())
            pos, cost, one, two, drop = (x[:on, : old + k] for x in state)
            t = (at[:on] + begin + k + 1)[:, None]
            now, square = sums[:on, begin + k, None], squares[:on, begin + k, None]
            open_ = (drop > t) & (pos <= t - min_size)
            d = now - one
            values = np.round(cost + (square - two) - d * d / np.where(open_, t - pos, 1), DIGITS)
            values[~open_] = np.inf
            least = values.min(axis=1, keepdims=True)
            any_ = np.isfinite(least[:, 0])
            back[:on, begin + k] = np.where(any_, np.where(open_ & (values == least), pos, 0).max(axis=1), 0)
            mine = np.round(least + penalties[:on, None], DIGITS)
            # A change point here serves as well as such a start, once a segment fits behind it.
            np.minimum(drop, t + min_size, out=drop, where=open_ & (values >= mine))
            new = (t[:, 0], np.where(any_, mine[:, 0], 0.0), now[:, 0], square[:, 0], np.where(any_, _NEVER, -1))
            for x, value in zip(state, new, strict=True):
                x[:on, old + k] = value
        # Tracks that end here; sums go on from zero in the next chunk.
        for row in range(int((sizes > begin + steps).sum()), rows):
            last = sizes[row] - 1
            live = state[4][row] > at[row] + sizes[row]
            pos, cost, one, two, drop = (x[row][live] for x in state)
            done[row] = [pos, cost, one - sums[row, last], two - squares[row, last], drop]
    out: list = [None] * len(order)
    for row, n in enumerate(order):
        out[n] = (back[row, : sizes[row]], done[row])
    return out


def _alike(tracks: Sequence[np.ndarray], states: Sequence[Sequence[np.ndarray]]) -> Iterator[np.ndarray]:
    """Numbers of the tracks that take steps together: of similar size, in matrices of bounded size."""
    sizes = np.array([max(len(x), min(len(x), STRIP) + len(s[0])) for x, s in zip(tracks, states, strict=True)])
    order, start = np.argsort(sizes, kind="stable"), 0
    for n in range(1, len(order) + 1):
        if n == len(order) or (n + 1 - start) * sizes[order[n]] > CELLS:
            yield order[start:n]
            start = n


def _first(penalty: float) -> list[np.ndarray]:
    return [np.zeros(1, np.int64), np.array([-penalty]), np.zeros(1), np.zeros(1), np.array([_NEVER])]


_STATE = ["_pos", "_cost", "_one", "_two", "_drop"]
_STATE_SCHEMA = "_pos array<bigint>, _cost array<double>, _one array<double>, _two array<double>, _drop array<bigint>"


def change_points(
    track: DataFrame, score: str, penalties: Sequence[float] = tuple(range(1, 10)), min_size: int = 3,
    key: str = "seq_id", order: str = "window_idx", chunk: int = CHUNK,
) -> DataFrame:
    """``key, penalty, first_window, end_window`` (exclusive): the segments for each penalty.

    Positions ``order`` count from 0 without gaps.
    """
    kind = track.schema[key].dataType.simpleString()
    parts = cut(
        track.where(F.col(order).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.floor(F.col(order) / chunk).cast("bigint").alias("_chunk"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(score).cast("double").alias("x")))).alias("_rows"))
        .select("_key", "_chunk", F.col("_rows")["x"].alias("_scores"))
    )
    levels = F.array(*[F.lit(float(p)) for p in penalties])
    waves = (parts.agg(F.max("_chunk").alias("m")).first()["m"] or 0) + 1

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            given = [(r[0], r[1], r[2], np.array(r[3], float), _first(r[2]) if r[4] is None else r[4:9]) for r in rows.itertuples(index=False)]
            for part in _alike([g[3] for g in given], [g[4] for g in given]):
                keys, numbers, levels_, scores, states = zip(*[given[n] for n in part], strict=True)
                made = advance(scores, np.array(numbers) * chunk, states, np.array(levels_), min_size)
                out = [(k, n, p, back, *state) for k, n, p, (back, state) in zip(keys, numbers, levels_, made, strict=True)]
                yield pd.DataFrame(out, columns=["_key", "_chunk", "_penalty", "_back", *_STATE])

    done, state = [], None
    for wave in range(waves):
        rows = parts.where(F.col("_chunk") == wave).select("_key", "_chunk", F.explode(levels).alias("_penalty"), "_scores")
        if state is None:
            rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (p.strip().split() for p in _STATE_SCHEMA.split(","))])
        else:
            same = state.select(F.col("_key").alias("_k"), F.col("_penalty").alias("_p"), *_STATE)
            rows = rows.join(same, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_penalty") == F.col("_p"))).drop("_k", "_p")
        rows = rows.repartition("_key", "_penalty")  # a row is a long loop: as many tasks as there are
        found = rows.mapInPandas(forward, f"_key {kind}, _chunk bigint, _penalty double, _back array<bigint>, {_STATE_SCHEMA}")
        found = cut(found)
        done.append(found.select("_key", "_chunk", "_penalty", "_back"))
        state = found.select("_key", "_penalty", *_STATE)
    # Back from the last position of each contig: ``_end`` is where the segments still to find end.
    ends = parts.groupBy("_key").agg(F.max(F.struct("_chunk", (F.col("_chunk") * chunk + F.size("_scores")).alias("n"))).alias("_last"))
    ends = cut(ends.select("_key", F.col("_last.n").alias("_end")).select("*", F.explode(levels).alias("_penalty")))

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key_, number, penalty, back, end in rows[["_key", "_chunk", "_penalty", "_back", "_end"]].itertuples(index=False):
                starts, stops, base = [], [], number * chunk
                while end > base:
                    stops.append(end)
                    end = int(back[end - base - 1])
                    starts.append(end)
                out.append((key_, penalty, starts, stops, end))
            yield pd.DataFrame(out, columns=["_key", "_penalty", "_starts", "_stops", "_end"])

    result = None
    schema = f"_key {kind}, _penalty double, _starts array<bigint>, _stops array<bigint>, _end bigint"
    for wave in reversed(range(waves)):
        mine = F.ceil(F.col("_end") / chunk) - 1 == wave
        way = done[wave].select(F.col("_key").alias("_k"), F.col("_penalty").alias("_p"), "_chunk", "_back")
        rows = ends.where(mine).join(way, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_penalty") == F.col("_p")))
        walked = cut(rows.mapInPandas(backward, schema))
        ends = cut(ends.where(~mine).unionByName(walked.where("_end > 0").select(*ends.columns))) if waves > 1 else ends
        some = walked.select("_key", "_penalty", F.explode(F.arrays_zip("_starts", "_stops")).alias("_s"))
        result = some if result is None else result.unionAll(some)
    return result.select(
        F.col("_key").alias(key), F.col("_penalty").alias("penalty"),
        F.col("_s._starts").alias("first_window"), F.col("_s._stops").alias("end_window"),
    )


def knee(sizes: Sequence[int]) -> int:
    """Index of the bend in falling numbers of segments, one for each rising penalty.

    Both axes are scaled to 0 to 1; the bend is where the curve lies furthest below the straight
    line between its ends, the first such place. A curve without a bend gives 0.
    """
    if len(sizes) < 3 or sizes[0] == sizes[-1]:
        return 0
    high, low, last = sizes[0], sizes[-1], len(sizes) - 1
    # Whole numbers: the distance times both spans.
    below = [(last - k) * (high - low) - (n - low) * last for k, n in enumerate(sizes)]
    best = max(below)
    return below.index(best) if best > 0 else 0


def _knee_column(sizes: Column) -> Column:
    """``knee`` of an array column."""
    last = F.size(sizes) - 1
    high, low = F.get(sizes, F.lit(0)), F.get(sizes, last)
    below = F.transform(sizes, lambda n, k: (last - k) * (high - low) - (n - low) * last)
    best = F.array_max(below)
    return F.when((last >= 2) & (best > 0), F.array_position(below, best) - 1).otherwise(0).cast("int")


def segment_by_changes(
    track: DataFrame, score: str, sensitivity: float = 1.5, penalties: Sequence[float] = tuple(range(1, 10)),
    min_size: int = 3, key: str = "seq_id", order: str = "window_idx", chunk: int = CHUNK,
) -> DataFrame:
    """``key, first_window, end_window, score``: regions from the change points of each contig.

    Of the penalties that leave more than one segment, the one at the bend of their numbers is
    taken. Segments with a mean score above ``sensitivity`` are regions; touching ones are merged,
    and the score is that of the merged region.
    """
    track = cut(track.select(key, order, score).where(F.col(order).isNotNull()))  # read three times
    segments = cut(change_points(track, score, penalties, min_size, key, order, chunk))
    counts = segments.groupBy(key, "penalty").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # One row for each penalty of a contig.
    listed = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("penalty", F.col("n").cast("bigint").alias("n")))).alias("_by"))
    chosen = listed.select(key, F.get("_by", _knee_column(F.col("_by.n")))["penalty"].alias("penalty"))
    kept = _mean_of(segments.join(chosen, [key, "penalty"]), track, score, key, order).where(F.col("score") > sensitivity)
    merged = merge_ranges(kept, [key], "first_window", "end_window", chunk)
    return _mean_of(merged, track, score, key, order).select(key, "first_window", "end_window", "score")


def _mean_of(ranges: DataFrame, track: DataFrame, score: str, key: str, order: str, width: int = 1 << 10) -> DataFrame:
    """Adds the mean ``score`` of the windows of each range; ranges and windows meet in strips."""
    last = F.floor((F.col("end_window") - 1) / width)
    strips = ranges.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("first_window") / width), last)))
    windows = track.select(
        F.col(key).alias("_k"), F.floor(F.col(order) / width).alias("_s"), F.col(order).alias("_w"), F.col(score).cast("double").alias("_x")
    )
    # So many parts that the windows sorted in one task are bounded.
    windows = windows.repartition(max(32, -(-track.count() // SORTED)), "_k", "_s")
    met = strips.join(windows, (F.col(key) == F.col("_k")) & (F.col("_strip") == F.col("_s")))
    inside = met.where((F.col("_w") >= F.col("first_window")) & (F.col("_w") < F.col("end_window")))
    return inside.groupBy(key, "first_window", "end_window").agg(F.avg("_x").alias("score"))
