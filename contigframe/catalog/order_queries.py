"""Queries that follow an order: runs, smoothing, ranges, tracks and regions.

The events form one single stream (one key holds every row), cut into short chunks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CLASSES
from ..operators import ordered as O
from ..operators.changes import change_points, segment_by_changes
from ..operators.lineage import cut
from ..operators.ranks import rank_rows
from ..operators.regions import (
    host_class,
    region_coordinates,
    score_track,
    segment_regions,
)
from ..plans.contigs import call_regions, score_sequences
from ..sources.tables import read_table
from .base import (
    CLASS_LIST,
    MIN_LEN,
    NUDGE,
    SIZE,
    STRIDE,
    argmax,
    register,
    scored,
    scorer,
    sequences,
    share_sql,
    softmax_sql,
)

CHUNK = 512
LONG = 2000


def _stream(spark, d):
    return read_table(spark, d, "events").select(
        F.lit(0).alias("stream"), "event_id", "user_id", "event_type", "value",
        (F.col("value") > 15).alias("high"),
    )


@register(
    "event_runs", "run_start:i run_length:i run_value:b",
    """SELECT min(event_id) AS run_start, count(*) AS run_length, high AS run_value FROM (
         SELECT event_id, high, event_id - row_number() OVER (PARTITION BY high ORDER BY event_id)
           AS grp FROM (SELECT *, value > 15 AS high FROM events)) GROUP BY high, grp""",
)
def _(spark, d):
    return O.find_runs(_stream(spark, d), ["stream"], "event_id", "high", CHUNK)


@register(
    "user_event_ranks", "user_id:i event_id:i rank:i",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1
       AS rank FROM events""",
)
def _(spark, d):
    return _ranked(spark, d)


def _ranked(spark, d):
    bucket = F.floor(F.col("event_id") / CHUNK)
    return rank_rows(_stream(spark, d), ["user_id"], ["event_id"], bucket)


@register(
    "consecutive_groups", "user_id:i event_id:i group_idx:i",
    """SELECT user_id, event_id, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS group_idx
       FROM (SELECT *, CASE WHEN event_id // 40 - lag(event_id // 40) OVER (
               PARTITION BY user_id ORDER BY event_id) <> 1 THEN 1 ELSE 0 END AS brk FROM events)""",
)
def _(spark, d):
    rows = _ranked(spark, d).withColumn("slot", F.floor(F.col("event_id") / 40))
    return O.consecutive_groups(rows, ["user_id"], "rank", "slot", 1, 16)


@register(
    "smoothed_events", "event_id:i sum4:d mean10:d mean5:d",
    """SELECT event_id,
         sum(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS sum4,
         sum(value) OVER (ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS mean10,
         sum(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS mean5
       FROM events""",
)
def _(spark, d):
    v = F.col("value")
    frames = {
        "sum4": ("sum", v, 2, 1), "_ten": ("sum", v, 5, 4), "_five": ("sum", v, 2, 2),
    }
    out = O.frame_over(_stream(spark, d), ["stream"], "event_id", frames, CHUNK)
    return out.withColumns({"mean10": F.col("_ten") / 10, "mean5": F.col("_five") / 5})


@register(
    "merged_ranges", "user_id:i start:i end:i",
    """WITH r AS (SELECT user_id, event_id AS s, event_id + floor(value * 8)::BIGINT AS e
                  FROM events),
            o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
            g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (
                    PARTITION BY user_id ORDER BY s) AS island FROM o)
       SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, island""",
)
def _(spark, d):
    rows = read_table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("start"),
        (F.col("event_id") + F.floor(F.col("value") * 8)).alias("end"),
    )
    return O.merge_ranges(rows, ["user_id"], chunk=CHUNK)


@register(
    "scaled_values", "event_id:i scaled:d",
    """SELECT event_id, (value - lo) / (hi - lo) * 2 - 1 AS scaled FROM (
         SELECT *, min(value) OVER (PARTITION BY event_type) AS lo,
                max(value) OVER (PARTITION BY event_type) AS hi FROM events)""",
)
def _(spark, d):
    return O.scale_range(_stream(spark, d), ["event_type"], "value", -1.0, 1.0, "scaled")


@register(
    "running_totals", "event_id:i total:d largest:d",
    """SELECT event_id, sum(value) OVER (ORDER BY event_id) AS total,
              max(value) OVER (ORDER BY event_id) AS largest FROM events""",
)
def _(spark, d):
    return O.running(
        _stream(spark, d), ["stream"], "event_id",
        {"total": ("sum", "value"), "largest": ("max", "value")}, CHUNK,
    )


@register(
    "local_peaks", "event_id:i peak:b",
    """SELECT event_id, coalesce(value > lag(value) OVER w, false)
                        OR coalesce(value >= lead(value) OVER w, false) AS peak
       FROM events WINDOW w AS (ORDER BY event_id)""",
)
def _(spark, d):
    return O.local_peaks(_stream(spark, d), ["stream"], "event_id", "value", "peak", CHUNK)


@register(
    "marked_ends", "user_id:i event_id:i is_first:b is_last:b",
    """SELECT user_id, event_id, lag(event_id) OVER w IS NULL AS is_first,
              lead(event_id) OVER w IS NULL AS is_last
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def _(spark, d):
    return O.mark_ends(_ranked(spark, d), ["user_id"], "rank")


# ---- tracks and regions -------------------------------------------------------------------

_SUMS = ", ".join(
    f"sum(p[{i + 1}]) OVER (PARTITION BY seq_id ORDER BY window_idx "
    f"ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS {c}"
    for i, c in enumerate(CLASSES)
)

share_sql(
    "track", "scored",
    f"""WITH p AS (SELECT *, {softmax_sql('scores')} AS p FROM scored WHERE seq_len >= {LONG}),
             m AS (SELECT *, {_SUMS}, sum(gc_skew) OVER (PARTITION BY seq_id ORDER BY window_idx
                     ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS sk FROM p),
             h AS (SELECT seq_id, {CLASS_LIST}[{argmax('a')} + 1] AS host FROM (
                     SELECT seq_id, [{", ".join(f"avg(p[{i + 1}])" for i in range(6))}] AS a
                     FROM p GROUP BY seq_id))
        SELECT *, least(window_idx * {STRIDE}, seq_len) AS position,
               (g + c)::DOUBLE / {SIZE} AS gc,
               CASE WHEN hi - lo < 1e-12 THEN -1.0 ELSE (sk - lo) / (hi - lo) * 2 - 1 END
                 AS skew_track
        FROM (SELECT *, min(sk) OVER (PARTITION BY seq_id) AS lo,
                     max(sk) OVER (PARTITION BY seq_id) AS hi FROM m) JOIN h USING (seq_id)""",
)


def _track(spark, d, chunk=16):
    return score_track(scored(spark, d), CLASSES, SIZE, STRIDE, LONG, chunk=chunk)


@register(
    "score_tracks",
    "seq_id:i window_idx:i position:i host:s gc:d skew_track:d "
    + " ".join(f"{c}:d" for c in CLASSES),
    "SELECT * FROM track", "track",
)
def _(spark, d):
    return _track(spark, d)


_HIGH = 0.9

share_sql(
    "regions", "track",
    f"""SELECT seq_id, min(window_idx) AS first_window, max(window_idx) + 1 AS end_window,
              avg(eukarya) AS score, any_value(seq_len) AS seq_len
        FROM (SELECT *, window_idx - row_number() OVER (PARTITION BY seq_id ORDER BY window_idx)
                AS grp FROM track WHERE eukarya > {_HIGH})
        GROUP BY seq_id, grp HAVING count(*) >= 3""",
)


def _regions(spark, d):
    return segment_regions(_track(spark, d), "eukarya", _HIGH, 3, chunk=16)


@register(
    "segmented_regions", "seq_id:i first_window:i end_window:i score:d",
    "SELECT * FROM regions", "regions",
)
def _(spark, d):
    return _regions(spark, d)


share_sql(
    "placed", "regions",
    f"""SELECT *, greatest(0, least(first_window * {STRIDE}, seq_len)) AS start,
               greatest(0, least((end_window - 1) * {STRIDE} + {SIZE}, seq_len)) AS stop
        FROM regions""",
)


# Scores are rounded alike, so that two cuts of equal cost are equal on both sides.
_CHANGE_SQL = f"""WITH RECURSIVE
  seen AS (SELECT seq_id, window_idx, round(eukarya + {NUDGE}, 6) AS x FROM track),
  sums AS (SELECT seq_id, count(*) AS n, [0.0::DOUBLE] || list(one ORDER BY window_idx) AS one,
             [0.0::DOUBLE] || list(two ORDER BY window_idx) AS two
           FROM (SELECT *, sum(x) OVER w AS one, sum(x * x) OVER w AS two FROM seen
                 WINDOW w AS (PARTITION BY seq_id ORDER BY window_idx)) GROUP BY seq_id),
  best AS (
    SELECT seq_id, n, penalty, 0::BIGINT AS t, [-penalty] AS cost, [0::BIGINT] AS back
    FROM sums, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (3.0::DOUBLE)) AS p(penalty)
    UNION ALL
    SELECT seq_id, n, penalty, t + 1, list_append(cost, round(least_cost + penalty, 9)),
           list_append(back, coalesce(list_max(list_filter(range(0, t - 1), lambda s: found[s + 1] = least_cost)), 0))
    FROM (SELECT *, list_min(found) AS least_cost FROM (
      SELECT best.*, list_transform(range(0, t - 1), lambda s: round(cost[s + 1] + (two[t + 2] - two[s + 1])
               - (one[t + 2] - one[s + 1]) * (one[t + 2] - one[s + 1]) / (t + 1 - s), 9)) AS found
      FROM best JOIN sums USING (seq_id) WHERE t < best.n))),
  part AS (
    SELECT seq_id, penalty, back[n + 1] AS first_window, n AS end_window, back FROM best WHERE t = n
    UNION ALL
    SELECT seq_id, penalty, back[first_window + 1], first_window, back FROM part WHERE first_window > 0)"""


def _rounded_track(spark, d):
    return _track(spark, d).withColumn("eukarya", F.round(F.col("eukarya") + NUDGE, 6))


@register(
    "change_points", "seq_id:i penalty:d first_window:i end_window:i",
    f"{_CHANGE_SQL} SELECT seq_id, penalty, first_window, end_window FROM part", "track",
)
def _(spark, d):
    return change_points(_rounded_track(spark, d), "eukarya", [0.5, 1, 3], chunk=64)


@register(
    "change_regions", "seq_id:i first_window:i end_window:i score:d",
    f"""{_CHANGE_SQL},
        counts AS (SELECT seq_id, list(n ORDER BY penalty) AS n, list(penalty ORDER BY penalty) AS penalty
                   FROM (SELECT seq_id, penalty, count(*) AS n FROM part GROUP BY seq_id, penalty HAVING count(*) > 1)
                   GROUP BY seq_id),
        bend AS (SELECT *, list_transform(range(0, len(n)), lambda k:
                   (len(n) - 1 - k) * (n[1] - n[-1]) - (n[k + 1] - n[-1]) * (len(n) - 1)) AS below FROM counts),
        chosen AS (SELECT seq_id, penalty[CASE WHEN len(n) > 2 AND list_max(below) > 0
                     THEN list_position(below, list_max(below)) ELSE 1 END] AS penalty FROM bend),
        high AS (SELECT seq_id, first_window, end_window FROM part JOIN chosen USING (seq_id, penalty)
                 JOIN seen USING (seq_id) WHERE window_idx >= first_window AND window_idx < end_window
                 GROUP BY ALL HAVING avg(x) > {_HIGH}),
        island AS (SELECT *, sum(fresh) OVER (PARTITION BY seq_id ORDER BY first_window) AS i FROM (
                     SELECT *, CASE WHEN lag(end_window) OVER (PARTITION BY seq_id ORDER BY first_window) = first_window
                       THEN 0 ELSE 1 END AS fresh FROM high)),
        merged AS (SELECT seq_id, min(first_window) AS first_window, max(end_window) AS end_window FROM island GROUP BY seq_id, i)
        SELECT seq_id, first_window, end_window, avg(x) AS score FROM merged JOIN seen USING (seq_id)
        WHERE window_idx >= first_window AND window_idx < end_window GROUP BY ALL""",
    "track",
)
def _(spark, d):
    return segment_by_changes(_rounded_track(spark, d), "eukarya", _HIGH, [0.5, 1, 3], chunk=64)


def placed(spark, d):
    lengths = sequences(spark, d).select("seq_id", F.length("seq").alias("seq_len"))
    return region_coordinates(_regions(spark, d).join(lengths, "seq_id"), SIZE, STRIDE)


@register(
    "region_coordinates", "seq_id:i start:i end:i score:d",
    "SELECT *, stop AS \"end\" FROM placed", "placed",
)
def _(spark, d):
    return placed(spark, d)


@register(
    "host_classes", "seq_id:i host:s",
    "SELECT DISTINCT seq_id, host FROM track", "track",
)
def _(spark, d):
    from ..functions.scores import softmax

    rows = scored(spark, d).where(F.col("seq_len") >= LONG)
    return host_class(rows.withColumn("p", softmax(F.col("scores"))), CLASSES, "seq_id", "p")


@register(
    "called_regions",
    "contig_id:i seq_len:i region_len:i phage_score:d sstart:i eend:i att_type:s "
    "att_alignment_length:i",
)
def _(spark, d):
    # Read for windows, reading frames, borders and bodies: written, so that no text is mapped again.
    rows = cut(sequences(spark, d).select("seq_id", "seq"))
    windows = score_sequences(rows, scorer(), SIZE, STRIDE, MIN_LEN, mask=False)
    return call_regions(rows, windows, CLASSES, "eukarya", SIZE, STRIDE, LONG, _HIGH)
