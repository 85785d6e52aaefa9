"""Change points against the full quadratic search."""

import random

import numpy as np
import pytest
from contigframe.operators import changes
from pyspark.sql import functions as F


def brute(x, penalty, min_size=3):
    """Starts of the last segments by looking at every pair of positions."""
    n = len(x)
    best, back = [-penalty] + [None] * n, [0] * (n + 1)
    for t in range(min_size, n + 1):
        found = []
        for s in range(t - min_size + 1):
            if best[s] is not None:
                part = x[s:t]
                found.append((round(best[s] + float(((part - part.mean()) ** 2).sum()), 9), -s))
        if found:
            value, s = min(found)
            best[t], back[t] = round(value + penalty, 9), -s
    out, t = [], n
    while t > 0:
        out.append((back[t], t))
        t = back[t]
    return out[::-1]


def tracks():
    rng = random.Random(1)
    levels = [0.0, 2.0, 0.5, 4.0, 0.5, 3.0]
    steps = np.concatenate([np.full(50, v) for v in levels])
    noise = np.array([rng.gauss(0, 0.7) for _ in steps])
    return {
        "steps": steps + noise, "flat": np.ones(300), "ties": steps, "noise": noise * 2, "short": np.array([1.0, 5.0]),
        "three": np.array([0.0, 9.0, 0.0]), "six": np.array([0.0, 0, 0, 5, 5, 5]), "saw": np.array([0.0, 1.0] * 40),
    }


@pytest.fixture(scope="module")
def table(spark):
    rows = [(name, k, float(v)) for name, x in tracks().items() for k, v in enumerate(x)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "seq_id string, window_idx int, eukarya double").cache()


@pytest.mark.parametrize("chunk", [1 << 16, 64])
def test_segments_are_those_of_the_full_search(table, chunk):
    got = {}
    for r in changes.change_points(table, "eukarya", [1, 2, 5, 9], chunk=chunk).collect():
        got.setdefault((r.seq_id, r.penalty), []).append((r.first_window, r.end_window))
    want = {(name, float(p)): brute(x, p) for name, x in tracks().items() for p in (1, 2, 5, 9)}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert want["flat", 1.0] == [(0, 300)] and len(want["ties", 1.0]) == 6


def test_bends():
    assert changes.knee([9, 3, 2, 2, 2]) == 1
    assert changes.knee([40, 38, 9, 8, 7, 7]) == 2
    assert changes.knee([5, 5, 5]) == changes.knee([5]) == changes.knee([6, 4, 2]) == 0


def test_regions_of_changes(table):
    got = {}
    for r in changes.segment_by_changes(table, "eukarya", 1.5).collect():
        got.setdefault(r.seq_id, []).append((r.first_window, r.end_window, round(r.score, 9)))
    want = {}
    for name, x in tracks().items():
        cuts = [c for c in (brute(x, p) for p in range(1, 10)) if len(c) > 1]
        if not cuts:
            continue
        regions = []
        for s, e in cuts[changes.knee([len(c) for c in cuts])]:
            if x[s:e].mean() > 1.5:
                if regions and regions[-1][1] == s:
                    regions[-1][1] = e
                else:
                    regions.append([s, e])
        if regions:
            want[name] = [(s, e, round(float(x[s:e].mean()), 9)) for s, e in regions]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [r[:2] for r in want["ties"]] == [(50, 100), (150, 200), (250, 300)]


def test_one_long_contig_runs_in_waves(spark):
    """A state goes from chunk to chunk; few candidates are left at any time."""
    n = 60_000
    df = spark.range(n).select(
        F.lit(1).alias("seq_id"), F.col("id").alias("window_idx"),
        (F.floor(F.col("id") / 5000) % 2 * 3 + (F.col("id") * 7919 % 101) / 101).cast("double").alias("x"),
    )
    got = changes.change_points(df, "x", [30, 50], chunk=1 << 14).collect()
    for p in (30.0, 50.0):
        assert sorted((r.first_window, r.end_window) for r in got if r.penalty == p) == [(k, k + 5000) for k in range(0, n, 5000)]
