"""Ordered operators, with chunks so short that every result crosses a border."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigframe.operators import decode, regions
from contigframe.operators import ordered as O
from contigframe.operators.ranks import (
    exact_quantiles,
    hash_bucket,
    rank_rows,
    totals_before,
)
from contigframe.operators.regions import orf_intervals, segment_regions, snap_boundaries
from contigframe.functions.picks import row_hash

CHUNKS = [3, 1000]


def series(spark, values, name="v"):
    rows = [(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)]
    kind = "double" if isinstance(rows[0][2], float) else "int"
    return spark.createDataFrame(rows, f"k string, i int, {name} {kind}")


@pytest.mark.parametrize("chunk", CHUNKS)
def test_runs(spark, chunk):
    rng = random.Random(1)
    values = {"a": [1, 1, 2, 2, 2, 3], "b": [rng.randint(0, 1) for _ in range(40)], "c": [7] * 11}
    got = {}
    for r in O.find_runs(series(spark, values), ["k"], "i", "v", chunk).collect():
        got.setdefault(r.k, []).append((r.run_start, r.run_length, r.run_value))
    for k, vs in values.items():
        at, expected = 0, []
        for v, g in itertools.groupby(vs):
            n = len(list(g))
            expected.append((at, n, v))
            at += n
        assert sorted(got[k]) == expected


@pytest.mark.parametrize("chunk", CHUNKS)
def test_window_summary(spark, chunk):
    names = ["phage"] * 5 + ["bacteria"] + ["Virus"] * 2 + ["eukarya"] * 13
    rows = spark.createDataFrame([("c", i, n) for i, n in enumerate(names)], "k string, i int, v string")
    assert O.window_summary(rows, ["k"], "i", "v", chunk=chunk).first()[1] == "5P1b2V13e"
    assert O.viral_summary(rows, ["k"], "i", "v", "phage", chunk).first()[1] == "5V16n"


@pytest.mark.parametrize("chunk", CHUNKS)
def test_smoothing_equals_convolution(spark, chunk):
    rng = np.random.default_rng(0)
    values = {"a": rng.normal(size=23).tolist(), "b": rng.normal(size=12).tolist()}
    for width in (4, 5, 10):
        got = O.smooth(series(spark, values), ["k"], "i", "v", width, "s", False, chunk).collect()
        for k, vs in values.items():
            mine = [r.s for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)]
            assert np.allclose(mine, np.convolve(vs, np.ones(width), mode="same"))


@pytest.mark.parametrize("chunk", [2, 5, 100])
def test_running(spark, chunk):
    values = {"a": [3, -1, 4, 1, -5, 9, 2], "b": [2, 7]}
    got = O.running(
        series(spark, values), ["k"], "i", {"s": ("sum", "v"), "m": ("max", "v")}, chunk
    ).collect()
    for k, vs in values.items():
        mine = sorted((r.i, r.s, r.m) for r in got if r.k == k)
        assert mine == [(i, sum(vs[: i + 1]), max(vs[: i + 1])) for i in range(len(vs))]


@pytest.mark.parametrize("chunk", [4, 1000])
def test_merge_ranges(spark, chunk):
    rng = random.Random(3)
    ranges = [("g", 1, 5), ("g", 4, 10), ("g", 12, 15)]
    for _ in range(60):
        a = rng.randint(0, 150)
        ranges.append(("r", a, a + rng.randint(0, 9)))
    df = spark.createDataFrame(ranges, "k string, start int, end int")
    got = sorted((r.k, r.start, r.end) for r in O.merge_ranges(df, ["k"], chunk=chunk).collect())
    expected = []
    for k, a, b in sorted(ranges):
        if expected and expected[-1][0] == k and a <= expected[-1][2]:
            expected[-1][2] = max(b, expected[-1][2])
        else:
            expected.append([k, a, b])
    assert got == [tuple(e) for e in expected]


def test_consecutive_groups(spark):
    got = O.consecutive_groups(
        series(spark, {"a": [1, 2, 3, 5, 6, 10]}), ["k"], "i", "v", 1, 2
    ).collect()
    assert [r.group_idx for r in sorted(got, key=lambda r: r.i)] == [0, 0, 0, 1, 1, 2]


def test_scale_and_constant(spark):
    got = O.scale_range(series(spark, {"a": [1, 3, 5], "b": [2, 2]}), ["k"], "v", -1, 1, "s").collect()
    assert sorted((r.k, r.s) for r in got) == [("a", -1), ("a", 0), ("a", 1), ("b", -1), ("b", -1)]


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, id long").withColumn("h", row_hash("id"))
    got = rank_rows(df, ["k"], ["h", "id"], hash_bucket("h", 4), "r").collect()
    for k in "ab":
        mine = sorted((r.h, r.id, r.r) for r in got if r.k == k)
        assert [m[2] for m in mine] == list(range(len(mine)))
    everywhere = rank_rows(df, [], ["h", "id"], hash_bucket("h", 4), "r").collect()
    assert [r.r for r in sorted(everywhere, key=lambda r: (r.h, r.id))] == list(range(500))


def test_quantiles_and_totals(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.exponential(size=700), "b": np.r_[np.zeros(300), rng.normal(size=50)]}
    rows = [(k, float(x)) for k, vs in values.items() for x in vs]
    df = spark.createDataFrame(rows, "k string, x double")
    for r in exact_quantiles(df, ["k"], "x", [0.0, 0.05, 0.5, 0.975, 1.0]).collect():
        assert r.value == pytest.approx(np.quantile(values[r.k], r.prob), abs=1e-12)
        assert r.n == len(values[r.k])
    counts = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    for r in totals_before(counts, ["k"], "x", ["n"]).collect():
        assert r.n_before == int((values[r.k] < r.x).sum()) and r.n_total == len(values[r.k])


def viterbi(z, costs):
    z = np.asarray(z, float)
    em = z - np.log(np.exp(z).sum(1, keepdims=True))
    best = max(
        itertools.product(range(z.shape[1]), repeat=len(z)),
        key=lambda p: sum(em[t, c] for t, c in enumerate(p))
        - sum(costs[a][b] for a, b in zip(p, p[1:])),
    )
    return list(best)


@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_joint_decoding_is_the_best_path(spark, chunk):
    rng = np.random.default_rng(8)
    classes = ["bacteria", "phage", "eukarya"]
    costs = decode.transition_costs(classes, 0.7)
    data = {k: rng.normal(size=(n, 3)) * 1.5 for k, n in enumerate([1, 2, 5, 7, 8])}
    rows = [(k, i, z.tolist()) for k, zs in data.items() for i, z in enumerate(zs)]
    df = spark.createDataFrame(rows, "seq_id long, window_idx int, scores array<double>")
    got = decode.viterbi_labels(df, costs, chunk=chunk).collect()
    for k, zs in data.items():
        mine = [r.decoded for r in sorted((r for r in got if r.seq_id == k), key=lambda r: r.window_idx)]
        assert mine == viterbi(zs, costs)


@pytest.mark.parametrize("run", [3, 64])
def test_joint_decoding_of_a_thousand_chunks(spark, monkeypatch, run):
    """The tree of products gives the path of one pass over all windows, in runs of few matrices."""
    monkeypatch.setattr(decode, "RUN", run)
    costs = decode.transition_costs(["bacteria", "phage", "eukarya"], 0.7)
    z = np.random.default_rng(3).normal(size=(3000, 3)) * 1.2
    em = z - np.log(np.exp(z).sum(1, keepdims=True))
    score, back = em[0], []
    for e in em[1:]:
        through = score[:, None] - np.asarray(costs)
        back.append(through.argmax(axis=0))
        score = through.max(axis=0) + e
    path = [int(score.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    rows = [(7, i, v.tolist()) for i, v in enumerate(z)] + [(8, i, v.tolist()) for i, v in enumerate(z[:4])]
    df = spark.createDataFrame(rows, "seq_id long, window_idx int, scores array<double>")
    got = sorted((r.window_idx, r.decoded) for r in decode.viterbi_labels(df, costs, chunk=3).where("seq_id = 7").collect())
    assert [c for _, c in got] == path[::-1]


@pytest.mark.parametrize(
    "labels, cost, expected",
    [
        ([0, 0, 0, 1, 0, 0, 0], 6.0, [0] * 7),
        ([0, 0, 0, 1, 0, 0, 0], 4.0, [0, 0, 0, 1, 0, 0, 0]),
        ([0, 0, 1, 1, 1, 0, 0], 6.0, [0, 0, 1, 1, 1, 0, 0]),
    ],
)
def test_decoding_flips(spark, labels, cost, expected):
    rows = [(1, i, [10.0 * (c == 0), 10.0 * (c == 1)]) for i, c in enumerate(labels)]
    df = spark.createDataFrame(rows, "seq_id long, window_idx int, scores array<double>")
    costs = decode.transition_costs(["x", "y"], cost)
    got = sorted(decode.viterbi_labels(df, costs, chunk=3).collect(), key=lambda r: r.window_idx)
    assert [r.decoded for r in got] == expected


def test_binary_decoding(spark):
    rows = [(1, i, z) for i, z in enumerate([-1.5, -1.5, 1.5, -1.5, -1.5])]
    df = spark.createDataFrame(rows, "seq_id long, window_idx int, z double")
    two = df.withColumn("scores", decode.binary_as_two("z"))
    for cost, expected in ((0.0, [0, 0, 1, 0, 0]), (2.0, [0] * 5)):
        costs = decode.transition_costs(["cell", "virus_x"], cost)
        got = sorted(decode.viterbi_labels(two, costs).collect(), key=lambda r: r.window_idx)
        assert [r.decoded for r in got] == expected


def test_transition_costs():
    names = ["bacteria", "phage", "eukarya", "virus"]
    costs = decode.transition_costs(names, 2.0)
    assert costs[0][1] == costs[1][0] == 1.0 and costs[2][1] == 6.0 and costs[0][3] == 2.0
    assert all(costs[i][i] == 0 for i in range(4))
    assert decode.transition_costs(["x", "y"], 3.0) == [[0, 3], [3, 0]]
    assert decode.transition_costs(names, 1.0, user={"bacteria": {"phage": 9}})[1][0] == 9


@pytest.mark.parametrize("chunk", [2, 100])
def test_regions(spark, chunk):
    scores = [0.1, 2.0, 2.5, 3.0, 0.2, 2.0, 2.0, 0.1, 2.0, 2.0, 2.0, 2.0]
    track = spark.createDataFrame(
        [(1, i, s) for i, s in enumerate(scores)], "seq_id long, window_idx int, phage double"
    )
    got = segment_regions(track, "phage", 1.5, 3, chunk=chunk).collect()
    assert sorted((r.first_window, r.end_window, r.score) for r in got) == [(1, 4, 2.5), (8, 12, 2.0)]


@pytest.mark.parametrize("bucket", [16, 100000])
def test_snapping(spark, bucket):
    def snap(regions, genes, limit):
        r = spark.createDataFrame(regions, "seq_id long, start long, end long, seq_len long")
        g = spark.createDataFrame(genes, "seq_id long, start long, end long")
        got = snap_boundaries(r, g, limit, bucket=bucket).collect()
        return [(x.refined_start, x.refined_end) for x in got]

    assert snap([(1, 150, 150, 999)], [(1, 100, 200)], None) == [(100, 200)]
    assert snap([(1, 900, 100, 5000)], [(1, 0, 1000)], 50) == [(850, 150)]
    assert snap([(1, 50, 200, 999)], [(1, 100, 200), (2, 0, 999)], None) == [(50, 200)]


def brute_orfs(s, min_len):
    out = set()
    back = s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    for strand, t in (("+", s), ("-", back)):
        for frame in range(3):
            first = None
            for i in range(frame, len(t) - 2, 3):
                codon = t[i : i + 3]
                if codon == "ATG" and first is None:
                    first = i
                elif codon in ("TAA", "TAG", "TGA"):
                    if first is not None and i + 3 - first >= min_len:
                        a, b = first, i + 3
                        out.add((strand, a, b) if strand == "+" else (strand, len(t) - b, len(t) - a))
                    first = None
    return out


@pytest.mark.parametrize("chunk", [50, 1 << 18])
def test_open_reading_frames(spark, chunk):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randint(2, 1500)))) for i in range(6)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    got = orf_intervals(df, 30, chunk=chunk).collect()
    for i, s in rows:
        assert {(r.strand, r.start, r.end) for r in got if r.seq_id == i} == brute_orfs(s, 30)


def test_few_codons_become_rows(spark, monkeypatch):
    """Frames inside a block and over block borders; only a block's outer starts and stops are carried along."""
    rng = random.Random(4)
    long = "".join(rng.choice("ACGT") for _ in range(40_000))
    far = "ATG" + "GCC" * 6_000 + "TAA" + "N" * 50 + "TTA" + "GCC" * 5_000 + "CAT"
    rows = [(1, long), (None, far), (3, "ACGTN" * 9), (4, "AT"), (5, None)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    carried = []
    monkeypatch.setattr(regions, "running", lambda events, *a, **b: carried.append(events.count()) or O.running(events, *a, **b))
    got = orf_intervals(df, 30).collect()
    for i, s in rows:
        assert {(r.strand, r.start, r.end) for r in got if r.seq_id == i} == brute_orfs(s or "", 30)
    n_blocks = sum(len(s or "") // regions.CODON_BLOCK + 1 for _, s in rows)
    assert len(got) == len({(r.seq_id, r.strand, r.start, r.end) for r in got}) and carried[0] <= 24 * n_blocks
