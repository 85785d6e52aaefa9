"""Groups without a key: no operator loses their rows, and large groups need no task of their own."""

import random
from collections import Counter

import pytest
from contigframe.operators import datasets, metrics, ordered, ranks
from contigframe.operators.skew import salted_join
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the labels is missing."""
    data = [(k, [None, "a", "b"][k % 3], float(k * 7 % 30), k // 3) for k in range(30)]
    return spark.createDataFrame(data, "id long, label string, x double, pos long").cache()


def test_interleaving_keeps_every_row(rows):
    got = datasets.interleave_classes(rows, "id", "label").collect()
    assert sorted(r.id for r in got) == list(range(30))
    assert sorted(r.position for r in got) == list(range(30))
    order = [r.label for r in sorted(got, key=lambda r: r.position)]
    assert all(len(set(order[i : i + 3])) == 3 for i in range(0, 30, 3))


def test_downsampling_keeps_the_shares(spark, rows):
    for n, each in ((15, 5), (20, 7), (40, 10)):  # shares are rounded label by label
        size = spark.createDataFrame([(n,)], "n long")
        got = Counter(r.label for r in datasets.downsample_to_match(rows, "label", "id", size).collect())
        assert got == {None: each, "a": each, "b": each}


def test_ranks_sort_ids_alone(spark, rows, monkeypatch):
    """No other column lies below the exchange of a rank; repeated ids have ranks of their own."""
    wide = rows.withColumn("text", F.repeat(F.lit("x"), 100))
    for limit in (1 << 16, 4):
        monkeypatch.setattr(ranks, "BUCKET_ROWS", limit)
        got = datasets.hash_rank(wide.unionAll(wide.where("id < 6")), ["label"], "id", 1).collect()
        assert Counter((r.label, r["rank"]) for r in got) == Counter((x, k) for x in (None, "a", "b") for k in range(12))
        plain = datasets.hash_rank(wide, [], "id", 1)
        assert sorted(r["rank"] for r in plain.collect()) == list(range(30))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Window" in line and "text" in line for line in plan.splitlines())


def test_samples_shards_and_batches(rows):
    assert Counter(r.label for r in datasets.stratified_sample(rows, "label", "id", 15).collect()) == {None: 5, "a": 5, "b": 5}
    shards = Counter((r.label, r.shard) for r in datasets.assign_shards(rows, "id", "label", 5).collect())
    assert set(shards.values()) == {2} and len(shards) == 15
    lengths = rows.withColumn("n", F.when(F.col("label") == "a", 4).when(F.col("label") == "b", 5))
    got = Counter(r.n for r in datasets.length_batches(lengths, "id", "n", {4: 4}, 5).collect())
    assert got == {None: 10, 5: 10, 4: 8}


def test_running_scaled_and_marked(rows):
    got = ordered.running(rows, ["label"], "pos", {"s": ("sum", "x")}, chunk=3).collect()
    assert len(got) == 30
    for r in got:
        assert r.s == sum(float(k * 7 % 30) for k in range(30) if k % 3 == r.id % 3 and k <= r.id)
    assert ordered.scale_range(rows, ["label"], "x", 0.0, 1.0, "y").where("y BETWEEN 0 AND 1").count() == 30
    assert ordered.mark_ends(rows, ["label"], "pos").where("is_last").count() == 3


def test_salted_join_meets_null_keys(spark, rows):
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    assert salted_join(rows, sizes, ["label"], ["id"]).where("n = 10").count() == 30
    assert salted_join(rows, sizes.where("label IS NULL"), ["label"], ["id"], how="left_anti").count() == 20


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("limit", [1 << 16, 8])
def test_quantiles_of_every_group(spark, monkeypatch, limit):
    """With a small limit, brackets are narrowed over several rounds."""
    monkeypatch.setattr(ranks, "BUCKET_ROWS", limit)
    monkeypatch.setattr(ranks, "PARTS", 4)
    rng = random.Random(limit)
    data = [(None, rng.gauss(0, 1)) for _ in range(300)] + [("half", 0.5 if k % 2 else rng.random() ** 9) for k in range(400)]
    data += [("one", 3.0), ("flat", 1.0), ("flat", 1.0), ("gone", None), (None, None)] + [("many", float(k % 90)) for k in range(180)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = [0.0, 0.05, 0.5, 0.501, 0.99, 1.0]
    got = {(r.g, r.prob): (r.value, r.n) for r in ranks.exact_quantiles(df, ["g"], "x", probs).collect()}
    groups = {g: [x for h, x in data if h == g and x is not None] for g, _ in data}
    assert got.keys() == {(g, p) for g, v in groups.items() if v for p in probs}
    for (g, p), (value, n) in got.items():
        assert n == len(groups[g]) and value == pytest.approx(quantile(groups[g], p), abs=1e-12)
    every = [x for _, x in data if x is not None]
    whole = ranks.exact_quantiles(df, [], "x", [0.25]).first()
    assert whole.value == pytest.approx(quantile(every, 0.25)) and whole.n == len(every)
    shares = metrics.score_distributions(df.withColumn("y", F.col("x")), "g", ["x", "y"], [0.5]) if hasattr(metrics, "score_distributions") else None
    assert shares is None or shares.where("g IS NULL").count() == 2


def test_quantiles_of_one_large_group(spark):
    """Ten million rows in one group, half of them one value."""
    n = 10_000_000
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = {r.prob: r.value for r in ranks.exact_quantiles(df, [], "x", [0.25, 0.5, 0.75, 1.0]).collect()}
    assert got == {0.25: -1.0, 0.5: pytest.approx(0.0), 0.75: pytest.approx(n / 2, rel=1e-6), 1.0: n - 1}


@pytest.mark.parametrize("limit", [1 << 16, 20])
def test_totals_before_every_value(spark, monkeypatch, limit):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", limit)
    rng = random.Random(3)
    data = [(g, x, rng.randint(1, 5)) for g in (None, "a", "b") for x in rng.sample(range(1000), 60)]
    got = ranks.totals_before(spark.createDataFrame(data, "g string, x int, w int"), ["g"], "x", ["w"]).collect()
    assert len(got) == len(data)
    for r in got:
        own = [(x, w) for g, x, w in data if g == r.g]
        assert r.w_total == sum(w for _, w in own) and r.w_before == sum(w for x, w in own if x < r.x)
