"""Cases in which rows, depth or draws once ran out."""

import math
import tracemalloc

import pyarrow as pa
import pytest
from contigframe.operators import datasets, refine, scoring, taxonomy
from pyspark.sql import functions as F


def test_null_labels_keep_their_ranks(spark):
    rows = spark.range(30).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("label"))
    ranked = datasets.hash_rank(rows, ["label"], "id", 1).collect()
    assert len(ranked) == 30
    assert sorted(r["rank"] for r in ranked if r["label"] is None) == list(range(10))


def test_deep_and_cyclic_taxonomies(spark):
    chain = spark.createDataFrame([(i, max(i - 1, 0)) for i in range(200)], "taxid int, parent int")
    closure = taxonomy.ancestors(chain)
    assert closure.count() == 200 * 201 // 2
    assert closure.agg(F.max("distance")).first()[0] == 199
    with pytest.raises(ValueError, match="cycle"):
        taxonomy.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "taxid int, parent int"))


def test_coverage_is_reached_between_many_n(spark):
    text = "ACGT" * 250 + "N" * 9000
    rows = spark.createDataFrame([("a", text), ("b", "ACGT" * 50), ("c", "ACG")], "seq_id string, seq string")
    got = datasets.coverage_sampling(rows, 50, 100, 1.0, max_n=0.3, seed=1).collect()
    total = {k: sum(len(r["fragment"]) for r in got if r["seq_id"] == k) for k in "abc"}
    assert 10_000 <= total["a"] < 10_100 and 200 <= total["b"] < 300 and total["c"] == 0
    assert all(r["fragment"].count("N") <= 0.3 * len(r["fragment"]) for r in got)


@pytest.mark.parametrize("circular", [False, True])
def test_coverage_with_few_places(spark, circular):
    """One place of one length, a place in a far block, lengths without a place, and none at all."""
    one = "N" * 60 + "A" * 50 + "N" * 60
    far = "N" * 30_000 + "ACGT" * 30
    rows = [("one", one), ("far", far), ("none", "N" * 500), ("short", "ACGT"), ("exact", "A" * 50), (None, "ACGT" * 20)]
    df = spark.createDataFrame(rows, "seq_id string, seq string").where("seq_id IS NOT NULL")
    got = datasets.coverage_sampling(df, 50, 100, 1.0, circular, max_n=0.0, seed=3).collect()
    text = dict(rows)
    total = {k: sum(r.length for r in got if r.seq_id == k) for k, _ in rows}
    assert total["none"] == total["short"] == 0 and total["exact"] == 50
    assert 30_120 <= total["far"] < 30_220 and 170 <= total["one"] < 220
    for r in got:
        whole = text[r.seq_id] * (2 if circular else 1)
        assert r.fragment == whole[r.start : r.start + r.length] and "N" not in r.fragment
        assert 50 <= r.length <= 100 and (r.seq_id != "one" or (r.start, r.length) == (60, 50))
    assert len({(r.start, r.length) for r in got if r.seq_id == "far"}) > 100


def test_refining_without_limits_is_an_error(spark):
    df = spark.createDataFrame([("x", "y", 1.0, 1.0)], "top_class string, second_class string, top_score double, margin double")
    limits = spark.createDataFrame([("z", 0.0, 0.0)], "class string, tau_logit double, tau_margin double")
    with pytest.raises(Exception, match="no limits for class x"):
        refine.refine_windows(df, limits).collect()


def test_unseen_kmers_count_and_no_window_is_lost(spark):
    train = spark.createDataFrame([("A", "AAAA"), ("B", "ACGACG")], "label string, window string")
    profile = scoring.fit_kmer_profile(train, 2)
    rows = spark.createDataFrame([(1, "GGGG"), (2, "AANC"), (3, "N")], "w int, window string")
    got = {(r.w, r.label): r.score for r in scoring.score_kmer_profile(rows, profile, 2, ["w"]).collect()}
    assert len(got) == 6
    assert got[1, "A"] == pytest.approx(math.log(1 / 19)) and got[1, "B"] == pytest.approx(math.log(1 / 21))
    assert got[2, "A"] == pytest.approx(math.log(4 / 19)) and got[2, "B"] == pytest.approx(math.log(1 / 21))
    assert got[3, "A"] is None and got[3, "B"] is None


def test_blocks_and_fragments_are_held_a_few_at_a_time(spark, monkeypatch):
    """An Arrow batch of many blocks and a block with very many draws, as a large input has them."""
    steps, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: steps.append(f) or plain(self, f, schema))
    df = spark.createDataFrame([("a", "ACGT" * 20)], "seq_id string, seq string")
    datasets.coverage_sampling(df, 50, 100, 1.0, max_n=0.5)
    count, _, select = steps
    names = ["key", "_len", "_lengths", "block_start", "block"]
    lists = pa.array([range(200, 230)] * 2000, pa.list_(pa.int32()))
    ints = pa.array([5000] * 2000, pa.int32())
    many = pa.RecordBatch.from_arrays([pa.array(["a"] * 2000), ints, lists, pa.array([0] * 2000, pa.int32()), pa.array(["ACGT" * 1174] * 2000)], names)
    tracemalloc.start()
    assert sum(x.num_rows for x in count(iter([many]))) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6
    text = "".join("ACGT"[i % 7 % 4] for i in range(4000))
    draws = pa.array([[{"draw": i, "length": 50 + i % 51, "nth": i % 900} for i in range(10_000)]])
    one = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([4000], pa.int32()), pa.array([0], pa.int32()), pa.array([text]), draws], list("abcde"))
    assert max(x.num_rows for x in select(iter([one]))) <= datasets.FRAGMENTS_HELD
    got = pa.Table.from_batches(select(iter([one]))).to_pylist()
    assert [r["draw"] for r in got] == [*range(10_000)] and all(r["start"] == r["draw"] % 900 and r["fragment"] == text[r["start"] :][: r["length"]] for r in got)
