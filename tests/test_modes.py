"""Crop modes, splits and reuse of training sets, one-class errors, and the header check of readers."""

import gzip
import lzma
import random

import pytest
from contigframe.operators import metrics
from contigframe.operators import windows as W
from contigframe.plans import training
from contigframe.sources import sequences
from pyspark.sql import functions as F


def rows(spark, lengths):
    rng = random.Random(3)
    data = [(k, "".join(rng.choices("ACGT", k=n)), "x") for k, n in enumerate(lengths)]
    return spark.createDataFrame(data, "seq_id long, seq string, _plan string").drop("_plan"), {k: s for k, s, _ in data}


def variants(n, sizes, strides):
    out = []
    for size, stride in zip(sizes, strides, strict=True):
        starts = [0] if n <= size else sorted({*range(0, n - size + 1, stride), n - size})
        out += [(size, s) for s in starts]
    return out


def test_sampled_crops_are_single_variants(spark):
    df, text = rows(spark, [55, 100, 130, 19])
    sizes, strides = [40, 100], [20, 30]
    seen = {k: set() for k in text}
    for epoch in range(25):
        got = W.training_crops(df, sizes, strides, "sample", epoch, seed=4).collect()
        assert sorted(r.seq_id for r in got) == sorted(text)
        for r in got:
            assert (r.crop_size, r.start) in variants(len(text[r.seq_id]), sizes, strides)
            assert r.crop == text[r.seq_id][r.start : r.start + r.crop_size] and r.crop_len == len(r.crop)
            seen[r.seq_id].add((r.crop_size, r.start))
    for k in (0, 3):  # few variants: all of them come up
        assert seen[k] == set(variants(len(text[k]), sizes, strides))
    again = [W.training_crops(df.repartition(n), sizes, strides, "sample", 7, seed=4).select("seq_id", "start").collect() for n in (1, 5)]
    assert sorted(again[0]) == sorted(again[1])


def test_range_crops_have_any_length_and_start(spark):
    df, text = rows(spark, [300] * 80 + [30, 50])
    got = W.training_crops(df, [40, 100, 60], mode="range", epoch=1, seed=2).collect()
    for r in got:
        assert r.crop == text[r.seq_id][r.start : r.start + r.crop_size]
        assert r.crop_len == len(r.crop) and (r.crop_len == 30 if r.seq_id == 80 else 40 <= r.crop_len <= 100)
    assert len({r.crop_size for r in got}) > 30 and len({r.start for r in got}) > 40
    other = W.training_crops(df, [40, 100], mode="range", epoch=2, seed=2).select("seq_id", "start").collect()
    assert sorted(other) != sorted((r.seq_id, r.start) for r in got)
    whole = W.training_crops(df, [100], [50], "all").count()
    assert whole == W.multi_crops(df, [100], [50]).count()
    with pytest.raises(ValueError, match="unknown crop mode"):
        W.training_crops(df, [100], mode="other")


def scorer(df):
    share = F.length(F.translate("seq", "CGTN", "")) / F.length("seq")
    return df.withColumn("scores", F.array(share * 8 - 2, 2 - share * 8).cast("array<double>"))


def test_reliability_sets_are_split_and_kept(spark, tmp_path):
    rng = random.Random(1)
    data = [(k, "".join(rng.choices("ACGT", weights=[1 + 3 * (k % 2), 1, 1, 1], k=120)), 1 - k % 2) for k in range(60)]
    real = spark.createDataFrame(data, "seq_id long, seq string, label int")
    made = []

    def build():
        made.append(1)
        return training.split_reliability_set(real, scorer, 0.5, 30, 1.0, {"shuffle": True}, val_fraction=0.25, seed=3)

    settings = {"threshold": 0.5, "seed": 3}
    first = training.stored_set(spark, str(tmp_path / "set"), settings, build)
    n = first.count()
    assert n > 20 and first.where("split = 'val'").count() == int(n * 0.25)
    assert {r.reliable for r in first.select("reliable").distinct().collect()} == {0, 1}
    second = training.stored_set(spark, str(tmp_path / "set"), settings, build)
    assert made == [1] and sorted(second.collect()) == sorted(first.collect())
    with pytest.raises(ValueError, match="was made with"):
        training.stored_set(spark, str(tmp_path / "set"), {"threshold": 0.6, "seed": 3}, build)
    own = training.split_reliability_set(real.where("seq_id < 40"), scorer, 0.5, 30, 1.0, {"shuffle": True}, real.where("seq_id >= 40"), seed=3)
    kinds = {(r.split, r.reliable) for r in own.select("split", "reliable").distinct().collect()}
    assert {s for s, _ in kinds} == {"train", "val"}
    ids = {r.seq_id for r in own.where("split = 'val' AND reliable = 1").collect()}
    assert all(int(i) >= 40 for i in ids if i.isdigit())


def test_one_label_is_an_error(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.8, 1)], "score double, label int")
    assert 0.2 < metrics.tuned_threshold(df, "score", "label").first().threshold <= 0.8
    with pytest.raises(ValueError, match="both labels"):
        metrics.tuned_threshold(df.where("label = 1"), "score", "label")
    with pytest.raises(ValueError, match="both labels"):
        metrics.tuned_threshold(df.limit(0), "score", "label")


def test_readers_check_headers(spark, tmp_path):
    fasta = b">a\nACGT\n>b\nGG\n"
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "x.fa").write_bytes(fasta)
    (tmp_path / "good" / "y.fa.gz").write_bytes(gzip.compress(fasta))
    assert sequences.read_fasta(spark, str(tmp_path / "good")).count() == 4
    assert sorted(sequences.compression(spark, str(tmp_path / "good" / "*")).values()) == ["gzip", "none"]
    for name, data, said in (("x.xz", lzma.compress(fasta), "cannot be read"), ("x.fa", gzip.compress(fasta), "without its extension")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match=said):
            sequences.read_fasta(spark, str(tmp_path / name))
    (tmp_path / "short.fa").write_bytes(b">")
    assert sequences.compression(spark, str(tmp_path / "short.fa")) == {f"file:{tmp_path}/short.fa": "none"}
    with pytest.raises(FileNotFoundError):
        sequences.read_fasta(spark, str(tmp_path / "nothing"))
