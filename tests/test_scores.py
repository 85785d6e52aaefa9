"""Golden values of summaries, refinement and evaluation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contigframe.functions import scores as S
from contigframe.operators import metrics as M
from contigframe.operators import refine, scoring, summary
from contigframe.plans.contigs import evaluate_sample

SIX = ["phage", "virus", "archaea", "bacteria", "plasmid", "eukarya"]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_stable_functions(spark):
    row = one(
        spark, S.log_sum_exp(arr(1000, 1000)), S.softmax(arr(0, 0)), S.sigmoid(F.lit(-800.0)),
        S.energy(arr(1, 2)), S.energy(arr(3)), S.energy(arr(1, 2, 3)), S.zscore(arr(1, 3)),
        S.l2_normalize(arr(3, 4)), S.binary_entropy(F.lit(0.5)), S.zscore(arr(2, 2)),
    )
    assert row[0] == pytest.approx(1000 + math.log(2))
    assert row[1] == [0.5, 0.5] and row[2] == 0.0
    assert row[3] == pytest.approx(-math.log(math.e + math.e**2))
    assert row[4] == pytest.approx(-math.log1p(math.e**3))
    assert row[5] == pytest.approx(-np.mean(np.log1p(np.exp([1, 2, 3]))))
    assert row[6] == [-1.0, 1.0] and row[7] == [0.6, 0.8] and row[8] == 1.0 and row[9] == [0, 0]


def test_top_two(spark):
    row = one(spark, *[c.alias(n) for n, c in S.top2(arr(3, 1, 0, 0, 0, 0), SIX).items()])
    assert (row.top_class, row.second_class, row.margin) == ("phage", "virus", 2.0)
    tied = one(spark, *[c.alias(n) for n, c in S.top2(arr(1, 1, 0), SIX[:3]).items()])
    assert (tied.top_class, tied.second_class, tied.margin) == ("phage", "virus", 0.0)


def test_unknown_signal():
    with pytest.raises(ValueError):
        S.ood_signals(arr(1, 2), ["max_prob", "nonsense"])


def windows(spark, rows):
    """rows: (contig, index, scores, reliability)."""
    df = spark.createDataFrame(
        rows, "seq_id string, window_idx int, scores array<double>, reliability double"
    )
    return df.withColumns(
        {c: F.lit(n) for c, n in zip("gcat", (100, 100, 150, 150))}
        | {"seq_len": F.lit(1500), "window": F.lit("A" * 500)}
    )


def test_contig_summary(spark):
    rows = [
        ("c1", 0, [2.0, 0.0, 1.0], 3.0), ("c1", 1, [0.0, 1.0, 0.0], -1.0),
        ("c1", 2, [4.0, 0.5, 0.0], 2.0), ("c2", 0, [0.0, 9.0, 0.0], None),
    ]
    names = ["bacteria", "phage", "eukarya"]
    got = summary.contig_summary(windows(spark, rows), names, 500, reliability="reliability")
    by = {r.contig_id: r for r in got.collect()}
    c1 = by["c1"]
    assert c1.prediction == "bacteria" and c1.length == 1500
    assert c1.bacteria_score == pytest.approx(2.0)
    assert c1.bacteria_var == pytest.approx(np.var([2, 0, 4]))
    assert c1["#_bacteria_windows"] == 2 and c1["#_phage_windows"] == 1
    assert c1["#_eukarya_windows"] == 0 and c1["G+C"] == pytest.approx(0.4) and c1["N%"] == 0
    assert c1.reliability_score == 0.67
    assert c1.prophage_contam == bool(0.5 < np.var([0, 1, 0.5])) and not c1.host_contam
    assert by["c2"].prediction == "phage" and by["c2"].reliability_score is None
    viral = summary.select_viral(got, names, 1.0, None).collect()
    assert [r.contig_id for r in viral] == ["c2"]
    assert summary.viral_label(["Bacteria", "Virus"]) == "Virus"


def test_thresholds(spark):
    rows = [("bacteria", "bacteria", [0.0, 0.0, 0.0, 2.0, 0.5, 0.0])] * 30 + [
        ("phage", "phage", [3.0, 0.0, 0.0, 0.0, 0.0, 0.0])
    ]
    df = spark.createDataFrame(rows, "prediction string, truth string, scores array<double>")
    taus = refine.fit_thresholds(refine.add_score_features(df, SIX), SIX, 0.0)
    by = {r["class"]: r for r in taus.collect()}
    assert (by["bacteria"].tau_logit, by["bacteria"].tau_margin, by["bacteria"].n) == (2.0, 1.5, 30)
    assert by["phage"].tau_logit == -math.inf and by["phage"].n == 1
    assert by["virus"].n == 0


def test_merge_comes_before_withholding(spark):
    rows = [(1, [0.0, 0.0, 0.0, 0.6, 0.4, 0.0]), (2, [0.0, 0.0, 0.0, 0.3, 0.0, 0.1]), (3, [0.0, 0.0, 0.0, 5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, scores array<double>")
    taus = spark.createDataFrame([(c, 1.0, 0.5) for c in SIX],
                                 "class string, tau_logit double, tau_margin double")
    got = refine.refine_windows(refine.add_score_features(df, SIX), taus).collect()
    assert {r.id: r.refined for r in got} == {
        1: "bacteria_or_plasmid", 2: "unknown", 3: "bacteria",
    }
    plain = refine.refine_windows(refine.add_score_features(df, SIX), taus, pairs={}).collect()
    assert {r.id: r.refined for r in plain}[1] == "unknown"


def test_aggregation_modes(spark):
    def call(rows, **kw):
        df = spark.createDataFrame(
            rows, "seq_id int, refined string, margin double, scores array<double>"
        )
        return refine.aggregate_refined(df, SIX, min_windows=1, **kw).first()

    weighted = call(
        [(1, "phage", 4.0, [4.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (1, "phage", 2.0, [2.0, 0.0, 0.0, 0.0, 0.0, 0.0])],
        mode="weighted",
    )
    assert weighted.contig_call == "phage" and weighted.total_weight == 6.0
    merged = [(1, "bacteria_or_plasmid", 0.1, [0.0, 0.0, 0.0, 2.0, 1.5, 0.0])]
    half = call(merged, merge_split="half")
    assert (half.contig_call, half.bacteria_score, half.plasmid_score) == ("bacteria", 1.0, 0.75)
    full = call([(1, "bacteria_or_plasmid", 0.1, [9.0, 0.0, 0.0, 1.0, 1.2, 0.0])], merge_split="full")
    assert full.contig_call == "plasmid" and full.phage_score == 0.0
    assert call(merged, allow_merged=True).contig_call == "bacteria_or_plasmid"
    none = spark.createDataFrame(
        merged, "seq_id int, refined string, margin double, scores array<double>"
    )
    assert refine.aggregate_refined(none, SIX, min_windows=2).isEmpty()


def test_votes_of_models(spark):
    rows = [(1, [3.0, 1.0]), (1, [2.0, 1.0]), (1, [0.0, 9.0])]
    df = spark.createDataFrame(rows, "w int, scores array<double>")
    assert scoring.combine_models(df, ["w"], "vote", 2).first().scores == [2.5, 0.0]
    assert scoring.combine_models(df, ["w"], "sum", 2).first().scores == [5.0, 11.0]
    with pytest.raises(ValueError):
        scoring.combine_models(df, ["w"], "best", 2)


def test_binary_and_class_metrics(spark):
    rows = [("bacteria", "bacteria"), ("bacteria", "phage"), ("phage", "phage"), ("virus", "virus")]
    df = spark.createDataFrame(rows, "fraction string, prediction string")
    got = M.binary_metrics(df).first()
    assert (got.precision, got.recall, got.f1) == pytest.approx((2 / 3, 1.0, 0.8))
    cells = M.confusion_matrix(df, ["bacteria", "phage", "virus"], "fraction").collect()
    assert len(cells) == 9 and sum(c.n for c in cells) == 4
    per = {r["class"]: r for r in M.per_class_metrics(df, "fraction").collect()}
    assert per["bacteria"].recall == 0.5 and per["phage"].precision == 0.5


def test_evaluation_needs_common_ids(spark):
    p = spark.createDataFrame([(1, "phage")], "contig_id int, prediction string")
    t = spark.createDataFrame([(2, "phage")], "contig_id int, fraction string")
    with pytest.raises(ValueError):
        evaluate_sample(p, t)


def scored_labels(spark, pairs):
    return spark.createDataFrame([(float(s), int(y)) for s, y in pairs], "score double, label int")


def test_threshold_sweep(spark):
    df = scored_labels(spark, zip([0.9, 0.85, 0.8, 0.2, 0.15, 0.1], [1, 1, 1, 0, 0, 0]))
    sweep = M.threshold_sweep(df, "score", "label")
    assert sweep.count() == 20
    best = M.best_threshold(sweep).first()
    assert best.value == 1.0 and 0.2 < best.threshold < 0.8
    with pytest.raises(ValueError):
        M.best_threshold(sweep, "accuracy")
    with pytest.raises(ValueError):
        M.require_both_labels(df.where("label = 1"), "label")


def test_ranking_quality(spark):
    rng = np.random.default_rng(3)
    scores, labels = rng.integers(0, 12, 200) / 12, rng.integers(0, 2, 200)
    got = M.ranking_quality(scored_labels(spark, zip(scores, labels)), "score", "label").first()
    pos, neg = scores[labels == 1], scores[labels == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    ap = sum(
        ((scores == s) & (labels == 1)).sum() / len(pos) * (labels[scores >= s] == 1).mean()
        for s in np.unique(scores)
    )
    assert got.auroc == pytest.approx(auc) and got.auprc == pytest.approx(ap)
    alone = M.ranking_quality(scored_labels(spark, [(0.1, 1), (0.2, 1)]), "score", "label").first()
    assert math.isnan(alone.auroc)


def test_calibration(spark):
    df = scored_labels(spark, [(1, 1), (0, 0), (1, 1), (0, 0)])
    got = M.calibration_error(df, "score", "label").first()
    assert (got.ece, got.brier) == (0.0, 0.0)
    bins = M.calibration(df, "score", "label").collect()
    assert sum(b["count"] for b in bins) == 4 and len(bins) == 10
    assert sum(math.isnan(b.mean_pred) for b in bins) == 8


def test_student_tail(spark):
    # Known values: t = 2.015 at 5 degrees and 1.812 at 10 leave 5 % above.
    rows = [(2.015048, 5.0), (1.812461, 10.0), (0.0, 3.0), (-1.812461, 10.0), (1.0, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "t double, df double")
    got = [r[0] for r in df.select(M.student_upper_tail("t", "df")).collect()]
    assert got[:5] == pytest.approx([0.05, 0.05, 0.5, 0.95, 0.25], abs=1e-6) and got[5] is None


def test_paired_takes_the_top_two_classes(spark):
    # Classes 3 and 0 lead contig 1, classes 1 and 2 contig 2; contig 3 ties at classes 0 and 1.
    rows = [(1, [2.0, 0.5, 0.0, 3.0]), (1, [1.0, 0.0, 0.5, 4.0]), (1, [2.0, 0.0, 0.0, 3.5])]
    rows += [(2, [0.0, 5.0, 1.0, 0.0]), (2, [0.0, 4.0, 3.0, 0.0]), (3, [1.0, 2.0, 0.0, 0.0]), (3, [2.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, scores array<double>")
    got = {r.k: r for r in M.with_p_value(M.paired_t_of_best(df, 4, ["k"])).collect()}
    for k, one_, two in ((1, 3, 0), (2, 1, 2)):
        d = np.array([s[one_] - s[two] for i, s in rows if i == k])
        assert got[k].t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(len(d))))
    assert got[1].p_value < 0.05 and got[1].significant
    assert not got[2].significant
    assert got[3].t_stat == 0 and got[3].p_value == pytest.approx(0.5)


def test_paired_and_welch(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 3.0, 1.0), (1, 4.0, 1.5)], "k int, a double, b double")
    got = M.with_p_value(M.paired_t_top2(df, F.col("a"), F.col("b"), ["k"])).first()
    d = np.array([1.0, 2.0, 2.5])
    assert got.t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))
    assert 0 < got.p_value < 0.05 and got.significant
    t, freedom = M.welch(*[F.lit(float(x)) for x in (2, 1, 10, 1, 4, 10)])
    row = one(spark, t, freedom)
    assert row[0] == pytest.approx(1 / math.sqrt(0.5))
    assert row[1] == pytest.approx(0.25 / (0.01 / 9 + 0.16 / 9))
    single, _ = M.welch(*[F.lit(float(x)) for x in (2, 1, 1, 1, 4, 1)])
    assert one(spark, single)[0] is None


def test_confident_rows(spark):
    logit = [[math.log(p), math.log(1 - p)] for p in (0.9, 0.2, 0.1, 0.6)]
    df = spark.createDataFrame(list(zip(range(4), logit, [0, 1, 0, 1])),
                               "id int, scores array<double>, label int")
    got = scoring.select_id_ood(df, 0.8 - 1e-9).collect()
    assert {r.id: r.id_label for r in got} == {0: 1, 1: 1, 2: 0}


def test_run_names(spark):
    row = one(spark, *M.run_name_parts(F.lit("experiment_500bp_trans")))
    assert list(row) == [500, "translated"]
