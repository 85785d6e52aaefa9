"""Queries that evaluate calls and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import CLASSES
from ..functions.scores import names_of, sigmoid, top_index
from ..operators import metrics as M
from ..operators.ranks import exact_quantiles
from ..operators.summary import contig_summary
from ..sources.tables import read_table
from .base import (
    CLASS_LIST,
    SIZE,
    argmax,
    register,
    scored,
    second,
    sequences,
    share_sql,
    vector_scores,
)

LANGS = ["de", "en", "es", "fr", "it"]
_LANGS = "['de', 'en', 'es', 'fr', 'it']"


@register(
    "class_distribution", "class:s n:i percent:d weight:d",
    f"""SELECT class, n, n * 100.0::DOUBLE / sum(n) OVER () AS percent,
               sum(n) OVER () / (5 * greatest(n, 1))::DOUBLE AS weight
        FROM (SELECT class, count(doc_id) AS n FROM (SELECT unnest({_LANGS}) AS class)
              LEFT JOIN documents ON lang = class GROUP BY class)""",
)
def _(spark, d):
    return M.class_distribution(read_table(spark, d, "documents"), LANGS, "lang")


@register(
    "class_count_ratios", "class:s n:i n_other:i ratio:d",
    f"""SELECT class, a AS n, b AS n_other, a::DOUBLE / greatest(b, 1) AS ratio FROM (
          SELECT class, count(*) FILTER (lang IS NOT NULL) AS a,
                 count(*) FILTER (lang IS NOT NULL AND doc_id % 3 = 0) AS b
          FROM (SELECT unnest({_LANGS}) AS class) LEFT JOIN documents ON lang = class
          GROUP BY class)""",
)
def _(spark, d):
    docs = read_table(spark, d, "documents")
    some = docs.where(F.col("doc_id") % 3 == 0)
    return M.count_ratios(
        M.class_distribution(docs, LANGS, "lang"), M.class_distribution(some, LANGS, "lang")
    )


@register(
    "class_log_prior", "label:i n:i log_prior:d",
    """SELECT label, n, ln(n::DOUBLE / sum(n) OVER ()) AS log_prior FROM (
         SELECT CASE label WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS label,
                count(*) AS n FROM embeddings GROUP BY 1)""",
)
def _(spark, d):
    return M.class_log_prior(read_table(spark, d, "embeddings"), "label", {1: 1, 2: 2, 3: 1})


@register(
    "positive_logit", "logit_prior:d",
    "SELECT ln(p / (1 - p)) AS logit_prior FROM (SELECT avg(quality::DOUBLE) AS p FROM labels)",
)
def _(spark, d):
    return M.positive_logit(read_table(spark, d, "labels"), "quality")


# ---- calls against truth ------------------------------------------------------------------

share_sql(
    "calls", "vscores",
    f"""SELECT vec_id, {CLASS_LIST}[label % 6 + 1] AS truth,
               {CLASS_LIST}[CASE WHEN vec_id % 3 = 0 THEN label % 6 ELSE {argmax('scores')} END + 1]
                 AS prediction, 1 / (1 + exp(-reliability)) AS reliability_score,
               (vec_id % 3 + 1) * 500 AS length_bp,
               CASE WHEN vec_id % 2 = 0 THEN 'translated' ELSE 'nucleotide' END AS input_type,
               scores[2] AS logit, label % 2 AS positive
        FROM vscores""",
)


def _calls(spark, d):
    names = names_of(CLASSES)
    truth = (F.col("label") % 6).cast("int")
    call = F.when(F.col("vec_id") % 3 == 0, truth).otherwise(top_index(F.col("scores")))
    kind = F.when(F.col("vec_id") % 2 == 0, "translated").otherwise("nucleotide")
    return vector_scores(spark, d).select(
        "vec_id", F.get(names, truth).alias("truth"), F.get(names, call).alias("prediction"),
        sigmoid(F.col("reliability")).alias("reliability_score"),
        ((F.col("vec_id") % 3 + 1) * 500).alias("length_bp"), kind.alias("input_type"),
        F.get("scores", F.lit(1)).alias("logit"), (F.col("label") % 2).alias("positive"),
    )


@register(
    "confusion_matrix", "truth:s prediction:s n:i",
    f"""SELECT truth, prediction, count(c.vec_id) AS n
        FROM (SELECT unnest({CLASS_LIST}) AS truth)
        CROSS JOIN (SELECT unnest({CLASS_LIST}) AS prediction)
        LEFT JOIN calls c USING (truth, prediction) GROUP BY ALL""",
    "calls",
)
def _(spark, d):
    return M.confusion_matrix(_calls(spark, d), CLASSES)


share_sql(
    "per_class", "calls",
    """SELECT class, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p) AS predicted,
              count(*) FILTER (t) AS support, any_value(total) AS total
       FROM (SELECT class, truth = class AS t, prediction = class AS p,
                    count(*) OVER (PARTITION BY class) AS total
             FROM calls, (SELECT DISTINCT unnest([truth, prediction]) AS class FROM calls))
       GROUP BY class""",
)


@register(
    "per_class_metrics", "class:s precision:d recall:d f1:d support:i",
    """SELECT class, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision,
              coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
              coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1, support
       FROM per_class""",
    "per_class",
)
def _(spark, d):
    return M.per_class_metrics(_calls(spark, d))


@register(
    "smoothed_class_metrics", "class:s precision:d recall:d specificity:d f1:d",
    """SELECT class, tp / (predicted + 1e-7) AS precision, tp / (support + 1e-7) AS recall,
              (total - predicted - support + tp) / (total - support + 1e-7) AS specificity,
              2 * tp / (predicted + support + 1e-7) AS f1 FROM per_class""",
    "per_class",
)
def _(spark, d):
    return M.smoothed_metrics(_calls(spark, d), CLASSES)


@register(
    "macro_f1", "macro_f1:d",
    "SELECT avg(2 * tp / (predicted + support + 1e-7)) AS macro_f1 FROM per_class", "per_class",
)
def _(spark, d):
    return M.macro_f1(M.smoothed_metrics(_calls(spark, d), CLASSES))


@register(
    "binary_f1", "f1:d",
    """SELECT 2 * tp / (2 * tp + fp + fn + 1e-7) AS f1 FROM (
         SELECT count(*) FILTER (logit > 0 AND positive = 1) AS tp,
                count(*) FILTER (logit > 0 AND positive = 0) AS fp,
                count(*) FILTER (logit <= 0 AND positive = 1) AS fn FROM calls)""",
    "calls",
)
def _(spark, d):
    return M.binary_f1(_calls(spark, d), "logit", "positive")


@register(
    "binary_metrics",
    "precision:d recall:d f1:d accuracy:d balanced_accuracy:d num_contigs:i num_viral_true:i "
    "num_cellular_true:i num_viral_pred:i",
    """SELECT tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall,
              2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1,
              (tp + tn) / (tp + tn + fp + fn)::DOUBLE AS accuracy,
              (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 AS balanced_accuracy,
              tp + tn + fp + fn AS num_contigs, tp + fn AS num_viral_true,
              tn + fp AS num_cellular_true, tp + fp AS num_viral_pred
       FROM (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp,
                    count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn
             FROM (SELECT truth IN ('phage', 'virus') AS t,
                          prediction IN ('phage', 'virus') AND reliability_score >= 0.45 AS p
                   FROM calls))""",
    "calls",
)
def _(spark, d):
    return M.binary_metrics(_calls(spark, d), "truth", "prediction", "reliability_score", 0.45)


@register(
    "reliability_stats", "mean_reliability:d median_reliability:d frac_above_cutoff:d",
    """SELECT avg(reliability_score) AS mean_reliability,
              quantile_cont(reliability_score, 0.5) AS median_reliability,
              avg(CASE WHEN reliability_score >= 0.6 THEN 1 ELSE 0 END) AS frac_above_cutoff
       FROM calls""",
    "calls",
)
def _(spark, d):
    return M.reliability_stats(_calls(spark, d), "reliability_score", 0.6)


@register(
    "accuracy_by_length", "length_bp:i input_type:s measure:s value:d",
    """WITH pc AS (SELECT length_bp, input_type, class, count(*) FILTER (t AND p) AS tp,
                     count(*) FILTER (p) AS predicted, count(*) FILTER (t) AS support
                   FROM (SELECT length_bp, input_type, class, truth = class AS t,
                                prediction = class AS p
                         FROM calls, (SELECT DISTINCT truth AS class FROM calls))
                   GROUP BY ALL),
            b AS (SELECT length_bp, input_type, avg(tp / support::DOUBLE) AS balanced_accuracy,
                    avg(2 * tp / (predicted + support)::DOUBLE) AS macro_f1
                  FROM pc WHERE support > 0 GROUP BY ALL),
            a AS (SELECT length_bp, input_type,
                    avg(CASE WHEN truth = prediction THEN 1 ELSE 0 END) AS overall_accuracy
                  FROM calls GROUP BY ALL)
       SELECT length_bp, input_type, unnest(['overall_accuracy', 'balanced_accuracy', 'macro_f1'])
                AS measure, unnest([overall_accuracy, balanced_accuracy, macro_f1]) AS value
       FROM a JOIN b USING (length_bp, input_type)""",
    "calls",
)
def _(spark, d):
    return M.accuracy_by_length(
        _calls(spark, d), ["length_bp", "input_type"], "truth", "prediction"
    )


@register(
    "run_names", "length_bp:i input_type:s n:i",
    """SELECT (doc_id % 3 + 1) * 500 AS length_bp,
              CASE WHEN doc_id % 2 = 0 THEN 'translated' ELSE 'nucleotide' END AS input_type,
              count(*) AS n FROM documents GROUP BY ALL""",
)
def _(spark, d):
    name = F.concat(
        F.lit("experiment_"), ((F.col("doc_id") % 3 + 1) * 500).cast("string"), F.lit("bp"),
        F.when(F.col("doc_id") % 2 == 0, "_trans").otherwise("_nuc"),
    )
    length, kind = M.run_name_parts(name)
    docs = read_table(spark, d, "documents").select(
        length.alias("length_bp"), kind.alias("input_type")
    )
    return docs.groupBy("length_bp", "input_type").agg(F.count(F.lit(1)).alias("n"))


# ---- scores against labels ------------------------------------------------------------------

share_sql(
    "quality", "seqs",
    """SELECT doc_id, quality AS label, (length(seq) - length(replace(seq, 'A', ''))) * 2.0::DOUBLE
              / length(seq) AS score FROM seqs JOIN labels ON doc_id = seq_id""",
)


def _quality(spark, d):
    from ..functions.dna import count_of, share

    score = share(count_of("seq", "A") * 2, F.length("seq")).alias("score")
    rows = sequences(spark, d).select(F.col("seq_id").alias("doc_id"), score)
    truth = read_table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return rows.join(truth, "doc_id")


_GRID = "[" + ", ".join(f"{round(i * 0.05, 10)}::DOUBLE" for i in range(20)) + "]"

share_sql(
    "sweep", "quality",
    f"""SELECT threshold, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1_id,
               coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0) AS f1_ood,
               tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE - 1 AS youden_j,
               CASE WHEN tp + fp = 0 OR tn + fn = 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt(
                 (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc
        FROM (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp,
                     count(*) FILTER (score >= threshold AND label = 0) AS fp,
                     count(*) FILTER (score < threshold AND label = 1) AS fn,
                     count(*) FILTER (score < threshold AND label = 0) AS tn
              FROM quality, (SELECT unnest({_GRID}) AS threshold) GROUP BY threshold)""",
)


@register(
    "threshold_sweep", "threshold:d f1_id:d f1_ood:d youden_j:d mcc:d",
    "SELECT * FROM sweep", "sweep",
)
def _(spark, d):
    return M.threshold_sweep(_quality(spark, d), "score", "label")


@register(
    "best_threshold", "threshold:d value:d",
    """SELECT threshold, round(youden_j, 9) AS value FROM sweep
       ORDER BY round(youden_j, 9) DESC, threshold LIMIT 1""",
    "sweep",
)
def _(spark, d):
    sweep = M.threshold_sweep(_quality(spark, d), "score", "label")
    return M.best_threshold(sweep.withColumn("youden_j", F.round("youden_j", 9)), "youden")


def _ranking_sql(table: str) -> str:
    return f"""
        SELECT sum(pos * (nb + neg / 2.0::DOUBLE)) / (max(p) * max(n))::DOUBLE AS auroc,
               sum(pos * ap / (ap + an)::DOUBLE) / max(p)::DOUBLE AS auprc
        FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                       AND 1 PRECEDING), 0) AS nb,
                     sum(pos) OVER (ORDER BY score DESC) AS ap,
                     sum(neg) OVER (ORDER BY score DESC) AS an,
                     sum(pos) OVER () AS p, sum(neg) OVER () AS n
              FROM (SELECT score, count(*) FILTER (label = 1) AS pos,
                           count(*) FILTER (label = 0) AS neg FROM {table} GROUP BY score))"""


@register("ranking_quality", "auroc:d auprc:d", _ranking_sql("quality"), "quality")
def _(spark, d):
    return M.ranking_quality(_quality(spark, d), "score", "label")


@register(
    "ranking_quality_large", "auroc:d auprc:d",
    _ranking_sql(
        "(SELECT l_extendedprice AS score, CASE WHEN l_quantity + l_tax * 200 > 30 THEN 1 ELSE 0 "
        "END AS label FROM lineitem)"
    ),
)
def _(spark, d):
    rows = read_table(spark, d, "lineitem").select(
        F.col("l_extendedprice").alias("score"),
        (F.col("l_quantity") + F.col("l_tax") * 200 > 30).cast("int").alias("label"),
    )
    return M.ranking_quality(rows, "score", "label")


@register(
    "exact_quantiles", "l_returnflag:s prob:d value:d n:i",
    """SELECT l_returnflag, unnest([0.05, 0.5, 0.99]) AS prob,
              unnest(quantile_cont(l_extendedprice, [0.05, 0.5, 0.99])) AS value, count(*) AS n
       FROM lineitem GROUP BY l_returnflag""",
)
def _(spark, d):
    rows = read_table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.99])


share_sql(
    "bins", "quality",
    """SELECT bin, (bin + 0.5::DOUBLE) / 10 AS bin_center, avg(score) AS mean_pred,
              avg(label::DOUBLE) AS empirical_rate, count(score) AS count
       FROM (SELECT unnest(range(0, 10)) AS bin) LEFT JOIN
            (SELECT *, least(floor(score * 10), 9) AS bin FROM quality WHERE score <= 1) USING (bin)
       GROUP BY bin""",
)


@register(
    "calibration_bins", "bin:i bin_center:d mean_pred:d empirical_rate:d count:i",
    "SELECT * FROM bins", "bins",
)
def _(spark, d):
    rows = M.calibration(_quality(spark, d), "score", "label")
    none = F.lit(None).cast("double")
    return rows.withColumns(
        {c: F.nanvl(F.col(c), none) for c in ("mean_pred", "empirical_rate")}
    )


@register(
    "calibration_error", "ece:d brier:d",
    """SELECT (SELECT sum(abs(empirical_rate - mean_pred) * count) / sum(count) FROM bins) AS ece,
              (SELECT avg((score - label) * (score - label)) FROM quality) AS brier""",
    "bins",
)
def _(spark, d):
    return M.calibration_error(_quality(spark, d), "score", "label")


# ---- statistics of contig tables --------------------------------------------------------------


def _summary(spark, d):
    return contig_summary(scored(spark, d), CLASSES, SIZE)


@register(
    "passed_share", "prediction:s status:s n:i percent:d",
    """SELECT prediction, CASE WHEN phage_score >= 1.0 THEN 'passed' ELSE 'failed' END AS status,
              count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent
       FROM summary GROUP BY ALL""",
    "summary",
)
def _(spark, d):
    return M.share_table(_summary(spark, d), "prediction", F.col("phage_score") >= 1.0)


@register(
    "score_distributions", "prediction:s measure:s prob:d value:d",
    """SELECT prediction, measure, unnest([0, 0.25, 0.5, 0.75, 1]) AS prob,
              unnest(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0])) AS value
       FROM (SELECT prediction, unnest(['entropy', 'energy']) AS measure,
                    unnest([entropy, energy]) AS x FROM summary) GROUP BY prediction, measure""",
    "summary",
)
def _(spark, d):
    return M.distributions(_summary(spark, d), "prediction", ["entropy", "energy"])


@register(
    "scores_long", "contig_id:i prediction:s class:s score:d",
    f"""SELECT contig_id, prediction, unnest({CLASS_LIST}) AS class, unnest(mean) AS score
        FROM summary""",
    "summary",
)
def _(spark, d):
    return M.scores_long(_summary(spark, d), CLASSES)


@register(
    "length_bins", "length_bin:i min_length:i max_length:i mean_value:d n:i",
    """SELECT length_bin, min(length) AS min_length, max(length) AS max_length,
              avg(entropy) AS mean_value, count(*) AS n
       FROM (SELECT *, greatest(len(list_filter(edges, lambda e: e < length)) - 1, 0) AS length_bin
             FROM summary, (SELECT quantile_cont(length::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
                            AS edges FROM summary)) GROUP BY length_bin""",
    "summary",
)
def _(spark, d):
    return M.by_length_bins(_summary(spark, d), "entropy")


share_sql(
    "welch", "summary",
    f"""SELECT contig_id, prediction, n AS n_windows,
          CASE WHEN n > 1 AND va + vb > 0 THEN (ma - mb) / sqrt(va / n + vb / n) END AS t_stat,
          CASE WHEN n > 1 AND va + vb > 0 THEN pow(va / n + vb / n, 2) /
            (pow(va / n, 2) / (n - 1) + pow(vb / n, 2) / (n - 1)) END AS df
        FROM (SELECT contig_id, prediction, mean[{argmax('mean')} + 1] AS ma,
                var[{argmax('mean')} + 1] AS va, mean[{second('mean')} + 1] AS mb,
                var[{second('mean')} + 1] AS vb,
                ({" + ".join(f'"#_{c}_windows"' for c in CLASSES)})::DOUBLE AS n FROM summary)""",
)


@register(
    "welch_tests", "contig_id:i prediction:s n_windows:i t_stat:d df:d",
    "SELECT * FROM welch", "welch",
)
def _(spark, d):
    return M.welch_top2(_summary(spark, d), CLASSES)


@register("welch_p_values", "contig_id:i t_stat:d df:d p_value:d significant:b")
def _(spark, d):
    return M.with_p_value(M.welch_top2(_summary(spark, d), CLASSES))


@register(
    "paired_tests", "seq_id:i n:i t_stat:d df:d",
    f"""SELECT seq_id, count(*) AS n, CASE WHEN stddev_samp(x) > 0
              THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END AS t_stat, count(*) - 1 AS df
       FROM (SELECT seq_id, scores[{argmax('mean')} + 1] - scores[{second('mean')} + 1] AS x
             FROM scored JOIN (SELECT seq_id, [{", ".join(f"avg(scores[{i + 1}])" for i in range(len(CLASSES)))}] AS mean
                               FROM scored GROUP BY seq_id) USING (seq_id)) GROUP BY seq_id""",
    "scored",
)
def _(spark, d):
    return _paired(spark, d)


def _paired(spark, d):
    return M.paired_t_of_best(scored(spark, d), len(CLASSES), ["seq_id"])


@register("paired_p_values", "seq_id:i n:i t_stat:d df:d p_value:d significant:b")
def _(spark, d):
    return M.with_p_value(_paired(spark, d))
