"""Queries on window scores: contig tables, refinement, model and reliability scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.constants import CLASSES
from ..operators import refine, scoring, summary
from ..operators.decode import transition_costs, viterbi_labels
from ..operators.ordered import viral_summary, window_summary
from ..plans.contigs import call_contigs
from ..plans.training import calibrate_refinement
from ..sources.results import extract_sequences, extract_windows, prediction_table
from .base import (
    CLASS_LIST,
    MIN_LEN,
    SIZE,
    STRIDE,
    argmax,
    labelled,
    register,
    scored,
    scorer,
    second,
    sequences,
    share_sql,
    share_variant,
    softmax_sql,
    vector_scores,
    windows,
)

N = len(CLASSES)
SOFTPLUS = "(greatest(x, 0) + ln(1 + exp(-abs(x))))"
CLIPPED = "least(greatest(x, 1e-12), 1.0)"


def sigmoid_sql(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


# ---- contig tables ------------------------------------------------------------------------

share_sql(
    "letters", "labelled",
    """SELECT seq_id, string_agg(n || CASE WHEN label_name IN ('virus', 'phage')
              THEN upper(left(label_name, 1)) ELSE lower(left(label_name, 1)) END, ''
              ORDER BY first_idx) AS window_summary
       FROM (SELECT seq_id, label_name, grp, count(*) AS n, min(window_idx) AS first_idx
             FROM (SELECT *, window_idx - row_number() OVER (
                     PARTITION BY seq_id, label_name ORDER BY window_idx) AS grp FROM labelled)
             GROUP BY ALL) GROUP BY seq_id""",
)

_COUNTS = ", ".join(
    f"count(*) FILTER (label_idx = {i}) AS \"#_{c}_windows\"" for i, c in enumerate(CLASSES)
)
_MEANS = ", ".join(f"avg(scores[{i + 1}])" for i in range(N))
_VARS = ", ".join(f"var_pop(scores[{i + 1}])" for i in range(N))
_SCORE_COLUMNS = ", ".join(
    f"mean[{i + 1}] AS {c}_score, var[{i + 1}] AS {c}_var" for i, c in enumerate(CLASSES)
)

share_sql(
    "summary", "labelled",
    f"""SELECT *, seq_id AS contig_id, {CLASS_LIST}[call + 1] AS prediction,
               mean[2] < var[2] AND call = 1 AS host_contam,
               mean[2] < var[2] AND call = 0 AS prophage_contam, {_SCORE_COLUMNS}
        FROM (SELECT *, {argmax('mean')} AS call FROM (
          SELECT seq_id, max(seq_len) AS length, [{_MEANS}] AS mean, [{_VARS}] AS var,
                 avg(-list_sum(list_transform(scores, lambda x: {CLIPPED} * log2({CLIPPED}))))
                   AS entropy,
                 avg(-list_sum(list_transform(scores, lambda x: {SOFTPLUS})) / {N}) AS energy,
                 avg((g + c)::DOUBLE / {SIZE}) AS "G+C",
                 avg(({SIZE} - g - c - a - t)::DOUBLE / {SIZE}) AS "N%", {_COUNTS}
          FROM labelled GROUP BY seq_id))""",
)

_SUMMARY = (
    "contig_id:i length:i prediction:s entropy:d energy:d host_contam:b prophage_contam:b "
    "G+C:d N%:d "
    + " ".join(f"#_{c}_windows:i" for c in CLASSES)
    + " "
    + " ".join(f"{c}_score:d {c}_var:d" for c in CLASSES)
)


def _summary(spark, d):
    return summary.contig_summary(scored(spark, d), CLASSES, SIZE)


@register("contig_summary", _SUMMARY, "SELECT * FROM summary", "summary")
def _(spark, d):
    return _summary(spark, d)


@register(
    "called_contigs", _SUMMARY + " window_summary:s",
    "SELECT * FROM summary JOIN letters USING (seq_id) WHERE \"N%\" < 0.3", "summary letters",
)
def _(spark, d):
    return call_contigs(sequences(spark, d), scorer(), CLASSES, SIZE, STRIDE, MIN_LEN, mask=False)


@register(
    "decoded_contigs",
    "contig_id:i prediction:s window_summary:s contig_call:s n_merged_windows:i "
    "terminal_repeats:s repeat_length:i",
)
def _(spark, d):
    rows = _truth(scored(spark, d))
    taus = calibrate_refinement(rows, CLASSES, "truth", 0.2)
    return call_contigs(
        sequences(spark, d), scorer(), CLASSES, SIZE, STRIDE, MIN_LEN, switch_cost=0.2,
        taus=taus, repeats=True, repeat_min_len=1000, mask=False,
    )


@register(
    "window_run_text", "seq_id:i window_summary:s", "SELECT * FROM letters", "letters"
)
def _(spark, d):
    return window_summary(labelled(spark, d), ["seq_id"], "window_idx", "label_name")


@register(
    "viral_run_text", "seq_id:i window_summary:s",
    """SELECT seq_id, string_agg(n || CASE WHEN viral THEN 'V' ELSE 'n' END, ''
                                ORDER BY first_idx) AS window_summary
       FROM (SELECT seq_id, viral, grp, count(*) AS n, min(window_idx) AS first_idx
             FROM (SELECT *, window_idx - row_number() OVER (
                     PARTITION BY seq_id, viral ORDER BY window_idx) AS grp
                   FROM (SELECT *, label_name = 'phage' AS viral FROM labelled))
             GROUP BY ALL) GROUP BY seq_id""",
    "labelled",
)
def _(spark, d):
    return viral_summary(labelled(spark, d), ["seq_id"], "window_idx", "label_name", "phage")


@register(
    "class_window_counts", "seq_id:i " + " ".join(f"n_{c}:i" for c in CLASSES),
    "SELECT seq_id, "
    + ", ".join(f"count(*) FILTER (label_name = '{c}') AS n_{c}" for c in CLASSES)
    + " FROM labelled GROUP BY seq_id",
    "labelled",
)
def _(spark, d):
    return summary.class_window_counts(labelled(spark, d), CLASSES)


@register(
    "binary_contig_summary",
    "contig_id:i length:i prediction:s entropy:d energy:d host_contam:b prophage_contam:b "
    "#_cell_windows:i #_virus_windows:i score:d var:d",
    f"""SELECT *, CASE WHEN call THEN 'virus' ELSE 'cell' END AS prediction,
               score < var AND call AS host_contam, score < var AND NOT call AS prophage_contam
        FROM (SELECT *, {sigmoid_sql('score')} > 0.5 AS call FROM (
          SELECT seq_id AS contig_id, max(seq_len) AS length, avg(z) AS score, var_pop(z) AS var,
                 avg(-(least(greatest(z, 1e-12), 1) * log2(least(greatest(z, 1e-12), 1)) +
                       least(greatest(1 - z, 1e-12), 1) * log2(least(greatest(1 - z, 1e-12), 1))))
                   AS entropy,
                 avg(-{SOFTPLUS.replace('x', 'z').replace('ezp', 'exp')}) AS energy,
                 count(*) FILTER ({sigmoid_sql('z')} <= 0.5) AS "#_cell_windows",
                 count(*) FILTER ({sigmoid_sql('z')} > 0.5) AS "#_virus_windows"
          FROM (SELECT *, scores[2] - scores[1] AS z FROM scored) GROUP BY seq_id))""",
    "scored",
)
def _(spark, d):
    rows = scored(spark, d).withColumn(
        "score", F.get("scores", F.lit(1)) - F.get("scores", F.lit(0))
    )
    return summary.binary_contig_summary(rows, ["cell", "virus"])


_L4 = ["bacteria", "phage", "eukarya", "archaea"]


@register(
    "legacy_contig_summary",
    "contig_id:i length:i prediction:s prediction_2:s entropy:d reliability_score:d "
    + " ".join(f"#_{c}_windows:i {c}_score:d {c}_var:d" for c in _L4)
    + " window_summary:s",
    f"""WITH rows AS (SELECT *, {argmax('s4')} AS lab, {sigmoid_sql('scores[6]')} AS rel
                      FROM (SELECT *, scores[1:4] AS s4 FROM scored)),
        txt AS (SELECT seq_id, string_agg(n || CASE WHEN viral THEN 'V' ELSE 'n' END, ''
                                          ORDER BY first_idx) AS window_summary
                FROM (SELECT seq_id, viral, grp, count(*) AS n, min(window_idx) AS first_idx
                      FROM (SELECT *, window_idx - row_number() OVER (
                              PARTITION BY seq_id, viral ORDER BY window_idx) AS grp
                            FROM (SELECT *, lab = 1 AS viral FROM rows))
                      GROUP BY ALL) GROUP BY seq_id),
        per AS (SELECT seq_id, max(seq_len) AS length,
                  [{", ".join(f"avg(s4[{i + 1}])" for i in range(4))}] AS mean,
                  [{", ".join(f"var_pop(s4[{i + 1}])" for i in range(4))}] AS var,
                  avg(-list_sum(list_transform(s4, lambda x: {CLIPPED} * log2({CLIPPED}))))
                    AS entropy, avg(rel) AS reliability_score,
                  {", ".join(f'count(*) FILTER (lab = {i}) AS "#_{c}_windows"'
                             for i, c in enumerate(_L4))}
                FROM rows GROUP BY seq_id)
        SELECT *, seq_id AS contig_id,
          CASE WHEN {argmax('mean')} = 1 THEN 'phage' ELSE 'non-phage' END AS prediction,
          CASE WHEN {argmax('mean')} = 1 THEN {_L4}[{second('mean')} + 1] ELSE '' END
            AS prediction_2,
          {", ".join(f"mean[{i + 1}] AS {c}_score, var[{i + 1}] AS {c}_var"
                     for i, c in enumerate(_L4))}
        FROM per JOIN txt USING (seq_id)""",
    "scored",
)
def _(spark, d):
    rows = scored(spark, d).withColumns(
        {
            "ood_prob": S.sigmoid(F.get("scores", F.lit(5))),
            "scores": F.slice("scores", 1, 4),
        }
    )
    return summary.legacy_summary(rows)


# Scores of one class spread wide, so that contigs are called viral, and some calls waver.
share_variant("_wide", ["summary"], {"scored": """SELECT * REPLACE (list_transform(scores, lambda x, i:
    CASE WHEN i = 2 THEN (x - 0.43::DOUBLE) * 20.0::DOUBLE ELSE x END) AS scores) FROM scored"""})


def _wide_summary(spark, d):
    def spread_out(x, i):
        return F.when(i == 1, (x - 0.43) * 20.0).otherwise(x)

    rows = scored(spark, d).withColumn("scores", F.transform("scores", spread_out))
    return summary.contig_summary(rows, CLASSES, SIZE)


@register("wavering_contigs", _SUMMARY, "SELECT * FROM summary_wide", "summary_wide")
def _(spark, d):
    return _wide_summary(spark, d)


@register(
    "viral_contigs", "contig_id:i length:i phage_score:d prediction:s",
    "SELECT * FROM summary_wide WHERE prediction = 'phage' AND phage_score > 1.0", "summary_wide",
)
def _(spark, d):
    return summary.select_viral(_wide_summary(spark, d), CLASSES, 1.0, None)


@register(
    "unambiguous_contigs", "contig_id:i N%:d",
    "SELECT * FROM summary WHERE \"N%\" < 0.25", "summary",
)
def _(spark, d):
    return summary.drop_ambiguous(_summary(spark, d), 0.25)


@register(
    "formatted_summary", "contig_id:i prediction:s phage_score:s",
    """SELECT contig_id, prediction, printf('%.3f', round(phage_score, 3)) AS phage_score
       FROM summary""",
    "summary",
)
def _(spark, d):
    cols = _summary(spark, d).select(
        "contig_id", "prediction", F.round("phage_score", 3).alias("phage_score")
    )
    return summary.format_doubles(cols)


@register(
    "extracted_sequences", "seq_id:i seq:s",
    """SELECT seq_id, seq FROM seqs WHERE seq_id IN
         (SELECT seq_id FROM summary_wide WHERE prediction = 'phage')""",
    "seqs summary_wide",
)
def _(spark, d):
    calls = _wide_summary(spark, d).where(F.col("prediction") == "phage")
    return extract_sequences(sequences(spark, d), calls)


@register(
    "extracted_windows", "seq_id:s seq:s",
    f"""SELECT seq_id || '_' || window_idx AS seq_id, win AS seq FROM labelled
        WHERE label_name = 'phage' AND {sigmoid_sql('scores[6]')} >= 0.6""",
    "labelled",
)
def _(spark, d):
    rows = labelled(spark, d).withColumn("rel", S.sigmoid(F.get("scores", F.lit(5))))
    return extract_windows(rows, "label_name", "phage", "rel", 0.6)


@register(
    "window_scores",
    "seq_id:i window_idx:i seq_len:i gc_skew:d scores:ld label_name:s",
    "SELECT * FROM labelled", "labelled",
)
def _(spark, d):
    return labelled(spark, d)


@register(
    "model_scored_windows", "seq_id:i window_idx:i scores:ld",
    "SELECT * FROM scored", "scored",
)
def _(spark, d):
    from .base import BIAS, WEIGHTS

    def make_scorer():
        import numpy as np
        import pandas as pd

        w, b = np.array(WEIGHTS), np.array(BIAS)

        def score(batch):
            n = batch["window"].str.len().to_numpy()
            x = np.stack(
                [*(batch[c].to_numpy() / n for c in ("g", "c", "a", "t")), batch["gc_skew"]], 1
            )
            return pd.DataFrame({"scores": list(x @ w.T + b)})

        return score

    return scoring.score_windows(
        windows(spark, d), make_scorer, ["window", "g", "c", "a", "t", "gc_skew"],
        {"scores": "array<double>"},
    )


@register(
    "kmer_profile_scores", "seq_id:i window_idx:i lang:s score:d",
    """WITH mers AS (SELECT seq_id, window_idx, lang, substr(win, i + 1, 2) AS kmer FROM (
                       SELECT *, unnest(range(0, length(win) - 1)) AS i FROM wins)),
            good AS (SELECT * FROM mers WHERE regexp_full_match(kmer, '[ACGT]+')),
            counts AS (SELECT lang AS label, kmer, count(*) AS n FROM good GROUP BY ALL),
            totals AS (SELECT label, sum(n) + 16 AS total FROM counts GROUP BY label)
       SELECT seq_id, window_idx, t.label AS lang,
              avg(CASE WHEN g.kmer IS NOT NULL THEN ln((coalesce(c.n, 0) + 1)::DOUBLE / total) END) AS score
       FROM wins CROSS JOIN totals t LEFT JOIN good g USING (seq_id, window_idx)
       LEFT JOIN counts c ON c.label = t.label AND c.kmer = g.kmer GROUP BY ALL""",
    "wins",
)
def _(spark, d):
    rows = windows(spark, d)
    profile = scoring.fit_kmer_profile(rows, 2, "lang")
    return scoring.score_kmer_profile(rows, profile, 2, ["seq_id", "window_idx"], "lang")


# ---- score arrays ---------------------------------------------------------------------------


@register(
    "softmax_scores", "vec_id:i p:ld logp:ld lse:d sig:d",
    f"""SELECT vec_id, {softmax_sql('scores')} AS p,
               list_transform({softmax_sql('scores')}, lambda x: ln(x)) AS logp,
               ln(list_sum(list_transform(scores, lambda x: exp(x)))) AS lse,
               {sigmoid_sql('scores[1]')} AS sig
        FROM vscores""",
    "vscores",
)
def _(spark, d):
    s = F.col("scores")
    return vector_scores(spark, d).select(
        "vec_id", S.softmax(s).alias("p"), S.log_softmax(s).alias("logp"),
        S.log_sum_exp(s).alias("lse"), S.sigmoid(F.get(s, F.lit(0))).alias("sig"),
    )


@register(
    "entropies", "vec_id:i two:d many:d present:d energy2:d energy1:d energy6:d",
    f"""SELECT vec_id, -(least(greatest(p[1], 1e-12), 1) * log2(least(greatest(p[1], 1e-12), 1)) +
                 least(greatest(1 - p[1], 1e-12), 1) * log2(least(greatest(1 - p[1], 1e-12), 1)))
                 AS two,
               -list_sum(list_transform(p, lambda x: {CLIPPED} * log2({CLIPPED}))) AS many,
               -list_sum(list_transform(p, lambda x: CASE WHEN x > 1e-10 THEN x * log2(x) ELSE 0
                 END)) AS present,
               -ln(exp(scores[1]) + exp(scores[2])) AS energy2,
               -ln(1 + exp(scores[1])) AS energy1,
               -list_sum(list_transform(scores, lambda x: {SOFTPLUS})) / 6 AS energy6
        FROM (SELECT *, {softmax_sql('scores')} AS p FROM vscores)""",
    "vscores",
)
def _(spark, d):
    rows = vector_scores(spark, d).withColumn("p", S.softmax(F.col("scores")))
    return rows.select(
        "vec_id", S.binary_entropy(F.get("p", F.lit(0))).alias("two"),
        S.softmax_entropy(F.col("p")).alias("many"), S.present_entropy(F.col("p")).alias("present"),
        S.energy(F.slice("scores", 1, 2)).alias("energy2"),
        S.energy(F.slice("scores", 1, 1)).alias("energy1"),
        S.energy(F.col("scores")).alias("energy6"),
    )


@register(
    "scaled_vectors", "vec_id:i z:ld unit:ld batch:ld",
    """SELECT vec_id, list_transform(embedding, lambda x: (x - m) / s) AS z,
              list_transform(embedding, lambda x: x / n) AS unit,
              list_transform(embedding, lambda x: (x - 0.1::DOUBLE) / 0.5::DOUBLE) AS batch
       FROM (SELECT vec_id, embedding, list_avg(embedding) AS m, list_var_pop(embedding) ** 0.5 AS s,
                    sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM vscores)""",
    "vscores",
)
def _(spark, d):
    e = F.col("embedding")
    mean = F.transform(e, lambda x: F.lit(0.1))
    spread = F.transform(e, lambda x: F.lit(0.5))
    return vector_scores(spark, d).select(
        "vec_id", S.zscore(e).alias("z"), S.l2_normalize(e).alias("unit"),
        S.zscore_with(e, mean, spread).alias("batch"),
    )


share_sql(
    "features", "scored",
    f"""SELECT *, list_max(scores) AS top_score, scores[{second('scores')} + 1] AS second_score,
               list_max(scores) - scores[{second('scores')} + 1] AS margin,
               list_max({softmax_sql('scores')}) AS top_prob,
               -list_sum(list_transform({softmax_sql('scores')}, lambda x: x * ln(x + 1e-12)))
                 AS entropy,
               {CLASS_LIST}[{argmax('scores')} + 1] AS top_class,
               {CLASS_LIST}[{second('scores')} + 1] AS second_class,
               {CLASS_LIST}[seq_id % 6 + 1] AS truth
        FROM scored""",
)


def _truth(rows):
    names = S.names_of(CLASSES)
    return rows.withColumn("truth", F.get(names, (F.col("seq_id") % 6).cast("int")))


def _features(spark, d):
    return refine.add_score_features(_truth(scored(spark, d)), CLASSES)


@register(
    "score_features",
    "seq_id:i window_idx:i top_score:d second_score:d margin:d top_prob:d entropy:d top_class:s "
    "second_class:s",
    "SELECT * FROM features", "features",
)
def _(spark, d):
    return _features(spark, d)


share_sql(
    "taus", "features",
    f"""SELECT class, coalesce(n, 0) AS n, CASE WHEN n >= 30 THEN tl END AS tau_logit,
               CASE WHEN n >= 30 THEN tm END AS tau_margin
        FROM (SELECT unnest({CLASS_LIST}) AS class) LEFT JOIN
             (SELECT truth AS class, count(*) AS n, quantile_cont(top_score, 0.2) AS tl,
                     quantile_cont(margin, 0.2) AS tm
              FROM features WHERE top_class = truth GROUP BY truth) USING (class)""",
)


@register(
    "fitted_thresholds", "class:s n:i tau_logit:d tau_margin:d", "SELECT * FROM taus", "taus"
)
def _(spark, d):
    taus = refine.fit_thresholds(_features(spark, d), CLASSES, 0.2, "top_class")
    none = F.lit(None).cast("double")
    return taus.select(
        "class", "n",
        *[F.when(F.col(c) > -1e300, F.col(c)).otherwise(none).alias(c)
          for c in ("tau_logit", "tau_margin")],
    )


share_sql(
    "refined", "features taus",
    """SELECT *, CASE
          WHEN close AND list_sort([top_class, second_class]) = ['bacteria', 'plasmid']
            THEN 'bacteria_or_plasmid'
          WHEN close AND list_sort([top_class, second_class]) = ['phage', 'virus']
            THEN 'virus_any'
          WHEN close OR low THEN 'unknown' ELSE top_class END AS refined
       FROM (SELECT f.*, coalesce(margin < tau_margin, false) AS close,
                    coalesce(top_score < tau_logit, false) AS low
             FROM features f JOIN taus ON top_class = class)""",
)


def _refined(spark, d):
    features = _features(spark, d)
    return refine.refine_windows(features, refine.fit_thresholds(features, CLASSES, 0.2, "top_class"))


@register(
    "refined_windows", "seq_id:i window_idx:i refined:s", "SELECT * FROM refined", "refined"
)
def _(spark, d):
    return _refined(spark, d)


def _aggregate_sql(mode: str, split: float, allow: bool) -> str:
    weight = "greatest(margin, 0.0)" if mode == "weighted" else "1.0::DOUBLE"
    where = "" if mode == "unweighted" else "WHERE refined <> 'unknown'"

    def factor(c: str) -> str:
        pair = {"bacteria": "bacteria_or_plasmid", "plasmid": "bacteria_or_plasmid",
                "phage": "virus_any", "virus": "virus_any"}.get(c)
        inside = f"CASE WHEN refined = '{pair}' THEN {split}::DOUBLE ELSE 0 END" if pair else "0"
        return (
            f"CASE WHEN refined IN ('bacteria_or_plasmid', 'virus_any') THEN {inside} ELSE 1 END"
        )

    sums = ", ".join(
        f"sum(scores[{i + 1}] * {weight} * {factor(c)})" for i, c in enumerate(CLASSES)
    )
    call = "top"
    if allow:
        call = """CASE WHEN margin < 1.0 AND list_sort([top, sec]) = ['bacteria', 'plasmid']
                       THEN 'bacteria_or_plasmid'
                       WHEN margin < 1.0 AND list_sort([top, sec]) = ['phage', 'virus']
                       THEN 'virus_any' ELSE top END"""
    return f"""SELECT *, top AS contig_top_class, sec AS contig_second_class,
                      margin AS contig_margin, sums[1] AS bacteria_score, {call} AS contig_call
               FROM (SELECT *, list_max(sums) AS contig_top_logit,
                       {CLASS_LIST}[{argmax('sums')} + 1] AS top,
                       {CLASS_LIST}[{second('sums')} + 1] AS sec,
                       list_max(sums) - sums[{second('sums')} + 1] AS margin
                     FROM (SELECT seq_id AS contig_id, [{sums}] AS sums, count(*) AS n_windows_used,
                             sum({weight}) AS total_weight,
                             count(*) FILTER (refined IN ('bacteria_or_plasmid', 'virus_any'))
                               AS n_merged_windows
                           FROM refined {where} GROUP BY seq_id HAVING count(*) >= 3))"""


for _name, _mode, _split, _allow in [
    ("gated_contig_calls", "gated", "half", False),
    ("weighted_contig_calls", "weighted", "full", True),
    ("unweighted_contig_calls", "unweighted", "half", True),
]:

    @register(
        _name,
        "contig_id:i n_windows_used:i total_weight:d n_merged_windows:i contig_top_class:s "
        "contig_second_class:s contig_top_logit:d contig_margin:d bacteria_score:d contig_call:s",
        _aggregate_sql(_mode, 0.5 if _split == "half" else 1.0, _allow), "refined",
    )
    def _(spark, d, mode=_mode, split=_split, allow=_allow):
        return refine.aggregate_refined(
            _refined(spark, d), CLASSES, mode=mode, merge_split=split, allow_merged=allow
        )


@register(
    "calibrated_thresholds", "class:s n:i has_limit:b",
    "SELECT class, n, n >= 30 AS has_limit FROM taus", "taus",
)
def _(spark, d):
    taus = calibrate_refinement(_truth(scored(spark, d)), CLASSES, "truth", 0.2)
    return taus.withColumn("has_limit", F.col("tau_logit") > -1e300)


# ---- models, discrepancies, reliability -------------------------------------------------------

share_sql(
    "models", "vscores",
    """SELECT vec_id, model, list_transform(embedding[model * 6 + 1:model * 6 + 6],
              lambda x: x * 10.0::DOUBLE) AS scores
       FROM vscores, (SELECT unnest([0, 1, 2]) AS model)""",
)


def _models(spark, d):
    model = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("model")
    rows = vector_scores(spark, d).select("vec_id", "embedding", model)
    part = F.slice("embedding", F.col("model") * 6 + 1, F.lit(6))
    return rows.select(
        "vec_id", "model", F.transform(part, lambda x: x * 10.0).alias("scores")
    )


for _name, _method, _agg in [
    ("mean_of_models", "mean", "avg"), ("sum_of_models", "sum", "sum"),
]:

    @register(
        _name, "vec_id:i scores:ld",
        "SELECT vec_id, [" + ", ".join(f"{_agg}(scores[{i + 1}])" for i in range(6))
        + "] AS scores FROM models GROUP BY vec_id", "models",
    )
    def _(spark, d, method=_method):
        return scoring.combine_models(_models(spark, d), ["vec_id"], method, 6)


@register(
    "vote_of_models", "vec_id:i scores:ld",
    f"""SELECT vec_id, list_transform(means, lambda x, i: CASE WHEN i = {argmax('votes')} + 1
               THEN x ELSE 0.0 END) AS scores
        FROM (SELECT vec_id, [{", ".join(
            f"count(*) FILTER ({argmax('scores')} = {i})" for i in range(6))}] AS votes,
              [{", ".join(f"coalesce(avg(nullif(scores[{i + 1}], 0)), 0.0)"
                          for i in range(6))}] AS means FROM models GROUP BY vec_id)""",
    "models",
)
def _(spark, d):
    return scoring.combine_models(_models(spark, d), ["vec_id"], "vote", 6)


@register(
    "ood_signals", "vec_id:i max_prob:d entropy:d energy:d margin:d nmd_norm:d",
    f"""SELECT vec_id, list_max(p) AS max_prob,
               -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-10)))) AS entropy,
               ln(list_sum(list_transform(scores, lambda x: exp(x)))) AS energy,
               list_max(p) - p[{second('p')} + 1] AS margin,
               sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS nmd_norm
        FROM (SELECT *, {softmax_sql('scores')} AS p FROM vscores)""",
    "vscores",
)
def _(spark, d):
    names = ["max_prob", "entropy", "energy", "margin", "nmd_norm"]
    signals = S.ood_signals("scores", names, F.col("embedding"))
    return vector_scores(spark, d).select("vec_id", *[c.alias(n) for n, c in signals.items()])


@register(
    "mean_discrepancy", "vec_id:i nmd:ld",
    """SELECT vec_id, list_transform(embedding, lambda x, i: x - means[i]) AS nmd
       FROM vscores, (SELECT list(m ORDER BY ch) AS means FROM (
         SELECT ch, avg(embedding[ch]) AS m FROM vscores, (SELECT unnest(range(1, 65)) AS ch)
         WHERE vec_id % 2 = 0 GROUP BY ch))""",
    "vscores",
)
def _(spark, d):
    rows = vector_scores(spark, d)
    reference = scoring.channel_means(rows.where(F.col("vec_id") % 2 == 0))
    return scoring.mean_discrepancy(rows, reference)


_W = [((i * 5) % 7 - 3) / 4 for i in range(64)]


@register(
    "logistic_ood", "vec_id:i positive:d negative:d",
    f"""SELECT vec_id, {sigmoid_sql('z')} AS positive, {sigmoid_sql('-z')} AS negative FROM (
          SELECT vec_id, 0.2::DOUBLE + list_sum(list_transform(embedding, lambda x, i:
                 (x - m) / s * {_W}[i])) AS z
          FROM (SELECT vec_id, embedding, list_avg(embedding) AS m,
                       list_var_pop(embedding) ** 0.5 AS s FROM vscores))""",
    "vscores",
)
def _(spark, d):
    e = F.col("embedding")
    return vector_scores(spark, d).select(
        "vec_id", S.logistic_ood(e, _W, 0.2).alias("positive"),
        S.logistic_ood(e, _W, 0.2, positive=False).alias("negative"),
    )


@register(
    "ood_share", "seq_id:i ood_share:d",
    """SELECT seq_id, avg(CASE WHEN reliability < 0.3 THEN 1 ELSE 0 END) AS ood_share
       FROM vscores GROUP BY seq_id""",
    "vscores",
)
def _(spark, d):
    return scoring.ood_share(vector_scores(spark, d), ["seq_id"], "reliability", 0.3)


@register(
    "reliability_fraction", "seq_id:i reliability_score:d",
    f"""SELECT seq_id, round(avg(CASE WHEN {sigmoid_sql('reliability')} > 0.5 THEN 1 ELSE 0 END), 2)
               AS reliability_score FROM vscores GROUP BY seq_id""",
    "vscores",
)
def _(spark, d):
    return vector_scores(spark, d).groupBy("seq_id").agg(
        summary.reliability_fraction(F.col("reliability")).alias("reliability_score")
    )


@register(
    "confident_rows", "vec_id:i confidence:d id_label:i",
    f"""SELECT vec_id, list_max(p) AS confidence,
               CASE WHEN {argmax('scores')} = label % 6 THEN 1 ELSE 0 END AS id_label
        FROM (SELECT *, {softmax_sql('scores')} AS p FROM vscores) WHERE list_max(p) >= 0.5""",
    "vscores",
)
def _(spark, d):
    rows = vector_scores(spark, d).withColumn("label", F.col("label") % 6)
    return scoring.select_id_ood(rows, 0.5)


@register(
    "loss_and_accuracy", "loss:d accuracy:d n:i",
    f"""SELECT avg(-ln(({softmax_sql('scores')})[label % 6 + 1])) AS loss,
               avg(CASE WHEN {argmax('scores')} = label % 6 THEN 1 ELSE 0 END) AS accuracy,
               count(*) AS n FROM vscores""",
    "vscores",
)
def _(spark, d):
    rows = vector_scores(spark, d).withColumn("label", F.col("label") % 6)
    return scoring.loss_and_accuracy(rows)


@register(
    "logits_as_probabilities", "vec_id:i prob:d kept:d",
    f"""SELECT vec_id, {sigmoid_sql('reliability')} AS prob, {sigmoid_sql('reliability')} AS kept
        FROM vscores""",
    "vscores",
)
def _(spark, d):
    rows = vector_scores(spark, d).select("vec_id", "reliability")
    once = scoring.logits_to_prob_if_needed(rows, "reliability", "prob")
    # A second call sees values in [0, 1] only and keeps them.
    return scoring.logits_to_prob_if_needed(once, "prob", "kept")


@register(
    "prediction_table", "vec_id:i label:i logit_phage:d prob_phage:d",
    f"""SELECT vec_id, label, scores[2] AS logit_phage, ({softmax_sql('scores')})[2] AS prob_phage
        FROM vscores""",
    "vscores",
)
def _(spark, d):
    rows = summary.softmax_scores(vector_scores(spark, d))
    return prediction_table(rows, CLASSES, key="vec_id")


# ---- joint decoding ---------------------------------------------------------------------------

_COST = 0.25
_COSTS = transition_costs(CLASSES, _COST)


def _step(b: int) -> str:
    """Best previous class (1-based) for class ``b`` of the current window."""
    through = "[" + ", ".join(f"delta[{a + 1}] - {_COSTS[a][b]}::DOUBLE" for a in range(N)) + "]"
    return f"(list_position({through}, list_max({through})))"


_NEXT = ", ".join(
    f"em[{b + 1}] + (delta[{_step(b)}] - {[row[b] for row in _COSTS]}[{_step(b)}])"
    for b in range(N)
)
_GROW = ", ".join(f"paths[{_step(b)}] || [{b}]" for b in range(N))


@register(
    "jointly_decoded_windows", "seq_id:i window_idx:i decoded:i",
    f"""WITH RECURSIVE em AS MATERIALIZED (
          SELECT seq_id, window_idx, list_transform({softmax_sql('scores')}, lambda x: ln(x)) AS em
          FROM scored),
        walk AS (
          SELECT seq_id, window_idx, em AS delta, [{", ".join(f"[{b}]" for b in range(N))}] AS paths
          FROM em WHERE window_idx = 0
          UNION ALL
          SELECT e.seq_id, e.window_idx, [{_NEXT}], [{_GROW}]
          FROM walk w JOIN em e ON e.seq_id = w.seq_id AND e.window_idx = w.window_idx + 1),
        ends AS (
          SELECT seq_id, paths[{argmax('delta')} + 1] AS path
          FROM walk JOIN (SELECT seq_id, max(window_idx) AS window_idx FROM em GROUP BY seq_id)
               USING (seq_id, window_idx))
        SELECT seq_id, unnest(range(0, len(path))) AS window_idx, unnest(path) AS decoded
        FROM ends""",
    "scored",
)
def _(spark, d):
    return viterbi_labels(scored(spark, d), _COSTS)
