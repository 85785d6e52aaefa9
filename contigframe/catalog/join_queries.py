"""Queries that join: borders and genes, repeats, taxa, near duplicates, samples."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.constants import CLASSES
from ..functions.dna import reverse_complement
from ..operators import dedup, validate
from ..operators.lineage import cut, shared_folder
from ..operators.regions import orf_intervals, snap_boundaries
from ..operators.repeats import att_sites, terminal_repeats
from ..operators.summary import add_repeats, contig_summary
from ..operators.taxonomy import (
    ancestors,
    attach_taxid,
    lineage_string,
    majority_lca,
    resolve_merged,
)
from ..operators.vector_index import nearest_vectors
from ..operators.windows import fragments_tail_aligned
from ..plans.contigs import assign_taxa, build_taxonomy, evaluate_sample, predict_taxa
from ..sources.results import pair_samples
from ..sources.tables import read_table
from .base import (
    REGISTRY,
    SIZE,
    climb_sql,
    links_sql,
    mers_sql,
    register,
    scored,
    sequences,
    share_sql,
    share_variant,
    sql_count,
)
from .evaluation_queries import _calls
from .order_queries import placed
from .sequence_queries import REVCOMP

# ---- equal joins --------------------------------------------------------------------------


@register(
    "attached_labels", "seq_id:i length:i quality:i toxic:i",
    """SELECT seq_id, length(seq) AS length, quality, toxic FROM seqs JOIN labels ON doc_id = seq_id""",
    "seqs",
)
def _(spark, d):
    labels = read_table(spark, d, "labels").withColumnRenamed("doc_id", "seq_id")
    return sequences(spark, d).join(labels, "seq_id").withColumn("length", F.length("seq"))


@register(
    "correct_ids", "seq_id:s",
    """SELECT 'c' || vec_id AS seq_id FROM calls WHERE truth = prediction""", "calls",
)
def _(spark, d):
    index = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("truth")) - 1
    named = _calls(spark, d).select(
        F.concat(F.lit("c"), "vec_id", F.lit("__class="), index).alias("contig_id"), "prediction"
    )
    return validate.correct_prediction_ids(named, CLASSES)


@register(
    "known_ids", "seq_id:i",
    "SELECT seq_id FROM seqs WHERE seq_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "seqs",
)
def _(spark, d):
    toxic = read_table(spark, d, "labels").where("toxic = 1").select(
        F.col("doc_id").alias("seq_id")
    )
    return sequences(spark, d).join(toxic, "seq_id", "left_semi")


@register(
    "paired_samples", "sample:s label_name:s",
    """SELECT sample, max_by(label_name, length(label_name)) AS label_name
       FROM (SELECT DISTINCT source || '_' || lang || '_' || doc_id % 5 AS sample FROM documents) p
       LEFT JOIN (SELECT DISTINCT source || CASE WHEN doc_id % 2 = 0 THEN '_' || lang ELSE '' END
                    AS label_name FROM documents WHERE source <> 'src3') l
       ON sample = label_name OR starts_with(sample, label_name || '_') GROUP BY sample""",
)
def _(spark, d):
    docs = read_table(spark, d, "documents")
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_"), "lang")).otherwise("")
    samples = docs.select(
        F.concat_ws("_", "source", "lang", (F.col("doc_id") % 5).cast("string")).alias("sample")
    )
    names = docs.where("source <> 'src3'").select(F.concat("source", tail).alias("label_name"))
    return pair_samples(samples, names)


@register(
    "evaluated_samples", "sample:i precision:d recall:d f1:d num_contigs:i",
    """SELECT vec_id % 4 AS sample,
              coalesce(count(*) FILTER (t AND p) / nullif(count(*) FILTER (p), 0)::DOUBLE, 0)
                AS precision,
              coalesce(count(*) FILTER (t AND p) / nullif(count(*) FILTER (t), 0)::DOUBLE, 0)
                AS recall,
              coalesce(2 * count(*) FILTER (t AND p) / nullif(count(*) FILTER (t) +
                count(*) FILTER (p), 0)::DOUBLE, 0) AS f1, count(*) AS num_contigs
       FROM (SELECT vec_id, truth IN ('phage', 'virus') AS t,
                    prediction IN ('phage', 'virus') AS p FROM calls)
       GROUP BY 1""",
    "calls",
)
def _(spark, d):
    from ..operators.metrics import binary_metrics

    calls = _calls(spark, d)
    truth = calls.select(
        F.col("vec_id").alias("contig_id"), F.col("truth").alias("fraction"),
        (F.col("vec_id") % 4).alias("sample"),
    )
    preds = calls.select(F.col("vec_id").alias("contig_id"), "prediction")
    return binary_metrics(truth.join(preds, "contig_id"), keys=["sample"])


@register(
    "evaluated_sample", "class:s precision:d recall:d f1:d support:i",
    """SELECT class, coalesce(tp / nullif(predicted, 0)::DOUBLE, 0) AS precision,
              coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall,
              coalesce(2 * tp / nullif(predicted + support, 0)::DOUBLE, 0) AS f1, support
       FROM per_class""",
    "per_class",
)
def _(spark, d):
    calls = _calls(spark, d)
    truth = calls.select(F.col("vec_id").alias("contig_id"), F.col("truth").alias("fraction"))
    preds = calls.select(
        F.col("vec_id").alias("contig_id"), "prediction", "reliability_score"
    )
    return evaluate_sample(preds, truth, 0.5)["per_class"]


# ---- genes and borders ----------------------------------------------------------------------

share_sql(
    "orfs", "seqs",
    f"""WITH strands AS (SELECT seq_id, length(seq) AS len, '+' AS strand, seq AS s FROM seqs
                         UNION ALL SELECT seq_id, length(seq), '-', {REVCOMP.format('seq')}
                         FROM seqs),
             cut AS (SELECT seq_id, len, strand, frame,
                            regexp_extract_all(substr(s, frame + 1), '...') AS list
                     FROM strands, (SELECT unnest([0, 1, 2]) AS frame)),
             codons AS (SELECT seq_id, len, strand, frame, unnest(list) AS codon,
                               unnest(range(0, len(list))) * 3 + frame AS pos FROM cut),
             ev AS (SELECT *, CASE WHEN codon <> 'ATG' THEN pos END AS stop FROM codons
                    WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA')),
             named AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY seq_id, strand, frame
                         ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
                         AS after FROM ev)
        SELECT seq_id, strand, frame, CASE WHEN strand = '+' THEN f ELSE len - t END AS start,
               CASE WHEN strand = '+' THEN t ELSE len - f END AS stop
        FROM (SELECT seq_id, strand, frame, after, min(pos) FILTER (codon = 'ATG') AS f,
                     min(stop) + 3 AS t, max(len) AS len FROM named GROUP BY ALL)
        WHERE t - f >= 30""",
)


@register(
    "open_reading_frames", "seq_id:i strand:s frame:i start:i end:i",
    "SELECT *, stop AS \"end\" FROM orfs", "orfs",
)
def _(spark, d):
    return orf_intervals(sequences(spark, d), 30)


@register(
    "snapped_borders", "seq_id:i start:i end:i refined_start:i refined_end:i",
    f"""SELECT p.seq_id, p.start, p.stop AS "end",
               greatest(0, p.start - least({2 * SIZE}, p.start - coalesce(
                 first(g.start ORDER BY g.start, g.stop)
                   FILTER (g.start <= p.start AND p.start < g.stop), p.start))) AS refined_start,
               least(p.seq_len, p.stop + least({2 * SIZE}, coalesce(
                 first(g.stop ORDER BY g.start, g.stop)
                   FILTER (g.start <= p.stop AND p.stop < g.stop), p.stop) - p.stop))
                 AS refined_end
        FROM placed p LEFT JOIN orfs g ON g.seq_id = p.seq_id
        GROUP BY p.seq_id, p.start, p.stop, p.seq_len, p.first_window""",
    "placed orfs",
)
def _(spark, d):
    genes = orf_intervals(sequences(spark, d), 30)
    return snap_boundaries(placed(spark, d), genes, 2 * SIZE, bucket=1024)


# ---- repeats --------------------------------------------------------------------------------


def _runs_sql(ends: str, key: str) -> str:
    """Best common run (at least 13 letters) of ``front`` and ``other`` per key and kind.

    The runs come from matching pairs of 13-mers, grouped along their diagonals; runs of one
    diagonal are chained over the letters between them.
    """
    return f"""
      fk AS (SELECT {key}, kind, i, substr(front, i + 1, 13) AS m FROM (
               SELECT *, unnest(range(0, length(front) - 12)) AS i FROM {ends}
               WHERE length(front) >= 13)),
      rk AS (SELECT {key}, kind, j, substr(other, j + 1, 13) AS m FROM (
               SELECT *, unnest(range(0, length(other) - 12)) AS j FROM {ends}
               WHERE length(other) >= 13)),
      hits AS (SELECT fk.{key}, fk.kind, i, j - i AS diag FROM fk JOIN rk
               ON fk.{key} = rk.{key} AND fk.kind = rk.kind AND fk.m = rk.m
               WHERE NOT contains(fk.m, 'N')),
      runs AS (SELECT {key}, kind, diag, min(i) AS i, count(*) + 12 AS len FROM (
                 SELECT *, i - row_number() OVER (PARTITION BY {key}, kind, diag ORDER BY i) AS grp
                 FROM hits) GROUP BY {key}, kind, diag, grp),
      gaps AS (SELECT r.*, lag(r.i + r.len) OVER (PARTITION BY r.{key}, r.kind, diag ORDER BY r.i)
                 AS prev_end, front, other FROM runs r JOIN {ends} e
               ON e.{key} = r.{key} AND e.kind = r.kind),
      same AS (SELECT {key}, kind, diag, i, len, CASE WHEN prev_end IS NULL THEN 0 ELSE len(
                 list_filter(range(prev_end, i), lambda x: substr(front, x + 1, 1) <> 'N' AND
                   substr(front, x + 1, 1) = substr(other, x + diag + 1, 1))) END AS eq,
                 coalesce(i - prev_end, 0) AS gap FROM gaps),
      sums AS (SELECT *, sum(2 * eq - 100 * (gap - eq) + 2 * len) OVER w AS total,
                      sum(eq + len) OVER w AS ids
               FROM same WINDOW w AS (PARTITION BY {key}, kind, diag ORDER BY i)),
      chains AS (SELECT *, min({{'s': total - 2 * len, 'i': i, 'ids': ids - len}}) OVER (
                   PARTITION BY {key}, kind, diag ORDER BY i) AS f FROM sums),
      scored_runs AS (SELECT {key}, kind, f.i AS a, f.i + diag AS b, i + len - f.i AS length,
                             ids - f.ids AS identities, total - f.s AS score FROM chains),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC,
                 CASE kind WHEN 'DTR' THEN 0 ELSE 1 END, a, b) AS place FROM scored_runs)
               WHERE place = 1)"""


share_sql(
    "terminal", "seqs",
    f"""WITH tips AS (SELECT *, left(seq, n) AS front, right(seq, n) AS rear FROM (
             SELECT seq_id, seq, length(seq) AS seq_len, least(least(greatest(
               floor(length(seq) * 0.04::DOUBLE)::BIGINT, 400), 4000), length(seq)) AS n
             FROM seqs WHERE length(seq) >= 1000)),
           ends AS (SELECT seq_id, 'DTR' AS kind, front, rear AS other FROM tips
                    UNION ALL SELECT seq_id, 'ITR', front, {REVCOMP.format('rear')} FROM tips),
           {_runs_sql('ends', 'seq_id')}
        SELECT t.seq_id AS contig_id, length AS repeat_length, identities,
               round(identities::DOUBLE / length, 2) AS identity, score,
               CASE WHEN kind = 'DTR' AND length >= 250 THEN 'LTR_DTR' ELSE kind END
                 AS terminal_repeats, a AS sstart, a + length AS send,
               seq_len - n + CASE WHEN kind = 'ITR' THEN greatest(n - (b + length - 1), 0)
                 ELSE greatest(b - 1, 0) END AS estart,
               seq_len - n + CASE WHEN kind = 'ITR'
                 THEN greatest(n - (b + length - 1), 0) + length
                 ELSE b + length - 1 END AS eend,
               substr(front, a + 1, length) AS front,
               CASE WHEN kind = 'ITR' THEN {REVCOMP.format(
                 f"substr({REVCOMP.format('rear')}, b + 1, length)")}
                 ELSE substr(rear, b + 1, length) END AS rear
        FROM tips t LEFT JOIN best USING (seq_id)""",
)


@register(
    "terminal_repeats",
    "contig_id:i repeat_length:i identities:i identity:d score:i terminal_repeats:s sstart:i "
    "send:i estart:i eend:i front:s rear:s",
    """SELECT * REPLACE (CASE WHEN repeat_length IS NULL THEN NULL ELSE estart END AS estart,
                         CASE WHEN repeat_length IS NULL THEN NULL ELSE eend END AS eend)
       FROM terminal""",
    "terminal",
)
def _(spark, d):
    return terminal_repeats(sequences(spark, d), 1000)


@register(
    "summary_with_repeats", "contig_id:i prediction:s terminal_repeats:s repeat_length:i",
    """SELECT s.contig_id, prediction, terminal_repeats, repeat_length
       FROM summary s LEFT JOIN terminal USING (contig_id)""",
    "summary terminal",
)
def _(spark, d):
    table = contig_summary(scored(spark, d), CLASSES, SIZE)
    return add_repeats(table, terminal_repeats(sequences(spark, d), 1000))


@register(
    "attachment_sites",
    "contig_id:i raw_start:i raw_end:i region_len:i att_type:s att_alignment_length:i "
    "att_score:i sstart:i eend:i gc%:d n%:d reject:b",
    f"""WITH near AS (SELECT *, region_id AS rid, substr(seq, lo + 1, start + off - lo) AS front,
                   substr(seq, rb + 1, hi - rb) AS rear FROM (
             SELECT p.*, p.seq_id || ':' || p.start || ':' || p.stop AS region_id, seq, off,
                    greatest(p.start - wide, 0) AS lo, least(p.stop + wide, p.seq_len) AS hi,
                    p.stop - off AS rb
             FROM (SELECT *, CASE WHEN (stop - start) // 2 >= 14000 THEN 2000
                       ELSE (stop - start) // 4 END AS off,
                       least(greatest(floor(seq_len * 0.04::DOUBLE)::BIGINT, 400), 4000) AS wide
                   FROM placed) p JOIN seqs s ON s.seq_id = p.seq_id)),
           ends AS (SELECT rid, 'DTR' AS kind, front, rear AS other FROM near
                    UNION ALL SELECT rid, 'ITR', front, {REVCOMP.format('rear')} FROM near),
           {_runs_sql('ends', 'rid')},
           cut AS (SELECT n.seq_id, n.start, n.stop, n.seq, n.lo, n.hi, n.rb, kind, a, b, length,
                     bb.score AS att_score,
                     CASE WHEN length IS NULL THEN n.start WHEN kind = 'ITR' THEN lo + a
                       ELSE lo + a END AS sstart,
                     CASE WHEN length IS NULL THEN n.stop
                       WHEN kind = 'ITR' THEN hi - (b + length - 1) - 1 + length
                       ELSE rb + b + length - 1 END AS eend
                   FROM near n LEFT JOIN best bb ON bb.rid = n.rid),
           body AS (SELECT *, substr(seq, sstart + 1, greatest(eend - sstart, 0)) AS body FROM cut)
        SELECT seq_id AS contig_id, start AS raw_start, stop AS raw_end, eend - sstart AS region_len,
               CASE WHEN kind = 'DTR' AND length - 1 >= 250 THEN 'LTR_DTR' ELSE kind END AS att_type,
               length AS att_alignment_length, att_score, sstart, eend,
               CASE WHEN length(body) = 0 THEN 0 ELSE ({sql_count('body', 'G')} +
                 {sql_count('body', 'C')})::DOUBLE / length(body) END AS "gc%",
               CASE WHEN length IS NOT NULL THEN CASE WHEN length(body) = 0 THEN 0 ELSE
                 {sql_count('body', 'N')}::DOUBLE / length(body) END END AS "n%",
               CASE WHEN length IS NOT NULL THEN length(body) > 0 AND
                 {sql_count('body', 'N')}::DOUBLE / length(body) > 0.20 END AS reject
        FROM body""",
    "placed seqs",
)
def _(spark, d):
    return att_sites(placed(spark, d), sequences(spark, d))


# ---- sequences with planted repeats -------------------------------------------------------------
# A stretch of each sequence without N stands at both ends: as it is, turned round, or not at all.


def _planted_sql(start: str, end: str, width: int, where: str) -> str:
    stretch = f"replace(substr(seq, {start} + 1, {width}), 'N', 'A')"
    other = f"CASE seq_id % 3 WHEN 0 THEN {stretch} ELSE {REVCOMP.format(stretch)} END"
    return f"""SELECT * REPLACE (CASE WHEN seq_id % 3 < 2 AND {where} THEN left(seq, {start}) || {stretch} ||
                 substr(seq, {start} + {width + 1}, {end} - {start} - {2 * width}) || {other} || substr(seq, {end} + 1)
               ELSE seq END AS seq) FROM seqs"""


def _planted(rows, start, end, width, where):
    def part(begin, length):
        return F.substr("seq", (begin + 1).cast("int"), length.cast("int"))

    stretch = F.translate(part(start, F.lit(width)), "N", "A")
    other = F.when(F.col("seq_id") % 3 == 0, stretch).otherwise(reverse_complement(stretch))
    whole = F.concat(
        part(F.lit(0), start), stretch, part(start + width, end - start - 2 * width), other, part(end, F.length("seq") - end)
    )
    return rows.withColumn("seq", F.when((F.col("seq_id") % 3 < 2) & where, whole).otherwise(F.col("seq")))


share_variant("_tips", ["terminal"], {"seqs": _planted_sql("0", "length(seq)", 80, "length(seq) >= 1000")})
share_variant("_sites", ["seqs"], {"seqs": _planted_sql("(length(seq) // 4)", "(length(seq) // 4 * 3)", 60, "length(seq) >= 2000")})
share_sql(
    "placed_sites", "seqs_sites",
    """SELECT seq_id, length(seq) // 4 AS start, length(seq) // 4 * 3 AS stop, 1.0 AS score, length(seq) AS seq_len
       FROM seqs_sites WHERE length(seq) >= 2000""",
)


@register(
    "planted_repeats",
    "contig_id:i repeat_length:i identities:i identity:d score:i terminal_repeats:s sstart:i "
    "send:i estart:i eend:i front:s rear:s",
    """SELECT * REPLACE (CASE WHEN repeat_length IS NULL THEN NULL ELSE estart END AS estart,
                         CASE WHEN repeat_length IS NULL THEN NULL ELSE eend END AS eend)
       FROM terminal_tips""",
    "terminal_tips",
)
def _(spark, d):
    rows = _planted(sequences(spark, d), F.lit(0), F.length("seq"), 80, F.length("seq") >= 1000)
    return terminal_repeats(rows, 1000)


@register(
    "planted_sites",
    "contig_id:i raw_start:i raw_end:i region_len:i att_type:s att_alignment_length:i "
    "att_score:i sstart:i eend:i gc%:d n%:d reject:b",
    re.sub(r"\b(placed|seqs)\b", r"\1_sites", REGISTRY["attachment_sites"].body), "placed_sites seqs_sites",
)
def _(spark, d):
    quarter = F.floor(F.length("seq") / 4)
    rows = cut(_planted(sequences(spark, d), quarter, quarter * 3, 60, F.length("seq") >= 2000))  # read four times
    regions = rows.where(F.length("seq") >= 2000).select(
        "seq_id", quarter.alias("start"), (quarter * 3).alias("end"), F.lit(1.0).alias("score")
    )
    return att_sites(regions, rows)


# ---- taxonomy -------------------------------------------------------------------------------
# A tree from the given tables: suppliers (species) in nations (genera) in regions (families)
# under one root. Ids: root 1, region 10+, nation 100+, supplier 1000+.

share_sql(
    "nodes", "",
    """SELECT 1 AS taxid, NULL::BIGINT AS parent, 'no rank' AS rank, 'root' AS name
       UNION ALL SELECT 10 + r_regionkey, 1, 'family', r_name FROM region
       UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'genus', n_name FROM nation
       UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, 'species', s_name FROM supplier""",
)
share_sql(
    "closure", "nodes",
    """WITH RECURSIVE up AS (SELECT taxid, taxid AS ancestor, 0 AS distance FROM nodes
         UNION ALL SELECT up.taxid, n.parent, up.distance + 1 FROM up
         JOIN nodes n ON n.taxid = up.ancestor WHERE n.parent IS NOT NULL)
       SELECT * FROM up""",
)


def _nodes(spark, d):
    def part(table, taxid, parent, rank, name):
        return read_table(spark, d, table).select(
            taxid.cast("bigint").alias("taxid"), parent.cast("bigint").alias("parent"),
            F.lit(rank).alias("rank"), F.col(name).alias("name"),
        )

    root = spark.range(1).select(
        F.lit(1).cast("bigint").alias("taxid"), F.lit(None).cast("bigint").alias("parent"),
        F.lit("no rank").alias("rank"), F.lit("root").alias("name"),
    )
    regions = part("region", F.col("r_regionkey") + 10, F.lit(1), "family", "r_name")
    nations = part("nation", F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "genus",
                   "n_name")
    suppliers = part("supplier", F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, "species",
                     "s_name")
    return root.unionByName(regions).unionByName(nations).unionByName(suppliers)


@register(
    "taxon_ancestors", "taxid:i ancestor:i distance:i", "SELECT * FROM closure", "closure"
)
def _(spark, d):
    return ancestors(_nodes(spark, d))


@register(
    "lineages", "taxid:i lineage:s",
    """SELECT c.taxid, string_agg(CASE rank WHEN 'family' THEN 'f' WHEN 'genus' THEN 'g' ELSE 's'
              END || '__' || name, ';' ORDER BY distance DESC) AS lineage
       FROM closure c JOIN nodes n ON n.taxid = ancestor WHERE rank <> 'no rank'
       GROUP BY c.taxid""",
    "nodes closure",
)
def _(spark, d):
    nodes = _nodes(spark, d)
    return lineage_string(nodes, ancestors(nodes), nodes, nodes.select("taxid", "name"))


@register(
    "merged_taxa", "c_custkey:i taxid:i",
    """SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 100 + (c_nationkey + 1) % 25
                              ELSE 100 + c_nationkey END AS taxid FROM customer""",
)
def _(spark, d):
    merged = read_table(spark, d, "nation").where("n_nationkey % 5 = 0").select(
        (F.col("n_nationkey") + 100).alias("old"),
        ((F.col("n_nationkey") + 1) % 25 + 100).alias("new"),
    )
    rows = read_table(spark, d, "customer").select(
        "c_custkey", (F.col("c_nationkey") + 100).alias("taxid")
    )
    return resolve_merged(rows, merged)


@register(
    "accession_taxa", "l_suppkey:i taxid:i n:i",
    """SELECT l_suppkey, s_nationkey + 100 AS taxid, count(*) AS n
       FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 <> 0
       GROUP BY ALL""",
)
def _(spark, d):
    acc = read_table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").alias("accession"), (F.col("s_nationkey") + 100).alias("taxid")
    )
    lines = read_table(spark, d, "lineitem").select("l_suppkey")
    return attach_taxid(lines, acc, "l_suppkey").groupBy("l_suppkey", "taxid").agg(
        F.count(F.lit(1)).alias("n")
    )


share_sql(
    "votes", "closure",
    """SELECT o_custkey, ancestor, count(*) AS votes, any_value(n) AS n_hits
       FROM (SELECT o_custkey, l_suppkey + 1000 AS taxid, count(*) OVER (PARTITION BY o_custkey)
               AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey) h
       JOIN closure c ON c.taxid = h.taxid GROUP BY o_custkey, ancestor""",
)


@register(
    "majority_taxa", "o_custkey:i lca:i n_hits:i",
    """SELECT o_custkey, max_by(ancestor, depth * 1000000 + votes * 10000 - ancestor) AS lca,
              max(n_hits) AS n_hits
       FROM votes JOIN (SELECT taxid, max(distance) AS depth FROM closure GROUP BY taxid)
            ON taxid = ancestor
       WHERE votes > n_hits * 0.25::DOUBLE GROUP BY o_custkey""",
    "votes",
)
def _(spark, d):
    lines = read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") + 1000).alias("taxid")
    )
    owners = read_table(spark, d, "orders").select("o_orderkey", "o_custkey")
    hits = lines.join(owners, "o_orderkey")
    return majority_lca(hits, ancestors(_nodes(spark, d)), "o_custkey", 0.25)


share_sql(
    "unit", "vscores",
    """SELECT vec_id, label, list_transform(embedding, lambda x: x / n) AS u FROM (
         SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n FROM vscores)""",
)
share_sql(
    "neighbours", "unit",
    """SELECT * FROM (
         SELECT q.vec_id AS query_id, r.vec_id, r.label AS taxid,
                list_inner_product(q.u, r.u) AS similarity,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.u, r.u)
                  DESC, r.vec_id) AS rank
         FROM unit q JOIN unit r ON q.vec_id % 2 = 1 AND r.vec_id % 2 = 0) WHERE rank <= 3""",
)


def _vectors(spark, d):
    table = read_table(spark, d, "embeddings")
    refs = table.where("vec_id % 2 = 0").select("vec_id", F.col("label").alias("taxid"), "embedding")
    queries = table.where("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries, refs


@register(
    "nearest_vectors", "query_id:i vec_id:i taxid:i similarity:d rank:i",
    "SELECT * FROM neighbours", "neighbours",
)
def _(spark, d):
    queries, refs = _vectors(spark, d)
    return nearest_vectors(queries, refs, 3, block=100)


_TAXA_SQL = """WITH h AS (SELECT query_id // 8 AS seq_id, 100 + taxid AS taxid FROM neighbours),
            v AS (SELECT seq_id, ancestor, count(*) AS votes,
                    (SELECT count(*) FROM h x WHERE x.seq_id = h.seq_id) AS n_hits
                  FROM h JOIN closure c ON c.taxid = h.taxid GROUP BY seq_id, ancestor),
            best AS (SELECT seq_id, max_by(ancestor, depth * 1000000 + votes * 10000 - ancestor)
                       AS lca, max(n_hits) AS n_hits
                     FROM v JOIN (SELECT taxid, max(distance) AS depth FROM closure GROUP BY taxid)
                          ON taxid = ancestor
                     WHERE votes > n_hits * 0.25::DOUBLE GROUP BY seq_id),
            lin AS (SELECT c.taxid, string_agg(CASE rank WHEN 'family' THEN 'f' WHEN 'genus'
                      THEN 'g' ELSE 's' END || '__' || name, ';' ORDER BY distance DESC) AS lineage
                    FROM closure c JOIN nodes n ON n.taxid = ancestor WHERE rank <> 'no rank'
                    GROUP BY c.taxid)
       SELECT seq_id, lca, n_hits, lineage FROM best LEFT JOIN lin ON lin.taxid = lca"""


@register("taxa_of_contigs", "seq_id:i lca:i n_hits:i lineage:s", _TAXA_SQL, "neighbours closure")
def _(spark, d):
    queries, refs = _vectors(spark, d)
    nodes = _nodes(spark, d)
    contigs = queries.withColumn("seq_id", F.floor(F.col("query_id") / 8))
    taxa = refs.withColumn("taxid", (F.col("taxid") + 100).cast("bigint"))
    names = nodes.select("taxid", "name")
    return assign_taxa(contigs, taxa, ancestors(nodes), nodes, names, 3, 0.25)


@register("predicted_taxa", "seq_id:i lca:i n_hits:i lineage:s", _TAXA_SQL, "neighbours closure")
def _(spark, d):
    """The taxonomy is built on disk and opened again."""
    queries, refs = _vectors(spark, d)
    nodes = _nodes(spark, d)
    windows = refs.select("vec_id", F.col("taxid").cast("string").alias("accession"), "embedding")
    accessions = refs.select(F.col("taxid").cast("string").alias("accession"), (F.col("taxid") + 100).cast("bigint").alias("taxid")).distinct()
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/taxonomy-{uuid.uuid4().hex}"
    build_taxonomy(windows, accessions, nodes, nodes.select("taxid", "name"), path, "signs", "1", cell_rows=100)
    contigs = queries.withColumn("seq_id", F.floor(F.col("query_id") / 8))
    return predict_taxa(contigs, path, "signs", "1", 3, 0.25)


# ---- near duplicates ------------------------------------------------------------------------

_K, _IDENTITY, _COVERAGE = 6, 0.6, 0.6

share_sql(
    "distinct_docs", "seqs",
    "SELECT seq, min(seq_id) AS seq_id, count(*) AS copies, length(seq) AS len FROM seqs GROUP BY seq",
)
share_sql("mers", "distinct_docs", mers_sql("distinct_docs", _K))
share_sql("links", "mers", links_sql("mers", _IDENTITY, _COVERAGE))


@register(
    "exact_duplicates", "seq_id:i copies:i length:i",
    "SELECT seq_id, copies, len AS length FROM distinct_docs", "distinct_docs",
)
def _(spark, d):
    rows = dedup.exact_groups(sequences(spark, d), "seq_id", "seq")
    return rows.withColumn("length", F.length("seq"))


@register(
    "similar_pairs", "member:i centre:i similarity:d",
    "SELECT member, centre, similarity FROM links", "links",
)
def _(spark, d):
    rows = dedup.exact_groups(sequences(spark, d), "seq_id", "seq")
    return dedup.centre_links(rows, _K, _IDENTITY, _COVERAGE)


@register(
    "non_redundant", "seq_id:i representative:i",
    f"""WITH RECURSIVE {climb_sql("links")}
       SELECT s.seq_id, coalesce(rep, dd.seq_id) AS representative
       FROM seqs s JOIN distinct_docs dd ON dd.seq = s.seq
       LEFT JOIN roots ON member = dd.seq_id""",
    "links",
)
def _(spark, d):
    return dedup.non_redundant(sequences(spark, d), _K, _IDENTITY, _COVERAGE)


share_sql(
    "distinct_pieces", "frags",
    """SELECT fragment AS seq, min(seq_id * 100000 + frag_idx) AS seq_id, length(fragment) AS len
       FROM frags GROUP BY fragment""",
)
share_sql("piece_mers", "distinct_pieces", mers_sql("distinct_pieces", 8))
share_sql("piece_links", "piece_mers", links_sql("piece_mers", 0.6, 0.6))


@register(
    "non_redundant_fragments", "frag_id:i representative:i",
    f"""WITH RECURSIVE {climb_sql("piece_links")}
       SELECT p.seq_id * 100000 + p.frag_idx AS frag_id, coalesce(rep, d.seq_id) AS representative
       FROM frags p JOIN distinct_pieces d ON d.seq = p.fragment
       LEFT JOIN roots ON member = d.seq_id""",
    "frags piece_links",
)
def _(spark, d):
    pieces = fragments_tail_aligned(sequences(spark, d), 300, 100, label="lang")
    rows = pieces.select(
        (F.col("seq_id") * 100000 + F.col("frag_idx")).alias("frag_id"),
        F.col("fragment").alias("seq"),
    )
    return dedup.non_redundant(rows, 8, key="frag_id")
