"""Queries that build training sets: splits, balance, batches, perturbations, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames
from ..functions.dna import base_counts, rounded_skew
from ..functions.picks import row_hash
from ..operators import datasets as D
from ..operators import perturb as P
from ..operators import validate
from ..operators.scoring import composition, linear_scores
from ..operators.windows import fragments_tail_aligned
from ..plans.training import encode_dataset, fragment_set, ood_set, reliability_set
from ..sources.encoded import union_padded
from ..sources.tables import read_table
from .base import (
    BIAS,
    WEIGHTS,
    at_sql,
    climb_sql,
    links_sql,
    md5_hash,
    mers_sql,
    register,
    sequences,
    share_sql,
    sql_count,
    tail_aligned_sql,
)
from .sequence_queries import _codon_sql

LANG_IDS = {"de": 0, "en": 1, "es": 2, "fr": 3}
_LABEL_SQL = "CASE lang " + " ".join(f"WHEN '{lang}' THEN {i}" for lang, i in LANG_IDS.items()) + " END"


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "lang", "n_chars")


def _ranked_sql(table: str, key: str, seed: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return (
        f"SELECT *, row_number() OVER ({part} ORDER BY {md5_hash(key, seed=seed)}, {key}) - 1 "
        f"AS r, count(*) OVER ({part}) AS n FROM {table}"
    )


@register(
    "shuffled_rows", "doc_id:i position:i",
    f"SELECT doc_id, r AS position FROM ({_ranked_sql('documents', 'doc_id', 7)})",
)
def _(spark, d):
    return D.hash_rank(_docs(spark, d), [], "doc_id", 7, "position")


@register(
    "first_shuffled_rows", "doc_id:i lang:s",
    f"SELECT doc_id, lang FROM ({_ranked_sql('documents', 'doc_id', 7)}) WHERE r < 25",
)
def _(spark, d):
    return D.shuffle_rows(_docs(spark, d), "doc_id", 7).limit(25)


@register(
    "exact_split", "doc_id:i split:s",
    f"""SELECT doc_id, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train'
               WHEN r < floor(n * 0.7::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val'
               ELSE 'test' END AS split
        FROM ({_ranked_sql('documents', 'doc_id', 3)})""",
)
def _(spark, d):
    return D.split_dataset(_docs(spark, d), "doc_id", 0.7, 0.2, 0.1, seed=3)


@register(
    "exact_split_large", "split:s n_rows:i key_sum:i",
    f"""SELECT split, count(*) AS n_rows, sum(k) AS key_sum FROM (
          SELECT l_orderkey * 10 + l_linenumber AS k,
                 CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train'
                      WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val'
                      ELSE 'test' END AS split
          FROM ({_ranked_sql(
              "(SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row_key "
              "FROM lineitem)", "row_key", 1)})) GROUP BY split""",
)
def _(spark, d):
    rows = read_table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_key"),
    )
    return D.split_dataset(rows, "row_key", 0.8, 0.1, 0.1, seed=1).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("k").alias("key_sum")
    )


@register(
    "validation_first_split", "doc_id:i split:s",
    f"""SELECT doc_id, CASE WHEN r < floor(n * 0.25::DOUBLE) THEN 'val' ELSE 'train' END AS split
        FROM ({_ranked_sql('documents', 'doc_id', 3)})""",
)
def _(spark, d):
    return D.split_val_first(_docs(spark, d), "doc_id", 0.25, seed=3)


@register(
    "assigned_shards", "doc_id:i lang:s shard:i",
    f"SELECT doc_id, lang, r % 7 AS shard FROM ({_ranked_sql('documents', 'doc_id', 0, 'lang')})",
)
def _(spark, d):
    return D.assign_shards(_docs(spark, d), "doc_id", "lang", 7)


@register(
    "interleaved_classes", "doc_id:i lang:s position:i",
    f"""SELECT doc_id, lang, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, lang) - 1
               AS position FROM ({_ranked_sql('documents', 'doc_id', 2, 'lang')})""",
)
def _(spark, d):
    return D.interleave_classes(_docs(spark, d), "doc_id", "lang", 2)


_SIZES = {3: 13, 5: 2}


@register(
    "length_batches", "row_key:s len:i batch_idx:i batch_size:i",
    f"""SELECT row_key, len, r // size AS batch_idx, size AS batch_size FROM (
          SELECT *, CASE len WHEN 3 THEN 12 ELSE 8 END AS size FROM ({_ranked_sql(
              "(SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS row_key, "
              "l_linenumber AS len FROM lineitem)", "row_key", 4, "len")}))
        WHERE (r // size + 1) * size <= n""",
)
def _(spark, d):
    rows = read_table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row_key"),
        F.col("l_linenumber").alias("len"),
    )
    return D.length_batches(rows, "row_key", "len", _SIZES, 10, 4, seed=4)


_TARGET = """
    SELECT lang, n_label, base + CASE WHEN pos <= gap THEN 1 ELSE 0 END AS target FROM (
      SELECT *, m - sum(base) OVER () AS gap,
             row_number() OVER (ORDER BY base - exact, lang) AS pos FROM (
        SELECT lang, n_label, m, m * n_label::DOUBLE / total AS exact,
               round_even(m * n_label::DOUBLE / total, 0) AS base
        FROM (SELECT lang, count(*) AS n_label, sum(count(*)) OVER () AS total FROM documents
              GROUP BY lang), (SELECT count(*) AS m FROM labels)))"""


@register(
    "downsampled_rows", "doc_id:i lang:s",
    f"""SELECT doc_id, r.lang FROM ({_ranked_sql('documents', 'doc_id', 6, 'lang')}) r
        JOIN ({_TARGET}) t ON r.lang = t.lang WHERE r.r < target""",
)
def _(spark, d):
    size = read_table(spark, d, "labels").agg(F.count(F.lit(1)).alias("n"))
    return D.downsample_to_match(_docs(spark, d), "lang", "doc_id", size, 6)


@register(
    "stratified_sample", "doc_id:i lang:s",
    f"""SELECT doc_id, lang FROM (
          SELECT *, row_number() OVER (ORDER BY CASE WHEN r = 0 THEN 0 ELSE 1 END,
                    {md5_hash('doc_id', seed=8)}, doc_id) - 1 AS place
          FROM ({_ranked_sql('documents', 'doc_id', 8, 'lang')}) x, (SELECT count(*) AS total
                FROM documents)
          WHERE r < greatest(1, round_even(90 * n::DOUBLE / total, 0))) WHERE place < 90""",
)
def _(spark, d):
    return D.stratified_sample(_docs(spark, d), "lang", "doc_id", 90, 8)


@register(
    "replaced_class", "doc_id:i lang:s origin:s",
    f"""SELECT doc_id, lang, 'old' AS origin FROM documents WHERE lang <> 'fr'
        UNION ALL
        SELECT doc_id, lang, 'old' FROM ({_ranked_sql(
            "(SELECT * FROM documents WHERE lang = 'fr')", 'doc_id', 9)})
        WHERE r < n - (SELECT count(*) FROM documents WHERE lang = 'es' AND doc_id % 2 = 0)
        UNION ALL
        SELECT doc_id + 1000000, 'fr', 'new' FROM documents WHERE lang = 'es' AND doc_id % 2 = 0""",
)
def _(spark, d):
    docs = _docs(spark, d).select("doc_id", "lang", F.lit("old").alias("origin"))
    new = _docs(spark, d).where((F.col("lang") == "es") & (F.col("doc_id") % 2 == 0)).select(
        (F.col("doc_id") + 1000000).alias("doc_id"), F.lit("fr").alias("lang"),
        F.lit("new").alias("origin"),
    )
    return D.replace_class(docs, new, "lang", "fr", "doc_id", 9)


@register(
    "united_passes", "doc_id:i lang:s band:s",
    """SELECT doc_id, lang, 'long' AS band FROM documents WHERE n_chars >= 1500
       UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE n_chars BETWEEN 500 AND 1499""",
)
def _(spark, d):
    docs = _docs(spark, d)
    long = docs.where(F.col("n_chars") >= 1500).withColumn("band", F.lit("long"))
    short = docs.where((F.col("n_chars") >= 500) & (F.col("n_chars") < 1500))
    return long.unionByName(short, allowMissingColumns=True)


@register(
    "padded_union", "seq_id:i start:i length:i tokens:l",
    """SELECT *, t || list_transform(range(0, max(length) OVER () - length), lambda x: 0) AS tokens
       FROM (SELECT *, len(t) AS length FROM (
         SELECT seq_id, start, list_transform(string_split(crop, ''),
                  lambda x: strpos('AGTC', x)) AS t FROM crops))""",
    "crops",
)
def _(spark, d):
    rows = _crops(spark, d)
    # Two sets that together are all crops.
    parts = [
        rows.where(F.col("seq_id") % 2 == n).select(
            "seq_id", "start", frames.letter_tokens("crop", frames.BASE_TOKENS).alias("tokens")
        )
        for n in (0, 1)
    ]
    return union_padded(parts, "tokens")


# ---- altered copies ---------------------------------------------------------------------------

share_sql(
    "hashed", "crops", f"SELECT *, {md5_hash('seq_id', 'start', seed=21)} AS h FROM crops"
)


def _crops(spark, d):
    from .sequence_queries import _crops as crops

    return crops(spark, d).withColumn("h", row_hash("seq_id", "start", seed=21))


def _by_hash_sql(items: str, h: str = "h") -> str:
    return (
        f"list_transform(list_sort(list_transform({items}, lambda x, i: "
        f"{{'h': {at_sql(h, 'i - 1')}, 'i': i, 'x': x}})), lambda s: s.x)"
    )


@register(
    "shuffled_bases", "seq_id:i start:i shuffled:s blocks:s",
    f"""SELECT seq_id, start, array_to_string({_by_hash_sql("string_split(crop, '')")}, '')
                 AS shuffled,
               array_to_string({_by_hash_sql("regexp_extract_all(crop, '.{5}')")}, '')
                 || right(crop, length(crop) % 5) AS blocks FROM hashed""",
    "hashed",
)
def _(spark, d):
    return _crops(spark, d).select(
        "seq_id", "start", P.shuffle_bases("crop", F.col("h")).alias("shuffled"),
        P.kmer_shuffle("crop", F.col("h"), 5).alias("blocks"),
    )


_PAIRS = (
    "array_to_string(list_sort(list_transform(range(1, greatest(length(crop), 1)), "
    "lambda i: substr(crop, i, 2))), ',')"
)


@register(
    "pair_shuffled", "seq_id:i start:i pairs:s first:s last:s len:i",
    f"""SELECT seq_id, start, {_PAIRS} AS pairs, left(crop, 1) AS first, right(crop, 1) AS last,
               length(crop) AS len FROM crops""",
    "crops",
)
def _(spark, d):
    rows = _crops(spark, d).withColumn("s", P.dinuc_shuffle("crop", F.col("h")))
    return rows.select(
        "seq_id", "start", P.sorted_pairs("s").alias("pairs"),
        F.left("s", F.lit(1)).alias("first"), F.right("s", F.lit(1)).alias("last"),
        F.length("s").alias("len"),
    )


def _between(h: str, low: str, high: str) -> str:
    return f"({low} + {h} % (({high}) - ({low}) + 1))"


_MOTIF = " || ".join(f"substr('ACGT', {at_sql('h', str(100 + i))} % 4 + 1, 1)" for i in range(30))


@register(
    "repeated_windows", "seq_id:i start:i subseq:s tandem:s",
    f"""SELECT seq_id, start, left(crop, b) || left(repeat(substr(crop, src + 1, sz), w // sz + 1),
                 w) || substr(crop, b + w + 1) AS subseq,
               left(crop, b) || left(repeat(left(motif, msz), w // msz + 1), w)
                 || substr(crop, b + w + 1) AS tandem
        FROM (SELECT *, {_between(at_sql('h', '3'), '0', 'n - sz')} AS src FROM (
          SELECT *, {_between(at_sql('h', '1'), '0', 'greatest(n - w, 0)')} AS b,
                 {_between(at_sql('h', '2'), '1', 'least(w, n)')} AS sz,
                 {_between(at_sql('h', '2'), '3', '10')} AS msz, {_MOTIF} AS motif
          FROM (SELECT *, length(crop) AS n, greatest(1, length(crop) // 4) AS w FROM hashed)))""",
    "hashed",
)
def _(spark, d):
    return _crops(spark, d).select(
        "seq_id", "start", P.repeat_window("crop", F.col("h")).alias("subseq"),
        P.tandem_window("crop", F.col("h")).alias("tandem"),
    )


@register(
    "tandem_negatives", "seq_id:s motif:s seq:s label:i",
    f"""SELECT 'tandem_repeat_' || seq_id AS seq_id, motif, left(repeat(motif, 2048 // length(motif) + 1), 2048) AS seq, 0 AS label
        FROM (SELECT seq_id, substr(bases, ({at_sql('h', '3')} % (length(bases) - sz + 1) + 1)::BIGINT, sz::BIGINT) AS motif
              FROM (SELECT *, least({_between(at_sql('h', '2'), '3', '30')}, length(bases)) AS sz
                    FROM (SELECT seq_id, replace(seq, 'N', '') AS bases, {md5_hash('seq_id', seed=13)} AS h FROM seqs) WHERE bases <> ''))""",
    "seqs",
)
def _(spark, d):
    return P.tandem_repeats(sequences(spark, d), seed=13)


@register(
    "augmented_bases", "seq_id:i start:i seq:s",
    f"""SELECT seq_id, start, array_to_string(list_transform(string_split(crop, ''), lambda ch, i:
              CASE WHEN {at_sql('h', 'i')}::DOUBLE / 4294967296.0::DOUBLE < 0.1::DOUBLE
                   THEN substr('ATGC', {at_sql('h', 'i - 1 + 16777216')} % 4 + 1, 1) ELSE ch END),
              '') AS seq FROM hashed""",
    "hashed",
)
def _(spark, d):
    return _crops(spark, d).select(
        "seq_id", "start", P.augment("crop", F.col("h"), 0.1).alias("seq")
    )


@register(
    "shuffled_frames", "seq_id:i start:i frames:ll",
    f"""SELECT seq_id, start, {_by_hash_sql('frames')} AS frames FROM (
          SELECT c.*, {md5_hash('seq_id', 'start', seed=21)} AS h
          FROM ({_codon_sql('codon_id')}) c)""",
    "crops",
)
def _(spark, d):
    return _crops(spark, d).select(
        "seq_id", "start",
        P.shuffle_frames(frames.codon_frames("crop"), F.col("h")).alias("frames"),
    )


@register(
    "n_stretches", "seq_id:i start:i len:i n_total:i kept:b",
    f"""SELECT seq_id, start, length(crop) AS len,
               least(length(crop), greatest(1, round_even(length(crop) * (0.3::DOUBLE +
                 ({at_sql('h', '1')}::DOUBLE / 4294967296.0::DOUBLE) * 0.2::DOUBLE), 0)::BIGINT))
                 AS n_total, true AS kept
        FROM (SELECT *, {md5_hash('seq_id', 'start', seed=21)} AS h FROM (
                SELECT seq_id, start, replace(crop, 'N', 'A') AS crop FROM crops))""",
    "crops",
)
def _(spark, d):
    rows = _crops(spark, d).withColumn("clean", F.translate("crop", "N", "A"))
    out = rows.withColumn("s", P.n_stretch("clean", F.col("h"), 0.3, 0.5))
    same = F.zip_with(
        F.split("s", ""), F.split("clean", ""), lambda a, b: (a == b) | (a == "N")
    )
    return out.select(
        "seq_id", "start", F.length("s").alias("len"), F.regexp_count("s", F.lit("N"))
        .alias("n_total"), F.forall(same, lambda x: x).alias("kept"),
    )


@register(
    "chimeras", "chimera_id:i n_classes:i len:i seq:s",
    f"""WITH source AS (SELECT seq_id, lang, seq, length(seq) AS len, row_number() OVER (PARTITION BY lang
                          ORDER BY {md5_hash('seq_id', seed=17)}, seq_id) - 1 AS r FROM seqs WHERE length(seq) > 0),
             class AS (SELECT list(struct_pack(c := lang, n := n) ORDER BY lang) AS classes
                       FROM (SELECT lang, count(*) AS n FROM source GROUP BY lang)),
             made AS (SELECT chimera_id, {md5_hash('chimera_id', seed=17)} AS h, classes
                      FROM (SELECT unnest(range(0, (SELECT count(*) FROM source))) AS chimera_id), class),
             mixed AS (SELECT chimera_id, h, list_sort(list_transform(range(0, len(classes)), lambda i:
                         struct_pack(k := {at_sql('h', 'i')}, i := i, c := classes[i + 1].c, n := classes[i + 1].n))) AS picks,
                         [0] || list_sort([{at_sql('h', '71')} % 501, {at_sql('h', '72')} % 501]) || [500] AS edges FROM made),
             part AS (SELECT chimera_id, h, part, picks[part + 1].c AS lang, edges[part + 2] - edges[part + 1] AS wide,
                             {at_sql('h', 'part + 50')} % picks[part + 1].n AS r
                      FROM (SELECT *, unnest([0, 1, 2]) AS part FROM mixed)),
             cut AS (SELECT chimera_id, h, part, seq, len, part.lang, least(wide, len) AS size FROM part JOIN source USING (lang, r)),
             piece AS (SELECT chimera_id, part, lang, substr(seq, ({at_sql('h', 'part + 90')} % (len - size + 1) + 1)::BIGINT, size::BIGINT) AS piece FROM cut)
        SELECT chimera_id, count(DISTINCT lang) AS n_classes, 500 AS len, rpad(string_agg(piece, '' ORDER BY part), 500, 'N') AS seq
        FROM piece GROUP BY chimera_id""",
    "seqs",
)
def _(spark, d):
    rows = sequences(spark, d).withColumnRenamed("lang", "label").where(F.length("seq") > 0)
    # As many mixes as there are source rows.
    count = rows.count()
    mixed = P.chimera(rows, 3, 500, count, seed=17)
    return mixed.select(
        "chimera_id", F.size(F.array_distinct("labels")).alias("n_classes"),
        F.length("seq").alias("len"), "seq",
    )


def _fragments(rows, label):
    """All fragments of 300 bases: ``seq_id, seq, label``. Shorter sequences have none."""
    cut = fragments_tail_aligned(rows, 300, 0, label=label)
    return cut.select(
        F.col("frag_name").alias("seq_id"), F.col("fragment").alias("seq"), F.col(label).alias("label")
    )


@register(
    "perturbed_counts", "kind:s rows:i same_length:i",
    """SELECT kind, n // 4 + CASE WHEN k < n % 4 THEN 1 ELSE 0 END AS rows,
              n // 4 + CASE WHEN k < n % 4 THEN 1 ELSE 0 END AS same_length
       FROM (SELECT unnest(['shuffle', 'subseq_repeat', 'tandem_repeat', 'n_stretch']) AS kind,
                    unnest([0, 1, 2, 3]) AS k),
            (SELECT (coalesce(sum(ceil((length(seq) - 300) / 300.0) + 1), 0) * 2)::BIGINT AS n
             FROM seqs WHERE length(seq) >= 300)""",
    "seqs",
)
def _(spark, d):
    rows = _fragments(sequences(spark, d), "lang")
    plan = P.perturbation_plan(rows.count(), 2.0, {"n_stretch": True})
    out = P.perturb(rows, plan, seed=2)
    return out.groupBy("kind").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.length("seq") == 300).alias("same_length")
    )


# ---- composed sets ------------------------------------------------------------------------


def _labelled_sequences(spark, d):
    ids = F.create_map(*[F.lit(x) for item in LANG_IDS.items() for x in item])
    return sequences(spark, d).withColumn("label", F.element_at(ids, F.col("lang")))


@register(
    "encoded_crops",
    "seq_id:i start:i label:i length:i translated_length:i shard:i nucleotide:ll translated:ll",
    f"""SELECT c.seq_id, c.start, d.label, length(crop) AS length,
               len(frames[1]) AS translated_length, d.shard,
               list_transform(nuc, lambda f: (f || list_transform(range(0, 122), lambda x: 0))
                 [1:122]) AS nucleotide,
               list_transform(frames, lambda f: (f || list_transform(range(0, 39), lambda x: 0))
                 [1:39]) AS translated
        FROM ({_codon_sql('codon_id').replace('SELECT seq_id, start,', 'SELECT seq_id, start, crop,', 1)}) c
        JOIN (SELECT seq_id, label, r % 4 AS shard FROM ({_ranked_sql(
            "(SELECT *, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END "
            "AS label FROM seqs)", "seq_id", 0, "label")})) d ON c.seq_id = d.seq_id
        JOIN (SELECT seq_id, start, [list_transform(string_split(crop, ''),
                lambda x: strpos('AGTC', x)), list_transform(string_split(
                translate(crop, 'ACGTN', 'TGCAN'), ''), lambda x: strpos('AGTC', x))] AS nuc
              FROM crops) q ON q.seq_id = c.seq_id AND q.start = c.start""",
    "crops",
)
def _(spark, d):
    return encode_dataset(_labelled_sequences(spark, d), [122], shards=4)


share_sql(
    "set_pieces", "seqs",
    tail_aligned_sql(f"(SELECT seq_id, seq, {_LABEL_SQL} AS label FROM seqs)", 400, 100, "label"),
)
share_sql(
    "set_distinct", "set_pieces",
    """SELECT fragment AS seq, min(frag_name) AS seq_id, length(fragment) AS len
       FROM set_pieces GROUP BY fragment""",
)
share_sql("set_mers", "set_distinct", mers_sql("set_distinct", 8))
share_sql("set_links", "set_mers", links_sql("set_mers", 0.6, 0.6))
share_sql(
    "set_kept", "set_links",
    f"""WITH RECURSIVE {climb_sql("set_links")}
        SELECT frag_name, label FROM set_pieces JOIN set_distinct d ON frag_name = d.seq_id
        WHERE frag_name NOT IN (SELECT member FROM roots)""",
)


@register(
    "fragment_set", "frag_name:s label:i split:s",
    f"""SELECT frag_name, label, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train'
               WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val'
               ELSE 'test' END AS split
        FROM ({_ranked_sql('set_kept', 'frag_name', 5)})""",
    "set_kept",
)
def _(spark, d):
    rows = _labelled_sequences(spark, d)
    return fragment_set(rows, 400, 100, (0.8, 0.1, 0.1), k=8, seed=5)


@register(
    "ood_labels", "seq_id:i ood_label:i plain_label:i",
    f"""SELECT seq_id, CASE WHEN n_share > 0.25 THEN 0 WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END
                 AS ood_label,
               CASE WHEN n_share > 0.25 THEN 0 ELSE seq_id % 2 END AS plain_label
        FROM (SELECT seq_id, {sql_count('seq', 'N')}::DOUBLE / length(seq) AS n_share FROM seqs)
        LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON doc_id = seq_id""",
    "seqs",
)
def _(spark, d):
    good = read_table(spark, d, "labels").where("quality = 1").select(
        F.col("doc_id").alias("seq_id")
    )
    rows = validate.ood_label(sequences(spark, d), good, 0.25)
    plain = rows.withColumn("half", F.col("seq_id") % 2).withColumnRenamed("ood_label", "first")
    out = validate.ood_label(plain, None, 0.25, "half")
    return out.select(
        "seq_id", F.col("first").alias("ood_label"), F.col("ood_label").alias("plain_label")
    )


@register(
    "ood_set", "kind:s label:i n:i bases:i",
    f"""WITH o AS (SELECT CASE WHEN {sql_count('seq', 'N')}::DOUBLE / length(seq) > 0.3 THEN 0
                          WHEN seq_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1
                          ELSE 0 END AS label, length(seq) AS len FROM seqs)
        SELECT 'original' AS kind, label, count(*) AS n, sum(len) AS bases FROM o GROUP BY label
        UNION ALL SELECT 'shuffled', 0, count(*), sum(len) FROM o
        UNION ALL SELECT 'tandem', 0, count(*), count(*) * 2048 FROM o""",
    "seqs",
)
def _(spark, d):
    good = read_table(spark, d, "labels").where("quality = 1").select(
        F.col("doc_id").alias("seq_id")
    )
    rows = ood_set(sequences(spark, d), good, 0.3, seed=1)
    kind = (
        F.when(F.endswith("seq_id", F.lit("_shuffled")), "shuffled")
        .when(F.startswith("seq_id", F.lit("tandem")), "tandem")
        .otherwise("original")
    )
    return rows.groupBy(kind.alias("kind"), "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases")
    )


@register("reliability_set", "seq_id:s seq:s reliable:i")
def _(spark, d):
    rows = _fragments(_labelled_sequences(spark, d), "label")

    def score(df):
        window = df.withColumn("window", F.col("seq"))
        counted = window.withColumns(base_counts("window")).withColumn(
            "gc_skew", rounded_skew(F.col("g"), F.col("c"))
        )
        scores = linear_scores(composition(), WEIGHTS[:4], BIAS[:4])
        return counted.withColumn("scores", F.transform(scores, lambda x: x * 4.0))

    return reliability_set(rows, score, 0.4, 400, 1.0, {"n_stretch": True}, seed=3)


@register(
    "missing_ids", "doc_id:i",
    "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
)
def _(spark, d):
    labels = read_table(spark, d, "labels").select("doc_id")
    return _docs(spark, d).join(labels, "doc_id", "left_anti").select("doc_id")

