"""Queries on sequences: validation, scalar functions, token arrays, row generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dna, frames
from ..functions.constants import BASE_TOKENS, CODONS, alphabet_ids
from ..operators import perturb, validate
from ..operators import windows as W
from ..operators.datasets import coverage_sampling, random_tiling
from ..operators.regions import gc_skew_profile
from ..sources.sequences import fasta_text, to_columns, to_headers
from ..sources.tables import read_table, spread
from .base import (
    MIN_LEN,
    SIZE,
    STRIDE,
    at_sql,
    md5_hash,
    register,
    sequences,
    share_sql,
    sql_count,
    sql_skew,
    windows,
    tail_aligned_sql,
)

REVCOMP = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"


@register(
    "valid_dna", "doc_id:i is_valid:b sequence_is_valid:b",
    """SELECT doc_id, regexp_full_match(text, '[ATGCNatgcn]+') AS is_valid,
              regexp_full_match(seq, '[ATGCNatgcn]+') AS sequence_is_valid
       FROM documents JOIN seqs ON seq_id = doc_id""",
    "seqs",
)
def _(spark, d):
    docs = spread(read_table(spark, d, "documents"), "doc_id")
    both = docs.select("doc_id", "text", dna.derive_sequence("text").alias("seq"))
    return both.select("doc_id", dna.is_valid_dna("text").alias("is_valid"), dna.is_valid_dna("seq").alias("sequence_is_valid"))


@register(
    "validate_sequences", "seq_id:i is_valid:b error:s",
    """SELECT seq_id, error IS NULL AS is_valid, error FROM (
         SELECT seq_id, CASE
           WHEN text = '' THEN 'empty sequence'
           WHEN NOT regexp_full_match(text, '[ATGCNatgcn]+') THEN 'invalid characters: ' ||
             array_to_string(list_sort(list_distinct(string_split(
               regexp_replace(text, '[ATGCNatgcn]', '', 'g'), ''))), '') END AS error
         FROM (SELECT doc_id AS seq_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS text
               FROM documents))""",
)
def _(spark, d):
    docs = spread(read_table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("seq_id"),
        F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("seq"),
    )
    return validate.validate_sequences(docs)


@register(
    "length_report", "entries:i long_enough:i",
    "SELECT count(*) AS entries, count(*) FILTER (length(seq) >= 500) AS long_enough FROM seqs",
    "seqs",
)
def _(spark, d):
    return validate.length_report(sequences(spark, d), 500)


@register(
    "n_run_filter", "seq_id:i length:i",
    "SELECT seq_id, length(seq) AS length FROM seqs WHERE NOT regexp_matches(seq, 'N{4,}')",
    "seqs",
)
def _(spark, d):
    kept = validate.filter_n_runs(sequences(spark, d), 3)
    return kept.select("seq_id", F.length("seq").alias("length"))


@register(
    "n_run_report", "lang:s kept:i removed:i percent_removed:d",
    """SELECT coalesce(lang, 'TOTAL') AS lang, count(*) FILTER (NOT bad) AS kept,
              count(*) FILTER (bad) AS removed,
              count(*) FILTER (bad) * 100.0::DOUBLE / count(*) AS percent_removed
       FROM (SELECT lang, regexp_matches(seq, 'N{4,}') AS bad FROM seqs)
       GROUP BY ROLLUP (lang)""",
    "seqs",
)
def _(spark, d):
    return validate.n_run_report(sequences(spark, d), 3, "lang")


@register(
    "prefix_crops", "seq_id:i crop_size:i seq:s",
    """SELECT seq_id, n AS crop_size, left(seq, n) AS seq
       FROM seqs, (SELECT unnest([300, 600, 1200]) AS n) WHERE length(seq) >= n""",
    "seqs",
)
def _(spark, d):
    return W.prefix_crop(sequences(spark, d), [300, 600, 1200])


@register(
    "remapped_labels", "vec_id:i new_label:i",
    """SELECT vec_id, CASE label WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 7 THEN 1 ELSE 0 END AS new_label
       FROM embeddings""",
)
def _(spark, d):
    from ..operators.metrics import remap_labels

    table = read_table(spark, d, "embeddings")
    return table.select(
        "vec_id", remap_labels(F.col("label"), {1: 3, 2: 5, 7: 1}).alias("new_label")
    )


@register(
    "escaped_ids", "name:s escaped:s restored:s id_part:s class_part:s",
    """SELECT name, replace(name, ',', '___') AS escaped, name AS restored,
              string_split(headed, '__class=')[1] AS id_part,
              string_split(headed, '__class=')[2] AS class_part
       FROM (SELECT source || ',' || doc_id AS name,
                    source || '_' || doc_id || '__class=' || lang AS headed FROM documents)""",
)
def _(spark, d):
    docs = read_table(spark, d, "documents")
    name = F.concat_ws(",", "source", "doc_id")
    headed = F.concat(F.col("source"), F.lit("_"), "doc_id", F.lit("__class="), "lang")
    id_part, class_part = dna.strip_class_suffix(headed)
    return docs.select(
        name.alias("name"), dna.escape_id(name).alias("escaped"),
        dna.unescape_id(dna.escape_id(name)).alias("restored"),
        id_part.alias("id_part"), class_part.alias("class_part"),
    )


@register(
    "header_round_trip", "seq_id:s label:s",
    "SELECT CAST(doc_id AS VARCHAR) AS seq_id, lang AS label FROM documents",
)
def _(spark, d):
    docs = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("seq_id"), F.col("lang").alias("label")
    )
    return to_columns(to_headers(docs))


@register(
    "fasta_records", "record:s",
    r"""SELECT '>' || seq_id || '__class=' || lang || chr(10) ||
               regexp_replace(regexp_replace(seq, '(.{70})', '\1' || chr(10), 'g'),
                              chr(10) || '$', '') AS record FROM seqs""",
    "seqs",
)
def _(spark, d):
    name = F.concat(F.col("seq_id").cast("string"), F.lit("__class="), "lang")
    return sequences(spark, d).select(fasta_text(name, F.col("seq"), 70).alias("record"))


@register(
    "crop_units", "seq_id:i codons:i nucleotides:i frame_len:i batch_len:i mismatch:b",
    """SELECT seq_id, floor((length(seq) - 5) / 3.0)::BIGINT AS codons,
              floor((length(seq) - 5) / 3.0)::BIGINT * 3 + 5 AS nucleotides,
              greatest(0, length(seq) // 3 - CASE WHEN length(seq) % 3 = 0 THEN 2 ELSE 1 END)
                AS frame_len,
              greatest(0, length(seq) // 3 - 1) AS batch_len,
              floor((length(seq) - 5) / 3.0) <> 500 AS mismatch
       FROM seqs""",
    "seqs",
)
def _(spark, d):
    rows = sequences(spark, d).select("seq_id", F.length("seq").alias("n"))
    rows = rows.withColumn("codons", dna.codon_length(F.col("n")))
    return validate.crop_mismatch(
        rows.withColumns(
            {
                "nucleotides": dna.nucleotide_length(F.col("codons")),
                "frame_len": frames.frame_length(F.col("n")),
                "batch_len": frames.batch_frame_length(F.col("n")),
            }
        ),
        500,
    ).withColumnRenamed("length_mismatch", "mismatch")


@register(
    "reverse_complements", "seq_id:i rc:s strict:s",
    f"""SELECT seq_id, {REVCOMP.format("seq")} AS rc, translate(seq, 'ACGTN', 'TGCAN') AS strict
        FROM seqs""",
    "seqs",
)
def _(spark, d):
    return sequences(spark, d).select(
        "seq_id", dna.reverse_complement("seq").alias("rc"),
        dna.complement_strict("seq").alias("strict"),
    )


_ENTROPY = " + ".join(
    f"CASE WHEN {sql_count('seq', b)} > 0 THEN -({sql_count('seq', b)}::DOUBLE / length(seq)) * "
    f"log2({sql_count('seq', b)}::DOUBLE / length(seq)) ELSE 0 END"
    for b in "ACGTN"
)


@register(
    "composition", "seq_id:i g:i c:i a:i t:i gc:d n_frac:d skew:d entropy:d",
    f"""SELECT seq_id, g, c, a, t, CASE WHEN len = 0 THEN 0 ELSE (g + c)::DOUBLE / len END AS gc,
               CASE WHEN len = 0 THEN 0 ELSE (len - g - c - a - t)::DOUBLE / len END AS n_frac,
               CASE WHEN g + c = 0 THEN 0 ELSE (g - c)::DOUBLE / (g + c) END AS skew, entropy
        FROM (SELECT seq_id, length(seq) AS len, {sql_count('seq', 'G')} AS g,
                     {sql_count('seq', 'C')} AS c, {sql_count('seq', 'A')} AS a,
                     {sql_count('seq', 'T')} AS t, {_ENTROPY} AS entropy FROM seqs)""",
    "seqs",
)
def _(spark, d):
    return sequences(spark, d).select(
        "seq_id", *[c.alias(n) for n, c in dna.base_counts("seq").items()],
        dna.gc_content("seq").alias("gc"), dna.n_fraction("seq").alias("n_frac"),
        dna.gc_skew("seq").alias("skew"), dna.shannon_entropy("seq").alias("entropy"),
    )


# ---- token arrays -----------------------------------------------------------------------------

CROP = 122  # 3 * 39 + 5 bases

share_sql(
    "crops", "seqs",
    f"""SELECT seq_id, lang, seq_len, start, substr(seq, start + 1, {CROP}) AS crop FROM (
          SELECT *, length(seq) AS seq_len, unnest(CASE WHEN length(seq) <= {CROP} THEN [0]
            ELSE list_distinct(range(0, length(seq) - {CROP - 1}, {CROP}) ||
                               [length(seq) - {CROP}]) END) AS start FROM seqs)""",
)


def _crops(spark, d):
    return W.multi_crops(sequences(spark, d), [CROP], [CROP])


def _codon_sql(alphabet: str) -> str:
    ids = ", ".join(f"'{c}': {i + 1}" for c, i in zip(CODONS, alphabet_ids(alphabet)))
    n = "greatest(0, length(crop) // 3 - CASE WHEN length(crop) % 3 = 0 THEN 2 ELSE 1 END)"

    def frame(strand: str, offset: int) -> str:
        return (
            f"list_transform(range(0, {n}), lambda i: coalesce(ids[substr({strand}, "
            f"(3 * i + {offset + 1})::BIGINT, 3)], 0))"
        )

    out = ", ".join(frame(s, o) for s in ("crop", "rc") for o in range(3))
    return f"""SELECT seq_id, start, [{out}] AS frames FROM (
                 SELECT *, {REVCOMP.format('crop')} AS rc, MAP {{{ids}}} AS ids FROM crops)"""


for _name, _alphabet in [
    ("codon_frames", "codon_id"), ("amino_acid_frames", "aa_id"),
    ("murphy10_frames", "murphy10_id"), ("pc5_frames", "pc5_id"), ("pc2_frames", "pc2_id"),
    ("synonym_rank_frames", "synonym_rank"),
]:

    @register(_name, "seq_id:i start:i frames:ll", _codon_sql(_alphabet), "crops")
    def _(spark, d, alphabet=_alphabet):
        return _crops(spark, d).select(
            "seq_id", "start", frames.codon_frames("crop", alphabet).alias("frames")
        )


@register(
    "dicodon_frames", "seq_id:i start:i pairs:ll",
    f"""SELECT seq_id, start, list_transform(frames, lambda f: list_transform(
            range(1, greatest(len(f), 1)), lambda i: CASE WHEN f[i] > 0 AND f[i + 1] > 0
            THEN (f[i] - 1) * 64 + f[i + 1] ELSE 0 END)) AS pairs
        FROM ({_codon_sql("codon_id")})""",
    "crops",
)
def _(spark, d):
    rows = _crops(spark, d).select("seq_id", "start", frames.codon_frames("crop").alias("f"))
    return rows.select("seq_id", "start", frames.dicodon_frames(F.col("f")).alias("pairs"))


_BASES = "MAP {" + ", ".join(f"'{b}': {t}" for b, t in BASE_TOKENS.items()) + "}"


@register(
    "nucleotide_tokens", "seq_id:i start:i plain:ll reversed:ll weak:l",
    f"""SELECT seq_id, start,
               [list_transform(s, lambda x: ids[x]), list_transform(c, lambda x: ids[x])] AS plain,
               [list_transform(s, lambda x: ids[x]),
                list_transform(list_reverse(c), lambda x: ids[x])] AS reversed,
               list_transform(s, lambda x: CASE WHEN x IN ('A', 'T') THEN 0
                                                WHEN x IN ('G', 'C') THEN 1 ELSE -1 END) AS weak
        FROM (SELECT seq_id, start, string_split(crop, '') AS s,
                     string_split(translate(crop, 'ACGTN', 'TGCAN'), '') AS c, {_BASES} AS ids
              FROM crops)""",
    "crops",
)
def _(spark, d):
    return _crops(spark, d).select(
        "seq_id", "start", frames.nucleotide_tokens("crop").alias("plain"),
        frames.nucleotide_tokens("crop", reverse=True).alias("reversed"),
        frames.strong_weak_tokens("crop").alias("weak"),
    )


_ABC = "abcdefghijklmnopqrstuvwxyz"


@register(
    "protein_tokens", "doc_id:i tokens:l",
    f"""SELECT doc_id, list_transform(string_split(translate(text, '{_ABC}', '{_ABC.upper()}'), ''),
              lambda x: strpos('FLIMVSPTAYHQNKDECWRG', x)) AS tokens FROM documents""",
)
def _(spark, d):
    upper = F.translate("text", _ABC, _ABC.upper())
    return read_table(spark, d, "documents").select(
        "doc_id", frames.protein_tokens(upper).alias("tokens")
    )


_ONE = "list_transform(range(0, {n}), lambda i: CASE WHEN {test} THEN 1 ELSE 0 END)"


@register(
    "one_hot_bases", "seq_id:i start:i skipped:lli plain:lli back:li label_cells:l",
    f"""SELECT seq_id, start,
          list_transform(t, lambda x: {_ONE.format(n=4, test="x > 0 AND x - 1 = i")}) AS skipped,
          list_transform(t, lambda x: {_ONE.format(n=4, test="x > 0 AND x = i")}) AS plain,
          list_transform(t, lambda x: CASE WHEN x BETWEEN 1 AND 4 THEN x - 1 ELSE 4 END) AS back,
          {_ONE.format(n=6, test="i = seq_id % 6")} AS label_cells
        FROM (SELECT seq_id, start, list_transform(string_split(crop, ''),
                     lambda x: strpos('AGTC', x)) AS t FROM crops)""",
    "crops",
)
def _(spark, d):
    # The steps of a column follow each other in one Python worker.
    tokens = frames.letter_tokens("crop", BASE_TOKENS)
    skipped = frames.first_cells(frames.one_hot(tokens, 5, batches=True), 4)
    return _crops(spark, d).select(
        "seq_id", "start", skipped.alias("skipped"),
        frames.one_hot(tokens, 4, skip_zero=False, batches=True).alias("plain"),
        frames.one_hot_to_tokens(skipped, 4, batches=True).alias("back"),
        frames.label_one_hot(F.col("seq_id") % 6, 6).alias("label_cells"),
    )


@register(
    "padded_frames", "seq_id:i start:i padded:ll steps:s",
    f"""SELECT seq_id, start,
          list_transform(frames, lambda f: (f || list_transform(range(0, 30), lambda x: 0))[1:30])
            AS padded,
          CASE WHEN len(frames[1]) >= 30 THEN
            array_to_string(list_transform(range(0, 3), lambda t: array_to_string(list_transform(
            frames, lambda f: array_to_string(CAST(f[t * 10 + 1:t * 10 + 10] AS VARCHAR[]), ',')),
            '|')), ';') END AS steps
        FROM ({_codon_sql("aa_id")})""",
    "crops",
)
def _(spark, d):
    rows = _crops(spark, d).select(
        "seq_id", "start", frames.codon_frames("crop", "aa_id").alias("f")
    )
    text = F.array_join(
        F.transform(
            frames.reshape_frames(F.col("f"), 3, 10).cast("array<array<array<string>>>"),
            lambda s: F.array_join(F.transform(s, lambda x: F.array_join(x, ",")), "|"),
        ),
        ";",
    )
    # A crop of fewer codons has no steps; its frames are padded.
    return rows.select(
        "seq_id", "start", F.when(F.size(F.get("f", F.lit(0))) >= 30, text).alias("steps"),
        frames.pad_frames(F.col("f"), 30).alias("padded"),
    )


# ---- row generators -----------------------------------------------------------------------


@register(
    "windows", "seq_id:i seq_len:i start:i window_idx:i is_last:b window:s g:i c:i a:i t:i gc_skew:d",
    "SELECT *, win AS window FROM counted", "counted",
)
def _(spark, d):
    return windows(spark, d)


@register(
    "dynamic_windows", "seq_id:i starts:l",
    """SELECT seq_id, CASE
         WHEN length(seq) >= 2000 THEN range(0, length(seq) - 199, 200)
         WHEN length(seq) < 200 THEN [0]
         WHEN n = 1 THEN [0]
         ELSE list_sort(list_distinct(list_transform(range(0, n), lambda i: CASE WHEN i = n - 1
                THEN length(seq) - 200
                ELSE round_even(i * (length(seq) - 200)::DOUBLE / (n - 1), 0)::BIGINT END)))
         END AS starts
       FROM (SELECT *, ceil(length(seq) / 200.0)::BIGINT AS n FROM seqs)
       WHERE length(seq) >= 60""",
    "seqs",
)
def _(spark, d):
    rows = W.make_windows(
        sequences(spark, d), 200, 200, min_len=60, dynamic=True, threshold=10.0, counts=False, mask=False
    )
    return rows.groupBy("seq_id").agg(F.array_sort(F.collect_list("start")).alias("starts"))


@register(
    "length_bands", "band:s windows:i sequences:i bases:i",
    f"""SELECT CASE WHEN seq_len >= {SIZE} THEN 'long' ELSE 'short' END AS band,
               count(*) AS windows, count(DISTINCT seq_id) AS sequences, sum(length(win)) AS bases
        FROM wins GROUP BY 1""",
    "wins",
)
def _(spark, d):
    rows = W.length_bands(sequences(spark, d), SIZE, STRIDE, MIN_LEN, counts=False)
    return rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("window_idx") == 0).alias("sequences"),
        F.sum(F.length("window")).alias("bases"),
    )


share_sql("frags", "seqs", tail_aligned_sql("seqs", 300, 100, "lang"))


@register(
    "tail_aligned_fragments", "frag_name:s start:i fragment:s",
    "SELECT frag_name, start, fragment FROM frags", "frags",
)
def _(spark, d):
    return W.fragments_tail_aligned(sequences(spark, d), 300, 100, label="lang")


@register(
    "multi_crops", "seq_id:i crop_size:i start:i crop:s",
    """SELECT seq_id, size AS crop_size, start, substr(seq, start + 1, size) AS crop FROM (
         SELECT seq_id, seq, size, unnest(CASE WHEN length(seq) <= size THEN [0] ELSE
           list_distinct(range(0, length(seq) - size + 1, stride) || [length(seq) - size]) END)
           AS start
         FROM seqs, (VALUES (500, 250), (1000, 1000)) AS p(size, stride))""",
    "seqs",
)
def _(spark, d):
    return W.multi_crops(sequences(spark, d), [500, 1000], [250, 1000])


@register(
    "short_tail_crops", "seq_id:i start:i crop:s",
    """SELECT seq_id, start, substr(seq, start + 1, 400) AS crop FROM (
         SELECT seq_id, seq, unnest(CASE WHEN length(seq) <= 400 THEN [0]
                                         ELSE range(0, length(seq), 300) END) AS start FROM seqs)""",
    "seqs",
)
def _(spark, d):
    return W.multi_crops(sequences(spark, d), [400], [300], pad=False)


@register(
    "sampled_crops", "seq_id:i crop_size:i start:i crop:s",
    f"""SELECT seq_id, size AS crop_size, start, substr(seq, start + 1, size) AS crop FROM (
          SELECT seq_id, seq, size, ({at_sql('h', '2')} % (length(seq) - size + 1)) AS start FROM (
            SELECT *, least(100 + {at_sql('h', '1')} % 201, length(seq)) AS size FROM (
              SELECT *, {md5_hash('seq_id', '2', seed=11)} AS h FROM seqs)))""",
    "seqs",
)
def _(spark, d):
    return W.training_crops(sequences(spark, d), [100, 300], mode="range", epoch=2, seed=11)


@register(
    "sampled_variants", "epoch:i seq_id:i crop_size:i start:i crop:s",
    f"""SELECT epoch, seq_id, pick[1] AS crop_size, pick[2] AS start, substr(seq, (pick[2] + 1)::BIGINT, pick[1]::BIGINT) AS crop FROM (
          SELECT epoch, seq_id, seq, variants[{at_sql('h', '0')} % len(variants) + 1] AS pick FROM (
            SELECT *, {md5_hash('seq_id', 'epoch', seed=6)} AS h,
                   list_transform({{0}}, lambda x: [500, x]) || list_transform({{1}}, lambda x: [1000, x]) AS variants
            FROM seqs, (VALUES (0), (1)) AS e(epoch)))""".format(*[
        f"(CASE WHEN length(seq) <= {size} THEN [0] ELSE list_sort(list_distinct("
        f"range(0, length(seq) - {size} + 1, {stride}) || [length(seq) - {size}])) END)"
        for size, stride in ((500, 250), (1000, 300))
    ]),
    "seqs",
)
def _(spark, d):
    rows = sequences(spark, d)
    epochs = [W.training_crops(rows, [500, 1000], [250, 300], "sample", e, seed=6).withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return epochs[0].unionByName(epochs[1])


@register(
    "fixed_fragments", "seq_id:i start:i label:i fragment:s",
    """SELECT seq_id, start, 2 AS label, substr(seq, start + 1, 500) AS fragment FROM (
         SELECT seq_id, seq, unnest(range(0, length(seq) - 499, 400)) AS start
         FROM seqs WHERE length(seq) >= 500)""",
    "seqs",
)
def _(spark, d):
    return W.fixed_fragments(sequences(spark, d), 500, 400, 2)


@register(
    "kmer_counts", "lang:s kmer:s n:i",
    """SELECT lang, kmer, count(*) AS n FROM (
         SELECT lang, unnest(regexp_extract_all(substr(seq, f + 1), '...')) AS kmer
         FROM seqs, (SELECT unnest([0, 1, 2]) AS f)) GROUP BY ALL""",
    "seqs",
)
def _(spark, d):
    return W.kmers(sequences(spark, d), 3).groupBy("lang", "kmer").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "mutation_levels", "seq_id:i level:i n_altered:i seq:s",
    f"""SELECT seq_id, level, n_altered, array_to_string(list_transform(string_split(seq, ''),
               lambda ch, i: CASE WHEN n_altered > 0 AND hashes[i] <= ranked[n_altered] THEN 'N'
                                  ELSE ch END), '') AS seq
        FROM (SELECT *, least(level * (length(seq) * 0.1::DOUBLE)::DOUBLE::BIGINT, length(seq))
                AS n0, level * floor(length(seq) * 0.1::DOUBLE)::BIGINT AS n_altered,
                list_sort(hashes) AS ranked
              FROM (SELECT *, list_transform(range(0, length(seq)), lambda i:
                      {at_sql('h', 'i')} * 2147483648 + i) AS hashes
                    FROM (SELECT *, {md5_hash('seq_id', seed=5)} AS h FROM seqs)),
                   (SELECT unnest([0, 1, 2]) AS level))""",
    "seqs",
)
def _(spark, d):
    return perturb.mutation_series(sequences(spark, d), 0.0, 0.2, 0.1, seed=5)


@register(
    "replaced_mutations", "seq_id:i level:i n_altered:i seq:s",
    f"""SELECT seq_id, level, n_altered, array_to_string(list_transform(string_split(seq, ''), lambda ch, i:
               CASE WHEN n_altered = 0 OR hashes[i] > ranked[n_altered] THEN ch WHEN ch = 'N' THEN 'N'
                    ELSE substr('ACGTACG', (instr('ACGT', ch) + 1 + ({at_sql('other', 'i - 1')} % 3))::BIGINT, 1) END), '') AS seq
        FROM (SELECT *, level * floor(length(seq) * 0.1::DOUBLE)::BIGINT AS n_altered, list_sort(hashes) AS ranked
              FROM (SELECT *, list_transform(range(0, length(seq)), lambda i: {at_sql('h', 'i')} * 2147483648 + i) AS hashes
                    FROM (SELECT *, {md5_hash('seq_id', seed=5)} AS h, {md5_hash('seq_id', seed=6)} AS other FROM seqs)),
                   (SELECT unnest([0, 1]) AS level))""",
    "seqs",
)
def _(spark, d):
    return perturb.mutation_series(sequences(spark, d), 0.0, 0.1, 0.1, replace=True, seed=5)


@register(
    "random_tiling", "seq_id:i frag_idx:i start:i length:i fragment:s",
    f"""SELECT * FROM (
          SELECT seq_id, frag_idx, start, least(long, len - start) AS length,
                 substr(seq, (start + 1)::BIGINT, least(long, len - start)::BIGINT) AS fragment
          FROM (SELECT *, coalesce(sum(long - 50) OVER (PARTITION BY seq_id ORDER BY frag_idx
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                FROM (SELECT seq_id, seq, len, frag_idx, 200 + {at_sql('h', 'frag_idx')} % 401 AS long
                      FROM (SELECT seq_id, seq, length(seq) AS len, {md5_hash('seq_id', seed=3)} AS h,
                                   unnest(range(0, ceil(length(seq) / 150.0)::BIGINT + 1)) AS frag_idx
                            FROM seqs WHERE length(seq) >= 200)))
          WHERE start = 0 OR start + 50 < len)
        WHERE length >= 200 AND {sql_count('fragment', 'N')}::DOUBLE / length <= 0.5""",
    "seqs",
)
def _(spark, d):
    return random_tiling(sequences(spark, d), 200, 600, 50, 0.5, seed=3)


@register(
    "fixed_tiling", "seq_id:i frag_idx:i start:i length:i fragment:s",
    f"""SELECT * FROM (SELECT *, length(fragment) AS length FROM (
          SELECT seq_id, start // 250 AS frag_idx, start, substr(seq, start + 1, 300) AS fragment
          FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 50, 1), 250)) AS start
                FROM seqs WHERE length(seq) >= 300)))
        WHERE length = 300 AND {sql_count('fragment', 'N')}::DOUBLE / length <= 0.25""",
    "seqs",
)
def _(spark, d):
    return random_tiling(sequences(spark, d), 300, 300, 50, 0.25, seed=3)


def _coverage_sql(coverage: float, circular: bool) -> str:
    """Draws of 200 to 600 letters among the places with at most half N, by rank."""
    text = "seq || left(seq, 600)" if circular else "seq"
    starts = "len" if circular else "greatest(len - length + 1, 0)"
    admissible = (
        f"list_filter(range(0, {starts}), lambda i: "
        "held[(i + length + 1)::BIGINT] - held[(i + 1)::BIGINT] <= length * 0.5::DOUBLE)"
    )
    return f"""WITH source AS (
           SELECT seq_id, length(seq) AS len, {text} AS text, {md5_hash('seq_id', seed=4)} AS h FROM seqs WHERE length(seq) >= 200),
         held AS (SELECT seq_id, len, text, list(n ORDER BY i) AS held FROM (
             SELECT seq_id, len, text, i, coalesce(sum(CASE WHEN substr(text, i, 1) = 'N' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY seq_id ORDER BY i), 0) AS n
             FROM (SELECT *, unnest(range(0, length(text) + 1)) AS i FROM source)) GROUP BY ALL),
         draws AS (SELECT *, least(200 + one % 401, len) AS length FROM (
             SELECT *, {at_sql('h', 'draw * 2')} AS one, {at_sql('h', 'draw * 2 + 1')} AS two FROM (
               SELECT seq_id, len, h, unnest(range(1, ceil(len * {coverage}::DOUBLE / 200)::BIGINT + 1)) AS draw FROM source))),
         drawn AS (SELECT DISTINCT seq_id, length FROM draws),
         first AS (SELECT seq_id, length, {admissible} AS starts FROM drawn JOIN held USING (seq_id)),
         barren AS (SELECT DISTINCT seq_id FROM first WHERE len(starts) = 0),
         other AS (SELECT seq_id, length, {admissible} AS starts FROM (
             SELECT seq_id, len, held, unnest(range(200, least(600, len) + 1)) AS length FROM held JOIN barren USING (seq_id))),
         place AS (SELECT * FROM first UNION SELECT * FROM other),
         listed AS (SELECT seq_id, list(length ORDER BY length) AS lengths FROM other WHERE len(starts) > 0 GROUP BY seq_id),
         final AS (SELECT seq_id, d.len, draw, two, CASE WHEN len(starts) > 0 THEN d.length ELSE lengths[one % len(lengths) + 1] END AS length
                   FROM draws d JOIN place USING (seq_id, length) LEFT JOIN listed USING (seq_id)),
         kept AS (SELECT * FROM (SELECT *, coalesce(sum(length) OVER (PARTITION BY seq_id ORDER BY draw
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM final WHERE length IS NOT NULL)
                  WHERE before < len * {coverage}::DOUBLE)
       SELECT seq_id, draw, start, length, substr(text, (start + 1)::BIGINT, length::BIGINT) AS fragment
       FROM (SELECT seq_id, draw, length, starts[two % len(starts) + 1] AS start FROM kept JOIN place USING (seq_id, length))
       JOIN source USING (seq_id)"""


@register(
    "coverage_fragments", "seq_id:i draw:i start:i length:i fragment:s", _coverage_sql(1.5, False), "seqs"
)
def _(spark, d):
    return coverage_sampling(sequences(spark, d), 200, 600, 1.5, max_n=0.5, seed=4)


@register(
    "circular_fragments", "seq_id:i draw:i start:i length:i fragment:s", _coverage_sql(1.0, True), "seqs"
)
def _(spark, d):
    return coverage_sampling(sequences(spark, d), 200, 600, 1.0, True, max_n=0.5, seed=4)


# For each length of an interval, the state of every start: equal triplets, pairs, the best score
# inside, and the starts that are masked.
share_sql(
    "masked", "seqs",
    """WITH RECURSIVE t AS (SELECT seq_id, seq, list_transform(range(1, greatest(length(seq) - 1, 1)), lambda i: substr(seq, i::BIGINT, 3)) AS t FROM seqs),
         s AS (
           SELECT seq_id, 1 AS n, list_transform(t, lambda x: 0::SMALLINT) AS c, list_transform(t, lambda x: 0::SMALLINT) AS r,
                  list_transform(t, lambda x: 0.0::DOUBLE) AS best, []::BIGINT[] AS hits FROM t WHERE len(t) > 0
           UNION ALL
           SELECT seq_id, n + 1, c, r, list_transform(score, lambda x, i: greatest(x, best[i], best[i + 1])),
                  list_filter(range(1, len(score) + 1), lambda i: score[i] > 8 AND score[i] >= best[i] AND score[i] >= best[i + 1])
           FROM (SELECT *, list_transform(r, lambda x: 10.0::DOUBLE * x / n) AS score FROM (
             SELECT seq_id, n, best, c, list_transform(range(1, len(c) - n + 1), lambda i: (r[i] + c[i + n])::SMALLINT) AS r FROM (
               SELECT s.seq_id, n, r, best, list_transform(c, lambda x, j: CASE WHEN j > n AND t[j] = t[j - n] THEN x + 1 ELSE x END) AS c
               FROM s JOIN t USING (seq_id) WHERE n < least(62, len(t)))))),
         hit AS (SELECT DISTINCT seq_id, unnest(range(i, i + n + 2)) AS spot FROM (SELECT seq_id, n, unnest(hits) AS i FROM s)),
         place AS (SELECT seq_id, list(spot) AS places FROM hit GROUP BY seq_id)
       SELECT seq_id, CASE WHEN places IS NULL THEN seq ELSE array_to_string(list_transform(string_split(seq, ''),
                lambda ch, i: CASE WHEN list_contains(places, i) THEN lower(ch) ELSE ch END), '') END AS masked
       FROM seqs LEFT JOIN place USING (seq_id)""",
)


@register("masked_low_complexity", "seq_id:i masked:s", "SELECT * FROM masked", "masked")
def _(spark, d):
    return sequences(spark, d).select(
        "seq_id", dna.low_complexity_mask("seq", 64, 8.0).alias("masked")
    )


@register(
    "gc_skew_windows", "seq_id:i window_idx:i position:i gc_skew:d cum_gc:d",
    f"""WITH w AS (SELECT seq_id, start // 256 AS window_idx, start AS position,
                          {sql_skew('g', 'c')} AS skew
                   FROM (SELECT *, {sql_count('win', 'G')} AS g, {sql_count('win', 'C')} AS c
                         FROM (SELECT seq_id, start, substr(seq, start + 1, 256) AS win FROM (
                           SELECT seq_id, seq, unnest(range(0, length(seq) - 255, 256)) AS start
                           FROM seqs WHERE length(seq) >= 256)))),
             m AS (SELECT *, sum(skew) OVER (PARTITION BY seq_id ORDER BY window_idx
                     ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10.0::DOUBLE AS mean FROM w),
             s AS (SELECT *, CASE WHEN hi - lo < 1e-12 THEN -1.0 ELSE (mean - lo) / (hi - lo) * 2 - 1
                     END AS gc_skew
                   FROM (SELECT *, min(mean) OVER (PARTITION BY seq_id) AS lo,
                                max(mean) OVER (PARTITION BY seq_id) AS hi FROM m)),
             k AS (SELECT *, sum(gc_skew) OVER (PARTITION BY seq_id ORDER BY window_idx) AS cum
                   FROM s)
        SELECT *, CASE WHEN h2 - l2 < 1e-12 THEN -1.0 ELSE (cum - l2) / (h2 - l2) * 2 - 1 END
               AS cum_gc
        FROM (SELECT *, min(cum) OVER (PARTITION BY seq_id) AS l2,
                     max(cum) OVER (PARTITION BY seq_id) AS h2 FROM k)""",
    "seqs",
)
def _(spark, d):
    return gc_skew_profile(sequences(spark, d), 256)
