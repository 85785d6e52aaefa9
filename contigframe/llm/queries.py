"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .decontaminate import find_passages
from .filter_audit import audit_filters, mask_tally
from .hamming import nearest_codes, sign_code
from .language import identify, train_languages
from .lexical_search import search_documents
from .licenses import oracle, scan_licenses
from .line_dedup import remove_boilerplate
from .near_dedup import near_duplicates
from .packing import pack_documents
from .pieces import encode_texts
from .quality import remainder, score_quality, train_quality
from .substring_dedup import remove_repeats
from .toxicity import score_toxicity, train_toxicity


def piece_model() -> str:
    """The model file of the registered queries, part of an installed package on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, folder, "documents"), size=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


# A window starts at word i (from 1) of its document; later marks those that are not the first.
OP1_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM doc WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
word AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
cover AS (SELECT x.doc_id, x.i, w[x.i] AS word,
    max(CASE WHEN l.i IS NOT NULL THEN l.i END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hit
  FROM word x LEFT JOIN later l ON x.doc_id = l.doc_id AND x.i = l.i),
done AS (SELECT doc_id, count(hit) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE hit IS NULL) AS kept FROM cover GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN done USING (doc_id)
"""

def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_boilerplate(read_table(spark, folder, "documents"), ratio=0.1)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH line AS (SELECT doc_id, host, i, lines[i] AS line, nullif(trim(lines[i], concat(' ', chr(9), chr(13))), '') AS key
  FROM (SELECT doc_id, coalesce(concat('=', source), '') AS host, lines, unnest(range(1, len(lines) + 1)) AS i
    FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
pages AS (SELECT coalesce(concat('=', source), '') AS host, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
often AS (SELECT host, key FROM line JOIN pages USING (host) WHERE key IS NOT NULL
  GROUP BY host, key, pages HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT doc_id) > pages * 0.1),
kept AS (SELECT doc_id, count(*) AS n, count(often.key) AS dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '') AS kept
  FROM line LEFT JOIN often ON line.host = often.host AND line.key = often.key GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dropped, 0) AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return _judged(score_quality(docs, train_quality(docs, labels)), 0.3)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return _judged(score_toxicity(docs, train_toxicity(docs, labels)), 0.5)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return identify(docs, train_languages(docs, piece_model())).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = find_passages(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), size=10)
    n_hit = F.size("hits").cast("bigint")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


# In SQL text lower() would also change letters beyond A-Z.
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_WORDS = rf"regexp_extract_all({SQL_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH doc AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {SQL_WORDS} AS w FROM benchmark),
pattern AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
win AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM win JOIN pattern USING (n, s)),
inside AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN inside USING (doc_id) LEFT JOIN named USING (doc_id)
"""

def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read_table(spark, folder, "documents"))


OP7_SQL = oracle(SQL_WORDS)


def op8_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"), size=5, percent=85)


OP8_SQL = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS component FROM reach GROUP BY a)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc.doc_id) AS component_id,
  coalesce(component, doc.doc_id) = doc.doc_id AS kept
FROM doc LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

def op10_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    codes = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return nearest_codes(codes, codes.where("id % 20 = 0"), k=10)


OP10_SQL = """
WITH flat AS (SELECT vec_id AS id, unnest(embedding) > 0 AS bit, unnest(range(0, 64)) AS i FROM embeddings WHERE len(embedding) = 64),
packed AS (SELECT id, CAST(sum(CASE WHEN bit THEN 1::HUGEINT << i::INT ELSE 0 END) AS UBIGINT) AS code FROM flat GROUP BY id),
pair AS (SELECT q.id AS query_id, r.id, bit_count(CAST(xor(q.code, r.code) AS BIT)) AS distance FROM packed q, packed r WHERE q.id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pair) WHERE rank <= 10
"""


def op9_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    coded = encode_texts(read_table(spark, folder, "documents"), piece_model(), decoded=True)
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.element_at("bounds", -1).cast("bigint").alias("n_bytes"),
    )


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(read_table(spark, folder, "documents"), word_tokenizer(), window=4096, end=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (read_table(spark, folder, name) for name in ("documents", "labels"))
    return audit_filters(mask_tally(docs, labels))


# Each document's mask, then the counts of each part and mask seen from every step of every order.
OP12_SQL = r"""
WITH mark AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
masked AS (SELECT doc_id, part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM doc),
tally AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masked LEFT JOIN mark USING (doc_id) GROUP BY part, mask),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(f, bit)),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
step AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS BIGINT) AS earlier
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS i FROM orders)),
seen AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (earlier | bit) = 0) AS kept,
    sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS removed, sum(n) FILTER (WHERE mask & bit <> 0 AND mask & earlier <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails, sum(good) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & earlier = 0) AS toxic_lost FROM tally, step GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM seen
"""


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_documents(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), k=10)


OP13_SQL = rf"""
WITH doc AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents), held AS (SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM doc WHERE len(w) > 0),
total AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM held),
asked AS (SELECT DISTINCT item_id, unnest({SQL_WORDS}) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM held) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * total.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, total.n),
scored AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * tf.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


REGISTRY: dict[str, Query] = {
    "op1_substring_dedup": Query(op1_substring_dedup, OP1_SQL),
    "op2_line_dedup": Query(op2_line_dedup, OP2_SQL),
    "op3_quality_classifier": Query(op3_quality_classifier),
    "op4_toxicity": Query(op4_toxicity),
    "op5_language_id": Query(op5_language_id),
    "op6_decontaminate": Query(op6_decontaminate, OP6_SQL),
    "op7_license_scan": Query(op7_license_scan, OP7_SQL),
    "op8_minhash_near_dedup": Query(op8_minhash_near_dedup, OP8_SQL),
    "op9_sentencepiece": Query(op9_sentencepiece),
    "op10_exact_topk": Query(op10_exact_topk, OP10_SQL),
    "op11_packing": Query(op11_packing),
    "op12_filter_audit": Query(op12_filter_audit, OP12_SQL),
    "op13_lexical_search": Query(op13_lexical_search, OP13_SQL),
}
