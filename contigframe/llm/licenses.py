"""License notices in texts: phrases, and an exact set-similarity join with notice templates.

Phrases are places where their words stand one after the other. Beyond them, a template is found
where some window of ``SPREAD`` times its number of words, wherever it starts, contains ``threshold``
or more of its distinct words. Words are ordered by how many documents hold them, rarest first. A
document can only hold such a window if the first words of the template, in that order, have one in
the document (prefix filter), if the document has enough of the template's words (length filter), and
if enough of them follow the common one in both (positional filter). The pairs that pass are cut into
windows: one starts at every occurrence of a word of the template (a best window starts at one), and
its distinct words are counted in full. Templates are of any length, from a line to a whole license.

Everything runs as DataFrame expressions, in one pass over the raw texts: it keeps the phrases' places,
the template words a document holds, and its words only where it has enough of some template's. The
templates and their words are a fixed list.

Defined cases: null and empty texts have no words, places or labels. Rows that repeat a doc_id and
a text get one result each; rows without doc_id are told apart by their texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Words of a window for each word of its template.
SPREAD = 2
THRESHOLD = 0.8

# Phrases that name a license.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of common notices and the whole of two short licenses, as words.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
    "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind "
    "express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
    "other dealings in the software": "mit-text",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
    "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
    "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
    "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
    "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software": "isc-text",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
    "merchantability or fitness for a particular purpose see the gnu general public license for more details": "gpl-warranty-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of": "gpl-program-notice",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "you may not use this file except in compliance with the license": "apache-file-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-permission",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "all rights reserved": "all-rights-reserved",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced_words(text: Column) -> Column:
    """Words in lower case with one space around each; a single space without words."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _count(spaced: Column) -> Column:
    """Words in a text from ``spaced_words``."""
    return F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) - 1


def _places(spaced: Column, phrase: str) -> Column:
    """How often a phrase stands in the text, and the first and last word it starts at."""
    words = phrase.split()
    if any(words[:k] == words[-k:] for k in range(1, len(words))):
        raise ValueError(f"a phrase may not overlap itself: {phrase}")
    between = F.split(spaced, f" {phrase}(?= )", -1)
    last = _count(spaced) - len(words) - _count(F.element_at(between, -1))
    found = F.struct(
        (F.size(between) - 1).cast("bigint").alias("n"),
        _count(F.concat(F.element_at(between, 1), F.lit(" "))).cast("bigint").alias("first"),
        last.cast("bigint").alias("last"),
    )
    return F.when(F.contains(spaced, F.lit(f" {phrase} ")), found)


def _overlap(size: int, threshold: float) -> int:
    """The least number of words that makes the containment of a template of ``size`` words."""
    return next(k for k in range(1, size + 1) if k >= threshold * size - 1e-9)


class Templates:
    """Templates by label: distinct words, the number that makes a match, and words of a window."""

    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.sets = {label: sorted(set(words.split())) for words, label in templates.items()}
        if len(self.sets) < len(templates):
            raise ValueError("two templates have the same label")
        self.need = {label: _overlap(len(words), threshold) for label, words in self.sets.items()}
        self.span = {label: SPREAD * len(words.split()) for words, label in templates.items()}
        self.words = sorted(set().union(*self.sets.values()))

    def held(self, words: Column) -> Column:
        """The template words of a document."""
        return F.array_intersect(F.array(*[F.lit(w) for w in self.words]), words)

    def possible(self, held: Column) -> Column:
        """Whether a document has enough words of any template."""
        enough = [
            F.size(F.array_intersect(held, F.array(*[F.lit(w) for w in words]))) >= self.need[label] for label, words in self.sets.items()
        ]
        return reduce(lambda a, b: a | b, enough)


def template_matches(texts: DataFrame, templates: Templates) -> DataFrame:
    """``key, label, containment`` of every template found in a document.

    ``texts`` has ``key``, the template words ``held``, and the document's ``words`` (null where no
    template is possible).
    """
    spark = texts.sparkSession
    # Documents holding each of the templates' words: one row a word.
    counts = texts.select(F.explode("held").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}
    rank = {w: k for k, w in enumerate(sorted(templates.words, key=lambda w: (frequency.get(w, 0), w)))}
    order = F.array(*[F.lit(w) for w in sorted(templates.words, key=rank.__getitem__)])
    prefixes = []
    for label, words in templates.sets.items():
        ordered = sorted(words, key=rank.__getitem__)
        need = templates.need[label]
        prefixes += [(w, label, ordered, i, need, templates.span[label]) for i, w in enumerate(ordered[: len(words) - need + 1])]
    # The fixed list of templates.
    table = F.broadcast(spark.createDataFrame(prefixes, "word string, label string, template array<string>, i int, need int, span int"))
    some = texts.where("words IS NOT NULL").select("key", "words", F.array_intersect(order, "held").alias("own"))
    least = min(templates.need.values())
    # The document's words are in the global order, so its prefix is its beginning.
    heads = some.select("key", "own", F.posexplode(F.slice("own", F.lit(1), F.greatest(F.size("own") - least + 1, F.lit(0)))).alias("j", "word"))
    rest = F.least(F.size("template") - F.col("i"), F.size("own") - F.col("j"))
    near = heads.join(table, "word").where((F.size("own") >= F.col("need")) & (F.least("i", "j") + rest >= F.col("need")))
    near = near.where(F.size(F.array_intersect("own", "template")) >= F.col("need")).select("key", "label").distinct()
    label_words = [(label, w, len(words), templates.need[label], templates.span[label]) for label, words in templates.sets.items() for w in words]
    members = F.broadcast(spark.createDataFrame(label_words, "label string, word string, size int, need int, span int"))
    keyed = near.withColumn("id", F.to_json("key")).select("id", "label")  # a null id must meet itself
    placed = some.select(F.to_json("key").alias("id"), "key", F.posexplode("words").alias("at", "word"))
    rows = placed.join(members, "word").join(keyed, ["id", "label"], "left_semi")
    # Frames of different widths: one for each window length.
    found = None
    for span in sorted(set(templates.span.values())):
        frame = Window.partitionBy("id", "label").orderBy("at").rangeBetween(0, span - 1)
        mine = rows.where(F.col("span") == span).withColumn("common", F.size(F.collect_set("word").over(frame)))
        mine = mine.where(F.col("common") >= F.col("need")).select("key", "label", (F.col("common") / F.col("size")).alias("containment"))
        found = mine if found is None else found.unionAll(mine)
    return found.groupBy("key", "label").agg(F.max("containment").alias("containment"))


def scan_licenses(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each document.

    ``score`` is 1 with a phrase, else the largest containment of a template found, else 0.
    """
    known = Templates(templates, threshold)
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    texts = docs.select(key.alias("key"), spaced_words(F.col(text)).alias("spaced"))
    found = [F.col(f"place{k}") for k in range(len(phrases))]
    words = F.split("spaced", " ")
    base = texts.select(
        "key", "spaced", known.held(words).alias("held"), *[_places(F.col("spaced"), p).alias(f"place{k}") for k, p in enumerate(phrases)]
    )
    base = cut(base.select(
        "key", "held", _count(F.col("spaced")).cast("bigint").alias("n_words"),
        F.when(known.possible(F.col("held")), F.filter(words, lambda w: w != "")).alias("words"),
        reduce(lambda a, b: a + b, [F.coalesce(f["n"], F.lit(0)) for f in found]).alias("n_base"),
        F.array_min(F.array(*[f["first"] for f in found])).alias("first_word"),
        F.array_max(F.array(*[f["last"] for f in found])).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(f.isNotNull(), F.lit(v)) for f, v in zip(found, phrases.values(), strict=True)])))).alias("base"),
    ))
    added = template_matches(base.select("key", "held", "words"), known).groupBy("key").agg(
        F.collect_set("label").alias("added"), F.max("containment").alias("containment")
    )
    base = base.drop("held", "words")
    # Null ids need a comparison of whole keys: their text is one.
    both = base.withColumn("join", F.to_json("key")).join(added.select(F.to_json("key").alias("join"), "added", "containment"), "join", "left")
    return both.select(
        F.col("key.id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("added", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def oracle(words_sql: str, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan_licenses`` over table ``documents``; ``words_sql`` gives the words of ``text``."""

    def listed(words: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrase_rows = ", ".join(f"({listed(p.split())}, '{v}')" for p, v in phrases.items())
    template_rows = ", ".join(f"({listed(sorted(set(t.split())))}, '{v}', {SPREAD * len(t.split())})" for t, v in templates.items())
    return f"""
WITH doc AS (SELECT doc_id, {words_sql} AS w FROM documents),
phrase(p, label) AS (VALUES {phrase_rows}), template(t, label, span) AS (VALUES {template_rows}),
place AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM doc) JOIN phrase ON w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY doc_id),
win AS (SELECT doc_id, label, t, w[s:s + span - 1] AS b FROM (
  SELECT doc_id, label, t, span, w, unnest(range(1, len(w) + 1)) AS s FROM doc, template
  WHERE len(list_intersect(list_distinct(w), t)) >= {threshold} * len(t) - 1e-9) WHERE list_contains(t, w[s])),
hit AS (SELECT doc_id, label, len(list_intersect(list_distinct(b), t)) / len(t) AS c FROM win WHERE len(list_intersect(list_distinct(b), t)) >= {threshold} * len(t) - 1e-9),
own AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM place) GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM hit) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(own.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""
