"""Registry, shared inputs and the matching SQL of the queries.

The driver tables hold prose: each text is mapped letter by letter to a DNA string, the same
way in Spark and in SQL, over the whole table and the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CLASSES
from ..functions.dna import derive_sequence
from ..functions.frames import numbers_text
from ..functions.scores import names_of, top_index
from ..operators.windows import make_windows
from ..plans.contigs import Scorer, linear_scorer, score_sequences
from ..sources.tables import read_table, spread

SIZE, STRIDE, MIN_LEN = 200, 150, 60

# Weights of the linear scorer: shares of G, C, A, T and the skew, one row per class.
WEIGHTS = [
    [2.01371, -1.02713, 3.03191, 1.04337, 0.51713],
    [6.02179, 2.03347, -2.01931, 0.52391, 1.01327],
    [-1.03119, 3.01733, 2.52871, 2.03919, -1.51331],
    [1.52117, 4.02939, 1.01773, -1.03733, -0.52397],
    [3.03391, 0.51917, 0.52771, 4.01393, 0.26113],
    [0.52973, 1.51339, 4.03177, -0.51797, 1.52311],
]
BIAS = [0.25317, 0.10939, 0.05171, 0.30713, 0.01939, -0.20373]

# Added before rounding on both sides, so that a value on the border of two roundings does not
# depend on the order in which a sum was taken.
NUDGE = 2.718e-10


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    columns: list[list[str]]
    body: str | None
    ctes: str

    @property
    def sql(self) -> str | None:
        """The full SQL text, with the shared parts it needs."""
        if self.body is None:
            return None
        parts = [f"{n} AS ({SHARED[n]})" for n in _needed(self.ctes.split())]
        head = f"WITH {', '.join(parts)} " if parts else ""
        chosen = ", ".join(_sql_value(n, k) for n, k in self.columns)
        return f"{head}SELECT {chosen} FROM ({self.body}) AS result"


REGISTRY: dict[str, Query] = {}


def _spark_value(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "d":
        # Plus zero turns a rounded -0.0 into 0.0.
        return (F.round(c.cast("double") + NUDGE, 6) + F.lit(0.0)).alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "l":
        return F.array_join(c.cast("array<string>"), ",").alias(name)
    if kind in ("li", "lli"):
        return numbers_text(c, *",|"[: len(kind) - 1]).alias(name)
    if kind == "ll":
        return F.array_join(
            F.transform(c.cast("array<array<string>>"), lambda x: F.array_join(x, ",")), "|"
        ).alias(name)
    if kind == "ld":
        return F.array_join(
            F.transform(c, lambda x: F.format_string("%.5f", F.round(x + NUDGE, 5) + F.lit(0.0))), ","
        ).alias(name)
    raise ValueError(kind)


def _sql_value(name: str, kind: str) -> str:
    q = f'"{name}"'
    return {
        "i": f"CAST({q} AS BIGINT)",
        "d": f"round(CAST({q} AS DOUBLE) + {NUDGE}, 6) + 0.0",
        "b": f"CAST({q} AS BOOLEAN)",
        "s": f"CAST({q} AS VARCHAR)",
        "l": f"array_to_string(CAST({q} AS VARCHAR[]), ',')",
        "ll": f"array_to_string(list_transform({q}, lambda x: "
        "array_to_string(CAST(x AS VARCHAR[]), ',')), '|')",
        "ld": f"array_to_string(list_transform({q}, lambda x: "
        f"printf('%.5f', round(CAST(x AS DOUBLE) + {NUDGE}, 5) + 0.0)), ',')",
    }[{"li": "l", "lli": "ll"}.get(kind, kind)] + f" AS {q}"


def register(name: str, columns: str, sql: str | None = None, ctes: str = ""):
    """Register a query with its result columns, written ``name:kind``.

    Kinds: i integer, d double (six decimals), b boolean, s text, l / ll / ld arrays as text,
    li / lli the same as l / ll for many whole numbers.
    ``ctes`` names the shared SQL parts the text builds on.
    """
    spec = [c.rsplit(":", 1) for c in columns.split()]

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(spark, folder).select(*[_spark_value(n, k) for n, k in spec])

        if name in REGISTRY:
            raise ValueError(f"duplicate query: {name}")
        REGISTRY[name] = Query(run, spec, sql, ctes)
        return fn

    return wrap


# ---- shared inputs --------------------------------------------------------------------------


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(read_table(spark, folder, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("seq_id"), derive_sequence("text").alias("seq"), "lang", "source"
    )


def windows(spark: SparkSession, folder: str) -> DataFrame:
    return make_windows(sequences(spark, folder), SIZE, STRIDE, min_len=MIN_LEN, mask=False)


def scorer() -> Scorer:
    return linear_scorer(WEIGHTS, BIAS)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return score_sequences(sequences(spark, folder), scorer(), SIZE, STRIDE, MIN_LEN, mask=False)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Scored windows with the index and name of their largest score."""
    index = top_index(F.col("scores"))
    return scored(spark, folder).withColumn("label_idx", index).withColumn(
        "label_name", F.get(names_of(CLASSES), F.col("label_idx"))
    )


def vector_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Window scores read from the embeddings: eight windows per contig."""
    table = read_table(spark, folder, "embeddings")
    e = F.col("embedding")
    return table.select(
        F.floor(F.col("vec_id") / 8).alias("seq_id"),
        (F.col("vec_id") % 8).cast("int").alias("window_idx"),
        F.transform(F.slice(e, 1, 6), lambda x: x.cast("double") * 10.0).alias("scores"),
        (F.get(e, F.lit(6)).cast("double") * 10.0).alias("reliability"),
        F.transform(e, lambda x: x.cast("double")).alias("embedding"),
        "label",
        "vec_id",
    )


# ---- the same in SQL ------------------------------------------------------------------------

CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in CLASSES) + "]"


def sql_count(col: str, letter: str) -> str:
    return f"(length({col}) - length(replace({col}, '{letter}', '')))"


def sql_skew(g: str, c: str) -> str:
    """Skew at two decimals, half to even, in whole numbers."""
    p, q = f"abs({g} - {c})", f"({g} + {c})"
    up = f"((200 * {p} + {q}) // (2 * {q}))"
    tie = f"((200 * {p} + {q}) % (2 * {q}) = 0 AND {up} % 2 = 1)"
    return (
        f"CASE WHEN {q} = 0 THEN 0.0::DOUBLE ELSE sign({g} - {c}) * "
        f"({up} - CASE WHEN {tie} THEN 1 ELSE 0 END)::DOUBLE / 100.0::DOUBLE END"
    )


def _sql_score(row: list[float], bias: float) -> str:
    out = f"{bias}::DOUBLE"
    for w, x in zip(row, ("g", "c", "a", "t")):
        out += f" + {w}::DOUBLE * ({x}::DOUBLE / length(win)::DOUBLE)"
    return out + f" + {row[4]}::DOUBLE * gc_skew"


def argmax(col: str) -> str:
    return f"(list_position({col}, list_max({col})) - 1)"


def second(col: str) -> str:
    rest = f"list_transform({col}, lambda x, i: CASE WHEN i = {argmax(col)} + 1 THEN NULL ELSE x END)"
    return f"(list_position({rest}, list_max({rest})) - 1)"


def softmax_sql(col: str) -> str:
    return (
        f"list_transform({col}, lambda x: exp(x - list_max({col})) / "
        f"list_sum(list_transform({col}, lambda y: exp(y - list_max({col})))))"
    )


SHARED = {
    "seqs": (
        "SELECT doc_id AS seq_id, lang, source, regexp_replace(translate(lower(text), "
        "'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', 'N', 'g') "
        "AS seq FROM documents"
    ),
    "wins": f"""
        SELECT seq_id, lang, seq_len, start, start // {STRIDE} AS window_idx,
               substr(seq, start + 1, {SIZE}) AS win,
               CASE WHEN seq_len >= {SIZE} THEN start + {STRIDE} + {SIZE} > seq_len
                    ELSE true END AS is_last
        FROM (SELECT seq_id, lang, seq, length(seq) AS seq_len,
                     unnest(CASE WHEN length(seq) >= {SIZE}
                                 THEN range(0, length(seq) - {SIZE - 1}, {STRIDE})
                                 WHEN length(seq) >= {MIN_LEN} THEN [0] ELSE [] END) AS start
              FROM seqs)""",
    "counted": (
        "SELECT *, " + sql_skew("g", "c") + " AS gc_skew FROM (SELECT *, "
        + ", ".join(f"{sql_count('win', b.upper())} AS {b}" for b in "gcat")
        + " FROM wins)"
    ),
    "scored": (
        "SELECT *, [" + ", ".join(_sql_score(w, b) for w, b in zip(WEIGHTS, BIAS))
        + "] AS scores FROM counted"
    ),
    "labelled": (
        f"SELECT *, {CLASS_LIST}[label_idx + 1] AS label_name FROM "
        f"(SELECT *, {argmax('scores')} AS label_idx FROM scored)"
    ),
    "vscores": (
        "SELECT vec_id // 8 AS seq_id, vec_id % 8 AS window_idx, label, vec_id, "
        "list_transform(embedding[1:6], lambda x: x::DOUBLE * 10.0::DOUBLE) AS scores, "
        "embedding[7]::DOUBLE * 10.0::DOUBLE AS reliability, "
        "list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings"
    ),
}

NEEDS = {
    "wins": ["seqs"], "counted": ["wins"], "scored": ["counted"], "labelled": ["scored"],
}


def share_sql(name: str, needs: str, text: str) -> None:
    """Add a shared SQL part."""
    SHARED[name] = text
    NEEDS[name] = needs.split()


def share_variant(suffix: str, names: list[str], base: dict[str, str]) -> None:
    """Copies of shared parts, ending in ``suffix``, that build on other texts of the parts in ``base``."""
    chain = [n for n in _needed(names) if n in base or any(b in _needed([n]) for b in base)]

    def renamed(text: str) -> str:
        for n in chain:
            text = re.sub(rf"(?<![\w.'\"]){n}(?![\w'\"(])", n + suffix, text)
        return text

    for n in chain:
        needs = [x + suffix if x in chain else x for x in NEEDS.get(n, [])]
        share_sql(n + suffix, n if n in base else " ".join(needs), base.get(n) or renamed(SHARED[n]))


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in out:
            out.append(name)

    for name in names:
        add(name)
    return out


def md5_hash(*cols: str, seed: int = 0) -> str:
    """The row hash: first 32 bits of md5 over seed and key."""
    key = " || ':' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]])
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def mix_sql(x: str) -> str:
    y = f"(({x} * 1664525 + 1013904223) % 4294967296)"
    return f"xor({y}, {y} >> 15)"


def at_sql(h: str, pos: str) -> str:
    return mix_sql(mix_sql(f"(({h} + ({pos})::BIGINT * 2654435761) % 4294967296)"))


def tail_aligned_sql(table: str, size: int, overlap: int, label: str) -> str:
    """Sliding fragments of ``seq``, the last one shifted left to full length."""
    return f"""SELECT *, substr(seq, start + 1, {size}) AS fragment,
                 seq_id || '_frag' || frag_idx || '_start' || start || '_len{size}_cls=' || {label} AS frag_name
               FROM (SELECT *, unnest(starts) AS start, unnest(range(0, len(starts))) AS frag_idx
                     FROM (SELECT *, range(0, length(seq) - {size}, {size - overlap}) || [length(seq) - {size}] AS starts
                           FROM {table} WHERE length(seq) >= {size}))"""


def mers_sql(table: str, k: int) -> str:
    """Distinct k-mers without N of the distinct sequences of ``table`` (seq_id, seq, len)."""
    return f"""SELECT DISTINCT seq_id, len, kmer AS mer FROM (
                 SELECT seq_id, len, substr(seq, i + 1, {k}) AS kmer FROM (
                   SELECT *, unnest(range(0, greatest(len - {k - 1}, 0))) AS i FROM {table}))
               WHERE NOT contains(kmer, 'N')"""


def links_sql(mers: str, identity: float, coverage: float) -> str:
    """Members and centres: longer, or equally long with a smaller id, that hold enough k-mers."""
    return f"""SELECT member, centre, shared::DOUBLE / size AS similarity, clen FROM (
                 SELECT a.seq_id AS member, b.seq_id AS centre, b.len AS clen, count(*) AS shared
                 FROM {mers} a JOIN {mers} b ON a.mer = b.mer AND a.len >= b.len * {coverage}::DOUBLE
                   AND (b.len > a.len OR (b.len = a.len AND b.seq_id < a.seq_id))
                 GROUP BY a.seq_id, b.seq_id, b.len)
               JOIN (SELECT seq_id AS member, count(*) AS size FROM {mers} GROUP BY seq_id) USING (member)
               WHERE shared::DOUBLE / size >= {identity}"""


def climb_sql(links: str) -> str:
    """CTEs up to ``roots``: the end of each member's chain of best centres."""
    return f"""best AS (SELECT member, centre FROM (
                 SELECT *, row_number() OVER (PARTITION BY member ORDER BY clen DESC, centre) AS place FROM {links})
               WHERE place = 1),
             climb AS (SELECT member, centre AS rep, 1 AS steps FROM best
                       UNION ALL SELECT climb.member, best.centre, steps + 1
                       FROM climb JOIN best ON best.member = climb.rep),
             roots AS (SELECT member, max_by(rep, steps) AS rep FROM climb GROUP BY member)"""
