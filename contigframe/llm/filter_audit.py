"""What each quality filter removes, in every order in which the filters could run.

A document's failures are one mask, a bit a filter. Documents are counted by (part, mask); from these
few rows come the removals v(S) of every coalition S of filters: the documents that fail any filter of
S. A filter that runs after the filters P then removes v(P + filter) - v(P), whatever the order within
P, so every step of every order is a difference of two coalitions.

The Shapley value of a filter is the solution of a least-squares problem: additive values that come
closest to v over all coalitions, weighted by the Shapley kernel, with the values of all filters
summing to the removals of all filters together. Its normal equations depend on v only through their
right side, so they are solved once, in rationals, for a unit right side per coalition
(``shapley_weights``); a part's values are whole-number combinations of its coalitions.

Scale: texts are read once; after that a document is its id, part, mask and a 256-bit fingerprint.
Copies are found by the smallest doc_id of each fingerprint, a map-side combined aggregate, and a join
on (fingerprint, doc_id), which no group of copies makes hot. A part may hold any share of the rows.

Defined cases: a null text is empty. A null part and an empty one are the same part. Rows without
doc_id are never a copy of another row, nor is another row a copy of them. Rows that repeat one doc_id
and text count as often as they come and do not make each other copies. A document is good or toxic
if any of its labels says so; without a label it is neither. An empty table has no parts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Filters of ``text_failures``, then copies.
LETTERS = "ABCDE"
_WORDS = r"[\x20\x09-\x0D]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column) -> Column:
    """Mask of the filters that look at one text: A (bit 0) fewer than 50 words, B distinct words
    under 65 % of the words, C capitals A-Z over 5 % of the code points, D any of ``#$%&*|``."""
    words = F.array_remove(F.split(text, _WORDS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    fails = [
        n < 50,
        100 * distinct.cast("bigint") < 65 * n.cast("bigint"),
        100 * capitals.cast("bigint") > 5 * F.length(text).cast("bigint"),
        text.rlike(r"[#$%&*|]"),
    ]
    bits = [F.when(fail, 1 << k).otherwise(0) for k, fail in enumerate(fails)]
    return sum(bits[1:], bits[0])


def shapley_weights(n: int) -> list[list[Fraction]]:
    """Row i gives filter i's Shapley value as a combination of v(S), S = 0 to 2**n - 1, v(0) = 0.

    Minimises sum over S of k(S) (v(S) - sum of the values in S)**2 with the sum of all values equal to
    v of all. The Lagrange conditions are n + 1 linear equations, eliminated in rationals.
    """
    whole = (1 << n) - 1
    if n == 1:
        return [[Fraction(0), Fraction(1)]]
    kernel = [Fraction(0)] * (whole + 1)
    for s in range(1, whole):
        size = s.bit_count()
        kernel[s] = Fraction(n - 1, comb(n, size) * size * (n - size))
    rows = []
    for i in range(n):
        left = [sum((kernel[s] for s in range(whole) if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        rows.append([*left, Fraction(1), *[kernel[s] if s >> i & 1 else Fraction(0) for s in range(whole + 1)]])
    rows.append([*[Fraction(1)] * n, Fraction(0), *[Fraction(int(s == whole)) for s in range(whole + 1)]])
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [rows[i][n + 1 :] for i in range(n)]


def mask_tally(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by their failures of all filters A to E."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("print"), text_failures(body).alias("mask"),
    )
    marks = labels.groupBy("doc_id").agg(
        F.max(F.expr("CASE WHEN quality = 1 THEN 1 ELSE 0 END")).alias("is_good"),
        F.max(F.expr("CASE WHEN toxic = 1 THEN 1 ELSE 0 END")).alias("is_toxic"),
    )
    found = rows.groupBy("doc_id", "part", "print", "mask").agg(F.count("*").alias("n"))
    found = found.join(marks.hint("merge"), "doc_id", "left").select(
        "doc_id", "part", "print", "mask", "n",
        (F.col("n") * F.coalesce("is_good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("is_toxic", F.lit(0))).alias("toxic"),
    )
    found = cut(found)
    first = found.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    originals = found.join(first.hint("merge"), ["print", "doc_id"]).select("part", "mask", "n", "good", "toxic")
    originals = originals.unionAll(found.where("doc_id IS NULL").select(*originals.columns))
    counts = ["n", "good", "toxic"]
    copies = 1 << LETTERS.index("E")

    def per_mask(df: DataFrame, bits: int, sign: int) -> DataFrame:
        summed = df.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])
        return summed.select("part", (F.col("mask") + bits).alias("mask"), *[(sign * F.col(c)).alias(c) for c in counts])

    # Copies are all rows less the originals.
    tally = per_mask(found, copies, 1).unionAll(per_mask(originals, copies, -1)).unionAll(per_mask(originals, 0, 1))
    return tally.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])


def audit_filters(tally: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Every step of every order of the filters, for each part of a ``mask_tally``.

    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``,
    where shapley is summed over all orders. ``letters`` names the filters of the mask's bits.
    """
    n, whole = len(letters), (1 << len(letters)) - 1
    coalitions = range(whole + 1)

    def table(count: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(count)).otherwise(0)) for s in coalitions])

    parts = tally.groupBy("part").agg(F.sum("n").alias("total"), *[table(c).alias(f"v_{c}") for c in ("n", "good", "toxic")])
    orders = factorial(n)
    weights = [[w * orders for w in row] for row in shapley_weights(n)]
    if any(w.denominator != 1 for row in weights for w in row):
        raise ArithmeticError("Shapley weights must be whole over all orders")
    values = [
        sum((int(w) * F.get("v_n", F.lit(s)) for s, w in enumerate(row) if w), F.lit(0).cast("bigint")) for row in weights
    ]
    steps = []
    for order in permutations(range(n)):
        name, before = "".join(letters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            steps.append({"filter_order": name, "step": step, "k": k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    # One constant, instead of thousands of literals for the optimizer to walk through.
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, k: int, before: int, after: int>>")
    rows = parts.select("*", F.array(*values).alias("shapley"), F.explode(listed).alias("s"))

    def v(count: str, coalition: Column) -> Column:
        return F.get(F.col(f"v_{count}"), coalition)

    before, after, alone = F.col("s.before"), F.col("s.after"), F.expr("shiftleft(1, s.k)")
    removed = v("n", after) - v("n", before)
    out = {
        "part": F.col("part"), "filter_order": F.col("s.filter_order"), "step": F.col("s.step"),
        "kept": F.col("total") - v("n", after), "removed": removed, "redundant": v("n", alone) - removed,
        "unique_fails": v("n", F.lit(whole)) - v("n", F.lit(whole).bitwiseXOR(alone)),
        "good_lost": v("good", after) - v("good", before), "toxic_lost": v("toxic", after) - v("toxic", before),
        "shapley": F.get("shapley", F.col("s.k")),
    }
    return rows.select(*[c.alias(name) for name, c in out.items()])
