"""The filter audit against a plain run of all filters in every order."""

import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import pytest
from contigframe.llm.filter_audit import LETTERS, audit_filters, mask_tally, shapley_weights

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, mask int, n bigint, print string"
LABELS = "doc_id bigint, quality int, toxic int, part string"
LONG = " ".join(f"w{k}" for k in range(60))


def failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    if len(words) < 50:
        out.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    return out


def by_hand(docs, labels):
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    rows = defaultdict(list)
    for i, t, s in docs:
        fails = failures(t or "") | ({"E"} if i is not None and i > smallest[t or ""] else set())
        good = any(a == i and i is not None and q == 1 for a, q, _ in labels)
        toxic = any(a == i and i is not None and x == 1 for a, _, x in labels)
        rows[s or ""].append((fails, good, toxic))
    out = {}
    for part, own in rows.items():
        total = defaultdict(int)
        for order in permutations(LETTERS):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in own if f in r[0]]
                out[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in own), sum(r[1] for r in gone), sum(r[2] for r in gone),
                ]
                total[f] += len(gone)
        for order in permutations(LETTERS):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", s, 1, 7, 7, "x") for i, t, s in docs], DOCS)


def result(spark, docs, labels):
    marks = spark.createDataFrame([(*x, "y") for x in labels], LABELS)
    rows = audit_filters(mask_tally(frame(spark, docs), marks)).collect()
    return {tuple(r[:3]): list(r[3:]) for r in rows}, len(rows)


CASES = {
    "mixed": [
        (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, "THE End #", "a"), (5, "the " * 80, "b"), (6, LONG + " $", "b"),
        (7, "THE End #", None), (8, None, ""), (9, "", None), (10, "é" * 20 + "A", "a"), (11, "\x1c \x0b|x", "b"), (12, "the " * 50_000, "a"),
    ],
    "repeated rows and no ids": [
        (3, LONG, "a"), (3, LONG, "a"), (3, LONG, "b"), (3, "other", "a"), (5, LONG, "a"), (5, LONG, "a"), (None, LONG, "a"),
        (None, LONG, "a"), (None, None, None), (2, "", "a"), (1, None, "a"),
    ],
    "one hot part": [(k, LONG if k % 3 else f"only {k} | X", "hot" if k % 4 else "b") for k in range(60)],
}


@pytest.mark.parametrize("name", CASES)
def test_audit_is_like_running_every_order(spark, name):
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (3, None, 1), (99, 1, 1)]
    want = by_hand(CASES[name], labels)
    got, n = result(spark, CASES[name], labels)
    assert got == want and n == len(want)


def test_empty_tables(spark):
    assert result(spark, [], [(1, 1, 1)]) == ({}, 0)
    got, n = result(spark, [(1, "x", "a")], [])
    assert n == 600 and got["a", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_gives_shapley_values(n):
    for i, row in enumerate(shapley_weights(n)):
        for s in range(1, 1 << n):
            k = s.bit_count()
            with_i = Fraction(factorial(k - 1) * factorial(n - k), factorial(n))
            without = -Fraction(factorial(k) * factorial(n - k - 1), factorial(n)) if k < n else 0
            assert row[s] == (with_i if s >> i & 1 else without)
