"""Ranked lexical search against plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from contigframe.llm import lexical_search as ls
from contigframe.llm import words as W
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def by_hand(docs, items, k=10):
    split = [(i, terms(t)) for i, t in docs]
    split = [(i, w) for i, w in split if w]
    n, total = len(split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, own in asked.items():
        found = []
        for i, w in split:
            tf, m, score = Counter(w), 100 - 90 + (90 * len(w) * n) // total, 0
            for t in own & set(w):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def result(spark, docs, items, k=10, partitions=3):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n", F.lit("x")).withColumn("term", F.lit("y"))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit("z"))
    return sorted((tuple(r) for r in ls.search_documents(d.repartition(partitions), q, k).collect()), key=repr)


def some(n, seed, n_items=12):
    rng = random.Random(seed)
    pool = ["The", "the", "é1", "x9", "ÀB", "aÀ", "日本", "q" * 300, "Q" * 299 + "r", "a" * 9, "a" * 8 + "b", "2024"] + [f"w{k}" for k in range(25)]
    text = lambda top: rng.choice([" ", "-", "\n"]).join(rng.choices(pool, k=rng.randint(0, top)))
    docs = [(k, text(60)) for k in range(n)] + [(None, text(20)), (None, "the w1"), (3, "the w1 w2"), (3, "the w1 w2"), (n, None), (n + 1, " .\x00"), (n + 2, "w1 the " * 4000)]
    docs += [(n + 10 + k, "w3 w4 same") for k in range(30)]  # ties
    items = [(k, text(15)) for k in range(n_items)] + [(100, None), (101, ""), (102, "nothing here"), (5, "w7 w8"), (None, "w1 w2"), (103, "same"), (104, "w1 the same")]
    return docs, items


@pytest.mark.parametrize(("seed", "k", "block", "cells", "held", "terms_each"), [
    (1, 10, 256, 4 << 20, 100_000, 1_000_000), (2, 3, 4, 60, 5, 1_000_000), (3, 1, 1, 1000, 1, 20),
])
def test_ranks_are_those_of_plain_scoring(spark, monkeypatch, seed, k, block, cells, held, terms_each):
    for name, value in (("BLOCK_ITEMS", block), ("CELLS", cells), ("HELD", held), ("PASS_TERMS", terms_each)):
        monkeypatch.setattr(ls, name, value)
    docs, items = some(80, seed)
    assert result(spark, docs, items, k) == by_hand(docs, items, k)


def test_empty_tables(spark):
    docs, items = some(5, 1, 2)
    assert result(spark, [], items) == result(spark, docs, []) == result(spark, [(1, None)], items) == []
    assert result(spark, docs, items, partitions=40) == by_hand(docs, items)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 15)), max_size=10))
def test_graphs_keep_every_sum(sets):
    nodes, parts = ls.shared_sums(sets, 16)
    holds = {t: [t] for t in range(16)}
    for symbol, own in nodes:
        holds[symbol] = [t for p in own for t in holds[p]]  # parts come before their node
    for own, kept in zip(sets, parts, strict=True):
        assert sorted(t for p in kept for t in holds[p]) == sorted(own)
    rows = [set(p) for _, p in nodes] + [set(p) for p in parts]
    assert all(len(a & b) < 2 for i, a in enumerate(rows) for b in rows[:i])  # nothing is left to share
    assert sum(max(0, len(p) - 1) for p in rows) <= sum(max(0, len(s) - 1) for s in sets)


def test_graphs_share_work():
    rng = random.Random(2)
    common = [set(rng.sample(range(400), 20)) for _ in range(5)]
    sets = [set().union(*rng.sample(common, 2), rng.sample(range(400), 5)) for _ in range(60)]
    nodes, parts = ls.shared_sums(sets, 400)
    sums = sum(len(p) - 1 for _, p in nodes) + sum(len(p) - 1 for p in parts)
    assert sums < 0.4 * sum(len(s) - 1 for s in sets)


def test_terms_are_confirmed_by_their_bytes(monkeypatch):
    known = ls.Vocabulary(["abc", "q" * 300, "é", "abcdefgh1"])
    words = W.split_words(pa.array(["ABC abd " + "q" * 300 + " " + "q" * 299 + "r É é abcdefgh2 abcdefgh1"]), W.ALNUM_LOWER)
    rows, found = known.find(words)
    assert list(zip(rows.tolist(), found.tolist(), strict=True)) == [(0, 0), (2, 1), (5, 2), (7, 3)]
    # Even if every word had the hash of a term, only equal words are found.
    monkeypatch.setattr(W, "word_hashes", lambda w, seed=0: np.full(len(w.start), known.hashes[0]))
    rows, found = known.find(words)
    term = int(known.order[0])
    assert [(r, t) for r, t in zip(rows.tolist(), found.tolist(), strict=True)] == [({0: 0, 1: 2, 2: 5, 3: 7}[term], term)]
