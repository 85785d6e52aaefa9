"""Packing against the tokenizer library, plain BM25 and the rules of a packing."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from contigframe.llm import packing
from contigframe.llm.queries import word_tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = Tokenizer.from_file(word_tokenizer())
ENCODER = packing.Encoder(word_tokenizer())
ODD = ["Σ", "ΑΣ", "\xa0", "a\xa0b", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "DON'T.", "a.b,c.", "...", "x.,.", "İ", "É", "H̱.",
       "ſ,", "12.5", "3", "\x00", "\x1c", "a\x85b", "日本語。", "é", "ÉTÉ,", "A", "́", ".̸", "ﬁ", "🙂", "", ",", "'s", "'S."]


def direct(text, end=2):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end]


def encoded(texts):
    ids, offsets = ENCODER.encode(packing.Units(pa.array(texts, pa.string())), 2)
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_are_the_librarys():
    texts = [*ODD, " ".join(ODD), "".join(ODD), "\n".join(ODD), "\t \r\n" + ",".join(ODD), "Ab " * 5000, "q" * 3000]
    assert encoded(texts) == [direct(t) for t in texts]
    assert encoded([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*ODD, " ", "\n", "The", "of.", "'", "b"])).map("".join), max_size=6))
def test_ids_of_any_mixture(texts):
    assert encoded(texts) == [direct(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_ids_of_any_text(texts):
    assert encoded(texts) == [direct(t) for t in texts]


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 10)
    for k in range(5):
        texts = [f"w{k}a w{k}b{j}" for j in range(9)]
        assert encoded(texts) == [direct(t) for t in texts]
        assert len(ENCODER.slot) <= 10 + 40


def some_docs(n, seed):
    rng = random.Random(seed)
    pools = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    docs = [(k, " ".join(rng.choices(pools[k % 3], k=rng.choice([1, 5, 20, 40, 90])))) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (None, "no id"), (3, "again"), (3, "again"), (n + 2, "long " * 900), (n + 3, " \n ")]
    rng.shuffle(docs)
    return docs


def plain_scores(texts, seed):
    docs = [t.split() for t in texts]
    counts = [Counter(d) for d in docs]
    df = Counter(w for c in counts for w in c)
    mean, n = sum(map(len, docs)) / len(docs), len(docs)
    out = []
    for d, c in zip(docs, counts, strict=True):
        s = 0.0
        for w in counts[seed]:
            tf = c[w]
            s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
        out.append(s)
    return out


def test_scores_are_plain_bm25():
    texts = ["a b b c", "b c d", "", "x y", "a a a a a a b", "d"]
    index = packing.Index(packing.Units(pa.array(texts)))
    for seed in range(len(texts)):
        assert np.allclose(index.scores(seed), plain_scores(texts, seed))


def test_windows_are_filled_with_the_best_neighbours():
    """A plain greedy on plain scores gives the same windows."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(40)], k=rng.randint(3, 12))) for _ in range(60)]
    left = np.array([rng.randint(1, 70) for _ in texts])
    windows, rest = packing.fill_windows(left, packing.Index(packing.Units(pa.array(texts))), 50)
    want, have = [], left.copy()
    for d, n in enumerate(have):
        want += [[(d, 50)]] * (n // 50)
    have %= 50
    seed = None
    while have.sum() >= 50:
        if seed is None:
            seed = next(d for d, n in enumerate(have) if n)
        own, room = [(seed, have[seed])], 50 - have[seed]
        have[seed] = 0
        scores, seed = plain_scores(texts, seed), None
        order = sorted((d for d, n in enumerate(have) if n), key=lambda d: -round(scores[d], 9))
        while room:
            fit = next((d for d in order if have[d] and have[d] <= room), None)
            if fit is None:
                seed = next(d for d in order if have[d])
                own.append((seed, room))
                have[seed] -= room
                room = 0
            else:
                own.append((fit, have[fit]))
                room -= have[fit]
                have[fit] = 0
        want.append(own)
    assert windows == want and rest.tolist() == have.tolist()


@pytest.mark.parametrize(("partitions", "shard"), [(1, 1 << 20), (1, 3000), (4, 1500)])
def test_every_id_lies_in_one_piece(spark, partitions, shard):
    docs = some_docs(150, 4)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("ids", F.lit("x")).withColumn("length", F.lit("y"))
    rows = packing.pack_documents(frame.repartition(partitions), word_tokenizer(), 128, 2, shard).collect()
    want = Counter((i, tuple(direct(t))) for i, t in docs)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        pieces[r.doc_id].append((r.start, r.doc_tokens, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128 and at & (at - 1) == 0  # whole windows and powers of two: no padding
    assert sum(sum(n for _, n in own) < 128 for own in sequences.values()) <= 7 * partitions
    for i in {i for i, _ in docs}:
        mine = [ids for (j, ids), n in want.items() for _ in range(n) if j == i]
        if len(mine) == 1:
            assert [x for _, _, ids in sorted(pieces[i]) for x in ids] == list(mine[0])
            assert {n for _, n, _ in pieces[i]} == {len(mine[0])}
            starts = [s for s, _, _ in sorted(pieces[i])]
            assert starts == np.cumsum([0, *[len(ids) for _, _, ids in sorted(pieces[i])[:-1]]]).tolist()
        assert sum(len(ids) for _, _, ids in pieces[i]) == sum(map(len, mine))


def test_neighbours_share_words(spark):
    docs = [(i, t) for i, t in some_docs(300, 9) if i is not None and i < 300]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    rows = packing.pack_documents(frame, word_tokenizer(), 512).collect()
    kinds = defaultdict(set)
    for r in rows:
        kinds[r.sequence_id].add(r.doc_id % 3)
    assert sum(len(k) == 1 for k in kinds.values()) > 0.7 * len(kinds)


def test_digests_and_empty_table(spark, tmp_path):
    from contigframe.llm.queries import op11_packing

    docs = some_docs(30, 1)
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op11_packing(spark, str(tmp_path)).collect()
    texts = {i: t for i, t in docs if i not in (None, 3)}
    for r in rows:
        if r.doc_id in texts:
            ids = direct(texts[r.doc_id])[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack_documents(empty, word_tokenizer()).count() == 0
