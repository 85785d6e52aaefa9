"""The text operators against brute force on small fixtures, with the cases their docstrings define."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from contigframe.llm import decontaminate, hamming, language, licenses, line_dedup, near_dedup, pieces, quality, substring_dedup, toxicity
from contigframe.llm.queries import piece_model
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, extra=""):
    """Rows of (doc_id, text), with other columns whose names the operators use inside."""
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in rows], SCHEMA)
    for name in extra.split():
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def some_texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["the", "Of", "and", "é1", "x-y", "b\x00c", "Zu,", "ab", "cd.", "日本", "q" * 300]
    texts = ["", None, " \n\t ", "one", "one two three", "the " * 3000]
    for _ in range(n):
        texts.append("".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randint(1, 60))))
    texts += rng.sample(texts[6:], 10)
    texts += [texts[8] + " " + texts[9], "new " + (texts[10] or "")]
    return list(enumerate(texts))


CLASHES = "bucket keys places page key row band hash h kept score starts ends"


# Substring dedup


def kept_by_hand(rows, size):
    seen, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = SPACED.findall(t or "")
        for k in range(len(w) - size + 1):
            seen.setdefault(tuple(w[k : k + size]), (i, k))
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and seen[tuple(w[k : k + size])] != (i, k):
                gone.update(range(k, k + size))
        out[i] = (" ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone))
    return out


@pytest.mark.parametrize("block", [substring_dedup.BLOCK_WINDOWS, 50])
def test_repeats_are_removed_like_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", block)
    rows = some_texts()
    random.Random(1).shuffle(rows)  # the order of rows does not matter
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows, CLASHES), 5).collect()}
    assert got == kept_by_hand(rows, 5)


def test_repeats_without_id_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(None, long), (4, long), (4, long), (7, long), (None, long)]
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, rows), 20).collect())
    assert got == [(-1, 0), (-1, 0), (4, 0), (4, 0), (7, 30)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.remove_repeats(none).count() == 0
    assert line_dedup.remove_boilerplate(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find_passages(none, items).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, [(1, "a b")]), items).count() == 1
    assert licenses.scan_licenses(none).count() == 0
    assert pieces.encode_texts(none, piece_model()).count() == 0
    codes = spark.createDataFrame([], "id bigint, code bigint")
    assert hamming.nearest_codes(codes, codes).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = frame(spark, [(1, "a"), (2, None)])
    assert {r.score for r in quality.score_quality(one, quality.train_quality(one, labels)).collect()} == {0.5}
    assert all(r.score < 1e-9 for r in toxicity.score_toxicity(one, toxicity.train_toxicity(one, labels)).collect())
    model = language.train_languages(none, piece_model())
    assert {(r.lang_pred, r.score) for r in language.identify(one, model).collect()} == {("und", 0.0)}


# Line dedup


def test_boilerplate_lines(spark):
    rows = [(i, f"own {i}\n  Menu \r\n\nfoot{i % 3}\n") for i in range(0, 24, 2)] + [(1, "Menu\nx"), (3, None), (5, "")]
    rows += [(40, "Menu\nMenu\nlast"), (None, "Menu"), (None, "Menu")]
    got = sorted((r.row.doc_id if r.row.doc_id is not None else -1, r.text, r.n_lines, r.n_dropped) for r in line_dedup.remove_boilerplate(frame(spark, rows, CLASHES), 0.5).collect())
    # Host s0: 12 pages, page 40 and the row without id (its repetition is the same page) hold "Menu".
    want = [(i, f"own {i}\n\nfoot{i % 3}\n", 5, 1) for i in range(0, 24, 2)]
    want += [(1, "Menu\nx", 2, 0), (3, None, 0, 0), (5, "", 1, 0), (40, "last", 3, 2), (-1, "", 1, 1), (-1, "", 1, 1)]
    assert got == sorted(want, key=lambda r: (r[0], r[1] or "", r[2], r[3])) or sorted(map(str, got)) == sorted(map(str, want))


def test_boilerplate_depends_on_the_share_alone(spark):
    """The same pages twice, once as a host of four and once repeated on a host of forty."""
    pages = ["Menu\nall", "Menu\nalone", "Menu\nx", "y"]
    small = {t: line_dedup.remove_boilerplate(frame(spark, [(2 * k, p) for k, p in enumerate(pages)]), 0.5).select("text").collect() for t in [0]}[0]
    large = line_dedup.remove_boilerplate(frame(spark, [(2 * k, f"{pages[k % 4]} {k}" if k % 4 == 3 else pages[k % 4].replace("al", f"{k}al")) for k in range(40)]), 0.5)
    assert sorted(r.text for r in small) == ["all", "alone", "x", "y"]
    assert large.where("text LIKE '%Menu%'").count() == 0 and large.where("n_dropped = 1").count() == 30


# Near duplicates


def shingles(text, size=5):
    w = SPACED.findall(lowered(text))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def test_near_duplicates_like_all_pairs(spark):
    rng = random.Random(5)
    texts = ["", None, "a b", "A b", "one two three four five", "One two three four five six"]
    for base in range(3):
        words = [f"w{base}x{k}" for k in range(120)]
        for _ in range(40):  # many texts about as similar as the limit
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(120)] = rng.choice([f"e{rng.random()}", "same", "also"])
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = frame(spark, [*enumerate(texts), (None, texts[8])], CLASHES)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, percent=85).collect()}
    assert got.pop(None) == (len(sets[8]), None, True)
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_of_repeated_ids(spark):
    """Every text of a repeated id finds its copies."""
    one, two, three = (" ".join(f"{c}{k}" for k in range(100)) for c in "xyz")
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, three), (7, three), (7, "other words of its own here"), (8, "other words of its own here")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows, CLASHES), percent=85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (7, 4, False), (8, 4, False)}


def test_one_row_of_each_group_stays(spark):
    """Also where ids repeat or are missing: by hand on rows whose groups are known."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    alone = " ".join(f"z{k}" for k in range(60))
    rows = [(4, one), (4, one), (4, two), (2, two + " end"), (None, one), (None, one), (None, alone), (9, ""), (9, ""), (None, None), (7, one + " tail")]
    docs = frame(spark, rows, CLASHES)
    left = near_dedup.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(4, one), (2, two + " end"), (0, alone), (9, ""), (0, "")])
    plain = frame(spark, [(1, one), (3, one + " tail"), (5, alone), (6, None), (8, "")], CLASHES)
    assert sorted(r.doc_id for r in near_dedup.one_of_each(plain).collect()) == [1, 5, 6, 8]


def test_min_and_max_agree_as_often_as_the_sets_overlap():
    a = np.arange(1, 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = np.sort(a[200:])
    _, _, sketch = near_dedup.signatures(np.concatenate([np.sort(a), b]), np.array([0, 1000, 1800]))
    nibbles = [[int(x) >> 4 * k & 15 for x in row for k in range(16)] for row in sketch]
    equal = np.mean([x == y for x, y in zip(*nibbles, strict=True)])
    assert abs(equal - (0.8 + 0.2 / 16)) < 0.12


# Decontamination


@pytest.mark.parametrize("block", [decontaminate.PATTERNS, 7])
def test_passages_like_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "PATTERNS", block)
    rng = random.Random(2)
    words = ["a", "B", "c", "é", "d1"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "\n\x00"]) for _ in range(rng.randint(0, 150)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "a b c " * 2000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 4, 5, 6, 9, 12, 0])]
    items += [(10, None), (None, "a"), (11, items[4][1]), (12, "zz")]
    want = {}
    for i, t in rows:
        w, hit, named = ALNUM.findall(lowered(t)), set(), set()
        for k, p in items:
            p = ALNUM.findall(lowered(p))
            m = min(4, len(p))
            for s in range(len(p) - m + 1) if k is not None and m else ():
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == p[s : s + m]:
                        hit.update(range(at, at + m))
                        named.add(str(k))
        want[i] = (len(w), sorted(hit), sorted(named))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, [*rows, (None, "zz"), (None, None), rows[3]], CLASHES)
    got = {(r.doc_id, r.text_hash): (r.n_words, sorted(r.hits), r["items"]) for r in decontaminate.find_passages(docs, table, 4).collect()}
    assert len(got) == len(rows) + 2
    assert {k[0]: v for k, v in got.items() if k[0] is not None} == want
    assert sorted(len(v[1]) for k, v in got.items() if k[0] is None) == [0, 1]
    clean = decontaminate.drop_contaminated(docs, table, 4)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, v in want.items() if not v[1]} | {None}


# Licenses


def test_licenses_like_by_hand(spark):
    notices = list(licenses.TEMPLATES)
    rng = random.Random(6)
    filler = "the of and license under public general software mit gnu cc by nc work this version 3 0".split()
    rows = [(0, None), (1, ""), (2, "CC  by-CC BY, gnu General/Public\nLicense"), (3, "MIT License"), (4, "by the mit License mit"), (5, "mit " * 5000)]
    for k in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 70))]
        at = rng.randint(0, len(words))
        notice = rng.choice(notices).title().split()
        if k % 3 == 0:
            notice.pop(rng.randrange(len(notice)))
        rows.append((10 + k, " ".join(words[:at] + notice + words[at:])))
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [*rows, (None, "mit license")], CLASHES)).collect()}
    assert got.pop(None).base_labels == "mit"
    for i, t in rows:
        w, places, base, labels, best = ALNUM.findall(lowered(t)), [], set(), set(), 0
        for p, label in licenses.PHRASES.items():
            p = p.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            base |= {label} if found else set()
        for words, label in licenses.TEMPLATES.items():
            part, span = set(words.split()), licenses.SPREAD * len(words.split())
            share = max((len(part & set(w[s : s + span])) / len(part) for s in range(len(w))), default=0)
            if share >= licenses.THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None)), t
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | labels))), t
        assert r.score == pytest.approx(1 if base else best)


# SentencePiece


def test_pieces_like_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    rng = random.Random(2)
    marks = [*"ab  the ing\n\t0123.,!▁é日本語😀ñ\x00 İ", "the ", "  "]
    texts = ["", None, " ", "▁▁a", "x" * 3000, " " * 500, "<s>", "<0x0A>"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 100))) for _ in range(600)]
    for r in pieces.encode_texts(frame(spark, list(enumerate(texts)), CLASHES), piece_model(), decoded=True).collect():
        text = texts[r.doc_id] or ""
        want = library.encode(text)
        assert (r.ids, r.decoded) == (want, library.decode(want))
        assert r.bounds[0] == 0 and r.bounds[-1] == len(text.encode()) and r.bounds == sorted(r.bounds)
        if "▁" not in text:
            for k, (i, a, b) in enumerate(zip(r.ids, r.bounds, r.bounds[1:], strict=False)):
                shown = library.id_to_piece(i)
                source = text.encode()[a:b]
                if not shown.startswith("<0x"):
                    assert source == shown.replace("▁", " ").encode()[0 if k else 1 :]
    ids = [[rng.randrange(3, 32000) for _ in range(rng.randint(0, 9))] for _ in range(200)] + [[0, 5], [1, 2], [230, 231], None]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id bigint, ids array<int>")
    for r in pieces.decode_ids(rows, piece_model()).collect():
        assert r.text == library.decode(ids[r.doc_id] or [])


def test_character_map_takes_the_longest_prefix():
    # A double array of "a" -> "X" and "ab" -> "YZ", laid out by hand.
    import struct

    values = b"X\0YZ\0"
    units = [0] * 512

    def unit(offset, label, leaf):
        return (offset << 10) | (256 if leaf else 0) | label

    units[0] = unit(1, 0, False)
    a = 1 ^ ord("a")
    units[a] = unit(a ^ 300, ord("a"), True)
    units[300] = (1 << 31) | 0
    b = 300 ^ ord("b")
    units[b] = unit(b ^ 400, ord("b"), True)
    units[400] = (1 << 31) | 2
    chars = pieces.CharacterMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + values)
    assert chars.longest(b"abc", 0) == (2, b"YZ")
    assert chars.longest(b"ac", 0) == (1, b"X")
    assert chars.longest(b"cab", 0) is None


# Nearest codes


@pytest.mark.parametrize("segments", [None, 5, 16])
def test_nearest_codes_like_all_pairs(spark, segments):
    rng = random.Random(9)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(150)]
    codes += [codes[0]] * 30 + [codes[k] ^ (1 << rng.randrange(63)) for k in range(40)]
    rows = list(enumerate(codes))
    table = spark.createDataFrame([*rows, (None, 5), (900, None), rows[3]], "id bigint, code bigint").withColumn("segment", F.lit(1))
    got = defaultdict(dict)
    for r in hamming.nearest_codes(table, table.where("id % 20 = 0"), 7, segments).collect():
        got[r.query_id][r["rank"]] = (r.distance, r.id)
    for q in range(0, len(rows), 20):
        want = sorted(((codes[q] ^ c) & ((1 << 64) - 1), i) for i, c in rows)
        want = sorted((x.bit_count(), i) for x, i in want)[:7]
        assert [got[q][k + 1] for k in range(7)] == want
    assert set(got) == set(range(0, len(rows), 20))


def test_fewer_rows_than_wanted_and_sign_codes(spark):
    vectors = [(1, [0.5] * 64), (2, [-1.0] * 64), (3, [0.0] * 63 + [1.0]), (4, None), (5, [1.0]), (6, [None] * 64)]
    table = spark.createDataFrame(vectors, "id bigint, v array<double>").select("id", hamming.sign_code(F.col("v")).alias("code"))
    assert {r.id: r.code for r in table.collect()} == {1: -1, 2: 0, 3: -(1 << 63), 4: None, 5: None, 6: 0}
    got = [(r["rank"], r.id, r.distance) for r in hamming.nearest_codes(table, table.where("id = 3"), 10).orderBy("rank").collect()]
    assert got == [(1, 3, 0), (2, 2, 1), (3, 6, 1), (4, 1, 63)]


# Classifiers


def test_trees_learn_and_score_every_text(spark):
    rng = random.Random(1)
    good = ["".join(rng.choice(["the ", "cat ", "sat. ", "on ", "mats "]) for _ in range(40)) for _ in range(150)]
    bad = ["".join(rng.choice(["BUY!! ", "NOW!! ", "%%% ", "$$$ "]) for _ in range(40)) for _ in range(150)]
    rows = list(enumerate(good + bad))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in rows] + [(None, 1, 0), (5000, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [*rows, (901, None), (902, ""), (None, "the cat")], CLASHES)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()}
    assert len(scores) == len(rows) + 3 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.5) == (i < 150) for i, _ in rows)
    assert scores[901] == scores[902]


def test_tree_margins_follow_single_paths():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(500, 4))
    trees = quality.Trees.fit(rows, (rows[:, 0] * rows[:, 1] > 0).astype(float), trees=30, depth=3)
    want = []
    for row in rows:
        total = trees.start
        for feature, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > above[node] else 1)
            total += leaf[node - len(feature)]
        want.append(total)
    assert np.allclose(trees.margins(rows), want)
    assert np.mean((trees.scores(rows) > 0.5) == (rows[:, 0] * rows[:, 1] > 0)) > 0.95


def test_groups_are_named_in_all_languages_of_the_corpus():
    assert toxicity.swapped("Die Juden, jüdischen") == "Die buddhisten, jüdischen"
    assert toxicity.swapped("les musulmans étrangers") == "les chrétiens autochtones"
    assert toxicity.swapped("Las mujeres, católico") == "Las hombres, musulmán"
    words = [w for row in toxicity.GROUPS for w in row]
    assert len(words) == len(set(words))


def test_features_are_words_and_their_beginnings():
    texts = ["The theory, THE the_x é1é日本 ab", None, "", "abcdefghij abcdefgh " + "q" * 300, "x y z"]
    text, key = toxicity.text_features(pa.array(texts))
    found = {}
    for i, t in enumerate(texts):
        words = [w.encode() for w in ALNUM.findall(lowered(t))]
        features = {(0, w) for w in words} | {(n, w[:n]) for w in words for n in toxicity.BEGINNINGS if len(w) >= n}
        mine = set(key[text == i].tolist())
        assert len(mine) == len(features) == (text == i).sum()
        for f in features:  # the same feature has the same hash in every text
            found.setdefault(f, set()).add(i)
    for f, where in found.items():
        if f[0] == 0:
            own = set.intersection(*[set(key[text == i].tolist()) for i in where])
            assert own
    wanted = np.unique(key)[::3]
    text2, at = toxicity.text_features(pa.array(texts), wanted)
    assert [(i, wanted[k]) for i, k in zip(text2, at.astype(int), strict=True)] == [(i, k) for i, k in zip(text, key, strict=True) if k in set(wanted.tolist())]


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    n, width = 12, 9
    has = rng.random((n, width)) < 0.4
    text, feature = np.nonzero(has)
    labels, importance = (rng.random(n) < 0.4).astype(float), rng.random(n) + 0.5
    pairs = (np.array([0, 0, 1, 2, 2]), np.array([1, 2, 3, 1, 8]), np.array([1, -1, 1, 1, -1]))
    weights, intercept = rng.normal(size=width), 0.3
    args = (text, feature, labels, importance, pairs, 5.0, 0.01)
    loss, gradient = toxicity.loss_and_gradient(weights, intercept, *args)
    margin = has @ weights + intercept
    plain = (importance * (np.log1p(np.exp(margin)) - labels * margin)).sum() / importance.sum() + 0.005 * (weights**2).sum()
    plain += 5 / 3 * ((weights[1] - weights[2]) ** 2 + weights[3] ** 2 + (weights[1] - weights[8]) ** 2)
    assert loss == pytest.approx(plain)
    for k in range(width + 1):
        step = np.zeros(width + 1)
        step[k] = 1e-6
        up, _ = toxicity.loss_and_gradient(weights + step[:-1], intercept + step[-1], *args)
        assert (up - loss) / 1e-6 == pytest.approx(gradient[k], abs=1e-4)


def test_every_training_text_gets_a_counterfactual():
    """Pairs hold just what their sides do not share, and a mention can be of every group."""
    texts = ["a muslim house", "plain words here", "manly blackbird", "", None, "Frauen und Katzen"]
    wanted = np.unique(np.concatenate([toxicity.text_features(pa.array([t or "" for t in texts]))[1], toxicity.group_features()]))
    lists = [c.to_pylist() for c in toxicity.encoded_rows(pa.array(texts), wanted)]
    for i, t in enumerate(texts):
        made = toxicity.counterfactuals(t or "")
        for k in range(2):
            one, two = (set(toxicity.text_features(pa.array([s]), wanted)[1].astype(int).tolist()) for s in made[k]) if k < len(made) else (set(), set())
            assert (set(lists[1 + 2 * k][i]), set(lists[2 + 2 * k][i])) == (one - two, two - one)
    named = {toxicity.counterfactuals(f"text {k}")[0][0].split()[-1] for k in range(6000)}
    assert named == set(toxicity._NEXT)


def test_inserted_mentions_move_no_score(spark):
    """No training text names a group, yet a word that begins like a group's name does not pull it up."""
    rng = random.Random(3)
    filler = [f"word{k}" for k in range(30)]
    rows = [(i, " ".join([*rng.choices(filler, k=8), "blackguard" if i % 3 == 0 else "tea"])) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    probes = [(1000, "word1 tea black"), (1001, "word1 tea white"), (1002, "word1 tea"), (1003, "blackguard word1")]
    docs = frame(spark, rows + probes)
    model = toxicity.train_toxicity(docs, labels)
    assert model.n_pairs >= 400
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[1003] > 0.5 and max(got[1000], got[1001], got[1002]) < 0.3 and abs(got[1000] - got[1001]) < 0.1


def test_mentions_of_groups_do_not_make_a_text_toxic(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(40)]

    def text(*more):
        own = [rng.choice(words) for _ in range(12)] + list(more)
        rng.shuffle(own)
        return " ".join(own)

    # In the labels one group is named mostly in toxic texts.
    toxic = [text("idiot", "muslim" if k % 2 else "scum") for k in range(120)]
    other = [text("christian" if k % 3 else "tea") for k in range(240)]
    rows = list(enumerate(toxic + other))
    labels = spark.createDataFrame([(i, 1, int(i < 120)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    probes = [(2000, "a muslim word1 word2"), (2001, "a christian word1 word2"), (2002, "Idiot! word1"), (2003, None), (2004, "")]
    docs = frame(spark, rows + probes, CLASHES)
    model = toxicity.train_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert got[2000] < 0.5 and abs(got[2000] - got[2001]) < 0.05
    assert got[2002] > 0.5 and got[2003] == got[2004] < 0.5
    assert all((got[i] >= 0.5) == (i < 120) for i, _ in rows)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    assert toxicity.swapped("Gay men, gayest!") == "lesbian girls, gayest!"


def test_languages(spark):
    rng = random.Random(8)
    stems = {"en": "the and ing of that with".split(), "de": "der und schaft für nicht öl".split()}
    rows = [(i, " ".join(rng.choice(stems[("en", "de")[i % 2]]) for _ in range(30))) for i in range(120)]
    docs = frame(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    model = language.train_languages(docs, piece_model())
    assert model.names == ["de", "en"] and np.allclose(model.chances.sum(axis=0), 1)
    probes = frame(spark, [*rows, (500, None), (501, ""), (502, "12 ,.!"), (503, "für nicht " * 2000), (None, "the"), (504, "日本")], CLASHES)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(probes, model).collect()}
    assert all(got[i][0] == ("en", "de")[i % 2] for i, _ in rows)
    assert {got[k] for k in (500, 501, 502)} == {("und", 0.0)}
    assert got[503][0] == "de" and got[None][0] == "en" and got[504][0] in ("de", "en")
    assert all(0 <= s <= 1 for _, s in got.values())


def test_forward_sums_all_segmentations():
    rng = random.Random(1)
    vocabulary = sorted({"".join(rng.choice("ab▁cé") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    table = language.PieceTable(vocabulary)
    chances = np.vstack([np.random.default_rng(0).random((len(vocabulary), 2)) / 50, np.zeros(2)])
    texts = ["".join(rng.choice("ab▁céz") for _ in range(rng.randint(1, 9))) for _ in range(100)]

    def brute(s, k):
        if not s:
            return 1.0
        whole = language.UNKNOWN * brute(s[1:], k)
        return whole + sum(chances[vocabulary.index(s[:n]), k] * brute(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in vocabulary)

    got = language.log_chances(table, texts, chances)
    assert np.allclose(got, [[np.log(brute(s, k)) for k in (0, 1)] for s in texts])
    counts = np.arange(len(texts)) + 1.0
    expected = language.expected_pieces(table, texts, counts, chances[:, [0]])
    for piece in range(0, len(vocabulary), 7):  # expected uses are the derivative by the log of a chance
        other = chances.copy()
        other[piece, 0] *= 1 + 1e-6
        slope = ((language.log_chances(table, texts, other)[:, 0] - got[:, 0]) * counts).sum() / 1e-6
        assert slope == pytest.approx(expected[piece], abs=1e-2 * max(1, abs(slope)))


def test_long_runs_are_summed_whole(monkeypatch):
    """A run beyond the batch length has the sums of the plain recursion, across every border."""
    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("ab▁cé") for _ in range(rng.randint(1, 5))) for _ in range(80)})
    table = language.PieceTable(vocabulary)
    chances = np.vstack([np.random.default_rng(0).random((len(vocabulary), 2)) / 50, np.zeros(2)])
    monkeypatch.setattr(language, "STRIP", 37)
    texts = ["▁" + "".join(rng.choice("ab▁céz") for _ in range(n)) for n in (20, 36, 37, 38, 150, 4000)]
    got = language.log_chances(table, texts, chances)
    for text, found in zip(texts, got, strict=True):
        for k in (0, 1):
            sums, log = [1.0], 0.0
            for j in range(1, len(text) + 1):
                new = sums[-1] * language.UNKNOWN
                new += sum(sums[-n] * chances[vocabulary.index(text[j - n : j]), k] for n in range(1, min(len(sums), 5) + 1) if text[j - n : j] in vocabulary)
                sums.append(new)
                if j % 10 == 0:
                    log += np.log(new)
                    sums = [x / new for x in sums[-5:]]
            assert found[k] == pytest.approx(log + np.log(sums[-1]))


# The pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]

    def text(n=40):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(12)
    rows = [(i, text() + "\nshared footer\n" + text(6)) for i in range(60)]
    rows += [(100 + i, text() + " scum idiot " + text(5)) for i in range(40)]
    rows += [(200, rows[3][1] + " tail"), (201, rows[4][1]), (202, text(5) + " " + passage.upper() + " " + text(5)), (203, None), (204, "")]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(60), 203, 204}
    assert all("shared footer" not in r.decoded for r in out.values())
    assert out[5].decoded == rows[5][1].replace("shared footer\n", "") and out[203].ids == [] == out[204].ids
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.schema == docs.schema, name


def test_digest_columns(spark, tmp_path):
    from contigframe.llm.queries import REGISTRY

    frame(spark, [(1, "a  b"), (2, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in REGISTRY["op1_substring_dedup"].run(spark, str(tmp_path)).collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(b"a b").hexdigest() and rows[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert Counter(name.split("_")[0] for name in REGISTRY) == Counter(f"op{k}" for k in range(1, 14))
