"""Golden values and brute-force checks of sequence functions and row generators."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from contigframe.functions import dna, frames
from contigframe.functions.constants import CODONS
from contigframe.operators import validate
from contigframe.operators import windows as W
from contigframe.operators.datasets import coverage_sampling, random_tiling


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def seqs(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, seq string")


def random_sequences(n=12, longest=9000, letters="ACGTN"):
    rng = random.Random(5)
    return [
        (i, "".join(rng.choice(letters) for _ in range(rng.randint(1, longest))))
        for i in range(n)
    ]


@pytest.mark.parametrize(
    "length, size, stride, dynamic, threshold, expected",
    [
        (3400, 2000, 2000, False, 10.0, [0]),
        (3400, 2000, 2000, True, 2.0, [0, 1400]),
        (4000, 2000, None, True, 10.0, [0, 2000]),
        (3999, 2000, None, True, 10.0, [0, 1999]),
        (6000, 2000, None, True, 10.0, [0, 2000, 4000]),
    ],
)
def test_window_starts(spark, length, size, stride, dynamic, threshold, expected):
    starts = W.window_starts(F.lit(length), size, stride, dynamic, threshold)
    assert one(spark, starts)[0] == expected


def test_dynamic_windows(spark):
    rows = seqs(spark, [(1, "A" * 3400), (2, "C" * 2000)])
    got = W.make_windows(rows, 2000, 2000, dynamic=True, threshold=2.0).collect()
    assert sorted((r.seq_id, r.start, r.is_last) for r in got) == [
        (1, 0, False), (1, 1400, True), (2, 0, True),
    ]


def test_length_passes(spark):
    rows = seqs(spark, [(1, "A" * 3000), (2, "C" * 1500), (3, "G" * 900)])
    long = W.make_windows(rows, 2000, 2000).collect()
    assert {r.seq_id for r in long} == {1}
    short = W.make_windows(rows, 2000, 2000, min_len=1000, max_len=1999).collect()
    assert [(r.seq_id, r.start, r.is_last, r.seq_len) for r in short] == [(2, 0, True, 1500)]


@pytest.mark.parametrize("size, stride", [(200, 150), (50, 7), (1000, 1000), (5000, 300)])
def test_windows_against_slices(spark, size, stride):
    rows = random_sequences()
    expected = {}
    for i, s in rows:
        starts = list(range(0, len(s) - size + 1, stride)) or ([0] if len(s) >= 60 else [])
        for n, b in enumerate(starts):
            w = s[b : b + size]
            expected[i, n] = (b, w, w.count("G"), w.count("T"), n == len(starts) - 1)
    got = W.make_windows(seqs(spark, rows), size, stride, min_len=60, mask=False).collect()
    assert {
        (r.seq_id, r.window_idx): (r.start, r.window, r.g, r.t, r.is_last) for r in got
    } == expected


def test_small_blocks_give_the_same_pieces(spark):
    rows = random_sequences(6, 3000)
    df = seqs(spark, rows)
    for block in (64, 100, 4096):
        got = W.blocks(df, "seq", 250, block).collect()
        for r in got:
            whole = dict(rows)[r.seq_id]
            assert r.block == whole[r.block_start : r.block_start + block + 250]


@pytest.mark.parametrize(
    "length, size, stride, expected",
    [(10, 20, 5, [0]), (100, 20, 0, [0]), (60, 20, 20, [0, 20, 40]), (55, 20, 20, [0, 20, 35])],
)
def test_crop_starts(spark, length, size, stride, expected):
    assert one(spark, W.crop_starts(F.lit(length), size, stride))[0] == expected


def test_multi_crops(spark):
    got = W.multi_crops(seqs(spark, [(1, "A" * 25)]), [20, 10], [10, 10]).collect()
    assert sorted((-r.crop_size, r.start, r.crop_len) for r in got) == [
        (-20, 0, 20), (-20, 5, 20), (-10, 0, 10), (-10, 10, 10), (-10, 15, 10),
    ]
    assert W.crop_strides([100, 10], overlap=0.5) == [50, 5]


def test_fragments_reach_the_end(spark):
    rows = random_sequences()
    got = W.fragments_tail_aligned(
        seqs(spark, rows).withColumn("label", F.lit(1)), 300, 100
    ).collect()
    for i, s in rows:
        mine = sorted((r.frag_idx, r.start, r.fragment) for r in got if r.seq_id == i)
        if len(s) < 300:
            assert not mine
            continue
        assert mine[-1][1] + 300 == len(s)
        assert all(s[b : b + 300] == f for _, b, f in mine)
        assert all(b - a == 200 for (_, a, _), (_, b, _) in zip(mine[:-2], mine[1:-1]))


def test_prefix_crop(spark):
    rows = seqs(spark, [(1, "A" * 600), (2, "C" * 300)])
    got = W.prefix_crop(rows, [300, 600]).collect()
    assert sorted((r.seq_id, len(r.seq)) for r in got) == [(1, 300), (1, 600), (2, 300)]


def test_complements(spark):
    row = one(
        spark,
        dna.reverse_complement(F.lit("ATGC")), dna.reverse_complement(F.lit("N")),
        dna.reverse_complement(F.lit("RYKMBVDHWSN-acgtx")), dna.complement_strict(F.lit("acRG")),
    )
    assert list(row) == ["GCAT", "N", "NACGT-NSWDHBVKMRY", "tgNC"]


def test_composition(spark):
    row = one(
        spark, dna.gc_content(F.lit("GC")), dna.gc_content(F.lit("AT")),
        dna.n_fraction(F.lit("ACGTNN")), dna.gc_skew(F.lit("GGGCTT")), dna.gc_content(F.lit("")),
        dna.shannon_entropy(F.lit("AAAA")), dna.shannon_entropy(F.lit("ACGT")),
        dna.shannon_entropy(F.lit("AACG")),
    )
    assert list(row) == pytest.approx([1.0, 0.0, 1 / 3, 0.5, 0.0, 0.0, 2.0, 1.5])


def test_soft_masked_bases_do_not_count(spark):
    counts = dna.base_counts(F.lit("GGggCCaT"))
    assert list(one(spark, *counts.values())) == [2, 2, 0, 1]


def brute_frames(s):
    ids = {c: n + 1 for n, c in enumerate(CODONS)}
    n = len(s) // 3
    n = max(0, n - 2 if len(s) % 3 == 0 else n - 1)
    back = s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]
    return [
        [ids.get(t[o + 3 * i : o + 3 * i + 3], 0) for i in range(n)]
        for t in (s, back)
        for o in range(3)
    ]


def test_codon_frames(spark):
    rows = random_sequences(40, 60)
    got = seqs(spark, rows).select("seq", frames.codon_frames("seq").alias("f")).collect()
    assert all(r.f == brute_frames(r.seq) for r in got)
    pairs = one(spark, frames.dicodon_frames(frames.codon_frames(F.lit("TTTTTCTTATTGACG"))))[0]
    assert pairs[0] == [0 * 64 + 1 + 1, 1 * 64 + 2 + 1]


def test_lower_case_codons_are_unknown(spark):
    assert one(spark, frames.codon_frames(F.lit("TTTaTTTTT")))[0][0] == [1]


def test_tokens(spark):
    row = one(
        spark, frames.nucleotide_tokens(F.lit("ATGC")),
        frames.nucleotide_tokens(F.lit("ATGC"), reverse=True),
        frames.protein_tokens(F.lit("FG*x")), frames.strong_weak_tokens(F.lit("ACGTN")),
    )
    assert row[0] == [[1, 3, 2, 4], [3, 1, 4, 2]]
    assert row[1] == [[1, 3, 2, 4], [2, 4, 1, 3]]
    assert row[2] == [1, 20, 0, 0]
    assert row[3] == [0, 1, 1, 0, -1]


def test_one_hot_round_trip(spark):
    tokens = F.array(*[F.lit(x) for x in (0, 1, 2, 3)])
    cells = frames.tokens_to_one_hot(tokens, 3)
    assert one(spark, cells)[0] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0]]
    assert one(spark, frames.one_hot_to_tokens(cells, 3))[0] == [0, 1, 2, 3]
    assert one(spark, frames.one_hot(tokens, 4))[0][0] == [0, 0, 0, 0]
    assert frames.narrow_type(65) == "tinyint" and frames.narrow_type(4097) == "smallint"


def test_crop_units():
    assert dna.resolve_crop(10, "codon") == {"codons": 10, "nucleotides": 35}
    assert dna.resolve_crop(500, "nucleotide")["codons"] == 165
    for bad in ((0, "codon"), (-3, "codon"), (4, "nucleotide"), (5, "furlong")):
        with pytest.raises(ValueError):
            dna.resolve_crop(*bad)


def brute_mask(s, window, limit):
    """Every interval and every interval inside it."""
    t = [s[i : i + 3] for i in range(len(s) - 2)]
    score = {}
    for i in range(len(t)):
        pairs, seen = 0, {}
        for n in range(1, min(window - 2, len(t) - i) + 1):
            pairs += seen.get(t[i + n - 1], 0)
            seen[t[i + n - 1]] = seen.get(t[i + n - 1], 0) + 1
            if n > 1:
                score[i, n] = 10 * pairs / (n - 1)
    hit = [False] * len(s)
    for (i, n), value in score.items():
        if value > limit and all(score[j, k] <= value for k in range(2, n) for j in range(i, i + n - k + 1)):
            hit[i : i + n + 2] = [True] * (n + 2)
    return "".join(c.lower() if h else c for c, h in zip(s, hit))


@pytest.mark.parametrize("strip", [1 << 16, 50])
def test_intervals_of_maximal_score_are_masked(monkeypatch, strip):
    monkeypatch.setattr(dna, "STRIP", strip)
    rng = random.Random(strip)
    for window, limit in ((64, 20), (16, 12), (24, 8)):
        for _ in range(6):
            parts = [rng.choice(["A", "AC", "ACG", "ACGT"]) * rng.randint(1, 14) + "".join(rng.choices("ACGTN", k=rng.randint(0, 30))) for _ in range(3)]
            text = "".join(parts)
            assert dna._masked(text, window, limit) == brute_mask(text, window, limit)
    assert [dna._masked(x, 64, 20) for x in ("", "AAA", None, "é" * 40)] == ["", "AAA", None, "é" * 40]


def test_windows_are_masked_unless_told_otherwise(spark):
    rng = random.Random(8)
    plain, low = "".join(rng.choices("ACGT", k=400)), "A" * 200
    rows = seqs(spark, [(1, plain), (2, plain[:200] + low)])
    for mask in (True, False):
        got = {(r.seq_id, r.start): r for r in W.make_windows(rows, 100, 100, mask=mask).collect()}
        assert got[1, 0].window == plain[:100] and got[1, 0].a == plain[:100].count("A")
        assert got[2, 0].window == plain[:100] and got[2, 300].window == ("a" if mask else "A") * 100
        assert got[2, 300].a == (0 if mask else 100)


def test_low_complexity_mask(spark):
    rng = random.Random(1)
    rows = []
    for i in range(10):
        parts = [
            "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 200))),
            rng.choice(["A", "AT", "ACG"]) * rng.randint(20, 90),
            "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 200))),
        ]
        rows.append((i, "".join(parts)))
    got = seqs(spark, rows).select("seq", dna.low_complexity_mask("seq").alias("m")).collect()
    assert all(r.m.upper() == r.seq for r in got)
    # The repeat in the middle is masked, and little besides.
    assert all(20 <= sum(c.islower() for c in r.m) <= 300 for r in got if re.search(r"A{30}|(AT){20}|(ACG){20}", r.seq))


def test_validation(spark):
    rows = spark.createDataFrame(
        [("a", "ACGTN"), ("", "AC"), ("b", ""), ("c", "AXCZX")], "seq_id string, seq string"
    )
    got = {r.seq_id: (r.is_valid, r.error) for r in validate.validate_sequences(rows).collect()}
    assert got["a"] == (True, None)
    assert got[""] == (False, "empty header")
    assert got["b"] == (False, "empty sequence")
    assert got["c"] == (False, "invalid characters: XZ")
    assert validate.assert_min_length(rows, 5) == 2
    with pytest.raises(ValueError):
        validate.assert_min_length(rows, 50)


def test_random_tiling_walks_on(spark):
    rows = random_sequences(8, 4000, "ACGT")
    got = random_tiling(seqs(spark, rows), 100, 300, 40, 1.0, seed=2).collect()
    again = random_tiling(seqs(spark, rows).repartition(3), 100, 300, 40, 1.0, seed=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for i, s in rows:
        mine = sorted((r.frag_idx, r.start, r.length, r.fragment) for r in got if r.seq_id == i)
        assert all(s[b : b + n] == f for _, b, n, f in mine)
        assert all(a + n - 40 == b for (k, a, n, _), (m, b, _, _) in zip(mine, mine[1:])
                   if m == k + 1)
        assert all(100 <= n <= 300 for _, _, n, _ in mine)
    with pytest.raises(ValueError):
        random_tiling(seqs(spark, rows), 100, 300, 100)


@pytest.mark.parametrize("circular", [False, True])
def test_coverage_is_reached_once(spark, circular):
    rows = [r for r in random_sequences(8, 4000, "ACGT") if len(r[1]) >= 100]
    got = coverage_sampling(seqs(spark, rows), 50, 100, 2.0, circular, 1.0, seed=3).collect()
    for i, s in rows:
        mine = sorted((r.draw, r.start, r.length, r.fragment) for r in got if r.seq_id == i)
        total = sum(n for _, _, n, _ in mine)
        assert total >= 2 * len(s) > total - mine[-1][2]
        assert all((s + s)[b : b + n] == f for _, b, n, f in mine)
        assert circular or all(b + n <= len(s) for _, b, n, _ in mine)


def test_rounded_skew_is_half_even(spark):
    got = one(spark, dna.rounded_skew(F.lit(9), F.lit(7)), dna.rounded_skew(F.lit(0), F.lit(0)))
    assert math.isclose(got[0], 0.12) and got[1] == 0.0


def test_one_hot_cells_of_batches(spark):
    """Batches, constants and the plain expression agree, for odd tokens, nulls and empty rows too."""
    rows = [(1, [0, 1, 4, 9, -3, None, 3]), (2, []), (3, None), (4, [2])]
    df = spark.createDataFrame(rows, "id int, t array<int>")

    def plain(t, depth, skip):
        return [int(t is not None and 0 < t < depth and i == t - skip) for i in range(depth)]

    for depth, skip in ((5, True), (4, False), (200, True)):
        made = [frames.one_hot(F.col("t"), depth, skip, batches=b).alias(n) for b, n in ((False, "a"), (True, "b"))]
        for r in df.select("t", *made).collect():
            assert r.a == r.b == (None if r.t is None else [plain(t, depth, skip) for t in r.t])
    cells = spark.createDataFrame([([[0, 1, 1], [], None, [0, None, 0], [1]],), (None,), ([],)], "c array<array<int>>")
    got = cells.select(*[frames.one_hot_to_tokens(F.col("c"), 3, batches=b).alias(n) for n, b in (("t", True), ("u", False))], frames.first_cells(F.col("c"), 2).alias("f")).collect()
    assert [r.t for r in got] == [r.u for r in got] == [[1, 3, 3, 3, 0], None, []]
    assert [r.f for r in got] == [[[0, 1], [], None, [0, None], [1]], None, []]


def test_text_of_number_lists(spark):
    one_level = [[1, 2], [0], [], None, [12, -3], [None, 5], [None]]
    two_levels = [[[1, 2], [3]], [[4]], None, [], [[], [1]], [None, [1, None]], [[10], [-1, 2]], [[7, 7, 7]]]
    for rows, kind, by in ((one_level, "array<int>", (",",)), (two_levels, "array<array<bigint>>", (",", "|"))):
        for some in (rows, rows[:2], rows[:3]):
            df = spark.createDataFrame([(i, r) for i, r in enumerate(some)], f"i int, c {kind}").coalesce(1)
            text = F.array_join(F.col("c").cast("array<string>"), ",") if len(by) == 1 else F.array_join(
                F.transform(F.col("c").cast("array<array<string>>"), lambda x: F.array_join(x, ",")), "|")
            got = df.select(text.alias("want"), frames.numbers_text(F.col("c"), *by).alias("got")).collect()
            assert [r.got for r in got] == [r.want for r in got]


def test_one_hot_text_stays_in_one_worker(spark, tmp_path):
    """From the crop to the text of its cells, no list of cells goes through the JVM."""
    from contigframe.catalog import REGISTRY

    docs = [(1, "Some words, and more of them. " * 9, "en", "x", 270)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = REGISTRY["one_hot_bases"].run(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and found.count() == 3
