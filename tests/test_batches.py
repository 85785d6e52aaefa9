"""Token arrays and altered copies made for all texts of an Arrow batch together."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from contigframe.functions import frames, picks
from contigframe.functions.constants import BASE_TOKENS, CODONS
from contigframe.operators import changes, datasets, perturb, refine, scoring, taxonomy
from contigframe.sources.encoded import union_padded
from pyspark.sql import functions as F


def texts(n=60, longest=40, letters="ACGTNacR"):
    rng = random.Random(3)
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return [(i, s) for i, s in enumerate([*made, "", "A", "AC", None, "ACGéTTA", "A€CGTACGT"])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, seq string")


def python_nodes(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


@pytest.mark.parametrize("part", [1, 7, 1 << 21])
def test_parts_of_a_batch(part, monkeypatch):
    monkeypatch.setattr(frames, "PART", part)
    rows = [s for _, s in texts()]
    found, begin = [], 0
    for place, codes, sizes in frames.letter_parts(pa.array(rows, pa.string())):
        assert place.start == begin and (len(codes) <= part or place.stop - place.start == 1)
        begin, at = place.stop, 0
        for n in sizes:
            found.append("".join(map(chr, codes[at : at + n])))
            at += n
    assert found == [s or "" for s in rows]


def test_token_arrays_in_batches(spark):
    """Work on all letters of a batch at once, with the same tokens as letter by letter."""
    df = frame(spark, texts())
    made = df.select(
        "seq", frames.codon_frames("seq").alias("f"), frames.dicodon_frames(frames.codon_frames("seq")).alias("d"),
        frames.pad_frames(frames.codon_frames("seq"), 4, 9).alias("p"), frames.letter_tokens("seq", BASE_TOKENS).alias("t"),
        frames.nucleotide_tokens("seq").alias("n"), frames.nucleotide_tokens("seq", reverse=True).alias("r"),
        frames.strong_weak_tokens("seq").alias("w"),
    )
    assert python_nodes(made) > 0
    ids, pairs = {c: n + 1 for n, c in enumerate(CODONS)}, dict(zip("ACGTacgtRN", "TGCATGCAYN", strict=True))
    for s, f, d, p, t, n, r, w in made.collect():
        if s is None:
            assert f == p == [None] * 6 and d == [[]] * 6 and t is None and w is None and n == r == [None, None]
            continue
        other = [pairs.get(x, "N") for x in s]
        size = max(0, len(s) // 3 - (2 if len(s) % 3 == 0 else 1))
        strands = (s, "".join(other)[::-1])
        assert f == [[ids.get(x[o + 3 * i : o + 3 * i + 3], 0) for i in range(size)] for x in strands for o in range(3)]
        assert d == [[(a - 1) * 64 + b if a and b else 0 for a, b in zip(x, x[1:])] for x in f]
        assert p == [(x + [9] * 4)[:4] for x in f]
        assert t == [BASE_TOKENS.get(x, 0) for x in s]
        assert n == [t, [BASE_TOKENS.get(x, 0) for x in other]] and r == [t, n[1][::-1]]
        assert w == [{"A": 0, "T": 0, "G": 1, "C": 1}.get(x, -1) for x in s]


def test_changed_bases_in_batches(spark):
    df = frame(spark, texts()).withColumn("h", picks.row_hash("seq_id", seed=4))
    made = df.select("seq", "h", perturb.augment("seq", F.col("h"), 0.3).alias("out"))
    assert python_nodes(made) > 0

    def at(h, i):
        x = (h + i * 2654435761) % 2**32
        for _ in range(2):
            x = (x * 1664525 + 1013904223) % 2**32
            x ^= x >> 15
        return x

    for s, h, out in made.collect():
        want = s and "".join("ATGC"[at(h, i + 2**24) % 4] if at(h, i + 1) / 2**32 < 0.3 else c for i, c in enumerate(s))
        assert out == want


def test_limits_are_copied_to_the_windows(spark):
    """The windows of a class in no single task: the class list goes to them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = F.when(F.col("id") % 50 == 0, "phage").otherwise("virus")
        df = spark.range(1000).select(names.alias("top_class"), F.lit("archaea").alias("second_class"), (F.col("id") / 100).alias("top_score"), F.lit(1.0).alias("margin"))
        taus = spark.createDataFrame([("phage", 0.0, 0.5), ("virus", 5.0, 0.5)], "class string, tau_logit double, tau_margin double")
        out = refine.refine_windows(df, taus)
        assert "Exchange hashpartitioning(top_class" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r["refined"]: r["count"] for r in out.groupBy("refined").count().collect()} == {"phage": 20, "virus": 490, "unknown": 490}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_are_not_copied_to_their_ranks(spark):
    df = frame(spark, [(i, "ACGT" * 20) for i in range(50)])
    plan = datasets.hash_rank(df, [], "seq_id", 1)._jdf.queryExecution().executedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "SortMergeJoin" in top


def test_tokens_of_a_padded_union_are_made_once(spark):
    parts = [frame(spark, [(i, "ACGT" * (i + 1))]).select("seq_id", frames.letter_tokens("seq", BASE_TOKENS).alias("t")) for i in range(3)]
    out = union_padded(parts, "t")
    assert python_nodes(out) == 0
    assert {r.seq_id: (r.length, len(r.t)) for r in out.collect()} == {0: (4, 12), 1: (8, 12), 2: (12, 12)}


def at_hash(h, i):
    x = (h + i * 2654435761) % 2**32
    for _ in range(2):
        x = (x * 1664525 + 1013904223) % 2**32
        x ^= x >> 15
    return x


def test_kmers_are_counted_in_the_windows(spark):
    """A row for each distinct k-mer, not for each place; equal for short and long k-mers."""
    df = frame(spark, texts())
    for k in (1, 2, 12, 20):
        for s, found in df.select("seq", scoring.kmer_counts("seq", k)).collect():
            mers = Counter(s[i : i + k] for i in range(len(s or "") - k + 1) if set(s[i : i + k]) <= set("ACGT"))
            assert {m: n for m, n in found} == {**mers, "": sum(mers.values())}
            assert len(found) == len(mers) + 1


def test_profile_scores_of_repeated_and_null_keys(spark):
    rows = frame(spark, [(1, "ACAC"), (1, "AC"), (2, "NNN"), (None, "ACAC"), (3, None)]).withColumnRenamed("seq", "window")
    train = spark.createDataFrame([("x", "ACAC"), ("y", "GG")], "label string, window string")
    profile = scoring.fit_kmer_profile(train, 2)
    got = sorted(map(tuple, scoring.score_kmer_profile(rows, profile, 2, ["seq_id"]).collect()), key=str)
    x, y = (3 * math.log(3 / 19) + math.log(2 / 19)) / 4, math.log(1 / 17)
    want = {(1, "x"): [x, x], (1, "y"): [y, y], (2, "x"): [None], (2, "y"): [None], (3, "x"): [None], (3, "y"): [None], (None, "x"): [None], (None, "y"): [None]}
    found = {}
    for key, label, score in got:
        found.setdefault((key, label), []).append(score)
    assert found.keys() == want.keys()
    assert all(found[k] == (pytest.approx(v) if v[0] is not None else v) for k, v in want.items())


def test_tracks_take_steps_together():
    """Cuts and candidates of each track are those of the track alone, whatever is beside it."""
    rng = np.random.default_rng(2)
    tracks = [np.round(rng.normal(size=n) + rng.integers(0, 3), 3) for n in (1, 2, 3, 5, 64, 65, 200)]
    levels = np.array([0.5, 1, 3, 0.5, 1, 3, 0.5])
    states = [changes._first(p) for p in levels]
    together = changes.advance(tracks, np.zeros(7, int), states, levels, 3)
    for n, (back, state) in enumerate(together):
        (alone, left), = changes.advance(tracks[n : n + 1], np.zeros(1, int), states[n : n + 1], levels[n : n + 1], 3)
        assert (back == alone).all() and all((a == b).all() for a, b in zip(state, left, strict=True))
        best = [-levels[n]]
        for t in range(1, len(tracks[n]) + 1):
            costs = [best[s] + ((tracks[n][s:t] - tracks[n][s:t].mean()) ** 2).sum() + levels[n] for s in range(t - 2)]
            best.append(min(costs, default=math.inf))
            if costs:
                assert costs[int(back[t - 1])] == pytest.approx(best[t])


def test_votes_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(taxonomy, "VOTES", 4)
    nodes = spark.createDataFrame([(i, max(i // 2, 1)) for i in range(1, 32)], "taxid int, parent int")
    closure = taxonomy.ancestors(nodes)
    hits = spark.createDataFrame([(i % 5, 16 + i % 16) for i in range(200)], "k int, taxid int")
    out = taxonomy.majority_lca(hits, closure, "k", 0.4)
    # 5 keys of 16 taxa, lineages of 5.
    assert "RepartitionByExpression [k#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ", 100" in plan
    votes = Counter((i % 5, (16 + i % 16) >> up) for i in range(200) for up in range(5))
    for key, lca, n in out.collect():
        kept = [t for (k, t), v in votes.items() if k == key and v > 40 * 0.4]
        assert n == 40 and lca == max(kept, key=lambda t: (t.bit_length(), votes[key, t], -t))


def test_stretches_and_points_by_hash(spark):
    rows = [(i, ("ACGT" * 60)[: 5 + 9 * i]) for i in range(20)] + [(90, ""), (91, None), (92, "NNNN")]
    df = frame(spark, rows).withColumn("h", picks.row_hash("seq_id", seed=4))
    made = df.select("seq", "h", perturb.n_stretch("seq", F.col("h"), 0.4, 0.4, 1, 0.5).alias("out"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_join" not in plan
    for s, h, out in made.collect():
        if not s or set(s) == {"N"}:
            assert out == s
            continue
        n, total = len(s), max(1, round(len(s) * 0.4))
        points = round(total * 0.5)
        start = at_hash(h, 41) % (n - (total - points) + 1)
        half = s[:start] + "N" * (total - points) + s[start + total - points :]
        chosen = sorted((at_hash(h, i + 1000), i) for i, c in enumerate(half) if c != "N")[:points]
        assert out == "".join("N" if i in {i for _, i in chosen} else c for i, c in enumerate(half))
