"""Splits, balance, altered copies, duplicates, repeats, taxa and files."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contigframe.functions.picks import row_hash
from contigframe.operators import datasets as D
from contigframe.operators import dedup, perturb, repeats, taxonomy, vector_index
from contigframe.plans.training import encode_dataset
from contigframe.sources import encoded, results, sequences


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def labelled(spark, sizes):
    rows = [(f"{c}{i}", c) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id string, label int")


def test_exact_split_does_not_depend_on_partitions(spark):
    df = labelled(spark, [70, 33])
    got = D.split_dataset(df, "id", 0.8, 0.1, 0.1, seed=4)
    assert Counter(r.split for r in got.collect()) == {"train": 82, "val": 10, "test": 11}
    again = D.split_dataset(df.repartition(7), "id", 0.8, 0.1, 0.1, seed=4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError):
        D.split_dataset(df, "id", 0.8, 0.1, 0.2)


def test_shards_and_interleaving(spark):
    df = labelled(spark, [30, 30, 30])
    shards = Counter((r.shard, r.label) for r in D.assign_shards(df, "id", "label", 4).collect())
    assert max(shards.values()) - min(shards.values()) <= 1
    rows = sorted(D.interleave_classes(df, "id", "label", 1).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(90))
    labels = [r.label for r in rows]
    longest = max(len(g) for g in "".join(map(str, labels)).replace("01", "0 1").split())
    assert Counter(labels) == {0: 30, 1: 30, 2: 30} and longest <= 4
    assert all(a != b or b != c for a, b, c in zip(labels, labels[1:], labels[2:]))


def test_length_batches(spark):
    df = spark.createDataFrame([(str(i), 5) for i in range(5)], "id string, n int")
    got = D.length_batches(df, "id", "n", {}, 3).collect()
    assert len(got) == 3 and {r.batch_idx for r in got} == {0}
    assert D.batch_sizes({1: 7, 2: 3}, 8, 4) == ({1: 4, 2: 8}, 8)
    with pytest.raises(ValueError):
        D.batch_sizes({}, 3, 4)


def test_matched_and_stratified_samples(spark):
    df = labelled(spark, [50, 30, 1])
    size = spark.createDataFrame([(20,)], "n long")
    got = Counter(r.label for r in D.downsample_to_match(df, "label", "id", size, 1).collect())
    assert sum(got.values()) == 20 and abs(got[0] - 12) <= 1
    whole = spark.createDataFrame([(500,)], "n long")
    assert D.downsample_to_match(df, "label", "id", whole).count() == 81
    sample = Counter(r.label for r in D.stratified_sample(df, "label", "id", 10, 1).collect())
    assert sum(sample.values()) == 10 and sample[2] == 1


def test_replace_class(spark):
    df, new = labelled(spark, [10, 6]), spark.createDataFrame([("n0", 1), ("n1", 1)], "id string, label int")
    got = D.replace_class(df, new, "label", 1, "id").collect()
    assert Counter(r.label for r in got) == {0: 10, 1: 6}
    assert {"n0", "n1"} <= {r.id for r in got}
    with pytest.raises(ValueError):
        D.replace_class(df, labelled(spark, [0, 7]), "label", 1, "id")


def altered(spark, rows, fn):
    df = spark.createDataFrame(rows, "seq_id long, seq string").withColumn("h", row_hash("seq_id", seed=3))
    return {r.seq_id: r.s for r in df.select("seq_id", fn("seq", F.col("h")).alias("s")).collect()}


def test_shuffles_keep_their_counts(spark):
    rng = random.Random(2)
    rows = [(i, dna(rng, rng.randint(1, 300), "ACGTN")) for i in range(15)]
    plain = altered(spark, rows, perturb.shuffle_bases)
    pairs = altered(spark, rows, perturb.dinuc_shuffle)
    triples = altered(spark, rows, lambda s, h: perturb.kmer_shuffle(s, h, 3))
    for i, s in rows:
        assert sorted(plain[i]) == sorted(s)
        assert Counter(zip(pairs[i], pairs[i][1:])) == Counter(zip(s, s[1:]))
        assert pairs[i][0] == s[0] and pairs[i][-1] == s[-1]
        whole = len(s) // 3 * 3
        cut = [s[k : k + 3] for k in range(0, whole, 3)]
        assert sorted(cut) == sorted(triples[i][k : k + 3] for k in range(0, whole, 3))
        assert triples[i][whole:] == s[whole:]
    assert sum(plain[i] != s for i, s in rows) > 10
    with pytest.raises(ValueError):
        perturb.kmer_shuffle("seq", F.lit(1), 0)


def test_pair_shuffle_of_a_whole_contig(spark):
    """Two million letters, the same under any partitioning; few places keep their letter."""
    text = "".join(np.random.default_rng(1).choice(list("ACGTN"), p=[0.4, 0.3, 0.2, 0.09, 0.01], size=2_000_000))
    got = {n: altered(spark, [(k, t) for k, t in enumerate((text, "AC" * 500 + "GT" * 500, "A" * 1000, "", "é日A日é", None))],
                      lambda s, h, n=n: perturb.dinuc_shuffle(s, h)) for n in (1, 8)}
    assert got[1] == got[8] and got[1][5] is None and got[1][3] == "" and got[1][2] == "A" * 1000
    for k, t in ((0, text), (1, "AC" * 500 + "GT" * 500), (4, "é日A日é")):
        one, two = (np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64) for x in (t, got[1][k]))
        assert one[0] == two[0] and one[-1] == two[-1]
        pairs = [np.unique(x[:-1] << np.uint64(32) | x[1:], return_counts=True) for x in (one, two)]
        assert all((a == b).all() for a, b in zip(*pairs, strict=True))
        if k == 0:
            assert (one == two).mean() < 0.35


def test_shuffled_fragments(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, dna(rng, 4000)) for i in range(3)], "seq_id long, seq string")
    plain, mixed = (D.coverage_sampling(df, 100, 200, 0.5, seed=2, shuffle=s).collect() for s in (False, True))
    assert [(r.seq_id, r.start, r.length) for r in sorted(plain)] == [(r.seq_id, r.start, r.length) for r in sorted(mixed)]
    assert {r.fragment for r in plain}.isdisjoint(r.fragment for r in mixed)
    tiles = D.random_tiling(df, 100, 100, seed=2, shuffle=True).collect()
    assert len(tiles) == 120 and all(len(r.fragment) == 100 for r in tiles)


def test_windows_of_repeats_keep_the_length(spark):
    rng = random.Random(4)
    rows = [(i, dna(rng, n)) for i, n in enumerate([1, 2, 7, 100, 333])]
    for fn in (perturb.repeat_window, perturb.tandem_window):
        got = altered(spark, rows, fn)
        assert all(len(got[i]) == len(s) for i, s in rows)
        assert got[4] != rows[4][1]


def test_n_share_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, dna(rng, 200)) for i in range(25)]
    got = altered(spark, rows, lambda s, h: perturb.n_stretch(s, h, 0.3, 0.3))
    for i, s in rows:
        assert got[i].count("N") == 60
        assert all(a == b or b == "N" for a, b in zip(s, got[i]))


def test_mutations_build_on_each_other(spark):
    rows = [(1, "ACGT" * 30)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    got = sorted(perturb.mutation_series(df, 0.0, 0.3, 0.1).collect(), key=lambda r: r.level)
    assert [r.seq.count("N") for r in got] == [0, 12, 24, 36]
    for a, b in zip(got, got[1:]):
        assert all(y == "N" for x, y in zip(a.seq, b.seq) if x == "N")
    other = perturb.mutation_series(df, 0.0, 0.1, 0.1, replace=True).where("level = 1").first().seq
    assert sum(x != y for x, y in zip(other, rows[0][1])) == 12 and "N" not in other


def test_perturbation_plan():
    assert [k["count"] for k in perturb.perturbation_plan(12, 1.0, {})] == [4, 4, 4]
    plan = perturb.perturbation_plan(
        100, 1.0,
        {"shuffle": {"count": 10}, "subseq_repeat": {"multiplier": 0.2}, "tandem_repeat": False},
    )
    assert [(k["kind"], k["count"]) for k in plan] == [("shuffle", 10), ("subseq_repeat", 20)]
    modes = perturb.perturbation_kinds({"shuffle": {"mode": ["random", "dinuc"]}})
    assert [k["mode"] for k in modes[:2]] == ["random", "dinuc"]
    with pytest.raises(ValueError):
        perturb.perturbation_kinds({"shuffle": {"mode": "sideways"}})


def test_mixes_use_distinct_classes(spark):
    rng = random.Random(1)
    rows = [(i, dna(rng, 80), i % 4) for i in range(20)]
    df = spark.createDataFrame(rows, "seq_id long, seq string, label int")
    got = perturb.chimera(df, 3, 100, 15, seed=2).collect()
    assert len(got) == 15
    assert all(len(set(r.labels)) == 3 and len(r.seq) == 100 for r in got)
    with pytest.raises(ValueError):
        perturb.chimera(df, 5, 100, 3)


def test_perturb_counts_and_sources(spark):
    rng = random.Random(1)
    df = spark.createDataFrame(
        [(i, dna(rng, 60), i % 2) for i in range(7)], "seq_id long, seq string, label int"
    )
    plan = perturb.perturbation_plan(7, 3.0, {"n_stretch": True, "mix": {"output_length": 50}})
    got = perturb.perturb(df, plan, seed=1).collect()
    assert Counter(r.kind for r in got) == {k["kind"]: k["count"] for k in plan}
    assert all(r.label == 0 for r in got)


def test_copies_of_few_sources_are_made_by_many_tasks(spark, monkeypatch):
    rows = [(i, "ACGTTGCA" * 5, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "seq_id long, seq string, label int").coalesce(1)
    plan = [{"kind": "n_stretch", "count": 4000}]
    monkeypatch.setattr(perturb, "COPIES", 4000)
    whole = {(r.i, r.seq) for r in perturb.perturb(df, plan, seed=2).collect()}
    monkeypatch.setattr(perturb, "COPIES", 4)
    got = perturb.perturb(df, plan, seed=2).withColumn("task", F.spark_partition_id()).collect()
    assert {r.i for r in got} == set(range(4000)) and len(got) == 4000
    assert {(r.i, r.seq) for r in got} == whole
    assert len({r.task for r in got}) > 4


def test_duplicates(spark):
    rng = random.Random(7)
    base = dna(rng, 400)
    near = base[:190] + "T" + base[191:390]
    rows = [(1, base), (2, base), (3, near), (4, dna(rng, 380)), (5, base), (6, dna(rng, 12))]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    got = {r.seq_id: r.representative for r in dedup.non_redundant(df, 11).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6}
    kept = dedup.representatives(df, dedup.non_redundant(df, 11))
    assert sorted(r.seq_id for r in kept.collect()) == [1, 4, 6]


def test_links_like_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(9, "A" * 50), (10, "ACG"), (11, "N" * 30)]
    for base in (dna(rng, 500) for _ in range(6)):
        # Cut and altered copies, of all of which few share a centre's smallest hashes.
        for _ in range(8):
            text = list(base[rng.randrange(150) : 500 - rng.randrange(150)])
            for i in rng.sample(range(len(text)), rng.randrange(12)):
                text[i] = rng.choice("ACGT")
            rows.append((20 + len(rows), "".join(text)))
    k, t, c = 8, 0.6, 0.6
    mers = {i: {s[j : j + k] for j in range(len(s) - k + 1)} - {"N" * k} for i, s in rows}
    want, best = {}, {}
    for a, s in rows:
        for b, u in sorted(rows, key=lambda r: (-len(r[1]), r[0])):
            if mers[a] and (len(u), -b) > (len(s), -a) and len(s) >= c * len(u):
                share = len(mers[a] & mers[b]) / len(mers[a])
                if share >= t:
                    want[a, b] = share
                    best.setdefault(a, b)

    def end(i):
        return end(best[i]) if i in best else i

    df = spark.createDataFrame(rows, "seq_id long, seq string")
    for block in (dedup.BLOCK, 5):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "STEP", block // 2)
        got = {(r.member, r.centre): r.similarity for r in dedup.centre_links(df, k, min_identity=t, min_coverage=c).collect()}
        assert got == pytest.approx(want)
        reps = {r.seq_id: r.representative for r in dedup.non_redundant(df, k, min_identity=t, min_coverage=c).collect()}
        assert reps == {i: end(i) for i, _ in rows}


def test_chains_of_links(spark):
    links = spark.createDataFrame([(i, i - 1) for i in range(1, 14)], "member long, centre long")
    assert {r.rep for r in dedup.follow_links(links).collect()} == {0}


def best_alignment(a, b):
    """Best ungapped local score by dynamic programming along every diagonal."""
    best = (0, 0, 0, 0)
    for d in range(-len(a) + 1, len(b)):
        run, start = 0, None
        for i in range(max(0, -d), min(len(a), len(b) - d)):
            gain = 2 if a[i] == b[i + d] and a[i] in "ACGT" else -100
            if run <= 0:
                run, start = 0, i
            run += gain
            if run > best[0]:
                best = (run, start, start + d, i - start + 1)
    return best


def test_common_runs_against_dynamic_programming(spark):
    rng = random.Random(11)
    rows = []
    for i in range(14):
        a, b = dna(rng, 220, "ACGTN"), dna(rng, 220, "ACGTN")
        if i % 2:
            piece = dna(rng, rng.randint(14, 150))
            a, b = a[:30] + piece + a[30:], b[:77] + piece + b[77:]
        if i % 4 == 3:
            cut = rng.randint(80, 100)
            a = a[:cut] + "ACGT"[rng.randint(0, 3)] + a[cut + 1 :]
        if i == 12:
            a = b = "A" * 150
        rows.append((i, "DTR", a, b))
    long = dna(rng, 160)
    rows.append((99, "DTR", long, long[:80] + ("A" if long[80] != "A" else "C") + long[81:]))
    df = spark.createDataFrame(rows, "id long, kind string, front string, rear string")
    got = {r.id: r for r in repeats.best_runs(df, "id").collect()}
    for i, _, a, b in rows:
        score, start, other, length = best_alignment(a, b)
        if length < 13:
            assert i not in got
        else:
            assert (got[i].score, got[i].length) == (score, length)
            assert (got[i].a_start, got[i].b_start) == (start, other)
    assert got[99].length == 160 and got[99].identities == 159


def test_terminal_repeats(spark):
    rng = random.Random(3)
    body, unit = dna(rng, 3000), dna(rng, 300)
    back = unit[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = [(1, unit + body + unit), (2, unit + body + back), (3, dna(rng, 2500)), (4, "ACGT")]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    got = {r.contig_id: r for r in repeats.terminal_repeats(df, 2000).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].terminal_repeats, got[1].repeat_length, got[1].sstart) == ("LTR_DTR", 300, 0)
    assert got[1].front == got[1].rear == unit
    assert (got[2].terminal_repeats, got[2].repeat_length) == ("ITR", 300)
    assert got[2].rear == back
    assert got[3].terminal_repeats is None and got[3].seq_len == 2500


def test_taxa(spark):
    nodes = spark.createDataFrame(
        [(1, 1, "no rank"), (2, 1, "realm"), (3, 2, "family"), (4, 2, "family"), (5, 3, "genus"),
         (6, 3, "genus"), (7, 5, "widget")],
        "taxid int, parent int, rank string",
    )
    names = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "taxid int, name string")
    closure = taxonomy.ancestors(nodes)
    seven = {r.ancestor: r.distance for r in closure.where("taxid = 7").collect()}
    assert seven == {7: 0, 5: 1, 3: 2, 2: 3, 1: 4}
    hits = spark.createDataFrame(
        [("a", 5), ("a", 5), ("a", 6), ("b", 7), ("c", 4), ("c", 5)], "contig string, taxid int"
    )
    calls = {r.contig: r.lca for r in taxonomy.majority_lca(hits, closure, "contig").collect()}
    assert calls == {"a": 5, "b": 7, "c": 2}
    text = taxonomy.lineage_string(nodes.where("taxid = 7"), closure, nodes, names).first().lineage
    assert text == "r__n2;f__n3;g__n5;w__n7"
    merged = spark.createDataFrame([(6, 5)], "old int, new int")
    assert sorted(r.taxid for r in taxonomy.resolve_merged(hits, merged).collect()) == [4, 5, 5, 5, 5, 7]


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_vectors(spark, block):
    rng = np.random.default_rng(5)
    refs, queries = rng.normal(size=(40, 8)), rng.normal(size=(11, 8))
    r = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(refs)],
                              "vec_id long, taxid int, embedding array<float>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)],
                              "query_id long, embedding array<float>")
    got = vector_index.nearest_vectors(q, r, 4, block).collect()
    a = refs.astype("f4").astype(float)
    b = queries.astype("f4").astype(float)
    sims = (b / np.linalg.norm(b, axis=1)[:, None]) @ (a / np.linalg.norm(a, axis=1)[:, None]).T
    for i in range(11):
        mine = [x.vec_id for x in sorted((g for g in got if g.query_id == i), key=lambda g: g.rank)]
        assert mine == np.argsort(-sims[i])[:4].tolist()


def test_fasta_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"c{i} extra", dna(rng, n)) for i, n in enumerate([1, 69, 70, 71, 140, 1000])]
    df = spark.createDataFrame(rows, "seq_id string, seq string")
    for codec in ("none", "gzip", "bzip2"):
        path = str(tmp_path / codec)
        spark.conf.set("mapreduce.output.fileoutputformat.compress", "false")
        text = df.select(sequences.fasta_text(F.col("seq_id"), F.col("seq"), 70).alias("value"))
        text.write.option("compression", codec).text(path)
        sequences.check_compression(spark, path)
        assert sorted(map(tuple, sequences.read_fasta(spark, path).collect())) == sorted(rows)
    first = sequences.read_fasta(spark, str(tmp_path / "none"), first_token=True)
    assert {r.seq_id for r in first.collect()} == {f"c{i}" for i in range(6)}
    (tmp_path / "x.xz").write_bytes(bytes.fromhex("FD377A585A00") + b"0" * 20)
    with pytest.raises(ValueError):
        sequences.check_compression(spark, str(tmp_path / "x.xz"))


def test_labelled_csv_round_trip(spark, tmp_path):
    rows = [(0, "ACGT", "a"), (1, "GG", "b"), (0, "TT", "c")]
    df = spark.createDataFrame(rows, "label int, seq string, seq_id string")
    sequences.write_labeled_csv(df, str(tmp_path / "x"))
    got = sequences.read_labeled_csv(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    unnamed = sequences.read_labeled_csv(spark, str(tmp_path / "x"), id_col=None).collect()
    assert {r.seq_id for r in unnamed} == {"seq_0", "seq_1", "seq_2"}
    sequences.write_labeled_csv(df.withColumn("split", F.lit("train")), str(tmp_path / "y"), "split")
    assert (tmp_path / "y" / "split=train").is_dir()


def test_threshold_files(spark, tmp_path):
    taus = spark.createDataFrame([("phage", 1.0, 0.5, 40)], "class string, tau_logit double, tau_margin double, n long")
    path = str(tmp_path / "taus")
    results.save_thresholds(taus, path, "m1", 0.05)
    assert results.load_thresholds(spark, path, "m1").first().tau_logit == 1.0
    with pytest.raises(ValueError):
        results.load_thresholds(spark, path, "m2")


def test_cached_predictions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 0)], "seq_id string, label int")
    path = str(tmp_path / "preds")
    assert results.cached_predictions(spark, path, rows) is None
    results.write_predictions(rows.withColumn("prob_x", F.lit(0.5)), path)
    assert results.cached_predictions(spark, path, rows).count() == 2
    other = spark.createDataFrame([("a", 1), ("b", 1)], "seq_id string, label int")
    assert results.cached_predictions(spark, path, other) is None


def test_summary_and_vector_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456)], "contig_id string, phage_score double")
    results.write_summary(df, str(tmp_path / "s"))
    assert results.read_summary(spark, str(tmp_path / "s"), "contig_id string, phage_score string").first()[1] == "1.235"
    assert not results.write_vectors(df, str(tmp_path / "v"), "embedding", ["contig_id"])
    vectors = df.withColumn("embedding", F.array(F.lit(1.0)))
    assert results.write_vectors(vectors, str(tmp_path / "v"), "embedding", ["contig_id"])
    assert spark.read.parquet(str(tmp_path / "v")).columns == ["contig_id", "embedding"]


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    (tmp_path / "names.dmp").write_text(
        "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tX y\t|\t\t|\tscientific name\t|\n"
        "2\t|\tother\t|\t\t|\tsynonym\t|\n"
    )
    (tmp_path / "merged.dmp").write_text("9\t|\t2\t|\n")
    dump = results.read_taxdump(spark, str(tmp_path))
    assert sorted(map(tuple, dump["nodes"].collect())) == [(1, 1, "no rank"), (2, 1, "genus")]
    assert sorted(map(tuple, dump["names"].collect())) == [(1, "root"), (2, "X y")]
    assert dump["merged"].first()[:] == (9, 2)
    (tmp_path / "acc.tsv").write_text("a\tb\tc\nX\tX.1\t7\tz\nshort\n\nY\tY.1\t8\tz\n")
    got = results.read_acc2taxid(spark, str(tmp_path / "acc.tsv"))
    assert sorted(map(tuple, got.collect())) == [("X.1", 7), ("Y.1", 8)]


def test_encoded_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGTACGTACGTAC", 0), (2, "GGGTTTACGAC", 1)], "seq_id long, seq string, label int")
    path = str(tmp_path / "e")
    encoded.write_encoded(encode_dataset(df, [14], shards=2), path, {"crops": [14]})
    assert encoded.read_manifest(spark, path) == {"crops": [14]}
    got = encoded.read_encoded(spark, path, ["translated"], one_hot_depth=65, classes=2).collect()
    assert len(got) == 2 and all(len(r.translated) == 6 for r in got)
    assert sorted(r.label for r in got) == [[0, 1], [1, 0]]


def test_streaming_rows(spark, tmp_path):
    from contigframe.plans.contigs import linear_scorer
    from contigframe.streaming import score_stream

    df = spark.createDataFrame([(1, "ACGT" * 100)], "seq_id long, seq string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    scorer = linear_scorer([[1, 0, 0, 0, 0], [0, 1, 0, 0, 0]], [0, 0])
    query = (
        score_stream(stream, scorer, 100, 50).writeStream.format("memory").queryName("w")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.awaitTermination(60)
    assert spark.table("w").count() == score_stream(df, scorer, 100, 50).count() == 7


def test_salted_joins_equal_plain_joins(spark):
    from contigframe.operators.skew import salted_join

    rng = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}") for i in range(300)]
    big = spark.createDataFrame(rows, "id long, k string")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = sorted(map(tuple, big.join(small, "k").select("id", "k", "n").collect()))
    salted = salted_join(big, small, ["k"], ["id"], salts=5).select("id", "k", "n")
    assert sorted(map(tuple, salted.collect())) == plain
    left = salted_join(big, small.where("k <> 'hot'"), ["k"], ["id"], how="left")
    assert left.count() == 300 and left.where("n IS NULL").count() == 100
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], ["id"], how="full")


@pytest.mark.parametrize(("k", "letters", "limits"), [(3, "ACGT", {}), (8, "ACGT", {}), (3, "ACGT", {"LISTED": 50, "WIDE_BLOCK": 40, "BLOCK": 32, "STEP": 7})])
def test_common_kmers_need_no_index(spark, monkeypatch, k, letters, limits):
    """Blocks meet without the index and give the links of all pairs, for copies and rows without k-mers too."""
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list(letters), 200))
    rows = [(i, base[s : s + n] + "".join(rng.choice(list(letters), 5))) for i, (s, n) in enumerate(zip(rng.integers(0, 120, 150), rng.integers(10, 80, 150)))]
    rows += [(500, "NNNN"), (501, rows[3][1]), (502, "AC")]
    for name, value in limits.items():
        monkeypatch.setattr(dedup, name, value)
    monkeypatch.setattr(dedup, "_needed", lambda *a: pytest.fail("the index was built"))
    monkeypatch.setattr(dedup, "_prunes", lambda sets: False) if k > 3 else None
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    sets = {i: {s[j : j + k] for j in range(len(s) - k + 1) if "N" not in s[j : j + k]} for i, s in rows}
    text, want = dict(rows), {}
    for i, a in sets.items():
        for j, b in sets.items():
            longer = (len(text[j]), -j) > (len(text[i]), -i)
            if a and longer and len(text[i]) >= 0.6 * len(text[j]) and len(a & b) / len(a) >= 0.6:
                want[i, j] = len(a & b) / len(a)
    got = dedup.centre_links(df, k).collect()
    assert len(got) == len(want) > 50
    assert {(r.member, r.centre): pytest.approx(r.similarity) for r in got} == want


def all_links(rows, k):
    """Links of all pairs of (key, text), keys in order, None last: to longer texts, or equally long ones before."""
    sets = [{s[j : j + k] for j in range(len(s) - k + 1) if "N" not in s[j : j + k]} for _, s in rows]
    order = [(-len(s), key is None, key or "") for key, s in rows]
    out = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and order[j] < order[i] and len(rows[i][1]) >= 0.6 * len(rows[j][1]) and len(a & b) >= 0.6 * len(a):
                out[i, j] = len(a & b) / len(a)
    return out


@pytest.mark.parametrize("k", [3, 8])
def test_runs_of_centres_are_met_without_copies(spark, monkeypatch, k):
    """The links of all pairs, and the best of each, from many blocks and runs; nothing is shuffled for them."""
    rng = random.Random(5)
    base = dna(rng, 900)
    rows = [(f"s{i}", base[(a := rng.randrange(800)) : a + rng.choice((40, 60, 60, 60, 90))] + dna(rng, 3)) for i in range(240)]
    rows += [(None, rows[9][1][:-1] + "N"), ("é", "N" * 50), ("t", "ACGTACGTN" * 4)]
    for name, value in {"HELD_ROWS": 60, "WIDE_BLOCK": 16}.items():
        monkeypatch.setattr(dedup, name, value)
    monkeypatch.setattr(dedup, "_prunes", lambda sets: False)
    df = spark.createDataFrame(rows, "seq_id string, seq string")
    want = all_links(rows, k)
    links = dedup.centre_links(df, k)
    assert "Exchange" not in links._jdf.queryExecution().toString()
    assert Counter((r.member, r.centre) for r in links.collect()) == Counter((rows[i][0], rows[j][0]) for i, j in want)
    best = {}
    for i, j in want:
        best.setdefault(i, []).append(((-len(rows[j][1]), rows[j][0] is None, rows[j][0] or ""), j))
    best = {rows[i][0]: rows[min(js)[1]][0] for i, js in best.items()}

    def end(key):
        return end(best[key]) if key in best else key

    got = {r.seq_id: r.representative for r in dedup.non_redundant(df, k).collect()}
    assert got == {key: end(key) for key, _ in rows} and len(want) > 200


def test_only_ends_that_lead_on_are_copied(spark, monkeypatch):
    copied, join = [], dedup.salted_join
    monkeypatch.setattr(dedup, "salted_join", lambda big, small, *a, **b: copied.append(small.count()) or join(big, small, *a, **b))
    links = [(i, 0) for i in range(1, 200)] + [(i, i - 199) for i in range(300, 320)]
    got = {r.member: r.rep for r in dedup.follow_links(spark.createDataFrame(links, "member long, centre long")).collect()}
    assert got == dict.fromkeys((i for i, _ in links), 0) and sum(copied) == 20


@pytest.mark.parametrize("part", [1, 300, 1 << 18])
def test_pairs_of_many_texts_are_shuffled_together(monkeypatch, part):
    """A text gives the same in any company, and its letter pairs and ends stay."""
    rng = random.Random(8)
    texts = [dna(rng, rng.randrange(60), rng.choice(("ACGTN", "AC", "A", "é日Ab"))) for _ in range(200)] + [None, ""]
    seeds = [rng.randrange(1 << 32) for _ in texts]
    walks, walk = [], perturb._pair_walks
    monkeypatch.setattr(perturb, "WALKED", part)
    monkeypatch.setattr(perturb, "_pair_walks", lambda *a: walks.append(1) or walk(*a))
    got = perturb.dinuc_shuffle.func(pa.array(texts), pa.array(seeds)).to_pylist()
    assert len(walks) == 1 if part > 300 else len(walks) > 10
    for text, seed, new in zip(texts, seeds, got):
        codes = perturb._code_points(text or "")
        assert (new or "") == perturb._text(walk(codes, np.array([len(codes)]), np.array([seed])))
        if text:
            assert Counter(zip(new, new[1:])) == Counter(zip(text, text[1:])) and (new[0], new[-1]) == (text[0], text[-1])
    assert got[-2:] == [None, ""] and sum(a != b for a, b in zip(texts, got)) > 80
    pairs = perturb.sorted_pairs.func(pa.array(texts)).to_pylist()
    assert pairs == [",".join(sorted(a + b for a, b in zip(t or "", (t or "")[1:]))) for t in texts]
