"""Long sequences, single passes of a scorer, and borders with a planted repeat."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contigframe.catalog import REGISTRY, join_queries
from contigframe.functions import dna
from contigframe.operators import repeats
from contigframe.operators.datasets import random_tiling
from contigframe.operators.repeats import att_sites
from contigframe.operators.scoring import score_windows
from contigframe.operators.windows import span_pieces
from contigframe.plans.contigs import call_contigs

CLASSES = ["host", "phage", "virus"]


def letters(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def table(spark, rows):
    return spark.createDataFrame(rows, "seq_id bigint, seq string")


def test_one_long_sequence_is_tiled(spark):
    seq = letters(2_000_000, 1)
    got = random_tiling(table(spark, [(1, seq), (2, seq[:50])]), 300, 600, 50).collect()
    assert len(got) > 4_000 and {r.seq_id for r in got} == {1}
    assert all(r.fragment == seq[r.start : r.start + r.length] for r in got)


def test_one_long_sequence_is_masked(spark):
    seq = letters(1_000_000, 2) + "A" * 100 + letters(1_000_000, 3) + "CA" * 60
    masked = table(spark, [(1, seq), (2, ""), (3, None), (4, "A" * 40)]).select("seq_id", dna.low_complexity_mask("seq").alias("m"))
    got = {r.seq_id: r.m for r in masked.collect()}
    assert got[1].upper() == seq and got[1][-64:].islower()
    # The run is masked, and nothing more than a window around it.
    at = 1_000_000
    assert got[1][at : at + 100].islower() and sum(c.islower() for c in got[1][: at - 64]) < at / 100
    assert got[2] == "" and got[3] is None and got[4] == "a" * 40


def test_span_pieces(spark):
    seq = letters(100_000, 4)
    spans = [(1, 0, 0, 100_000), (1, 1, 16_383, 16_385), (1, 2, 500, 500), (1, 3, 32_768, 40_000)]
    spans = spark.createDataFrame(spans, "seq_id bigint, n int, start int, end int")
    found = {}
    for r in sorted(span_pieces(table(spark, [(1, seq)]), spans).collect(), key=lambda r: r.block_start):
        found[r.n] = found.get(r.n, "") + r.text
    assert found == {0: seq, 1: seq[16_383:16_385], 3: seq[32_768:40_000]}


def test_a_model_scores_each_window_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def make():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            seen.add(len(batch))
            gc = (batch.g + batch.c).to_numpy(float)
            return pd.DataFrame({"scores": list(np.stack([gc, batch.a.to_numpy(float), batch.t.to_numpy(float)], axis=1))})

        return run

    sequences = table(spark, [(k, letters(5_000, k)) for k in range(6)])
    calls = call_contigs(
        sequences, lambda w: score_windows(w, make, ["g", "c", "a", "t"], {"scores": "array<double>"}), CLASSES, 500, 500,
        switch_cost=0.5, repeats=True,
    )
    assert calls.count() == 6 and len(calls.collect()) == 6
    assert seen.value == 60


def test_attachment_sites(spark):
    core = letters(60, 9)
    seq = letters(20_000, 5) + core + letters(30_000, 6) + core + letters(20_000, 7)
    start, end = 20_000, 50_000 + 2 * len(core)
    other = letters(40_000, 8) + "N" * 4_000 + letters(40_000, 10)
    regions = spark.createDataFrame([(1, start, end, 2.0), (2, 30_000, 60_000, 1.5)], "seq_id bigint, start bigint, end bigint, score double")
    got = {r.contig_id: r for r in att_sites(regions, table(spark, [(1, seq), (2, other)])).collect()}
    hit = got[1]
    assert hit.att_type == "DTR" and hit.att_alignment_length == 60 and hit.attL == hit.attR == core
    body = seq[hit.sstart : hit.eend]
    assert hit["gc%"] == (body.count("G") + body.count("C")) / len(body) and hit["n%"] == 0 and hit.reject is False
    miss = got[2]
    body = other[miss.sstart : miss.eend]
    assert miss["gc%"] == (body.count("G") + body.count("C")) / len(body)
    assert (miss.sstart, miss.eend) == (30_000, 60_000) or miss.att_alignment_length < 20


@pytest.mark.parametrize("name", ["planted_repeats", "planted_sites"])
def test_planted_sequences_are_made_once(spark, monkeypatch, name):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(seq):
        made.add(1)
        return seq

    rows = table(spark, [(i, letters(900 + 300 * i, i)) for i in range(9)])
    monkeypatch.setattr(join_queries, "sequences", lambda spark, d: rows.select("seq_id", counted("seq").alias("seq")))
    assert REGISTRY[name].run(spark, "").count() == (8 if name == "planted_repeats" else 5)
    assert made.value == 9


def test_runs_are_searched_row_by_row(spark):
    """Rows with an id of their own are not joined; others, and null ids, are what the join of k-mers makes of them."""
    rows = []
    for i in range(12):
        core = letters(40, i)
        spoilt = core[:15] + "ACGT"["ACGT".index(core[15]) - 1] + core[16:] if i % 3 else core
        rows.append((i, "ITR" if i % 2 else "DTR", letters(90, 50 + i) + core, letters(70, 80 + i) + spoilt + "N"))
    rows += [(20, "DTR", "AC" * 60, "AC" * 50), (21, "DTR", "A" * 50, "NA" * 30), (22, "DTR", "", None)]
    schema = "id long, kind string, front string, rear string"
    alone = spark.createDataFrame(rows, schema)
    found = repeats.best_runs(alone, "id")
    assert "Join" not in found._jdf.queryExecution().toString()
    want = sorted(map(tuple, repeats._joined_runs(alone, "id").collect()))
    assert sorted(map(tuple, found.collect())) == want and len(want) == 13
    more = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], schema)
    assert sorted(map(tuple, repeats.best_runs(more, "id").collect())) == sorted(map(tuple, repeats._joined_runs(more, "id").collect()))
