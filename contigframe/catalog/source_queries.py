"""Queries that write the given tables in a file format and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import frames
from ..operators.lineage import shared_folder
from ..plans.training import encode_dataset
from ..sources import encoded, results
from ..sources import sequences as files
from ..sources.tables import read_table
from . import evaluation_queries, summary_queries  # noqa: F401 (registered before these)
from .base import REGISTRY, labelled, register, sequences, vector_scores
from .dataset_queries import _labelled_sequences


def _folder(spark) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/{app}/files-{uuid.uuid4().hex}"


@register(
    "fasta_files", "seq_id:s seq:s",
    "SELECT CAST(seq_id AS VARCHAR) AS seq_id, seq FROM seqs", "seqs",
)
def _(spark, d):
    path = _folder(spark)
    files.write_fasta(sequences(spark, d), path, 60)
    return files.read_fasta(spark, path)


@register(
    "labelled_fasta_files", "seq_id:s label:s seq:s",
    "SELECT CAST(seq_id AS VARCHAR) AS seq_id, lang AS label, seq FROM seqs", "seqs",
)
def _(spark, d):
    path = _folder(spark)
    files.write_fasta(sequences(spark, d), path, 70, label="lang")
    return files.to_columns(files.read_fasta(spark, path)).withColumn(
        "label", F.lower("label")
    )


@register(
    "labelled_csv_files", "label:i seq:s seq_id:i",
    """SELECT CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS label, seq,
              seq_id FROM seqs""",
    "seqs",
)
def _(spark, d):
    path = _folder(spark)
    files.write_labeled_csv(_labelled_sequences(spark, d), path)
    return files.read_labeled_csv(spark, path)


@register(
    "split_csv_files", "split:s rows:i",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS rows
       FROM documents GROUP BY 1""",
)
def _(spark, d):
    path = _folder(spark)
    split = F.when(F.col("seq_id") % 4 == 0, "val").otherwise("train")
    rows = _labelled_sequences(spark, d).withColumn("split", split)
    files.write_labeled_csv(rows, path, "split")
    back = spark.read.csv(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "window_score_files", "seq_id:i window_idx:i scores:ld gc_skew:d",
    "SELECT * FROM scored", "scored",
)
def _(spark, d):
    path = _folder(spark)
    results.write_window_scores(labelled(spark, d), path)
    return spark.read.parquet(path)


@register("vector_files", "vec_id:i embedding:ld", "SELECT * FROM vscores", "vscores")
def _(spark, d):
    path = _folder(spark)
    results.write_vectors(vector_scores(spark, d), path, "embedding", ["vec_id"])
    return spark.read.parquet(path)


@register(
    "summary_files", "contig_id:i value:s",
    """SELECT doc_id AS contig_id, printf('%.3f', n_chars / 8.0::DOUBLE) AS value
       FROM documents""",
)
def _(spark, d):
    path = _folder(spark)
    rows = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("contig_id"), (F.col("n_chars") / 8.0).alias("value")
    )
    results.write_summary(rows, path)
    return results.read_summary(spark, path, "contig_id long, value string")


@register(
    "accession_files", "accession:s taxid:i",
    "SELECT CAST(s_suppkey AS VARCHAR) AS accession, s_nationkey + 100 AS taxid FROM supplier",
)
def _(spark, d):
    path = _folder(spark)
    read_table(spark, d, "supplier").select(
        F.lit("x").alias("a"), F.col("s_suppkey").alias("b"),
        (F.col("s_nationkey") + 100).alias("c"),
    ).write.csv(path, sep="\t", header=True)
    return results.read_acc2taxid(spark, path)


@register(
    "taxdump_files", "taxid:i parent:i rank:s name:s old:i",
    """SELECT n_nationkey + 100 AS taxid, n_regionkey + 10 AS parent, 'genus' AS rank, n_name AS name,
              CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 500 END AS old FROM nation""",
)
def _(spark, d):
    path = _folder(spark)
    nation = read_table(spark, d, "nation").withColumn("taxid", F.col("n_nationkey") + 100)
    lines = {
        "nodes": [("taxid", F.col("n_regionkey") + 10, F.lit("genus"))],
        "names": [("taxid", "n_name", F.lit(""), F.lit("scientific name")), ("taxid", F.lit("other"), F.lit(""), F.lit("synonym"))],
        "merged": [(F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") + 500), "taxid")],
    }
    for name, kinds in lines.items():
        for fields in kinds:
            line = F.concat(F.concat_ws("\t|\t", *fields), F.lit("\t|"))
            rows = nation.where("n_nationkey % 5 = 0") if name == "merged" else nation
            rows.select(line).write.mode("append").text(f"{path}/{name}.dmp")
    dump = results.read_taxdump(spark, path)
    merged = dump["merged"].select("old", F.col("new").alias("taxid"))
    return dump["nodes"].join(dump["names"], "taxid").join(merged, "taxid", "left")


_FITTED = REGISTRY["fitted_thresholds"]


@register("threshold_files", " ".join(f"{n}:{k}" for n, k in _FITTED.columns), _FITTED.body, _FITTED.ctes)
def _(spark, d):
    path = _folder(spark)
    fitted = _FITTED.run(spark, d)
    results.save_thresholds(fitted, path, "linear", 0.05)
    return results.load_thresholds(spark, path, "linear")


@register(
    "sweep_files", "threshold:d f1_id:d f1_ood:d youden_j:d mcc:d", "SELECT * FROM sweep", "sweep"
)
def _(spark, d):
    path = _folder(spark)
    results.write_small_csv(REGISTRY["threshold_sweep"].run(spark, d), path, "threshold")
    return spark.read.csv(path, header=True, inferSchema=True)


@register(
    "encoded_files", "shard:i rows:i tokens:i",
    """SELECT shard, count(*) AS rows, sum(len(list_filter(string_split(crop, ''),
              lambda x: x <> 'N'))) * 2 AS tokens
       FROM crops JOIN (SELECT seq_id, (row_number() OVER (PARTITION BY label ORDER BY h, seq_id)
              - 1) % 3 AS shard FROM (SELECT seq_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1
                WHEN 'es' THEN 2 ELSE 3 END AS label,
                CAST('0x' || substr(md5('0:' || seq_id), 1, 8) AS BIGINT) AS h FROM seqs))
            USING (seq_id) GROUP BY shard""",
    "crops",
)
def _(spark, d):
    path = _folder(spark)
    rows = encode_dataset(_labelled_sequences(spark, d), [122], kind="nucleotide", shards=3)
    encoded.write_encoded(rows, path, {"crops": [122], "padded": True})
    width = encoded.read_manifest(spark, path)["crops"][0]
    back = encoded.read_encoded(spark, path, ["nucleotide"], pad_to=width)
    bases = F.size(F.array_remove(F.flatten("nucleotide"), 0))
    return back.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(bases).alias("tokens")
    )


@register(
    "narrow_tokens", "seq_id:i start:i kind:s",
    "SELECT seq_id, start, 'array<array<tinyint>>' AS kind FROM crops", "crops",
)
def _(spark, d):
    rows = encode_dataset(
        _labelled_sequences(spark, d), [122], kind="translated", alphabet="aa_id"
    )
    assert frames.narrow_type(22) == "tinyint"
    return rows.select("seq_id", "start", F.typeof("translated").alias("kind"))
