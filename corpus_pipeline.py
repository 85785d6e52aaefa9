"""A text corpus made ready for training, in stages that each keep part of what they are given.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and returns rows with the
columns of ``documents``; the last returns token ids. No stage needs the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contigframe.llm.decontaminate import drop_contaminated
from contigframe.llm.line_dedup import remove_boilerplate
from contigframe.llm.near_dedup import one_of_each
from contigframe.llm.pieces import encode_texts
from contigframe.llm.queries import piece_model
from contigframe.llm.toxicity import reject_toxic, train_toxicity
from contigframe.operators.lineage import cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from the labels of ``sf_dir``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject_toxic(docs, train_toxicity(docs, labels), 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines on more than a tenth (and on two pages at least) of their source's documents.

    ``n_chars`` is that of the text left; a document may be left with an empty text.
    """
    kept = remove_boilerplate(docs, ratio=0.1)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked at a similarity of 0.8;
    rows that repeat an id or have none are documents like any other."""
    return one_of_each(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, bounds, decoded``: token ids, where each begins in the text's bytes,
    and the text of the ids."""
    coded = encode_texts(docs, piece_model(), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "bounds", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: A trained classifier has no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of ``sf_dir``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
