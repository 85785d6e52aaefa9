"""Result files: summaries, window scores, vectors, thresholds, predictions, taxonomy dumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import unescape_id
from ..functions.picks import row_hash
from ..operators.summary import format_doubles

SCHEMA_VERSION = 1


def write_summary(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated, with header and three decimals."""
    format_doubles(df).write.mode(mode).csv(path, sep="\t", header=True)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def extract_sequences(sequences: DataFrame, summary: DataFrame, key: str = "seq_id") -> DataFrame:
    """Sequences whose id is in the summary; ids are un-escaped on both sides."""
    wanted = summary.select(unescape_id(F.col("contig_id").cast("string")).alias("_id")).distinct()
    return (
        sequences.withColumn("_id", unescape_id(F.col(key).cast("string")))
        .join(wanted, "_id", "left_semi")
        .drop("_id")
    )


def extract_windows(
    windows: DataFrame, label: str, wanted: str, reliability: str, cutoff: float,
    key: str = "seq_id",
) -> DataFrame:
    """Single windows of one class at or above a reliability, named ``<contig>_<index>``."""
    return windows.where((F.col(label) == wanted) & (F.col(reliability) >= cutoff)).select(
        F.concat_ws("_", F.col(key).cast("string"), "window_idx").alias("seq_id"),
        F.col("window").alias("seq"),
    )


def write_window_scores(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.drop("window").write.mode(mode).parquet(path)


def write_vectors(
    df: DataFrame, path: str, kind: str, keys: Sequence[str], mode: str = "errorifexists"
) -> bool:
    """Write one kind of vector with its ids; nothing happens when the column is absent."""
    if kind not in df.columns:
        return False
    df.select(*keys, kind).write.mode(mode).parquet(path)
    return True


def save_thresholds(
    taus: DataFrame, path: str, model: str, quantile: float, mode: str = "errorifexists"
) -> None:
    """One row per class with the version, the model and the quantile they belong to."""
    stamped = taus.withColumns(
        {
            "schema_version": F.lit(SCHEMA_VERSION),
            "model": F.lit(model),
            "quantile": F.lit(float(quantile)),
            "created": F.current_timestamp(),
        }
    )
    stamped.coalesce(1).write.mode(mode).parquet(path)


def load_thresholds(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    head = df.select("schema_version", "model").first()
    if head is None or head["schema_version"] != SCHEMA_VERSION:
        raise ValueError("unsupported version of the threshold table")
    if model is not None and head["model"] != model:
        raise ValueError(f"thresholds were fitted for {head['model']}, not for {model}")
    return df.select("class", "tau_logit", "tau_margin", "n")


def write_small_csv(df: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """A table of a few rows (a sweep or a calibration) as one ordered CSV file."""
    df.coalesce(1).sortWithinPartitions(order).write.mode(mode).csv(path, header=True)


def prediction_table(
    scored: DataFrame, classes: Sequence[str], probs: str = "probs", key: str = "seq_id",
    label: str = "label",
) -> DataFrame:
    return scored.select(
        key,
        label,
        *[F.get("scores", F.lit(i)).alias(f"logit_{c}") for i, c in enumerate(classes)],
        *[F.get(probs, F.lit(i)).alias(f"prob_{c}") for i, c in enumerate(classes)],
    )


def write_predictions(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def cached_predictions(
    spark: SparkSession, path: str, rows: DataFrame, key: str = "seq_id", label: str = "label"
) -> DataFrame | None:
    """Stored predictions if they belong to exactly these rows, else None.

    Counts and a sum of row hashes are compared in one pass per side.
    """
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # the reader's error class differs between session types
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    if key not in stored.columns or label not in stored.columns:
        return None

    def print_of(df: DataFrame) -> tuple:
        h, g = row_hash(key, label), row_hash(label, key, seed=1)
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h), F.sum(g)).first())

    return stored if print_of(stored) == print_of(rows) else None


def read_acc2taxid(spark: SparkSession, path: str) -> DataFrame:
    """``accession, taxid`` from the second and third field; the largest taxid wins for an
    accession given twice. Short lines and the header are skipped."""
    raw = spark.read.schema("a string, accession string, taxid string").csv(
        path, sep="\t", header=True
    )
    return (
        raw.where(F.col("accession").isNotNull() & F.col("taxid").isNotNull())
        .groupBy("accession")
        .agg(F.max(F.col("taxid").cast("int")).alias("taxid"))
    )


def read_taxdump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nodes, names and merged tables of a taxonomy dump."""

    def fields(name: str) -> DataFrame:
        parts = F.split("value", r"\t\|\t?")
        return spark.read.text(f"{folder}/{name}.dmp").select(parts.alias("f"))

    def field(i: int):
        return F.trim(F.get("f", F.lit(i)))

    nodes = fields("nodes").select(
        field(0).cast("int").alias("taxid"), field(1).cast("int").alias("parent"),
        field(2).alias("rank"),
    )
    names = fields("names").where(field(3) == "scientific name").select(
        field(0).cast("int").alias("taxid"), field(1).alias("name")
    )
    merged = fields("merged").select(
        field(0).cast("int").alias("old"), field(1).cast("int").alias("new")
    )
    return {"nodes": nodes, "names": names, "merged": merged}


def pair_samples(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Longest label name that equals a sample name or is a ``_`` prefix of it, null if none.

    ``predictions``: sample; ``labels``: label_name.
    """
    tokens = F.split("sample", "_")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(tokens)), lambda n: F.array_join(F.slice(tokens, 1, n), "_")
    )
    tried = predictions.select("sample", F.explode(prefixes).alias("label_name"))
    hits = tried.join(labels.select("label_name").distinct(), "label_name")
    best = hits.groupBy("sample").agg(
        F.max_by("label_name", F.length("label_name")).alias("label_name")
    )
    return predictions.select("sample").distinct().join(best, "sample", "left")

