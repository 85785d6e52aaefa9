"""Sequence files: FASTA and headerless labelled CSV, plain or compressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import strip_class_suffix
from ..functions.picks import row_hash
from ..operators.ranks import bits_of, hash_bucket, rank_rows

# Leading bytes of compressed files.
MAGIC = {"gzip": "1F8B", "bzip2": "425A68", "xz": "FD377A585A00"}
EXTENSIONS = {"gzip": (".gz", ".gzip"), "bzip2": (".bz2",)}


def compression(spark: SparkSession, path: str) -> dict[str, str]:
    """Compression of each file at ``path`` (a file, folder or pattern), by its leading bytes.

    Six bytes of each file are read, wherever Spark's file systems reach.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    found: dict[str, str] = {}
    for top in files.globStatus(place) or []:
        for status in files.listStatus(top.getPath()):
            if status.isDirectory() or status.getPath().getName().startswith(("_", ".")):
                continue
            stream = files.open(status.getPath())
            try:
                head = bytes(stream.read() for _ in range(min(6, status.getLen()))).hex().upper()
            finally:
                stream.close()
            kinds = [name for name, magic in MAGIC.items() if head.startswith(magic)]
            found[status.getPath().toString()] = kinds[0] if kinds else "none"
    return found


def check_compression(spark: SparkSession, path: str) -> None:
    """Refuse files Spark would misread: xz, or a compressed file without its extension."""
    files = compression(spark, path)
    if not files:
        raise FileNotFoundError(path)
    for name, kind in files.items():
        if kind == "none":
            continue
        if kind not in EXTENSIONS:
            raise ValueError(f"{kind} files cannot be read: {name}")
        if not name.endswith(EXTENSIONS[kind]):
            raise ValueError(f"{kind} file without its extension: {name}")


def read_fasta(spark: SparkSession, path: str, first_token: bool = False) -> DataFrame:
    """``seq_id, seq`` per record; records are split by the reader, not collected.

    A gzip file is one task up to here: repartition after reading it.
    """
    check_compression(spark, path)
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    parts = F.split(record, "\r?\n", 2)
    header = F.trim(F.get(parts, F.lit(0)))
    if first_token:
        header = F.get(F.split(header, r"\s+", 2), F.lit(0))
    body = F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "")
    return raw.where(F.trim("value") != "").select(
        header.alias("seq_id"), F.upper(body).alias("seq")
    )


def fasta_text(name: Column, seq: Column, width: int = 70) -> Column:
    """One record: header line and wrapped sequence lines."""
    wrapped = F.regexp_replace(seq, "(.{%d})" % width, "$1\n")
    return F.concat(F.lit(">"), name, F.lit("\n"), F.regexp_replace(wrapped, "\n$", ""))


def write_fasta(
    df: DataFrame, path: str, width: int = 70, label: str | None = None,
    key: str = "seq_id", seq: str = "seq", mode: str = "errorifexists",
) -> None:
    name = F.col(key).cast("string")
    if label:
        name = F.concat(name, F.lit("__class="), F.col(label).cast("string"))
    df.select(fasta_text(name, F.col(seq), width).alias("value")).write.mode(mode).text(path)


def read_labeled_csv(
    spark: SparkSession, path: str, label_col: int = 0, seq_col: int = 1, id_col: int | None = 2
) -> DataFrame:
    """Headerless labelled fragments: ``label, seq, seq_id``.

    Without an id column a row is named ``seq_<n>``, n being its rank in the hash order of its
    content, which does not depend on how the file is split.
    """
    width = max(label_col, seq_col, id_col or 0) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.schema(schema).csv(path)
    cols = [F.col(f"c{label_col}").cast("int").alias("label"), F.col(f"c{seq_col}").alias("seq")]
    if id_col is not None:
        return raw.select(*cols, F.col(f"c{id_col}").alias("seq_id"))
    rows = raw.select(*cols).withColumn("_h", row_hash("label", "seq"))
    ranked = rank_rows(rows, [], ["_h", "seq", "label"], hash_bucket("_h", bits_of(rows.count())), "_n")
    return ranked.withColumn("seq_id", F.concat(F.lit("seq_"), F.col("_n").cast("string"))).drop(
        "_h", "_n"
    )


def write_labeled_csv(
    df: DataFrame, path: str, split: str | None = None, mode: str = "errorifexists"
) -> None:
    """``label, seq, seq_id``; one folder per split that has rows."""
    cols = ["label", "seq", "seq_id"]
    if split is None:
        df.select(*cols).write.mode(mode).csv(path)
    else:
        df.select(split, *cols).write.mode(mode).partitionBy(split).csv(path)


def to_columns(df: DataFrame, header: str = "seq_id") -> DataFrame:
    """Split ``id__class=label`` headers."""
    name, label = strip_class_suffix(header)
    return df.withColumns({header: name, "label": label})


def to_headers(df: DataFrame, key: str = "seq_id", label: str = "label") -> DataFrame:
    joined = F.concat_ws("__class=", F.col(key).cast("string"), F.col(label).cast("string"))
    return df.withColumn(key, joined).drop(label)
