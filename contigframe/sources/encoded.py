"""Encoded training samples as Parquet, with a one-row manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import label_one_hot, one_hot, pad_frames
from ..operators.lineage import cut
from ..operators.skew import with_single


def write_encoded(
    df: DataFrame, path: str, manifest: dict, mode: str = "errorifexists"
) -> None:
    """Samples partitioned by ``shard`` under ``samples``, the manifest beside them."""
    df.write.mode(mode).partitionBy("shard").parquet(f"{path}/samples")
    text = json.dumps(manifest, sort_keys=True)
    one = df.sparkSession.range(1).select(F.lit(text).alias("value"))
    one.coalesce(1).write.mode(mode).text(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def read_encoded(
    spark: SparkSession,
    path: str,
    features: list[str],
    one_hot_depth: int | None = None,
    classes: int | None = None,
    pad_to: int | None = None,
) -> DataFrame:
    """Selected arrays and the label, padded and one-hot coded on request.

    The label column may be called ``label`` or ``labels``.
    """
    df = spark.read.parquet(f"{path}/samples")
    if "labels" in df.columns and "label" not in df.columns:
        df = df.withColumnRenamed("labels", "label")
    out = []
    for name in features:
        value = F.col(name)
        if pad_to is not None:
            value = pad_frames(value.cast("array<array<int>>"), pad_to)
        if one_hot_depth is not None:
            value = F.transform(value, lambda f: one_hot(f, one_hot_depth))
        out.append(value.alias(name))
    label = F.col("label") if classes is None else label_one_hot(F.col("label"), classes)
    return df.select(*out, label.alias("label"), "shard")


def union_padded(parts: list[DataFrame], feature: str, value: int = 0) -> DataFrame:
    """Union of sets of different lengths, padded to the longest; the true length is kept."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sized = cut(every.withColumn("length", F.size(feature)))  # read twice
    longest = sized.agg(F.max("length").alias("_width"))
    return (
        with_single(sized, longest)
        .withColumn(
            feature,
            F.concat(
                F.col(feature), F.array_repeat(F.lit(value), F.col("_width") - F.col("length"))
            ),
        )
        .drop("_width")
    )
