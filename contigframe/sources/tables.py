"""Reading tables and spreading small scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, key: str, per_core: int = 2) -> DataFrame:
    """Hash-spread a scan that has fewer splits than the cluster has cores.

    A file with one row group is one task however many cores are free. A scan with enough
    splits is left alone, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= per_core * cores:
        return df
    return df.repartition(per_core * cores, key)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
