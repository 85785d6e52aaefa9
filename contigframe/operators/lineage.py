"""Durable cut points for iterative jobs and for frames that are used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting gets a folder of its own, which is then kept in
    the setting. On a cluster a machine-local folder would be lost with its machine, so a
    missing setting is an error there.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="contigframe-")
    spark.conf.set(SETTING, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later uses read the same rows whatever is lost in between, and only the columns they need.
    The rows are computed once (a checkpoint would compute them twice).
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark).rstrip('/')}/{app}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
