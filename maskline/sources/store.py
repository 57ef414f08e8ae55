"""Tables that a plan reads more than once, kept in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir (in local mode, where it is unset, under one of our own)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="maskline-"))
        folder = context.getCheckpointDir()
    return f"{folder}/kept/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to a fresh folder and read again."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
