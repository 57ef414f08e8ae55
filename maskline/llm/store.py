"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a folder of our own, but only in local mode: a cluster's
    executors could not read it.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="maskline-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/maskline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it exists; False if it does, whoever wrote it.

    The text is written aside and appears under its name whole and at once: by
    a hard link on a mounted folder, else by a rename of the file, which HDFS
    refuses where the name is taken.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    to, aside = place(path), place(f"{path}.{uuid.uuid4().hex}.tmp")
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(to.getParent())
    with_text = files.create(aside, False)
    with_text.write(bytearray(text.encode()))
    with_text.close()
    try:
        if to.toUri().getScheme() in (None, "file") and files.getScheme() == "file":
            os.link(aside.toUri().getPath(), to.toUri().getPath())
            return True
        return not files.exists(to) and bool(files.rename(aside, to))
    except FileExistsError:
        return False
    finally:
        files.delete(aside, False)


def get_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.read.text(path, wholetext=True).first()[0]


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 4 << 20) -> None:
    """Let Arrow batches hold so many rows and bytes: theirs are whole texts, some of them very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
