"""Lines (sample_id, line_no, raw) from tables, files and event objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan, dealt anew where its files give fewer partitions than twice the cores.

    Detection costs far more than reading, and a file of one row group is one
    task.  Only a small scan has so few partitions, so only a small one moves.
    """
    wanted = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(wanted) if rows.rdd.getNumPartitions() < wanted else rows


def normalised(text: Column) -> Column:
    """One event a line: CRLF to LF, adjacent <Event> elements apart."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(unix, r">\s*<Event(?=[\s>])", ">\n<Event")


def to_lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every non-blank line with its 1-based number in the text."""
    split = F.split(normalised(F.col(text_col)), "\n")
    rows = texts.select(F.col(id_col).cast("string").alias("sample_id"), F.posexplode(split).alias("n", "raw"))
    return rows.where(F.trim("raw") != "").select("sample_id", (F.col("n") + 1).cast("long").alias("line_no"), "raw")


def read_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Text files as samples named by their path; larger ones are refused."""
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_size")
    if most_bytes is not None:
        files = files.where(F.col("file_size") <= most_bytes)
    return to_lines(files, "file_path", "value")


def event_line(event: Column) -> Column:
    """An event object's _raw if it has one, else its JSON."""
    raw = F.get_json_object(event, "$._raw")
    return F.when(F.trim(raw) != "", raw).otherwise(event)


def flattened(event: Column) -> Column:
    """A multi-line event as one line."""
    return F.regexp_replace(event, r"\n\s*", " ")


def events_array(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A JSON array, or an object with ``events``, one line an event."""
    body = F.coalesce(F.get_json_object(text_col, "$.events"), F.col(text_col))
    items = F.from_json(body, "array<string>")
    rows = texts.select(F.col(id_col).cast("string").alias("sample_id"), F.posexplode(items).alias("n", "event"))
    return rows.select("sample_id", (F.col("n") + 1).cast("long").alias("line_no"), flattened(event_line(F.col("event"))).alias("raw"))


def without_control_fields(events: DataFrame, prefix: str = "__") -> DataFrame:
    return events.select(*[c for c in events.columns if not c.startswith(prefix)])
