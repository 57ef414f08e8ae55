"""Where the plan touches lines: places in the text before and in the text after.

Places come from the replacer's own hits, so what is marked is what is replaced.
The map from before to after is a running sum of length differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.operators import apply, spans


def _placed(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(sample_id, line_no, number, start, finish, original, alias, kind): the replacer's hits, places from 0."""
    found = apply.picked(lines, entries)
    runs, between = spans.cut(F.col("raw"), spans.RUN, keys=True)
    rows = lines.join(found, ["sample_id", "line_no"]).withColumns({"runs": runs, "between": between})
    rows = rows.withColumn("sizes", F.flatten(F.transform("between", lambda b, i: F.array(F.length(b), F.coalesce(F.length(F.get("runs", i)), F.lit(0))))))
    rows = rows.select("sample_id", "line_no", "sizes", F.posexplode("picks").alias("number", "p"))
    total = lambda low, n: F.aggregate(F.slice("sizes", low, n), F.lit(0), lambda a, x: a + x)
    p = F.col("p")
    quote = F.when(p["key"], 1).otherwise(0)
    begin = total(F.lit(1), 2 * p["at"] + 1)
    size = total(2 * p["at"] + 2, 2 * p["n"] - 1)
    start, finish = begin - p["lead"] + quote, begin + size - p["cut"] + p["tail"] - quote
    return rows.select("sample_id", "line_no", "number", start.alias("start"), finish.alias("finish"), p["original"].alias("original"), p["alias"].alias("alias"), p["kind"].alias("kind"))


def marked(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Every place that an entry covers, whether it is enabled or not: (sample_id, line_no, start, finish, original, kind, enabled)."""
    unlike = entries.where("alias <> original")
    placed = _placed(lines, unlike.withColumn("enabled", F.lit(True)))
    return placed.drop("alias", "number").join(unlike.select("original", "kind", "enabled"), ["original", "kind"])


def mapped(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Every replacement with its place before (start, finish) and after (after_start, after_finish)."""
    rows = _placed(lines, entries)
    before = Window.partitionBy("sample_id", "line_no").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("alias") - (F.col("finish") - F.col("start"))).over(before), F.lit(0)).cast("int")
    rows = rows.withColumn("after_start", F.col("start") + shift)
    return rows.withColumn("after_finish", F.col("after_start") + F.length("alias")).drop("number")


def preview(lines: DataFrame, entries: DataFrame, most: int = 200, trying: Column | None = None, bad: Column | None = None) -> DataFrame:
    """The first changed lines with spans of both sides; ``trying`` and ``bad`` say of an entry that it is provisional or breaks the format."""
    flags = {"trying": trying if trying is not None else F.lit(False), "bad": bad if bad is not None else F.lit(False)}
    rows = mapped(lines, entries).withColumns(flags)
    first = rows.select("sample_id", "line_no").distinct().orderBy("sample_id", "line_no").limit(most)
    side = lambda a, b: F.array_sort(F.collect_list(F.struct(F.col(a).alias("start"), F.col(b).alias("finish"), "trying", "bad")))
    spans_of = rows.join(first, ["sample_id", "line_no"], "left_semi").groupBy("sample_id", "line_no").agg(
        side("start", "finish").alias("before_spans"), side("after_start", "after_finish").alias("after_spans")
    )
    shown = apply.applied(lines.join(first, ["sample_id", "line_no"], "left_semi"), entries)
    return shown.select("sample_id", "line_no", F.col("raw").alias("before"), "after").join(spans_of, ["sample_id", "line_no"])
