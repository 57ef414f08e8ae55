"""Whether generated or captured lines are usable, and which to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import fixed
from maskline.operators import recognise


def usability(lines: DataFrame) -> DataFrame:
    """Refusals, empty events and exact repeats of each sample, and whether it is usable."""
    refusal = F.trim("raw").rlike(fixed.REFUSAL)
    empty = F.trim("raw").isin("{}", "[]", "null", '""')
    rows = lines.groupBy("sample_id").agg(
        F.count("*").alias("lines"), F.count_if(refusal).alias("refusals"), F.count_if(empty).alias("empty"),
        F.count_distinct("raw").alias("distinct_lines"),
    )
    good = (F.col("refusals") < fixed.REFUSAL_SHARE * F.col("lines")) & (F.col("empty") < fixed.DEGENERATE_SHARE * F.col("lines"))
    return rows.withColumn("usable", good)


def round_robin(lines: DataFrame, group: str, most: int = fixed.ROUND_ROBIN_EVENTS, size: int = fixed.ROUND_ROBIN_BYTES) -> DataFrame:
    """Distinct lines of each sample taken in turn from its groups, up to a count and a size."""
    first = lines.groupBy("sample_id", group, "raw").agg(F.min("line_no").alias("line_no"))
    turn = F.row_number().over(Window.partitionBy("sample_id", group).orderBy("line_no"))
    rows = first.withColumn("turn", turn).where(F.col("turn") <= most)
    order = Window.partitionBy("sample_id").orderBy("turn", group)
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("size", F.sum(F.length("raw")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") <= most) & (F.col("size") <= size)).select("sample_id", group, "raw", "line_no", "place")


def structure_verdict(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Samples with at most a tenth of exact repeats and three keys or more."""
    rows = lines.groupBy("sample_id").agg(F.count("*").alias("lines"), F.count_distinct("raw").alias("distinct_lines"))
    rows = rows.join(keys, "sample_id", "left")
    ok = ((F.col("lines") - F.col("distinct_lines")) * 10 <= F.col("lines")) & (F.coalesce(F.size("keys"), F.lit(0)) >= fixed.VERIFY_FIELDS)
    return rows.select("sample_id", "lines", "distinct_lines", ok.alias("verified"))


def shape_universe(lines: DataFrame) -> DataFrame:
    """Formats, words and length range of each sample's real lines."""
    each = F.array_distinct(F.regexp_extract_all(F.lower("raw"), F.lit("[a-z]{3,}"), F.lit(0)))
    # Words are made distinct as rows, so that a group holds the vocabulary and not the lines.
    words = lines.select("sample_id", F.explode(each).alias("word")).distinct().groupBy("sample_id").agg(F.collect_list("word").alias("words"))
    shapes = lines.groupBy("sample_id").agg(
        F.collect_set(recognise.line_format(F.col("raw"))).alias("formats"), F.min(F.length("raw")).alias("shortest"), F.max(F.length("raw")).alias("longest")
    )
    return shapes.join(words, "sample_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def guard_extension(candidates: DataFrame, universe: DataFrame, real: DataFrame) -> DataFrame:
    """Candidate lines with the reason of their rejection, null where they may join the sample."""
    rows = candidates.join(universe, "sample_id").join(real.select("sample_id", "raw", F.lit(True).alias("known")).distinct(), ["sample_id", "raw"], "left")
    words = F.array_distinct(F.regexp_extract_all(F.lower("raw"), F.lit("[a-z]{3,}"), F.lit(0)))
    old = F.size(F.array_intersect(words, F.col("words")))
    reason = (
        F.when(F.col("known"), "duplicate").when(F.length("raw") < fixed.EXTEND_SHORT * F.col("shortest"), "too short")
        .when(F.length("raw") > fixed.EXTEND_LONG * F.col("longest"), "too long")
        .when(~F.array_contains("formats", recognise.line_format(F.col("raw"))), "format")
        .when(old < fixed.EXTEND_VOCABULARY * F.size(words), "vocabulary")
    )
    return rows.select("sample_id", "line_no", "raw", reason.alias("reason"))


def key_echo(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Samples whose name (sample_id, sourcetype) stands in over half of the lines as program, field name or value.

    Names of one word are left out, because daemons are called like that; of
    several finds, the one in most lines is returned.
    """
    raw_name = F.lower(F.trim(F.substring_index("sourcetype", "::", 1)))
    words = F.filter(F.split(raw_name, "[^a-z0-9]+"), lambda x: x != "")
    joined = [F.array_join(words, sep) for sep in ("", "_", "-", ".")]
    forms = F.filter(F.array_distinct(F.array(raw_name, *joined)), lambda f: F.length(f) >= 6)
    spelled = names.where(F.size(words) >= 2).select("sample_id", F.explode(forms).alias("form"))
    rows = lines.where(F.trim("raw") != "").select("sample_id", F.lower("raw").alias("raw"))
    total = rows.groupBy("sample_id").agg(F.count("*").alias("checked"))
    near = rows.join(spelled, "sample_id").where(F.contains("raw", "form"))
    form = F.concat(F.lit(r"\Q"), F.col("form"), F.lit(r"\E"))
    program = F.regexp_extract("raw", r"(?:^|\s)([a-z][\w.-]{2,})(?:\[\d+\])?:\s", 1) == F.col("form")
    field = F.regexp_like("raw", F.concat(F.lit(r"""(?:^|[\s,{"'])"?"""), form, F.lit(r'"?\s*[=:]')))
    value = F.regexp_like("raw", F.concat(F.lit(r'[=:]\s*"?'), form, F.lit(r"""(?:"?(?:[\s,"'}]|$))""")))
    position = F.when(program, "syslog-program").when(field, "field-name").when(value, "field-value")
    counted = near.select("sample_id", "form", position.alias("position")).where("position is not null").groupBy("sample_id", "form", "position").agg(F.count("*").alias("lines"))
    most = counted.join(total, "sample_id").where(F.col("lines") * 2 > F.col("checked"))
    best = most.groupBy("sample_id").agg(F.max_by(F.struct("form", "position", "lines", "checked"), F.struct("lines", "form", "position")).alias("b"))
    return best.select("sample_id", "b.*")


def evidence(verdict: Column, method: Column) -> Column:
    """What a passed check proves."""
    passed = (
        F.when(method == "parser-emulation", "parser-verified").when(method == "source-expectation", "format-declared")
        .when(method == "structure", "structure-only").otherwise("none")
    )
    return F.when(verdict == "pass", passed).otherwise("none")
