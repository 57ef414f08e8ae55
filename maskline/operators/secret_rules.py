"""Secrets by a table of rules: a shape, and words that must stand shortly before it.

A rule of literal precision is its own evidence; any other fires only where one
of its anchor words stands within WINDOW characters before the hit, which is a
look-behind of bounded length in the rule's own pattern.  So the rules, which
are configuration, become one projection over the lines, without a join.  Of a
hit that begins with a name only the value counts, of a connection's address
only the password.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import fixed

RULES = "id string, pattern string, precision string, anchors array<string>"
WINDOW = 40
_NAMED = r"^[A-Za-z][\w.\-]*+\s*+[=:]\s*+(?=[\s\S])"
_URI = r"^[A-Za-z][\w+.\-]*+://[^:/\s\"']++:([^@/\s\"']++)@"


def defaults(like: DataFrame) -> DataFrame:
    """The rules that come along (``fixed.SECRET_RULES``)."""
    return like.sparkSession.createDataFrame(fixed.SECRET_RULES, RULES)


def anchored(pattern: str, anchors: list[str]) -> str:
    """The pattern where one of the words, in any case, ends at most so far before it that it lies in the window whole."""
    quoted = [(x, "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E") for x in anchors if 0 < len(x) <= WINDOW]
    if not quoted:
        return r"(?!)"
    before = "|".join(rf"(?iu:{q})[\s\S]{{0,{WINDOW - len(x)}}}" for x, q in quoted)
    return rf"(?<={before})(?:{pattern})"


def _value(hit: Column) -> Column:
    """(value, short): what of a hit is the secret; a connection's password may be short."""
    bare = F.when(hit.contains("://"), hit).otherwise(F.regexp_replace(hit, _NAMED, ""))
    password = F.regexp_extract(bare, _URI, 1)
    return F.struct(F.when(password != "", password).otherwise(bare).alias("value"), (password != "").alias("short"))


def _finding(order: Column, name: Column):
    return lambda h: F.struct(order.alias("order"), name.alias("rule"), _value(h).alias("v"))


def findings(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(sample_id, line_no, rule, value): distinct secrets of each line under the first rule that finds them."""
    found = []
    for k, rule in enumerate(rules.orderBy("id").collect()):  # configuration
        pattern = rule.pattern if rule.precision == "literal" else anchored(rule.pattern, rule.anchors or [])
        low = F.lower("raw")
        some = F.lit(True) if rule.precision == "literal" else F.exists(F.array(*[F.lit(x.lower()) for x in rule.anchors or [""]]), lambda a: F.contains(low, a))
        hits = F.when(some, F.regexp_extract_all("raw", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        order, name = F.lit(k), F.lit(rule.id)
        found.append(F.transform(hits, _finding(order, name)))
    if not found:
        return lines.sparkSession.createDataFrame([], "sample_id string, line_no long, rule string, value string")
    rows = lines.select("sample_id", "line_no", F.explode(F.concat(*found)).alias("h")).select("sample_id", "line_no", "h.order", "h.rule", "h.v.*")
    rows = rows.where((F.col("value") != "") & (F.col("short") | (F.length(F.trim("value")) >= fixed.SECRET_LENGTH)))
    return rows.groupBy("sample_id", "line_no", "value").agg(F.min_by("rule", "order").alias("rule")).select("sample_id", "line_no", "rule", "value")


def hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The findings as the detectors make hits."""
    via = F.concat(F.lit("secret rule "), "rule")
    return findings(lines, rules).select("sample_id", "line_no", "value", F.lit("secret").alias("kind"), via.alias("via"), F.lit(12).alias("pass"), F.lit(False).alias("version"))
