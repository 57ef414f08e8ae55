"""Counts and warnings about samples, fields and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import fixed, values
from maskline.operators import recognise

VARIANT_SHARE, CEF_SHARE = 0.1, 0.6


def squash(name: Column) -> Column:
    """A name's letters and digits, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def squashed_duplicates(names: DataFrame, key: str = "key") -> DataFrame:
    """Keys that are their own squashed form while another spelling of them is there too."""
    rows = names.select(F.col(key).alias("key"), squash(F.col(key)).alias("squashed")).distinct()
    others = rows.where("key <> squashed").select(F.col("squashed").alias("key")).distinct()
    return rows.where("key = squashed").select("key").join(others, "key", "left_semi")


def volumes(rows: DataFrame, name: str = "name", events: str = "events") -> DataFrame:
    """(squashed, events): the most events that any spelling of a name has."""
    return rows.groupBy(squash(F.col(name)).alias("squashed")).agg(F.max(events).alias("events"))


def with_volume(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """The names with the events of their squashed form, null where it is unknown."""
    return names.withColumn("squashed", squash(F.col(name))).join(index, "squashed", "left").drop("squashed")


def member_counts(groups: DataFrame, members: DataFrame, group: str = "group") -> DataFrame:
    """Each group with the number of its members, 0 too."""
    counted = members.groupBy(group).agg(F.count("*").alias("members"))
    return groups.join(counted, group, "left").withColumn("members", F.coalesce("members", F.lit(0)))


def credentials(lines: DataFrame) -> DataFrame:
    """(sample_id, line_no, rule): the number of the first published credential shape in a line that has one."""
    rule = F.lit(None).cast("int")
    for number, shape in reversed(list(enumerate(fixed.CREDENTIALS))):
        rule = F.when(F.col("raw").rlike(shape), number).otherwise(rule)
    return lines.select("sample_id", "line_no", rule.alias("rule")).where("rule is not null")


def event_labels(lines: DataFrame) -> DataFrame:
    """The lines with ``label``: refusal, empty or event."""
    bare = F.trim("raw")
    return lines.withColumn("label", F.when(bare.rlike(fixed.REFUSAL), "refusal").when(bare.isin("", "{}", "[]", "null", '""'), "empty").otherwise("event"))


def variants(lines: DataFrame) -> DataFrame:
    """Formats that a tenth of a sample's lines or more have."""
    shares = recognise.format_shares(lines, most=None)
    return shares.where(F.col("lines") >= VARIANT_SHARE * F.col("total")).select("sample_id", "format", "lines")


def starts_with_cef(lines: DataFrame) -> DataFrame:
    """(sample_id, cef): whether 60 % of a sample's lines begin as CEF."""
    return lines.groupBy("sample_id").agg((F.count_if(F.col("raw").rlike(r"^CEF:\d+\|")) >= CEF_SHARE * F.count("*")).alias("cef"))


def business_ids(pairs: DataFrame) -> DataFrame:
    """(field, distinct_values) of fields that number orders, customers and the like, which no alias is made for unasked."""
    canon = values.canon_field(F.col("field"))
    rows = pairs.where(canon.isin(fixed.BUSINESS_FIELDS)).groupBy(canon.alias("field"))
    return rows.agg(F.count_distinct("value").alias("distinct_values"))


def longest_first(entries: DataFrame) -> DataFrame:
    """Entries in the order in which overlapping ones are tried: longest first, then by text."""
    return entries.orderBy(F.desc(F.length("original")), "original")


def html_escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
