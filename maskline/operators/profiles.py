"""Hint profiles of sources: fields that hold identities there, and words that must stay.

A profile names sources by parts of their names.  Names and parts meet in an
equi-join on n-grams: each part is posted once, under the n-gram of its own that
fewest parts have, and only names with that n-gram are tested.  The first
profile that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import values

#: rank orders the profiles; ``match`` are the parts, the profile's own name if there are none.
PROFILES = "rank int, profile string, match array<string>, identity_fields array<string>, never array<string>, note string"
GRAM = 3


def canonical(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _grams(text: Column, size: Column) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def matched(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """(name, profile) of the first profile that has a part of the name; names without one are left out."""
    own = F.when(F.size("match") > 0, F.col("match")).otherwise(F.array("profile"))
    parts = profiles.select("rank", "profile", F.explode(own).alias("part")).withColumn("part", canonical(F.col("part"))).where("part <> ''").distinct()
    each = parts.withColumn("gram", F.explode(_grams(F.col("part"), F.least(F.length("part"), F.lit(GRAM)))))
    times = each.groupBy("gram").agg(F.count("*").alias("n"))
    posted = each.join(times, "gram").groupBy("rank", "profile", "part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    known = names.select("name").distinct().withColumn("key", canonical(F.col("name")))
    looked = known.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("key"), F.lit(k)) for k in range(1, GRAM + 1)])))))
    met = looked.join(posted, "gram").where(F.col("key").contains(F.col("part")))
    return met.groupBy("name").agg(F.min_by("profile", "rank").alias("profile"))


def identity_hits(pairs: DataFrame, sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Hits of fields (sample_id, line_no, field, value) that the profile of the sample's source (sample_id, profile) holds for identities."""
    asked = sources.join(profiles, "profile").select("sample_id", F.explode("identity_fields").alias("wanted"))
    asked = asked.select("sample_id", values.canon_field(F.col("wanted")).alias("canon")).distinct()
    rows = pairs.withColumn("canon", values.canon_field(F.col("field"))).join(asked, ["sample_id", "canon"])
    value = values.field_value(F.col("value"))
    kind = F.coalesce(F.when(values.ipv4_class(value).isNotNull(), F.lit("ipv4")), values.field_kind(F.col("field")), F.lit("user"))
    rows = rows.select("sample_id", "line_no", value.alias("value"), kind.alias("kind"), F.concat(F.lit("profile field "), "field").alias("via"), F.lit(13).alias("pass"), F.lit(False).alias("version"))
    return rows.where((F.length("value") > 1) & ~values.is_never(F.col("value")) & ((F.col("kind") != "ipv4") | values.ipv4_class(F.col("value")).isNotNull()))


def without_words(hits: DataFrame, sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Hits but for values that the profile of the sample's source says are its vocabulary."""
    words = sources.join(profiles, "profile").select("sample_id", F.explode("never").alias("word")).select("sample_id", F.lower("word").alias("_low")).distinct()
    return hits.withColumn("_low", F.lower("value")).join(words, ["sample_id", "_low"], "left_anti").select(hits.columns)
