"""Hits to entries: one row a distinct value, with kind, count and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import values
from maskline.operators import apply, mint, parsers, prove
from maskline.sources.store import kept


def entries(hits: DataFrame) -> DataFrame:
    """(original, kind, via, count, ip_class, enabled): the earliest pass names the kind.

    An address that stands for a version wherever it stands is no entry.
    """
    first = F.min_by(F.struct("kind", "via"), F.struct("pass", "kind", "via"))
    named = F.count_if("version") if "version" in hits.columns else F.count_if(F.lit(False))
    rows = hits.groupBy(F.col("value").alias("original")).agg(first.alias("f"), (F.count("*") - named).alias("count"), named.alias("versions"))
    return rows.where((F.col("versions") == 0) | (F.col("count") > F.col("versions"))).select(
        "original", "f.kind", "f.via", "count",
        F.when(F.col("f.kind") == "ipv4", values.ipv4_class(F.col("original"))).alias("ip_class"),
        F.lit(True).alias("enabled"),
    )


def with_literals(found: DataFrame, lines: DataFrame, literals: list[str]) -> DataFrame:
    """Entries and the values picked by hand, counted in one pass; a pick overrides the kind."""
    if not literals:
        return found
    n = F.array(*[F.struct(F.lit(x).alias("original"), (F.size(F.split("raw", "\\Q" + x.replace("\\E", "\\E\\\\E\\Q") + "\\E")) - 1).alias("n")) for x in literals])
    rows = lines.select(F.inline(F.filter(n, lambda x: x["n"] > 0))).groupBy("original").agg(F.sum("n").cast("long").alias("count"))
    picks = rows.select(
        "original", F.lit("custom").alias("kind"), F.lit("picked").alias("via"), "count",
        F.lit(None).cast("string").alias("ip_class"), F.lit(True).alias("enabled"),
    )
    return found.join(picks.select("original"), "original", "left_anti").unionByName(picks)


def collapse_composites(found: DataFrame) -> DataFrame:
    """Values with : or / whose parts are entries themselves go; the parts of one that was enabled are enabled."""
    whole = found.where(F.col("original").rlike("[:/]") & ~F.col("kind").isin("ipv6", "mac", "secret", "custom"))
    parts = whole.select("original", "enabled", F.explode(F.array_distinct(F.split("original", r"[^\w.$\-]+"))).alias("part")).where("length(part) > 2 and part <> original")
    known = parts.join(found.select(F.col("original").alias("part")), "part", "left_semi")
    ticked = known.where("enabled").select(F.col("part").alias("original")).distinct().withColumn("_ticked", F.lit(True))
    left = found.join(known.select("original").distinct(), "original", "left_anti").join(ticked, "original", "left")
    return left.withColumn("enabled", F.col("enabled") | F.coalesce("_ticked", F.lit(False))).select(found.columns)


def with_gaps(found: DataFrame, gaps: DataFrame) -> DataFrame:
    """Entries and the values (field, value) that the coverage proof still names, enabled, of the kind that value and field say."""
    v, named = F.col("value"), values.field_kind(F.col("field"))
    kind = (
        F.when(values.ipv4_class(v).isNotNull(), "ipv4").when(v.rlike(r"(?i)^(?!\d+\.)[a-z0-9\-]+(\.[a-z0-9\-]+)*\.[a-z]{2,}$"), "fqdn")
        .when(named.isin("user", "host") & v.rlike(r"^[\w.@\-]+$"), named).otherwise("pii")
    )
    said = gaps.where("value <> ''").groupBy("value").agg(F.min_by(F.struct(kind.alias("kind"), "field"), "field").alias("g"), F.count("*").alias("count"))
    new = said.select(
        F.col("value").alias("original"), F.col("g.kind").alias("kind"), F.concat(F.lit("parsed field "), "g.field").alias("via"), "count",
        F.when(F.col("g.kind") == "ipv4", values.ipv4_class(F.col("value"))).alias("ip_class"), F.lit(True).alias("enabled"),
    )
    on = found.where("enabled").select("original")
    new = new.join(on, "original", "left_anti")
    return found.join(new.select("original"), "original", "left_anti").unionByName(new)


def closed(lines: DataFrame, found: DataFrame, salt: str, read=parsers.named_values) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, changed, gaps): plan, apply and proof in turn until the proof of fields names no gap, or the same gaps again.

    ``read`` gives the fields (sample_id, line_no, field, value) of lines.  Each turn
    adds all gaps at once, so turns are few: a gap is new only where parts of a
    composite were collapsed, or a value was hidden inside another.
    """
    before = kept(read(lines))
    seen = -1
    while True:
        entries = kept(mint.with_aliases(kept(collapse_composites(found)), salt))
        changed = kept(apply.applied(lines, entries))
        proof = prove.coverage(before, read(changed.select("sample_id", "line_no", F.col("after").alias("raw"))))
        gaps = kept(proof.where("not replaced").select("sample_id", "line_no", "field", "value"))
        n = gaps.count()
        if not n or n == seen:
            return entries, changed, gaps
        seen = n
        found = kept(with_gaps(entries.drop("alias"), gaps))


def census(pairs: DataFrame) -> DataFrame:
    """Occurrences and distinct values of each field."""
    return pairs.groupBy(values.canon_field(F.col("field")).alias("field")).agg(
        F.count("*").alias("occurrences"), F.count_distinct("value").alias("distinct_values")
    )


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("entries"), F.sum("count").cast("long").alias("hits"))


def review(found: DataFrame, most: int = 200) -> DataFrame:
    """Entries by review group, the first that fits, at most so many a group."""
    group = (
        F.when(F.col("kind") == "secret", "secrets").when(F.col("kind") == "pii", "personal").when(F.col("kind").isin("ipv4", "ipv6", "mac"), "addresses")
        .when(F.col("kind").isin("host", "fqdn"), "hosts").when(F.col("kind").isin("user", "email"), "people").otherwise("other")
    )
    order = Window.partitionBy("group").orderBy(F.desc("count"), "original")
    return found.withColumn("group", group).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
