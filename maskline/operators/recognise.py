"""What format lines have and which source a name means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import fixed
from maskline.functions.values import canonical_sourcetype
from maskline.operators import parsers


def line_format(raw: Column) -> Column:
    pairs = F.regexp_count(raw, F.lit(r"(?<![\w.\-])[\w.\-]++=\S"))
    return (
        F.when(raw.rlike(r"LEEF:[\d.]+\|"), "leef").when(raw.rlike(r"CEF:\d+\|"), "cef")
        .when(raw.rlike(r"^\s*[{\[]") & F.try_parse_json(raw).isNotNull(), "json")
        .when(raw.rlike(r"^\s*<[?A-Za-z]"), "xml").when(pairs >= 3, "kvp")
        .when(raw.rlike(r"^(<\d{1,3}>)?([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\S+) \S+ "), "syslog")
        .when(pairs >= 1, "kvp").otherwise("text")
    )


def format_shares(lines: DataFrame, most: int | None = 50) -> DataFrame:
    """Lines and share of each format among each sample's first lines."""
    if most:
        order = Window.partitionBy("sample_id").orderBy("line_no")
        lines = lines.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    counted = lines.groupBy("sample_id", line_format(F.col("raw")).alias("format")).agg(F.count("*").alias("lines"))
    total = counted.groupBy("sample_id").agg(F.sum("lines").cast("long").alias("total"))
    return counted.join(total, "sample_id")


def describe(lines: DataFrame) -> DataFrame:
    """The most frequent format of each sample; mixed unless it has over half."""
    shares = format_shares(lines)
    best = shares.groupBy("sample_id").agg(F.max_by(F.struct("format", "lines", "total"), F.struct("lines", "format")).alias("b"))
    return best.select("sample_id", "b.format", "b.lines", (F.col("b.lines") <= fixed.MIXED_SHARE * F.col("b.total")).alias("mixed"))


def dominant_delimiter(lines: DataFrame) -> DataFrame:
    """Delimiter and column count that at least 70 % of a sample's lines share (tab, comma, pipe in that order)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(d).alias("delimiter"), (F.regexp_count("raw", F.lit(p)) + 1).alias("columns")) for k, (d, p) in enumerate([("\t", "\t"), (",", ","), ("|", r"\|")])]))
    counted = lines.select("sample_id", each.alias("e")).groupBy("sample_id", "e.rank", "e.delimiter", "e.columns").agg(F.count("*").alias("lines"))
    total = lines.groupBy("sample_id").agg(F.count("*").alias("total"))
    good = counted.join(total, "sample_id").where((F.col("columns") >= fixed.DELIMITED_COLUMNS) & (F.col("lines") >= fixed.DELIMITED_SHARE * F.col("total")))
    return good.groupBy("sample_id").agg(F.min_by(F.struct("delimiter", "columns"), "rank").alias("b")).select("sample_id", "b.*")


def dominant_header(lines: DataFrame) -> DataFrame:
    """The most frequent CEF or LEEF vendor and product of each sample."""
    heads = lines.withColumn("h", parsers.security_header(F.col("raw"))).where("h is not null")
    counted = heads.groupBy("sample_id", "h.format", "h.vendor", "h.product").agg(F.count("*").alias("lines"))
    return counted.groupBy("sample_id").agg(F.max_by(F.struct("format", "vendor", "product", "lines"), F.struct("lines", "vendor", "product")).alias("b")).select("sample_id", "b.*")


def sample_keys(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("sample_id").agg(F.array_sort(F.collect_set(F.lower("field"))).alias("keys"))


def recognise_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, canonical, tier, match) against known(sourcetype): exact, without rotation, no event source, one edit, or unresolved.

    A one-edit match shares the first or the second half with its name, so
    candidates come from an equi-join on halves, not from all pairs.
    """
    rows = names.withColumn("canonical", canonical_sourcetype(F.col("name")))
    rows = rows.withColumn("bare", F.regexp_replace("canonical", r"(_(\d+|log|gz|json|csv|xml|old|bak))+$", ""))
    rows = rows.withColumn("non_event", F.col("bare").rlike("(^|_)(" + "|".join(fixed.NON_EVENT) + ")$"))
    k = known.select(canonical_sourcetype(F.col("sourcetype")).alias("key")).distinct()
    exact, bare = k.select(F.col("key").alias("canonical"), F.col("key").alias("exact")), k.select(F.col("key").alias("bare"), F.col("key").alias("stripped"))
    rows = rows.join(exact, "canonical", "left").join(bare, "bare", "left")

    def pieces(c: str) -> Column:
        n = F.length(c)
        cuts = [F.floor(n / 2), F.floor((n + 1) / 2), F.floor((n - 1) / 2)]
        return F.array_distinct(F.concat(
            F.array(*[F.concat(F.lit("<"), F.substring(F.col(c), F.lit(1), x.cast("int"))) for x in cuts]),
            F.array(*[F.concat(F.lit(">"), F.substring(F.col(c), (x + 1).cast("int"), n)) for x in cuts]),
        ))

    left = rows.where("exact is null and stripped is null and not non_event").select("bare").distinct()
    near = left.withColumn("piece", F.explode(pieces("bare"))).join(k.withColumn("piece", F.explode(pieces("key"))), "piece")
    near = near.where((F.levenshtein("bare", "key", 1) >= 0) & (F.levenshtein("bare", "key") <= 1)).groupBy("bare").agg(F.min("key").alias("fuzzy"))
    rows = rows.join(near, "bare", "left")
    tier = (
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("stripped").isNotNull(), "stripped").when(F.col("non_event"), "non-event")
        .when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("unresolved")
    )
    match = F.coalesce("exact", "stripped", F.when(~F.col("non_event"), F.col("fuzzy")))
    return rows.select("name", "canonical", tier.alias("tier"), match.alias("match"))
