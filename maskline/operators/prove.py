"""Proofs over lines before and after: structure, coverage and residue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions import fixed, values
from maskline.operators import spans

ADDRESS_KEY = r'^"(?:[\d.]+|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}|[^"@\s]+(?:@|%40)[^"@\s]+)"$'
STRUCTURAL = ["\t", "|", ",", "="]


def structure(changed: DataFrame) -> DataFrame:
    """Lines (raw, after) whose delimiters or JSON keys changed, with the reason."""
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    delimiters = F.lit(False)
    for x in STRUCTURAL:
        delimiters = delimiters | (count("raw", x) != count("after", x))
    # Keys of all levels; those that are addresses or mailboxes may have changed.
    plain = lambda k: F.when(k.rlike(ADDRESS_KEY), "address").otherwise(k)
    keys = lambda c: F.array_sort(F.transform(F.regexp_extract_all(c, F.lit(spans.JSON_KEY), F.lit(0)), plain))
    is_json = F.col("raw").rlike(r"^\s*[{\[]") & F.try_parse_json("raw").isNotNull()
    reason = (
        F.when(is_json & F.try_parse_json("after").isNull(), "json no longer valid")
        .when(is_json & ~keys("raw").eqNullSafe(keys("after")), "json keys changed")
        .when(~is_json & delimiters, "delimiters changed")
    )
    return changed.select("sample_id", "line_no", reason.alias("reason")).where("reason is not null")


def residual(changed: DataFrame, entries: DataFrame) -> DataFrame:
    """Originals still in the lines, one row a value and line.

    The search doesn't share the replacer's cut: originals are found in any case
    wherever no letter, digit or underscore adjoins them, inside longer words
    too, in what the replacer left (``rest``, where the aliases that it put are
    blank, so that an original which is an alias too is found).  Where lines come
    from elsewhere and have ``after`` only, values that are aliases don't count.
    JSON keys are exempt.
    """
    placed = "rest" in changed.columns
    left = F.col("rest" if placed else "after")
    bare = F.when(spans.is_json(left), F.regexp_replace(left, spans.JSON_KEY, "")).otherwise(left)
    values = spans.sought(entries.select("original", "kind", "enabled"), spans.WORD)
    lines = changed.select("sample_id", "line_no", bare.alias("raw"))
    found = spans.matches(lines, values, spans.WORD, keys=False)
    found = found.select("sample_id", "line_no", "kind", F.lower("original").alias("value")).distinct()
    if not placed:
        found = found.join(entries.select(F.lower("alias").alias("value")), "value", "left_anti")
    return found.select("sample_id", "line_no", "kind", "value")


def released(changed: DataFrame, left: DataFrame) -> DataFrame:
    """The changed lines with ``withheld``; a line with residue (sample_id, line_no) is withheld and gives out no text."""
    bad = left.select("sample_id", "line_no").distinct().withColumn("withheld", F.lit(True))
    rows = changed.join(bad, ["sample_id", "line_no"], "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))
    hidden = {c: F.when(~F.col("withheld"), F.col(c)) for c in ("after", "rest") if c in changed.columns}
    return rows.withColumns(hidden).select("sample_id", "line_no", *hidden, "replaced", "withheld")


def coverage(before: DataFrame, after: DataFrame) -> DataFrame:
    """Identities in fields (sample_id, line_no, field, value) before: replaced or remaining.

    Each (field, value) counts once, at its first line; values never replaced,
    reserved domains and bare digits don't count.
    """
    def named(field):
        """Whether a field may say who or where: what ``values.field_kind`` needs of any name."""
        return values.let(F.lower(field), lambda low: values.has(low, fixed.IDENTITY_WORDS))

    def cheap(p):
        return named(p["field"]) & (p["identity"] != "") & ~p["identity"].rlike(r"^\d+$")

    def counts(p):
        kind, value = values.field_kind(p["field"]), p["identity"]
        plain = ~values.is_never(value) & ~F.lower(value).rlike(fixed.RESERVED_DOMAIN)
        return plain & values.let(kind, lambda k: k.isNotNull() & ((k != "ipv4") | values.ipv4_class(value).isin("private", "public", "cgnat", "link-local")))

    # Tested inside arrays, so that each value is brought to its form once; what costs more is asked of distinct values.
    pair = F.struct("field", values.field_value(F.col("value")).alias("identity"))
    rows = before.select("sample_id", "line_no", F.inline(F.filter(F.array(pair), cheap)))
    first = rows.groupBy("field", "identity").agg(F.min(F.struct("sample_id", "line_no")).alias("p"))
    first = first.select("p.*", F.inline(F.filter(F.array(F.struct("field", "identity")), counts)))
    pair = F.struct("field", values.field_value(F.col("value")).alias("now"))
    now = after.select("sample_id", "line_no", F.inline(F.filter(F.array(pair), lambda p: named(p["field"]))))
    joined = first.join(now, ["sample_id", "line_no", "field"], "left")
    return joined.select("sample_id", "line_no", "field", F.col("identity").alias("value"), (~F.col("identity").eqNullSafe(F.col("now"))).alias("replaced"))


def verdict(proof: DataFrame) -> DataFrame:
    total = F.count("*")
    return proof.agg(
        total.alias("total"), F.count_if("replaced").alias("replaced"), (total == 0).alias("blind"),
        ((total > 0) & (F.count_if(~F.col("replaced")) == 0)).alias("ok"),
    )
