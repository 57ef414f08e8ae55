"""Samples against registries: what a source's samples must look like, and which datatype reads a sample.

Registries are tables.  Keys of samples meet keys of the registry in an inverted
index by the rarest keys only: of a set that must be contained whole, one key is
enough; of a share that must be met, as many as can't all be missed.  The exact
test follows on the pairs that met.  Patterns of a registry meet only the lines
of samples that its row is about.

A registry row is small and their number is that of known sources, so what must
become an expression (the alternatives that every line is tried with) is read
from the table first; that is the only thing read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import fixed
from maskline.functions.values import canonical_sourcetype
from maskline.operators import ladder, parsers, recognise

EXPECTATIONS = "sourcetype string, format string, also array<string>, keys array<string>, patterns array<string>, distinctive boolean, cef boolean"
DATATYPES = "datatype string, anchors array<string>, fields array<string>, evidence string"
#: Keys of an expectation that are looked at, and the share of them that a sample must have.
CRITICAL, ENOUGH = 8, 0.5
#: Lines of a sample that datatypes are tried with; bars of both kinds of match.
TRIED, ANCHOR_BAR, FIELD_BAR, LEAST_FIELDS, LEAST_CONTENT = 40, 0.75, 0.6, 3, 2


def fingerprints(lines: DataFrame) -> DataFrame:
    """(sample_id, format, keys): the form that half of a sample's lines have, unstructured if none does, with its names in lower case."""
    said = recognise.line_format(F.col("raw"))
    form = F.when(said.isin("json", "kvp", "cef"), said).when(said == "leef", "kvp").otherwise("unstructured")
    counted = lines.groupBy("sample_id", form.alias("format")).agg(F.count("*").alias("n"))
    total = counted.groupBy("sample_id").agg(F.sum("n").alias("total"), F.max_by(F.struct("format", "n"), F.struct("n", "format")).alias("best"))
    format_ = F.when(F.col("best.n") * 2 >= F.col("total"), F.col("best.format")).otherwise("unstructured")
    pairs = parsers.named_values(lines).unionByName(
        parsers.long(lines.where(F.col("raw").rlike(r"CEF:\d+\|")).select("sample_id", "line_no", parsers.cef(F.col("raw")).alias("fields")))
    )
    keys = recognise.sample_keys(pairs)
    none = F.array().cast("array<string>")
    return total.select("sample_id", format_.alias("format")).join(keys, "sample_id", "left").select("sample_id", "format", F.coalesce("keys", none).alias("keys"))


def verdicts(lines: DataFrame, named: DataFrame, registry: DataFrame) -> DataFrame:
    """(sample_id, sourcetype, verdict) for samples named (sample_id, sourcetype): match, mismatch, or unknown where nothing is expected."""
    rows = named.withColumn("canonical", canonical_sourcetype(F.col("sourcetype")))
    known = registry.withColumnRenamed("sourcetype", "canonical").withColumnRenamed("format", "expected").withColumn("critical", F.slice(F.transform("keys", F.lower), 1, CRITICAL)).drop("keys")
    asked = rows.join(known, "canonical", "left").join(fingerprints(lines), "sample_id", "left")
    patterns = asked.where(F.size("patterns") > 0).select("sample_id", "sourcetype", F.explode("patterns").alias("pattern"))
    fits = lines.select("sample_id", "raw").join(patterns, "sample_id").groupBy("sample_id", "sourcetype").agg(F.bool_or(F.rlike("raw", F.col("pattern"))).alias("fits"))
    asked = asked.join(fits, ["sample_id", "sourcetype"], "left").join(ladder.cef_source(lines).select("sample_id", F.lit(True).alias("is_cef")), "sample_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n, held = F.size("critical"), F.size(F.array_intersect("critical", "keys"))
    free = F.col("expected") == "unstructured"
    also = F.coalesce(F.call_function("array_contains", F.col("also"), F.col("format")), F.lit(False))
    pairs_alike = F.call_function("array_contains", F.array_append("also", F.col("expected")), F.when(F.col("format") == "cef", "kvp").when(F.col("format") == "kvp", "cef").otherwise("-"))
    compatible = (F.col("expected") == F.col("format")) | also | F.coalesce(pairs_alike, F.lit(False))
    structured = (
        F.when(compatible & (F.col("format") == "cef"), True)
        .when(~compatible, (F.col("format") == "unstructured") & ((n == 0) | (held > 0)))
        .otherwise((n == 0) | (held >= F.ceil(n * ENOUGH)))
    )
    unstructured = F.when(F.size("patterns") > 0, yes("fits")).otherwise((F.col("format") == "unstructured") | (F.size("keys") <= 3))
    match = F.when(F.coalesce(F.col("cef"), F.lit(False)), yes("is_cef")).when(free, unstructured).otherwise(structured)
    verdict = F.when(F.col("expected").isNull() | F.col("format").isNull(), "unknown").when(match, "match").otherwise("mismatch")
    return asked.select("sample_id", "sourcetype", verdict.alias("verdict"))


def golden(lines: DataFrame, registry: DataFrame) -> DataFrame:
    """(sample_id, sourcetype) where exactly one distinctive expectation fits the sample."""
    marks = registry.where("distinctive").select("sourcetype", F.explode("patterns").alias("pattern")).collect()
    if not marks:
        return lines.sparkSession.createDataFrame([], "sample_id string, sourcetype string")
    each = F.array_compact(F.array(*[F.when(F.col("raw").rlike(m.pattern), F.lit(m.sourcetype)) for m in marks]))
    named = lines.select("sample_id", F.explode(each).alias("sourcetype")).distinct()
    good = verdicts(lines, named, registry).where("verdict = 'match'")
    return good.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("sourcetype").alias("sourcetype")).where("n = 1").drop("n")


def _rarest(sets: DataFrame, owner: str, keys: str, frequency: DataFrame, most: Column) -> DataFrame:
    """(owner, key): the ``most`` keys of each set that ``frequency`` (key, n) has least often; unknown ones first."""
    each = sets.select(owner, most.alias("_most"), F.explode(keys).alias("key")).join(frequency, "key", "left")
    place = F.row_number().over(Window.partitionBy(owner).orderBy(F.coalesce("n", F.lit(0)), "key"))
    return each.withColumn("_place", place).where("_place <= _most").select(owner, "key")


def _frequency(sets: DataFrame, keys: str) -> DataFrame:
    return sets.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def contained(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """(sample_id, sourcetype, n): registry rows (sourcetype, keys) all of whose keys the sample (sample_id, keys) has, met by their rarest key."""
    asked = registry.select("sourcetype", F.array_distinct(F.transform("keys", F.lower)).alias("wanted")).where("size(wanted) > 0")
    first = _rarest(asked, "sourcetype", "wanted", _frequency(samples, "keys"), F.lit(1)).join(asked, "sourcetype")
    met = samples.select("sample_id", "keys", F.explode("keys").alias("key")).join(first, "key")
    return met.where(F.size(F.array_except("wanted", "keys")) == 0).select("sample_id", "sourcetype", F.size("wanted").alias("n"))


def by_keys(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """(sample_id, sourcetype): the row with most keys among those ``contained``."""
    best = F.max_by("sourcetype", F.struct("n", "sourcetype"))
    return contained(samples, registry).groupBy("sample_id").agg(best.alias("sourcetype"))


def overlaps(samples: DataFrame, datatypes: DataFrame) -> DataFrame:
    """(sample_id, datatype, hit, share): at least three of the sample's keys, and so many that they reach the bar, are fields of the datatype.

    A sample of s keys needs t of them; any s - t + 1 of them hold one that a
    matching datatype has, so the rarest are looked up, and of datatypes with
    fewer than t fields none.
    """
    known = datatypes.select("datatype", F.array_distinct(F.transform("fields", F.lower)).alias("fields"))
    index = known.select("datatype", "fields", F.explode("fields").alias("key"))
    size = F.size("keys")
    least = F.greatest(F.lit(LEAST_FIELDS), F.ceil(size * FIELD_BAR - 1e-9)).cast("int")
    rows = samples.select("sample_id", F.array_distinct("keys").alias("keys")).where(size >= LEAST_FIELDS).withColumn("least", least)
    probes = _rarest(rows, "sample_id", "keys", _frequency(known, "fields"), F.size("keys") - F.col("least") + 1)
    met = probes.join(index, "key").where("size(fields) > 0").select("sample_id", "datatype", "fields").distinct().join(rows, "sample_id")
    hit = F.size(F.array_intersect("keys", "fields"))
    return met.where(hit >= F.col("least")).select("sample_id", "datatype", hit.alias("hit"), (hit / F.size("keys")).alias("share"))


def anchored(lines: DataFrame, datatypes: DataFrame) -> DataFrame:
    """(sample_id, datatype, share) of the sample's first lines that an anchor reads, with two groups of content a line or the source's own mark."""
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("line_no"))
    first = lines.withColumn("_place", place).where(F.col("_place") <= TRIED)
    tries = []
    for row in datatypes.where("size(anchors) > 0").collect():
        evident = F.col("raw").rlike(row.evidence) if row.evidence else F.lit(False)
        for k, anchor in enumerate(row.anchors):
            groups = parsers.regex(F.col("raw"), anchor)
            said = F.map_filter(groups, lambda name, v: (F.trim(v) != "") & ~F.regexp_replace(F.lower(name), "^syslog_", "").isin(fixed.ENVELOPE_GROUPS))
            tries.append(F.struct(F.lit(row.datatype).alias("datatype"), F.lit(k).alias("anchor"), F.col("raw").rlike(parsers.numbered(anchor)).alias("read"), F.size(said).alias("content"), evident.alias("evident"), F.lit(bool(row.evidence)).alias("gated")))
    if not tries:
        return lines.sparkSession.createDataFrame([], "sample_id string, datatype string, share double")
    each = first.select("sample_id", F.inline(F.array(*tries)))
    read = F.count_if("read")
    rows = each.groupBy("sample_id", "datatype", "anchor").agg(
        (read / F.count("*")).alias("share"), read.alias("n"), (F.sum(F.when(F.col("read"), F.col("content"))) / read).alias("content"),
        F.count_if(F.col("read") & F.col("evident")).alias("evidenced"), F.bool_or("evident").alias("seen"), F.first("gated").alias("gated"),
    )
    good = (F.col("n") > 0) & ((F.col("content") >= LEAST_CONTENT) | (F.col("evidenced") == F.col("n"))) & (F.col("seen") | ~F.col("gated"))
    return rows.where(good).groupBy("sample_id", "datatype").agg(F.max("share").alias("share"))


def datatype(lines: DataFrame, datatypes: DataFrame) -> DataFrame:
    """(sample_id, datatype, confidence, method): the datatype that reads the sample best, if it reaches the bar; ties to the first by name."""
    regex = anchored(lines, datatypes).select("sample_id", "datatype", F.col("share").alias("confidence"), F.lit("regex").alias("method"))
    fields = overlaps(fingerprints(lines).select("sample_id", "keys"), datatypes).select("sample_id", "datatype", F.col("share").alias("confidence"), F.lit("fields").alias("method"))
    both = regex.unionByName(fields)
    top = both.groupBy("sample_id").agg(F.max(F.struct("confidence", (F.col("method") == "regex").alias("regex"))).alias("top"))
    best = both.join(top, "sample_id").where((F.col("confidence") == F.col("top.confidence")) & ((F.col("method") == "regex") == F.col("top.regex")))
    best = best.groupBy("sample_id").agg(F.min("datatype").alias("datatype"), F.first("confidence").alias("confidence"), F.first("method").alias("method"))
    return best.where(F.col("confidence") >= F.when(F.col("method") == "regex", ANCHOR_BAR).otherwise(FIELD_BAR))
