"""Which source a sample is from, step by step, and whether its layout reads it.

Each step gives at most one row a sample; the first step that names a source
wins.  All steps are grouped shares over a sample's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import fixed
from maskline.operators import guards, parsers, recognise, signatures, vendors
from maskline.sources.store import kept

CEF_LINES, CEF_SHARE = 40, 0.6
# Makers whose CEF lines a layout of their own reads, by vendor and product in the header.
CEF_MAKERS = [("fortinet_fortigate", r"(?i)^fortinet$", r"(?i)^forti\s*gate$"), ("checkpoint_firewall", r"(?i)^check\s*point$", "")]


def unwrapped(lines: DataFrame) -> DataFrame:
    """The lines, an event in a JSON object's _raw taken out."""
    inner = F.trim(F.get_json_object("raw", "$._raw"))
    return lines.withColumn("raw", F.when(F.col("raw").startswith("{") & (inner != ""), inner).otherwise(F.col("raw")))


def cef_source(lines: DataFrame) -> DataFrame:
    """(sample_id, sourcetype, vendor, product) where 60 % of the first lines are CEF; the maker's own layout if one maker has 60 % of those."""
    order = Window.partitionBy("sample_id").orderBy("line_no")
    first = unwrapped(lines).where(F.trim("raw") != "").withColumn("place", F.row_number().over(order)).where(F.col("place") <= CEF_LINES)
    heads = first.select("sample_id", parsers.security_header(F.regexp_replace(F.col("raw"), '^"|"$', "")).alias("h"))
    total = heads.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(F.col("h.format") == "cef").alias("cef"))
    total = total.where((F.col("cef") > 0) & (F.col("cef") >= F.ceil(F.col("n") * CEF_SHARE)))
    makers = heads.where("h.format = 'cef'").groupBy("sample_id", F.lower("h.vendor").alias("v"), F.lower("h.product").alias("p"))
    makers = makers.agg(F.count("*").alias("lines"), F.min("h.vendor").alias("vendor"), F.min("h.product").alias("product"))
    top = makers.groupBy("sample_id").agg(F.max_by(F.struct("vendor", "product", "lines"), F.struct("lines", "v", "p")).alias("m"))
    rows = total.join(top, "sample_id").withColumn("one", F.col("m.lines") >= CEF_SHARE * F.col("cef"))
    source = F.lit("cef")
    for name, vendor, product in reversed(CEF_MAKERS):
        fits = F.col("one") & F.col("m.vendor").rlike(vendor) & F.col("m.product").rlike(product)
        source = F.when(fits & F.lit(name in vendors.CATALOGUE), name).otherwise(source)
    return rows.select("sample_id", source.alias("sourcetype"), F.when(F.col("one"), F.col("m.vendor")).alias("vendor"), F.when(F.col("one"), F.col("m.product")).alias("product"))


def recognised(lines: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(sample_id, sourcetype, tier, format) of each sample; ``hints`` (sample_id, sourcetype) go first where a layout has that name."""
    steps = [("cef", cef_source(lines)), ("signature", signatures.json_signature(unwrapped(lines))), ("channel", signatures.windows_channel(lines)), ("layout", vendors.best_parser(lines))]
    if hints is not None:
        steps.insert(0, ("hint", hints.where(F.col("sourcetype").isin(sorted(vendors.CATALOGUE)))))
    rows = reduce(DataFrame.unionByName, [x.select("sample_id", "sourcetype", F.lit(tier).alias("tier"), F.lit(k).alias("step")) for k, (tier, x) in enumerate(steps)])
    best = rows.groupBy("sample_id").agg(F.min_by(F.struct("sourcetype", "tier"), "step").alias("b"))
    formats = recognise.describe(lines).select("sample_id", "format")
    return formats.join(best, "sample_id", "left").select("sample_id", "b.sourcetype", F.coalesce("b.tier", F.lit("format")).alias("tier"), "format")


def read(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """(sample_id, line_no, sourcetype, fields): each line by its sample's layout, without one by its form."""
    named = lines.join(sources.select("sample_id", "sourcetype"), "sample_id", "left")
    names = [r.sourcetype for r in sources.select("sourcetype").distinct().collect()]  # names of layouts, at most one each
    fields = parsers.fields(F.col("raw"))
    for name in sorted(n for n in names if n in vendors.CATALOGUE):
        fields = F.when(F.col("sourcetype") == name, vendors.CATALOGUE[name](F.col("raw"))).otherwise(fields)
    return named.select("sample_id", "line_no", "sourcetype", fields.alias("fields"))


def verified(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """(sample_id, verdict, method, lines, parsed, fields): usable lines, then by layout, then by structure."""
    usable = guards.usability(lines).select("sample_id", "usable")
    # Each line is read once: what is kept has a row for each sample and field, not for each line.
    keys = read(lines, sources).select("sample_id", F.posexplode_outer(F.map_keys("fields")).alias("place", "field"))
    seen = keys.groupBy("sample_id", "field").agg(F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("lines"), F.count_if(F.col("place") == 0).alias("parsed"))
    seen = kept(seen)
    ratio = seen.groupBy("sample_id").agg(F.sum("lines").alias("lines"), F.sum("parsed").alias("parsed"))
    named = seen.where("field is not null").select("sample_id", "field")
    count = named.groupBy("sample_id").agg(F.count_distinct("field").alias("fields"))
    structure = guards.structure_verdict(lines, recognise.sample_keys(named)).select("sample_id", F.col("verified").alias("structured"))
    rows = ratio.join(count, "sample_id", "left").join(usable, "sample_id").join(structure, "sample_id", "left").join(sources.select("sample_id", "sourcetype"), "sample_id", "left")
    enough = (F.col("parsed") >= fixed.VERIFY_RATIO * F.col("lines")) & (F.coalesce("fields", F.lit(0)) >= fixed.VERIFY_FIELDS)
    layout = F.col("sourcetype").isNotNull()
    verdict = F.when(~F.col("usable"), "fail").when(layout, F.when(enough, "pass").otherwise("fail")).when(F.col("structured"), "pass").otherwise("unverified")
    method = F.when(~F.col("usable"), "usability").when(layout, "parser-emulation").otherwise("structure")
    return rows.select("sample_id", verdict.alias("verdict"), method.alias("method"), "lines", "parsed", F.coalesce("fields", F.lit(0)).alias("fields"))
