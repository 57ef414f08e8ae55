"""Pattern picks: of each match of a user's pattern only the chosen groups are replaced.

Spark's functions give the texts of groups but not their places, so matches and
their groups' offsets are found in tasks, over lines that the pattern meets at
all.  Everything after that is rows: one alias for each distinct group value,
patches put into the match from its right end, and lines patched at the places
themselves.  What stands between picks goes on to the plan's other entries.

A pattern written for another engine names its groups ``(?<name>...)``.  A group
that takes no part in a match, or is empty, is left alone; of overlapping groups
the first wins.  In a line that is patched, U+E001 becomes U+E002.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.operators import apply, mint
from maskline.sources.store import kept

FOUND = (
    "pattern int, sample_id string, line_no long, start int, finish int, match string, "
    "parts array<struct<start:int,finish:int,name:string,value:string>>"
)
VIA = "picked pattern"
MARK, MARK_KEPT = "\ue001", "\ue002"


def found(lines: DataFrame, patterns: list[tuple[str, list[str]]]) -> DataFrame:
    """Every match (FOUND) of patterns (source, chosen groups), with the places of its groups inside it (from 0)."""
    if not patterns:
        return lines.sparkSession.createDataFrame([], FOUND)
    compiled = [(regex.compile(source), set(groups)) for source, groups in patterns]
    some = reduce(lambda a, b: a | b, [F.col("raw").rlike(source) for source, _ in patterns])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sample, number, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for k, (pattern, groups) in enumerate(compiled):
                    for m in pattern.finditer(raw):
                        parts, end = [], m.start()
                        for low, high, name in sorted((*m.span(g), g) for g in groups if g in m.groupdict()):
                            if low >= end and high > low:
                                parts.append({"start": low - m.start(), "finish": high - m.start(), "name": name, "value": raw[low:high]})
                                end = high
                        if parts:
                            rows.append({"pattern": k, "sample_id": sample, "line_no": number, "start": m.start(), "finish": m.end(), "match": m[0], "parts": parts})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return lines.where(some).select("sample_id", "line_no", "raw").mapInArrow(search, FOUND)


_PART = pa.struct([("start", pa.int32()), ("finish", pa.int32()), ("name", pa.string()), ("value", pa.string())])
_SCHEMA = pa.schema([("pattern", pa.int32()), ("sample_id", pa.string()), ("line_no", pa.int64()), ("start", pa.int32()), ("finish", pa.int32()), ("match", pa.string()), ("parts", pa.list_(_PART))])


def aliases(matches: DataFrame, salt: str) -> DataFrame:
    """(value, alias) of the groups' distinct values: of the same length and classes of characters.

    Values of which there could be ten million or more get aliases of their own
    that are no values; where a sixteenth or more of such a shape's strings are
    values, they are permuted among its strings, so an alias may be another value
    but still is one value's.  Shorter ones, such as single digits, for which
    there may be no others left, get one that differs from the value.
    """
    values = matches.select(F.explode("parts.value").alias("original")).distinct().withColumn("kind", F.lit("pii"))
    count = lambda p: F.regexp_count("original", F.lit(p))
    digits, letters = count("[0-9]"), count("[A-Za-z]")
    wide = digits + letters * 1.4 >= 7
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("original", "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    values = kept(values.withColumns({"wide": wide, "shape": shape}))
    # How many strings ``scrambled`` draws from at least, letters of hex being six.
    room = 0.9 * F.pow(F.lit(10.0), digits) * F.pow(F.lit(6.0), letters)
    counted = values.where("wide").groupBy("shape").agg(F.count("*").alias("n"), F.min(room).alias("room")).where("16 * n > room")
    crowded = values.where("wide").join(F.broadcast(counted.select("shape")), "shape", "left_semi")  # each has over 500,000 values
    roomy = values.where("wide").join(F.broadcast(counted.select("shape")), "shape", "left_anti")
    own = mint.with_aliases(kept(roomy.select("original", "kind")), salt).select(F.col("original").alias("value"), "alias")
    own = own.unionByName(crowded.select(F.col("original").alias("value"), mint.permuted(salt, F.col("original")).alias("alias")))
    draws = [F.nullif(mint.scrambled(f"{salt}\x00{k}", F.col("original")), F.col("original")) for k in range(6)]
    return own.unionByName(values.where("not wide").select(F.col("original").alias("value"), F.coalesce(*draws, F.col("original")).alias("alias")))


def entries(matches: DataFrame, named: DataFrame) -> DataFrame:
    """An entry for each distinct match: its alias has only the chosen groups replaced, ``patches`` says where."""
    first = F.min_by("parts", F.struct("pattern", "sample_id", "line_no", "start"))
    each = matches.groupBy("match").agg(F.count("*").alias("count"), first.alias("parts")).select("match", "count", F.explode("parts").alias("p"))
    each = each.join(named, F.col("p.value") == F.col("value"))
    patch = F.struct("p.start", "p.finish", "alias")
    whole = each.groupBy("match", "count").agg(F.array_sort(F.collect_list(patch)).alias("patches"))
    return whole.select(
        F.col("match").alias("original"), _patched(F.col("match"), F.col("patches")).alias("alias"), F.lit("custom").alias("kind"), F.lit(VIA).alias("via"),
        "count", F.lit(None).cast("string").alias("ip_class"), F.lit(True).alias("enabled"), "patches",
    ).where("alias <> original")


def _patched(text: Column, patches: Column) -> Column:
    """The text with its patches, which are in order, put in from the right, so that places stay true."""
    put = lambda t, p: F.concat(F.left(t, p["start"]), p["alias"], F.substring(t, p["finish"] + 1, F.length(t)))
    return F.aggregate(F.reverse(patches), text, put)


def shown(entry: DataFrame) -> DataFrame:
    """Entries with what a reviewer sees: the replaced parts and their aliases, each joined by +."""
    part = lambda p: F.substring(F.col("original"), p["start"] + 1, p["finish"] - p["start"])
    return entry.withColumns({"from": F.array_join(F.transform("patches", part), "+"), "to": F.array_join(F.transform("patches", lambda p: p["alias"]), "+")})


def edited(entry: DataFrame, to: Column) -> DataFrame:
    """Entries whose aliases a reviewer has changed to ``to``, parts joined by +; a part that is missing keeps its alias."""
    said = F.split(to, r"\+")
    new = F.transform("patches", lambda p, i: F.struct(p["start"].alias("start"), p["finish"].alias("finish"), F.coalesce(F.get(said, i), p["alias"]).alias("alias")))
    rows = entry.withColumn("patches", new)
    return rows.withColumn("alias", _patched(F.col("original"), F.col("patches")))


def applied(lines: DataFrame, matches: DataFrame, named: DataFrame, known: DataFrame) -> DataFrame:
    """``apply.applied`` with the picks put in by their places, and the other entries in what stands around them."""
    parts = matches.select("sample_id", "line_no", F.col("start").alias("at"), F.explode("parts").alias("p"))
    parts = parts.join(named, F.col("p.value") == F.col("value"))
    place = F.struct((F.col("at") + F.col("p.start")).alias("start"), (F.col("at") + F.col("p.finish")).alias("finish"), "alias")
    own = parts.groupBy("sample_id", "line_no").agg(F.array_sort(F.collect_set(place)).alias("_picks"))
    state = F.struct(F.lit(0).alias("end"), F.slice("_picks", 1, 0).alias("taken"))
    take = lambda s, p: F.when(p["start"] >= s["end"], F.struct(p["finish"].alias("end"), F.concat(s["taken"], F.array(p)).alias("taken"))).otherwise(s)
    own = own.withColumn("_picks", F.aggregate("_picks", state, take, lambda s: s["taken"]))
    rows = lines.join(own, ["sample_id", "line_no"], "left")
    text = F.translate("raw", MARK, MARK_KEPT)
    end = lambda k: F.coalesce(F.get("_picks", k - 1)["finish"], F.lit(0))
    piece = lambda k: F.substring(text, end(k) + 1, F.coalesce(F.get("_picks", k)["start"], F.length(text)) - end(k))
    marked = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_picks")), piece), MARK)
    rows = rows.withColumn("_marked", F.when(F.col("_picks").isNull(), F.col("raw")).otherwise(marked))
    changed = apply.applied(rows.select("sample_id", "line_no", F.col("_marked").alias("raw")), known).drop("raw")
    rows = rows.select("sample_id", "line_no", "raw", "_picks").join(changed, ["sample_id", "line_no"])

    def filled(column: str, put) -> Column:
        pieces = F.split(column, MARK, -1)
        whole = F.array_join(F.flatten(F.transform(pieces, lambda x, i: F.array(x, F.coalesce(put(i), F.lit(""))))), "")
        return F.when(F.col("_picks").isNull(), F.col(column)).otherwise(whole)

    return rows.select(
        "sample_id", "line_no", "raw", filled("after", lambda i: F.get("_picks", i)["alias"]).alias("after"),
        filled("rest", lambda i: F.when(i < F.size("_picks"), apply.BLANK)).alias("rest"),
        (F.col("replaced") + F.greatest(F.coalesce(F.size("_picks"), F.lit(0)), F.lit(0))).alias("replaced"),
    )
