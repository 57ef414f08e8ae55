"""Replacing originals by aliases in lines.

The values' anchors are looked up in the lines (``spans``), the hits of a line are
brought together, the leftmost and longest of those that overlap win, and the
line is put together again.  Lines are shuffled once, by their own key, unless
Spark finds the hits small enough to broadcast.

A hit in a JSON key stays unless the whole key is a mailbox or an address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions.values import let
from maskline.operators import spans

#: Kinds whose values are the same in any case.
ANY_CASE = ["host", "user", "email", "fqdn"]
#: What stands for an alias where the proof looks for originals.
BLANK = "\ue000"


def replacements(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits that are enabled entries: exactly, or but for case for hosts, users and mailboxes."""
    values = spans.sought(entries.select("original", "alias", "kind", "enabled"), spans.RUN)
    met = spans.matches(lines, values, spans.RUN)
    exact = F.concat("lead", "hit", "tail") == F.col("original")
    fits = (exact | F.col("kind").isin(ANY_CASE)) & (~F.col("key") | F.col("kind").isin(spans.KEY_KINDS))
    return met.where(fits).select(
        "sample_id", "line_no", "at", "n", "cut", "key", "alias", "original", "kind", exact.alias("exact"),
        F.length("lead").alias("lead"), F.length("tail").alias("tail"),
    )


def _picked(hits: Column) -> Column:
    """Of sorted hits, those that begin after the one taken before ends."""
    none = F.filter(hits, lambda h: F.lit(False))
    state = F.struct(F.lit(0).alias("end"), none.alias("taken"))
    step = lambda s, h: F.when(
        h["at"] >= s["end"], F.struct((h["at"] + h["n"]).alias("end"), F.concat(s["taken"], F.array(h)).alias("taken"))
    ).otherwise(s)
    return F.aggregate(hits, state, step, lambda s: s["taken"])


def _parts() -> Column:
    """The line up to and with each pick, and its end: (text, alias, blank), ``alias`` and ``blank`` in place of the pick.

    Both forms of the line are put together of these, so its pieces are joined once.
    """
    end = lambda k: F.coalesce(F.get("picks", k - 1)["at"] + F.get("picks", k - 1)["n"], F.lit(0))

    def part(k: Column) -> Column:
        before, here = F.get("picks", k - 1), F.get("picks", k)
        first, last = end(k), F.coalesce(here["at"], F.size("runs"))
        cut = F.coalesce(before["cut"], F.lit(0))
        pieces = F.array_join(F.slice("_pieces", first * 2 + 1, (last - first) * 2 + 1), "")
        text = F.when(cut > 0, F.concat(F.right(F.get("runs", first - 1), cut), pieces)).otherwise(pieces)
        low, high = F.coalesce(before["tail"], F.lit(0)), F.coalesce(here["lead"], F.lit(0))
        text = F.when(low + high == 0, text).otherwise(let(text, lambda t: F.substring(t, low + 1, F.length(t) - low - high)))
        quoted = lambda name: F.when(here["key"], F.concat(F.lit('"'), F.coalesce(here[name], F.lit("")), F.lit('"'))).otherwise(F.coalesce(here[name], F.lit("")))
        return F.struct(text.alias("text"), quoted("alias").alias("alias"), quoted("blank").alias("blank"))

    return F.transform(F.sequence(F.lit(0), F.size("picks")), part)


def _rebuilt(name: str) -> Column:
    """The line with the field of that name (of each pick) in place of the pick."""
    return F.array_join(F.flatten(F.transform("_parts", lambda p: F.array(p["text"], p[name]))), "")


def picked(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(sample_id, line_no, picks): the hits of each line that win, in order."""
    found = replacements(lines, entries)
    hit = F.struct(
        "at", (-F.col("n")).alias("longest"), (-(F.col("lead") + F.col("tail"))).alias("widest"), (~F.col("exact")).alias("loose"),
        F.col("cut").alias("shortest"), "alias", "n", "cut", "key", "lead", "tail", F.lit(BLANK).alias("blank"), "original", "kind",
    )
    hits = found.groupBy("sample_id", "line_no").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return hits.select("sample_id", "line_no", _picked(F.col("hits")).alias("picks"))


def applied(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """The lines with ``after``, ``rest`` (after with each alias blanked) and the number of hits replaced."""
    hits = picked(lines, entries)
    runs, between = spans.cut(F.col("raw"), spans.RUN, keys=True)
    rows = lines.join(hits, ["sample_id", "line_no"], "left")
    some = F.col("picks").isNotNull()
    rows = rows.withColumns({"runs": F.when(some, runs), "between": F.when(some, between)})
    rows = rows.withColumn("_pieces", F.flatten(F.transform("between", lambda b, i: F.array(b, F.get("runs", i)))))
    rows = rows.withColumn("_parts", _parts())
    return rows.select(
        "sample_id", "line_no", "raw", F.coalesce(_rebuilt("alias"), "raw").alias("after"), F.coalesce(_rebuilt("blank"), "raw").alias("rest"),
        F.greatest(F.coalesce(F.size("picks"), F.lit(0)), F.lit(0)).alias("replaced"),
    )


def counts(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(original, kind, replaced): how often each entry stands in the lines; none for those that never do."""
    return replacements(lines, entries).groupBy("original", "kind").agg(F.count("*").alias("replaced"))


def preview(changed: DataFrame, most: int = 200) -> DataFrame:
    """The first changed lines, before and after."""
    return changed.where("replaced > 0").orderBy("sample_id", "line_no").limit(most)
