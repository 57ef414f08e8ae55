"""Parsers as rows of steps: a source's pipeline functions compiled to one projection.

A step is a dict with an ``id`` and what it needs; steps share one map of fields,
so a later step reads what an earlier one wrote.  ``when`` holds conditions on
fields (all of a list must hold); a ``final`` step that runs ends the pipeline.

- regex_extract: ``regex`` with named groups, ``source`` (``_raw`` unless given)
- serde: ``type`` json, kvp, csv or delim (``fields``, ``sep``), ``source``
- eval: ``add`` {name: chain of fields, the first that is filled} and ``set`` {name: constant}, ``remove`` [names]
- rename: ``names`` {old: new}
- flatten: ``source``, the JSON text of a field to dotted names below it
- lookup: ``source``, ``table`` {value: result}, ``into``
- unroll: ``source``, a JSON list of a field to a row for each item, in ``into``

Names that begin with two underscores are scratch.  Any other id is left out and
marks the result as partial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.operators import parsers
from maskline.operators.parsers import let

DONE = "__done"
NATIVE = {"regex_extract", "serde", "eval", "rename", "flatten", "lookup", "unroll"}


def _put(event: Column, more: Column) -> Column:
    """The event with more fields, whose values win where they are filled."""
    new = F.map_filter(F.coalesce(more, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    return let(new, lambda m: F.map_concat(F.map_filter(event, lambda k, v: ~F.map_contains_key(m, k)), m))


def _holds(event: Column, condition: dict | list) -> Column:
    out = F.lit(True)
    for c in condition if isinstance(condition, list) else [condition]:
        value = event[c["field"]]
        if "equals" in c:
            out &= F.coalesce(value == c["equals"], F.lit(False))
        if "matches" in c:
            out &= F.coalesce(value.rlike(c["matches"]), F.lit(False))
        if "present" in c:
            out &= (F.coalesce(value, F.lit("")) != "") == F.lit(c["present"])
    return out


def _changed(event: Column, step: dict) -> Column:
    source = event[step.get("source", "_raw")]
    kind = step["id"]
    if kind == "regex_extract":
        return _put(event, F.map_filter(parsers.regex(source, step["regex"], scratch=True), lambda k, v: v != ""))
    if kind == "serde":
        read = {
            "json": lambda: parsers.json_leaves(source), "kvp": lambda: parsers.kvp(source),
            "csv": lambda: parsers.delimited(source, step["fields"]), "delim": lambda: parsers.delimited(source, step["fields"], step.get("sep", ",")),
        }
        return _put(event, read[step["type"]]())
    if kind == "eval":
        chains = [(k, F.coalesce(*[F.nullif(event[x], F.lit("")) for x in chain.split()])) for k, chain in step.get("add", {}).items()]
        chains += [(k, F.lit(str(v))) for k, v in step.get("set", {}).items()]
        out = _put(event, F.create_map(*[x for k, v in chains for x in (F.lit(k), v)])) if chains else event
        gone = step.get("remove", [])
        return F.map_filter(out, lambda k, v: ~k.isin(gone)) if gone else out
    if kind == "rename":
        moved = F.create_map(*[x for old, new in step["names"].items() for x in (F.lit(new), event[old])])
        return _put(F.map_filter(event, lambda k, v: ~k.isin(list(step["names"]))), moved)
    if kind == "flatten":
        name = step["source"]
        return _put(event, F.transform_keys(parsers.json_leaves(source), lambda k, v: F.concat(F.lit(f"{name}."), k)))
    table = F.create_map(*[F.lit(x) for pair in step["table"].items() for x in pair])
    return _put(event, F.create_map(F.lit(step["into"]), table[source]))


def _applied(event: Column, steps: list[dict]) -> Column:
    for step in steps:
        if step["id"] not in NATIVE:
            continue

        def one(e: Column, step=step) -> Column:
            runs = ~F.map_contains_key(e, F.lit(DONE))
            if step.get("when"):
                runs &= _holds(e, step["when"])
            out = _changed(e, step)
            if step.get("final"):
                out = _put(out, F.create_map(F.lit(DONE), F.lit("1")))
            return F.when(runs, out).otherwise(e)

        event = let(event, one)
    return event


def run(lines: DataFrame, steps: list[dict]) -> DataFrame:
    """(sample_id, line_no, item, fields, partial); ``item`` numbers the rows of an unrolled line, from 0."""
    partial = any(s["id"] not in NATIVE for s in steps)
    rows = lines.select("sample_id", "line_no", F.lit(0).alias("item"), F.create_map(F.lit("_raw"), "raw").alias("event"))
    begin = 0
    for k, step in enumerate(steps):
        if step["id"] != "unroll":
            continue
        rows = rows.withColumn("event", _applied(F.col("event"), steps[begin:k]))
        items = F.from_json(F.col("event")[step["source"]], "array<string>")
        rows = rows.select("sample_id", "line_no", F.posexplode_outer(items).alias("n", "x"), "item", "event")
        event = F.when(F.col("x").isNotNull(), _put(F.col("event"), F.create_map(F.lit(step["into"]), F.col("x")))).otherwise(F.col("event"))
        rows = rows.select("sample_id", "line_no", F.coalesce("n", "item").alias("item"), event.alias("event"))
        begin = k + 1
    event = _applied(F.col("event"), steps[begin:])
    shown = let(event, lambda e: F.map_filter(e, lambda k, v: ~k.startswith("__") & (k != "_raw")))
    return rows.select("sample_id", "line_no", "item", shown.alias("fields"), F.lit(partial).alias("partial"))
