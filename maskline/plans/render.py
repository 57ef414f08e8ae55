"""Table rows as log lines, the inverse of the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def kvp(columns: list[str]) -> Column:
    each = [F.concat(F.lit(f"{c}="), F.when(_text(c).rlike(r"[\s=\"]"), F.concat(F.lit('"'), _text(c), F.lit('"'))).otherwise(_text(c))) for c in columns]
    return F.concat_ws(" ", *each)


def json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]))


def delimited(columns: list[str], sep: str = ",") -> Column:
    quote = lambda c: F.when(_text(c).contains(sep) | _text(c).contains('"'), F.concat(F.lit('"'), F.replace(_text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(_text(c))
    return F.concat_ws(sep, *map(quote, columns))


def cef(vendor: str, product: str, event_id: Column, name: Column, columns: list[str]) -> Column:
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit(vendor), F.lit(product), F.lit("1.0"), event_id, name, F.lit("5"))
    return F.concat(head, F.lit("|"), F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), _text(c)) for c in columns]))


def leef(vendor: str, product: str, event_id: Column, columns: list[str]) -> Column:
    head = F.concat_ws("|", F.lit("LEEF:1.0"), F.lit(vendor), F.lit(product), F.lit("1.0"), event_id)
    return F.concat(head, F.lit("|"), F.concat_ws("\t", *[F.concat(F.lit(f"{c}="), _text(c)) for c in columns]))


def as_lines(rows: DataFrame, sample: str, number: str, line: Column) -> DataFrame:
    return rows.select(F.lit(sample).alias("sample_id"), F.col(number).cast("long").alias("line_no"), line.alias("raw"))
