"""long values are cut by string functions; what comes out is what the patterns gave."""

import random
import re

from pyspark.sql import functions as F

from maskline.functions import values
from maskline.operators import parsers

OLD_PAIR = r'(?:\G|(?<![\w.\-]))([\w.\-]++)=("(?:[^"\\]|\\.)*+"|[^\s]*+)'
KEY = r"[\w.\-]++="
OLD_SPACED = rf"(?:^|\s)([\w.\-]++)=((?:\\.|[^\\=\s]|\s++(?!{KEY}|$))*+)(?=\s+{KEY}|\s*$)"


def _old_value(raw):
    unquoted = F.trim(F.regexp_replace(F.trim(raw), r"^([\"'])([\s\S]*)\1$", "$2"))
    return F.when(F.trim(raw).startswith('"') | F.trim(raw).startswith("'"), unquoted).otherwise(F.trim(raw))


def _all(line, pattern, value):
    return parsers._map(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(2)), value))


def test_pairs_are_those_of_the_patterns(spark):
    draw = random.Random(7)
    parts = ["a", "b1", "c.d", "e-f", "=", "=", "=", " ", " ", " ", "  ", '"', '"', "'", "é", "$", "\\", "\\=", "\\\\", "\t", "\n", "\r\n", " ", "\x85", ""]
    plain = [p for p in parts if "\\" not in p and not re.fullmatch(r"[\t\n\r \x85]+", p)]
    texts = ["".join(draw.choices(some, k=draw.randrange(16))) for some in (parts, plain, plain) for _ in range(4000)]
    texts += ["a=", "a= b=1", "a=b=c d=", "=x a=1", "a=1  ", " a=1", "  a=1", "é a=1 b=é c", "a=x =y b=2", "a=1 a=2", '"x"\n', "'x' ", '"', "''", "' x '"]
    lines = spark.createDataFrame([(t,) for t in [*texts, None]], "raw string").repartition(4)
    raw = F.col("raw")
    new = {"kvp": parsers.kvp(raw), "spaced": parsers._spaced(raw), "value": values.field_value(raw)}
    old = {"kvp": _all(raw, OLD_PAIR, _old_value), "spaced": _all(raw, OLD_SPACED, lambda v: F.regexp_replace(v, r"\\([=\\])", "$1")), "value": _old_value(raw)}
    rows = lines.select("raw", *[x.alias(f"new_{k}") for k, x in new.items()], *[x.alias(f"old_{k}") for k, x in old.items()]).collect()
    for k in new:
        assert [(r.raw, r[f"new_{k}"]) for r in rows] == [(r.raw, r[f"old_{k}"]) for r in rows]
    assert sum(len(r.new_spaced or ()) for r in rows) > 500


def test_values_are_cut_without_patterns(spark):
    """A quoted value was read again by a pattern, and a line of pairs or of CEF twice."""
    def patterns(tree):
        plan = spark.createDataFrame([("x",)], "raw string").select(tree.alias("x"))._jdf.queryExecution().analyzed().toString()
        return len(re.findall("regexp_extract_all", plan))

    assert patterns(parsers.kvp(F.col("raw"))) == 1
    plan = spark.createDataFrame([("x",)], "raw string").select(parsers.cef(F.col("raw")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "split(" in plan and plan.count("regexp_extract(") == 1
