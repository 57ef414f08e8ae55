"""Extra identifiers that a user names: literals, whole fields, and patterns with named groups.

A text of extras becomes a few rules on the driver; finding, counting and
masking what they name are expressions over the lines.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.functions.values import field_value

FIELD, PATTERN = "field:", "re:"
_GROUP = re.compile(r"\(\?<(?![=!])([A-Za-z_$][\w$]*)>")


_NAME = r"[A-Za-z_$][\w$]*"
_PATTERN = re.compile(rf"\s*{PATTERN}(?P<source>.+)\|[\s+]*(?P<groups>{_NAME}(?:[\s]*\+[\s+]*{_NAME})*)[\s+]*", re.I | re.A)
#: A pattern up to the end of the line that it begins, or an item of a comma list.
_ITEM = re.compile(rf"^[ \t\r]*(?P<line>{PATTERN}.*)|[ \t\r]*(?:{FIELD}(?P<field>[^,\n]*)|(?P<pattern>{PATTERN}[^,\n]*)|(?P<literal>[^,\n]+))", re.I | re.M)


class Extras(NamedTuple):
    literals: list[str]
    fields: list[str]
    patterns: list[tuple[str, list[str]]]


def pattern_extra(source: str, groups: list[str]) -> str:
    return f"{PATTERN}{source}|{'+'.join(g for g in groups if g)}"


def parse_pattern(token: str) -> tuple[str, list[str]] | None:
    """(source, groups) of ``re:<source>|g1+g2``; None if it isn't one."""
    found = _PATTERN.fullmatch(token)
    return (found["source"], re.findall(_NAME, found["groups"], re.ASCII)) if found else None


def split_extras(text: str) -> Extras:
    """Comma lists of literals and ``field:`` names; a pattern has a line of its own. Malformed patterns are dropped."""
    items = [("pattern" if m["line"] else m.lastgroup, m[m.lastgroup].strip()) for m in _ITEM.finditer(text)]
    of = lambda kind: [x for k, x in items if k == kind and x]
    return Extras(of("literal"), of("field"), [x for x in map(parse_pattern, of("pattern")) if x])


def named_groups(source: str) -> list[str]:
    return list(dict.fromkeys(_GROUP.findall(source)))


def from_selection(selected: str) -> str:
    """A pattern that finds the selected text itself, each of its words a group g1, g2, ..."""
    words = selected.split()
    escape = lambda w: re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", w)
    return r"\s+".join(f"(?<g{i}>{escape(w)})" for i, w in enumerate(words, 1))


def _numbers(source: str) -> dict[str, int]:
    """The number of each named group among all capturing groups."""
    bare = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", lambda m: " " * len(m[0]), source)
    opened = [m for m in re.finditer(r"\((?!\?)|\(\?<(?![=!])([A-Za-z_$][\w$]*)>", bare)]
    return {m[1]: i for i, m in enumerate(opened, 1) if m[1]}


def _java(source: str) -> str:
    return re.sub(r"\(\?<(?![=!])[A-Za-z_$][\w$]*>", "(", source)


def count_matches(lines: DataFrame, source: str) -> DataFrame:
    """(matches, lines): how often a pattern is found, and in how many lines."""
    n = F.regexp_count("raw", F.lit(_java(source)))
    return lines.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("matches"), F.count_if(n > 0).alias("lines"))


#: A selection longer than this has no shape.
LONGEST_SHAPE = 120


def shape(token: str) -> str | None:
    """A pattern of tokens built like this one: its runs of letters and digits become groups, what is between them stays.

    None where the token is too long or has not both runs and something between or around them.
    """
    token = token.strip()
    parts = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]+", token)
    runs = [p for p in parts if p[0].isascii() and p[0].isalnum()]
    if not runs or len(runs) == len(parts) or len(token) > LONGEST_SHAPE:
        return None
    out, n = "", 0
    for part in parts:
        if not (part[0].isascii() and part[0].isalnum()):
            out += re.escape(part)
            continue
        n += 1
        kind = r"\d" if part.isdigit() else "[A-Za-z]" if part.isalpha() else "[A-Za-z0-9]"
        out += f"(?<g{n}>{kind}+)"
    return out


def suggestions(line: str, start: int, end: int) -> list[str]:
    """Patterns that a selection of a line may stand for, the narrowest first, each once; none for an empty selection.

    The text itself; the same words in its place behind a label (``user=``,
    ``user:`` or a JSON member); its shape; the shape of the whole word that it
    lies in.
    """
    chosen = line[start:end].strip()
    if not chosen:
        return []
    at = line.index(chosen, start)
    found: list[str | None] = [f"(?<g1>{re.escape(chosen)})"]
    before = line[:at]
    if member := re.search(r'"([^"\\]+)"\s*:\s*"[^"\\]*$', before):
        found.append(rf'"{re.escape(member[1])}"\s*:\s*"(?<g1>[^"]+)"')
    elif label := re.search(r"(?<![\w.\-])([\w.\-]+)(=|:\s*)(\"?)$", before):
        value = '[^"]+' if label[3] else r"[^\s,;|]+"
        found.append(rf"(?<![\w.\-]){re.escape(label[1])}{'=' if label[2] == '=' else ':[ ]*'}{label[3]}(?<g1>{value})")
    grown = re.search(r"[^\s\"=,;|]*$", before)[0] + chosen + re.match(r"[^\s\"=,;|]*", line[at + len(chosen) :])[0]
    found += [shape(chosen), shape(grown)]
    return list(dict.fromkeys(x for x in found if x))


def count_all(lines: DataFrame, sources: list[str]) -> DataFrame:
    """(source, matches, lines) of every pattern, as ``count_matches`` gives for one, in a single scan of the lines."""
    each = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(x).alias("source"), F.regexp_count("raw", F.lit(_java(x))).alias("n")) for k, x in enumerate(sources)])
    counted = lines.select(F.explode(each).alias("c")).groupBy("c.place", "c.source")
    found = counted.agg(F.coalesce(F.sum("c.n"), F.lit(0)).cast("long").alias("matches"), F.count_if(F.col("c.n") > 0).alias("lines"))
    names = lines.sparkSession.createDataFrame(list(enumerate(sources)), "place int, source string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return F.broadcast(names).join(found.drop("source"), "place", "left").select("source", zero("matches"), zero("lines"))


def hits(lines: DataFrame, extras: Extras, pairs: DataFrame | None = None) -> DataFrame:
    """Hits of patterns and fields as the detectors make them, of kind custom; ``plan.with_literals`` takes the literals.

    Fields are looked up in pairs (sample_id, line_no, field, value).
    """
    found = []
    for source, groups in extras.patterns:
        numbers = _numbers(source)
        found += [F.regexp_extract_all("raw", F.lit(_java(source)), F.lit(numbers[g])) for g in groups if g in numbers]
    none = F.array().cast("array<string>")
    values = reduce(lambda a, b: F.concat(a, b), found, none)
    rows = lines.select("sample_id", "line_no", F.explode(values).alias("value"))
    if pairs is not None and extras.fields:
        plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
        wanted = [re.sub(r"[^a-z0-9]", "", x.lower()) for x in extras.fields]
        own = pairs.where(plain(F.col("field")).isin(wanted)).select("sample_id", "line_no", field_value(F.col("value")).alias("value"))
        rows = rows.unionByName(own)
    return rows.where("value <> ''").select("*", F.lit("custom").alias("kind"), F.lit("named by the user").alias("via"), F.lit(0).alias("pass"))
