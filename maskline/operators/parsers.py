"""Lines to named fields (map<string,string>), each a Column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions.values import field_value, has, let
from maskline.operators import spans

# Java matches a repeated group by recursion unless it is possessive, and a run of characters that may begin anywhere
# costs the square of its length; so groups are possessive here and runs begin where one does.
_PAIR = r'(?:\G|(?<![\w.\-]))([\w.\-]++)=("(?:[^"\\]+|\\.)*+"|[^\s]*+)'


def last_wins(entries: Column) -> Column:
    """A map of entries (key, value) in which the last of equal keys wins."""
    placed = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("place"), e["value"].alias("value"))))
    last = lambda es: F.filter(es, lambda e, i: ~F.get(es, i + 1)["key"].eqNullSafe(e["key"]))
    return let(placed, lambda es: F.map_from_entries(F.transform(last(es), lambda e: F.struct(e["key"], e["value"]))))


def _map(keys: Column, values: Column) -> Column:
    """A map in which the last of equal keys wins."""
    return last_wins(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))))


def kvp(raw: Column, pattern: str = _PAIR) -> Column:
    """key=value pairs; quoted values lose their quotes."""
    if pattern == _PAIR:  # the match is the key, = and the value, so the line is searched once
        apart = lambda p: let(F.substring_index(p, "=", 1), lambda k: F.struct(k.alias("key"), field_value(F.substring(p, F.length(k) + 2, F.length(p))).alias("value")))
        return last_wins(F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(0)), apart))
    keys = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
    values = F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(2)), field_value)
    return _map(keys, values)


def numbered(pattern: str) -> str:
    """The pattern with its named groups as plain ones."""
    return re.sub(r"\(\?<[A-Za-z_]\w*>", "(", pattern)


def regex(raw: Column, pattern: str, scratch: bool = False) -> Column:
    """Named groups of the first match, the last of equal names, those of two underscores if asked for; empty where it doesn't match."""
    names = [n for n in re.findall(r"\(\?<([A-Za-z_]\w*)>", pattern)]
    plain = numbered(pattern)
    if re.sub(r"\\.|\[[^\]]*\]", "", plain).replace("(?", "").count("(") != len(names):
        raise ValueError("every capturing group needs a name")
    last = {n: i for i, n in enumerate(names, 1) if scratch or not n.startswith("__")}
    pairs = [x for n, i in last.items() for x in (F.lit(n), F.regexp_extract(raw, plain, i))]
    return F.when(raw.rlike(plain), F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,string>"))


def json(raw: Column) -> Column:
    """Top-level members as strings; null members are dropped."""
    return F.map_filter(F.from_json(raw, "map<string,string>"), lambda k, v: v.isNotNull())


def json_leaves(raw: Column, depth: int = 6) -> Column:
    """Dotted paths to leaves, arrays kept as one leaf; below so many levels an object is a leaf too.

    Of equal paths, as of a dotted key and a nested one, the last wins.
    """
    text = lambda m: F.map_entries(json(m))

    def below(e: Column) -> Column:
        inner = F.transform(text(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
        return F.when(e["value"].startswith("{"), F.coalesce(inner, F.array(e))).otherwise(F.array(e))

    entries = text(raw)
    for _ in range(depth - 1):
        entries = F.flatten(F.transform(entries, below))
    return last_wins(entries)


_STRING = r'"(?:[^"\\]|\\.)*+"'
_SCALAR = rf"{_STRING}|-?\d[\d.eE+\-]*+|true|false"
#: A string, with the scalar or the list of scalars that it names if it is a key.
_MEMBER = rf"({_STRING})(?:\s*+:\s*+({_SCALAR}|\[(?:\s*+(?:{_SCALAR}|null)\s*+,?+)*+\]))?"


def json_pairs(raw: Column) -> Column:
    """Every scalar of a JSON text with the key that it stands under, at any depth, those of lists too (array of key and value).

    The text is cut into its strings, so it is read once however deep it is.
    """
    keys, values = (F.regexp_extract_all(raw, F.lit(_MEMBER), F.lit(k)) for k in (1, 2))
    texts = lambda x: F.from_json(x, "array<string>")
    named = F.filter(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda e: e["value"] != "")

    def each(e: Column) -> Column:
        inner = texts(F.when(e["value"].startswith("["), e["value"]).otherwise(F.concat(F.lit("["), e["value"], F.lit("]"))))
        key = F.get(texts(F.concat(F.lit("["), e["key"], F.lit("]"))), 0)
        return F.transform(F.filter(inner, lambda x: x.isNotNull()), lambda x: F.struct(key.alias("key"), x.alias("value")))

    return F.flatten(F.transform(named, lambda e: F.coalesce(each(e), F.array().cast("array<struct<key:string,value:string>>"))))


def named_values(lines: DataFrame) -> DataFrame:
    """(sample_id, line_no, field, value): what the lines' own form names, without a layout."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    found = F.when(spans.is_json(F.col("raw")), json_pairs(F.col("raw"))).otherwise(F.coalesce(F.map_entries(fields(F.col("raw"))), none))
    rows = lines.select("sample_id", "line_no", F.inline(found).alias("field", "value"))
    return rows.where(~F.col("field").startswith("__") & (F.col("field") != "_raw"))


def fields(raw: Column) -> Column:
    """The named fields of a line by its form: JSON, XML, an access log, else pairs and a syslog header."""
    none = F.create_map().cast("map<string,string>")
    some = lambda f: F.map_filter(f, lambda k, v: ~v.isin("", "-"))
    access = F.map_filter(clf(raw), lambda k, v: k.isin("client", "user"))
    named = F.transform_keys(access, lambda k, v: F.when(k == "client", "client_ip").otherwise(k))
    host = F.filter(F.map_entries(syslog(raw)), lambda e: e["key"] == "host")
    both = lambda h: F.when(F.size(h) == 0, kvp(raw)).otherwise(last_wins(F.concat(h, F.map_entries(kvp(raw)))))
    pairs = let(host, both)
    return (
        F.when(spans.is_json(raw), F.coalesce(json_leaves(raw), none)).when(raw.rlike(r"^\s*<[A-Za-z?]"), some(xml(raw)))
        .when(raw.rlike(r'^\S+ \S+ \S+ \[[^\]]+\] "'), some(named)).otherwise(some(pairs))
    )


def cells(raw: Column, sep: str = ",") -> Column:
    """The cells of a delimited line; a quoted one may hold separators and doubled quotes."""
    sep = re.escape(sep)
    found = F.regexp_extract_all(raw, F.lit(rf'(?:^|{sep})("(?:[^"]|"")*+"|[^{sep}]*+)'), F.lit(1))
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), inner(c)).otherwise(c))


def delimited(raw: Column, columns: list[str], sep: str = ",") -> Column:
    """Quote-aware split into named columns, of equal ones the last; accepted with half of them or more."""
    names = F.array(*map(F.lit, columns))

    def named(found: Column) -> Column:
        n = F.least(F.size(found), F.lit(len(columns)))
        pairs = F.zip_with(F.slice(names, F.lit(1), n), F.slice(found, F.lit(1), n), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
        return F.when(F.size(found) * 2 >= len(columns), last_wins(F.filter(pairs, lambda e: e["value"] != "")))

    return let(cells(raw, sep), named)


def aliased(fields: Column, chains: dict[str, str]) -> Column:
    """The fields with canonical names added: each takes the first value that is not empty among its fields.

    Both maps are computed once: each is named again for every chain or key.
    """
    def named(own: Column) -> Column:
        values = {name: F.coalesce(*[F.nullif(own[x], F.lit("")) for x in chain.split()]) for name, chain in chains.items()}
        added = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
        return let(added, lambda new: F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new))

    return let(fields, named)


_CELL = r"(?:[^|\\]+|\\.)*+"
_HEAD = r"^(?:.*?\s)?{0}:(\d+(?:\.\d+)?)" + rf"\|({_CELL})" * 3


def security_header(raw: Column) -> Column:
    """format, version, vendor, product, product_version of a CEF or LEEF line; null otherwise."""
    def one(name: str) -> Column:
        pattern = _HEAD.format(name)
        parts = [F.regexp_extract(raw, pattern, k) for k in (1, 2, 3, 4)]
        names = ("version", "vendor", "product", "product_version")
        return F.when(raw.rlike(pattern), F.struct(F.lit(name.lower()).alias("format"), *[p.alias(n) for p, n in zip(parts, names)]))

    return F.coalesce(one("CEF"), one("LEEF"))


def cef(raw: Column) -> Column:
    """Extension pairs; a value runs to the next key, \\= and \\\\ are unescaped."""
    extension = F.regexp_extract(raw, r"CEF:\d+" + rf"\|{_CELL}" * 6 + r"\|(.*)$", 1)
    return _spaced(extension)


def _spaced(extension: Column) -> Column:
    """Pairs whose values run to the next key.

    A value holds no = that isn't escaped, so the text is cut at =, and only the end of a piece can be the next key.
    With escapes or other white space than blanks, patterns find the same pairs, word by word.
    """
    odd = ["\\", "\t", "\n", "\x0b", "\f", "\r", "\x85", "\u2028", "\u2029"]
    return let(extension, lambda e: F.when(has(e, odd), _spaced_words(e)).otherwise(let(F.split(e, "=", -1), _spaced_pieces)))


def _spaced_pieces(pieces: Column) -> Column:
    def piece(text: Column, at: Column) -> Column:
        def ended(word: Column) -> Column:
            own = word.rlike(r"^[\w.\-]+$") & ((at == 0) | (F.length(word) < F.length(text)))
            before = F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(word)))
            value = F.when(at == F.size(pieces) - 1, F.rtrim(text)).when(own, before)
            return F.struct(F.when(own, word).alias("key"), value.alias("value"))

        return let(F.substring_index(text, " ", -1), ended)

    def paired(found: Column) -> Column:
        pairs = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.struct(a["key"].alias("key"), b["value"].alias("value")))
        return last_wins(F.filter(pairs, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))

    return let(F.transform(pieces, piece), paired)


def _spaced_words(extension: Column) -> Column:
    key = r"[\w.\-]++="
    pattern = rf"(?:^|\s)([\w.\-]++)=((?:[^\\=\s]+|\\.|\s++(?!{key}|$))*+)(?=\s+{key}|\s*$)"
    values = F.regexp_extract_all(extension, F.lit(pattern), F.lit(2))
    return _map(F.regexp_extract_all(extension, F.lit(pattern), F.lit(1)), F.transform(values, lambda v: F.regexp_replace(v, r"\\([=\\])", "$1")))


def leef(raw: Column) -> Column:
    """Tab-separated attributes after the five-field header."""
    extension = F.regexp_extract(raw, r"LEEF:[\d.]+" + rf"\|{_CELL}" * 4 + r"\|(.*)$", 1)
    pairs = F.filter(F.split(extension, "\t"), lambda x: x.contains("="))
    return _map(F.transform(pairs, lambda x: F.substring_index(x, "=", 1)), F.transform(pairs, lambda x: F.regexp_replace(x, "^[^=]*=", "")))


def clf(raw: Column) -> Column:
    return regex(raw, r'^(?<client>\S+) (?<ident>\S+) (?<user>\S+) \[(?<time>[^\]]+)\] "(?<method>\S+) (?<path>\S+) (?<protocol>[^"]*)" (?<status>\d{3}) (?<bytes>\S+)')


def syslog(raw: Column) -> Column:
    return regex(raw, r"^(?:<(?<pri>\d{1,3})>)?(?<time>[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (?<host>\S+) (?<program>[\w./\-]+)(?:\[\d+\])?: (?<message>.*)$")


def xml(raw: Column) -> Column:
    """Leaves by element name, and Data elements by their Name."""
    leaf, data = r"<([A-Za-z][\w.\-]*)(?:\s[^<>]*)?>([^<>]*)</\1>", r"<Data Name=[\"']([^\"']+)[\"']>([^<>]*)</Data>"
    both = []
    for k in (1, 2):
        both.append(F.concat(F.regexp_extract_all(raw, F.lit(leaf), F.lit(k)), F.regexp_extract_all(raw, F.lit(data), F.lit(k))))
    return F.map_filter(_map(*both), lambda k, v: k != "Data")


def with_header(lines: DataFrame, sep: str = ",", prefix: str = "") -> DataFrame:
    """Fields named by the first line of each sample (or its ``prefix`` directive, as in #Fields:)."""
    bare = F.regexp_replace("raw", f"^{prefix}\\s*", "") if prefix else F.col("raw")
    heads = lines.where(F.col("raw").startswith(prefix)) if prefix else lines
    head = heads.groupBy("sample_id").agg(F.min_by(cells(bare, sep), "line_no").alias("columns"), F.min("line_no").alias("head_no"))
    own = cells(F.col("raw"), sep)
    body = lines.join(head, "sample_id").where((F.col("line_no") > F.col("head_no")) & (F.size(own) == F.size("columns")))
    return body.select("sample_id", "line_no", _map(F.col("columns"), own).alias("fields"))


def long(parsed: DataFrame) -> DataFrame:
    """(sample_id, line_no, field, value), without internal fields."""
    # Not explode: Spark would test the map's size before, and so read each line twice.
    rows = parsed.select("sample_id", "line_no", F.inline(F.map_entries("fields")).alias("field", "value"))
    return rows.where(~F.col("field").startswith("__") & (F.col("field") != "_raw"))
