"""Identifiers in lines: one row a hit (sample_id, line_no, value, kind, via, pass, version).

Every pattern pass is an array of hits of one line; ``everything`` joins the
arrays and explodes them once, so the lines are read once and nothing is
shuffled.  ``version`` marks a second row for an address that stands after a
word for a version; ``plan.entries`` drops those that always do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import fixed, values
from maskline.operators import parsers, spans

# Java matches a repeated group by recursion unless it is possessive, and a run of characters that may begin anywhere
# costs the square of its length; so groups are possessive or short, and runs begin where one does, or where the last hit ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\-]))[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,126}\.[A-Za-z]{2,}"
# A mailbox in a URL.
EMAIL_ENCODED = r"(?:\G|(?<![\w.+\-]))[\w.+\-]++%40[\w\-]++(?:\.[\w\-]++)++"
MAC = r"(?<![0-9A-Fa-f:\-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![0-9A-Fa-f:\-])"
# A number with separators, or, after a word for telephones within 40 characters, one without; no time zone after a clock.
PHONE = (
    r"(?=\+[1-9])(?<![\w+])(?<!\d\d:\d\d(?:[.,]\d{1,9})?\s?)(?:\+\d{1,4}[ .\-(](?: ?[\d().\-]){4,18}\d"
    r"|(?<=(?i:phone|tel|mobile|msisdn|cell|fax|sms|whatsapp|call|contact)[^\n]{0,36})\+\d{8,15}(?!\d))"
)
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
IBAN_GROUPS = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?(?![A-Za-z0-9])"
DOMAIN_USER_JSON = r"(?<![\\\w:])([A-Za-z][\w\-]{1,14})\\\\([A-Za-z][\w.\-$]{1,63})(?![\\\w])"
DOMAIN_USER = r"(?<![\\\w:])([A-Za-z][\w\-]{1,14})\\([A-Za-z][\w.\-$]{1,63})(?![\\\w])"
FQDN = (
    r"(?i)(?<![\w.@\-])(?!(?<=%)40)(?:[a-z0-9]++(?:-++[a-z0-9]++)*+\.(?=[a-z0-9]))++(?<=\.)(?:" + "|".join(fixed.DOMAIN_ENDINGS) + r")(?![\w\-]|\.\w)"
)


def _by_first(words: list[str]) -> str:
    """The words as alternatives by their first letter, longer ones first, so that one letter rules out most."""
    firsts = sorted({w[0] for w in words})
    return "|".join(f"{c}(?:" + "|".join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True)) + ")" for c in firsts)


DN_PART = r"(?:CN|OU|DC|O)=([^,=\"]+)"
SECRET_PAIR = (
    r"(?i)(?<![A-Za-z0-9])(?=[a-z0-9_]++[\"']?\s*[:=])(?:" + _by_first(fixed.SECRET_FIELDS) + r")[\"']?\s*[:=]\s*[\"']?"
    r"(?:(?:" + "|".join(fixed.AUTH_SCHEMES) + r")\s+)?([A-Za-z0-9_\-./+=~]{8,})"
)
VERSION = r"(?i)\b(?:version|ver|v|release|build|rev|sdk|agent|schema)\b\W{0,3}(?<![\w.])((?:\d{1,3}\.){3}\d{1,3})(?![\w]|\.\w)"


def _all(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("raw", F.lit(pattern), F.lit(group))


def _if(test: Column, found: Column) -> Column:
    """The array only where the cheap test holds."""
    return F.when(test, found).otherwise(F.array().cast("array<string>"))


def _hits(found: Column, kind: str, via: str, number: int, version: bool = False) -> Column:
    return F.transform(
        found,
        lambda v: F.struct(v.alias("value"), F.lit(kind).alias("kind"), F.lit(via).alias("via"), F.lit(number).alias("pass"), F.lit(version).alias("version")),
    )


def _rows(lines: DataFrame, *arrays: Column) -> DataFrame:
    found = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return lines.select("sample_id", "line_no", F.explode(found).alias("h")).select("sample_id", "line_no", "h.*")


def words(pattern: str, strip: str = ".") -> Column:
    """Maximal runs of the pattern's characters without trailing dots."""
    return F.transform(_all(pattern), lambda w: F.rtrim(w, F.lit(strip)))


def _quads() -> Column:
    plain = _all(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?=\.*+(?![\w.]))")  # runs that are one but for dots at their end
    return F.filter(_if(F.col("raw").rlike(r"\d\.\d{1,3}\.\d"), plain), lambda w: values.ipv4_class(w).isNotNull())


def _ipv4_identities() -> list[Column]:
    """IPv4 hits worth an alias: not loopback, multicast or reserved; once more where a version is meant."""
    worth = lambda w: values.ipv4_class(w).isin("private", "public", "cgnat", "link-local")
    named = _if(F.col("raw").rlike(r"\d\.\d{1,3}\.\d"), _all(VERSION, 1))
    return [_hits(F.filter(_quads(), worth), "ipv4", "ipv4 pattern", 1), _hits(F.filter(named, worth), "ipv4", "ipv4 pattern", 1, version=True)]


def _ipv6() -> Column:
    found = F.filter(_if(F.col("raw").rlike(":[0-9A-Fa-f]*:"), _all(r"(?<![\w:.])[0-9A-Fa-f:]{2,39}(?![\w:])")), lambda w: w.contains(":"))
    return _hits(F.filter(found, lambda w: values.ipv6_class(w).isin("public", "private", "link-local")), "ipv6", "ipv6 pattern", 2)


def _emails() -> list[Column]:
    return [
        _hits(_if(F.col("raw").contains("@"), _all(EMAIL)), "email", "email pattern", 3),
        _hits(_if(F.col("raw").contains("%40"), _all(EMAIL_ENCODED)), "email", "URL-encoded email pattern", 3),
    ]


def _cards() -> Column:
    grouped = _all(r"(?<![\w.+\-])\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3}|[ \-]\d{6}[ \-]\d{5})(?![\w]|[.\-]\d)")
    plain = F.filter(words(r"[\w.+\-]+", ".-+"), lambda w: w.rlike(r"^\d{14,16}$"))
    found = _if(F.col("raw").rlike(r"\d{14}|\d{4}[ \-]\d{4}"), F.concat(plain, grouped))
    return _hits(F.filter(found, lambda v: values.card_ok(F.regexp_replace(v, "[ -]", ""))), "pii", "card pattern", 5)


def _ibans() -> Column:
    """IBANs in one word, or in groups of four, of which trailing ones may belong to the next field."""
    grouped = F.filter(_all(IBAN_GROUPS), lambda g: g.contains(" "))
    shorter = lambda g: F.transform(
        F.sequence(F.size(F.split(g, " ")), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(F.split(g, " "), 1, n), " ")
    )
    whole = F.transform(grouped, lambda g: F.element_at(F.concat(F.filter(shorter(g), lambda x: values.iban_ok(F.replace(x, F.lit(" ")))), F.array(F.lit(""))), 1))
    found = _if(F.col("raw").rlike(r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}"), F.concat(F.filter(_all(IBAN), values.iban_ok), F.filter(whole, lambda x: x != "")))
    return _hits(found, "pii", "iban", 6)


def _phones() -> Column:
    found = F.filter(_if(F.col("raw").contains("+"), _all(PHONE)), lambda v: F.length(F.regexp_replace(v, r"\D", "")).between(8, 15))
    return _hits(found, "pii", "phone", 7)


def _domain_users() -> list[Column]:
    some = F.col("raw").contains("\\")
    found = []
    for pattern, fits in ((DOMAIN_USER, ~spans.is_json(F.col("raw"))), (DOMAIN_USER_JSON, spans.is_json(F.col("raw")))):
        for group, kind in ((1, "host"), (2, "user")):
            found.append(_hits(_if(some & fits, _all(pattern, group)), kind, "DOMAIN\\user pattern", 8))
    return found


def _fqdns() -> Column:
    reserved = lambda v: values.has(v, fixed.RESERVED_WORDS) & v.rlike(fixed.RESERVED_DOMAIN)
    found = _if(F.col("raw").rlike(r"\.[A-Za-z]{2}"), _all(FQDN))
    return _hits(F.filter(found, lambda v: ~values.let(F.lower(v), reserved)), "fqdn", "fqdn pattern", 9)


def _logins() -> Column:
    found = F.flatten(F.array(*[_if(values.has(F.col("raw"), some), _all(p, 1)) for p, some in zip(fixed.LOGIN_PHRASES, fixed.LOGIN_WORDS, strict=True)]))
    return _hits(found, "user", "login phrase", 10)


def _distinguished_names() -> list[Column]:
    """CN is a person or a machine; OU and O are an organisation's units, DC a part of its domain."""
    out = []
    for label, kind in (("CN", "user"), ("OU", "host"), ("DC", "host"), ("O", "host")):
        parts = F.transform(_all(rf"(?<![\w=\\]){label}\\?=([^,=\"\\]+)", 1), F.trim)
        out.append(_hits(_if(values.has(F.col("raw"), fixed.DN_WORDS) & (F.size(_all(DN_PART, 1)) >= 2), parts), kind, f"dn pattern ({label})", 11))
    return out


def _secrets() -> list[Column]:
    shapes = F.flatten(F.array(*[_if(values.has(F.col("raw"), some), _all(p)) for p, some in zip(fixed.CREDENTIALS, fixed.CREDENTIAL_WORDS, strict=True)]))
    return [_hits(shapes, "secret", "secret rule", 12), _hits(_if(F.col("raw").rlike("[:=]"), _all(SECRET_PAIR, 1)), "secret", "secret field", 12)]


def ipv4(lines: DataFrame) -> DataFrame:
    """Every IPv4 address, of whatever class."""
    return _rows(lines, _hits(_quads(), "ipv4", "ipv4 pattern", 1))


def ipv4_identities(lines: DataFrame) -> DataFrame:
    """IPv4 hits worth an alias: not loopback, multicast or reserved, and not always a version."""
    rows = _rows(lines, *_ipv4_identities())
    named = F.count_if("version")
    always = rows.groupBy("value").agg(named.alias("v"), F.count("*").alias("n")).where("v > 0 and 2 * v >= n")
    return rows.where("not version").join(always, "value", "left_anti").select(rows.columns)


def email(lines: DataFrame) -> DataFrame:
    return _rows(lines, _emails()[0])


def card(lines: DataFrame) -> DataFrame:
    return _rows(lines, _cards())


def iban(lines: DataFrame) -> DataFrame:
    return _rows(lines, _ibans())


def phone(lines: DataFrame) -> DataFrame:
    return _rows(lines, _phones())


def logins(lines: DataFrame) -> DataFrame:
    return _rows(lines, _logins())


def fqdn(lines: DataFrame) -> DataFrame:
    return _rows(lines, _fqdns())


def secrets(lines: DataFrame) -> DataFrame:
    return _rows(lines, *_secrets())


def fields(pairs: DataFrame) -> DataFrame:
    """Hits by the name of a parsed field (sample_id, line_no, field, value), credentials and personal facts too."""
    squashed = lambda names: [n.replace("_", "") for n in names]

    def hit(said: Column) -> Column:
        """Each of the name's and the value's forms is computed once, and looked at as often as the cases need."""
        canon, value, named = said["canon"], said["value"], said["named"]
        scheme = F.regexp_replace(value, "(?i)^(?:" + "|".join(fixed.AUTH_SCHEMES) + r")\s+", "")
        is_ip = values.ipv4_class(value).isNotNull() | values.ipv6_class(value).isNotNull()
        secret = canon.isin(squashed(fixed.SECRET_FIELDS))
        kind = (
            F.when(canon.isin(squashed(fixed.NEVER_FIELDS)), None).when(secret, "secret")
            .when(named == "ipv4", F.when(values.ipv6_class(value).isNotNull(), "ipv6").when(is_ip, "ipv4").otherwise("pii"))
            .when(named.isNotNull(), F.when(value.rlike(f"^{EMAIL}$"), "email").otherwise(named)).when(canon.isin(squashed(fixed.PERSONAL_FIELDS)), "pii")
        )
        return F.struct(
            F.when(secret, scheme).otherwise(value).alias("value"), kind.alias("kind"), F.concat(F.lit("field "), said["field"]).alias("via"),
            F.lit(13).alias("pass"), F.lit(False).alias("version"),
        )

    said = F.struct(F.col("field").alias("field"), values.canon_field(F.col("field")).alias("canon"), values.field_kind(F.col("field")).alias("named"), F.col("value").alias("value"))
    telling = lambda s: s["named"].isNotNull() | s["canon"].isin(squashed(fixed.SECRET_FIELDS + fixed.PERSONAL_FIELDS))
    # The value's form is worked out where the name says something.
    said = F.transform(F.filter(F.array(said), telling), lambda s: F.struct(s["field"].alias("field"), s["canon"].alias("canon"), values.field_value(s["value"]).alias("value"), s["named"].alias("named")))

    def worth(h: Column) -> Column:
        long_enough = F.length(h["value"]) >= F.when(h["kind"] == "secret", fixed.SECRET_LENGTH).otherwise(2)
        digits = h["value"].rlike(r"^\d+$") & ~h["kind"].isin("pii", "secret")
        return h["kind"].isNotNull() & long_enough & ~digits & ~values.is_never(h["value"]) & ~h["value"].rlike(r"^[\[{]")

    def protocol(h: Column) -> Column:
        own = F.when(h["kind"] == "ipv4", values.ipv4_class(h["value"])).when(h["kind"] == "ipv6", values.ipv6_class(h["value"]))
        return F.coalesce(own.isin("loopback", "multicast", "reserved"), F.lit(False))

    # Tested inside an array, so that each expression is there once.
    return _rows(pairs, F.filter(F.filter(F.transform(said, hit), worth), lambda h: ~protocol(h)))


def vocabulary(pairs: DataFrame, never_fields: list[str]) -> DataFrame:
    """Values of fields that hold words of the schema, which no alias may touch."""
    names = values.canon_field(F.col("field")).isin([n.replace("_", "").lower() for n in never_fields])
    return pairs.where(names & (F.col("value") != "NA")).select(F.lower("value").alias("word")).distinct()


def everything(lines: DataFrame) -> DataFrame:
    """All pattern passes over the lines, in one scan, without values that are never replaced."""
    rows = _rows(
        lines, *_ipv4_identities(), _ipv6(), *_emails(), _hits(_if(F.col("raw").rlike("[:-][0-9A-Fa-f]{2}[:-]"), _all(MAC)), "mac", "mac pattern", 4), _cards(), _ibans(), _phones(),
        *_domain_users(), _fqdns(), _logins(), *_distinguished_names(), *_secrets(),
    )
    return rows.where(~values.is_never(F.col("value")) & (F.length("value") > 1))


def identities(lines: DataFrame) -> DataFrame:
    """Hits of all patterns and of all named values of the lines."""
    return everything(lines).unionByName(fields(parsers.named_values(lines)))


def suspects(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Host-like tokens that nothing has found, top 25 a sample, in samples of two lines or more."""
    tokens = lines.select("sample_id", "line_no", F.explode(_all(r"(?<![A-Za-z])(?:[A-Za-z][A-Za-z0-9]*+(?:[\-_.][A-Za-z0-9]++)++|[A-Za-z]++\d++)")).alias("value"))
    n = lines.groupBy("sample_id").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= fixed.SUSPECT_MIN_LINES)
    counted = tokens.groupBy("sample_id", "value").agg(F.count("*").alias("count"), F.count_distinct("line_no").alias("df")).join(n, "sample_id")
    rare = (F.col("n_lines") < fixed.SUSPECT_SHARE_LINES) | (F.col("df") < fixed.SUSPECT_SHARE * F.col("n_lines"))
    left = counted.where(rare & ~values.is_never(F.col("value"))).join(found.select("sample_id", "value").distinct(), ["sample_id", "value"], "left_anti")
    order = Window.partitionBy("sample_id").orderBy(F.desc("count"), "value")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= fixed.SUSPECT_TOP).select("sample_id", "value", "count", "rank")
