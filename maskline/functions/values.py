"""Predicates and normal forms of single values, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskline.functions import fixed


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), 0)


def has(value: Column, words: list[str]) -> Column:
    """Whether any of the words is in the value: far cheaper than a pattern that needs one of them."""
    return reduce(Column.__or__, [value.contains(w) for w in words])


def snake_field(name: Column) -> Column:
    apart = lambda n: F.when(n == F.lower(n), n).otherwise(F.regexp_replace(n, r"([a-z0-9])([A-Z])", "$1_$2"))
    return F.lower(F.regexp_replace(let(name, apart), r"[-\s.]+", "_"))


def canon_field(name: Column) -> Column:
    unquoted = lambda n: F.when(has(n, ['"', "'"]), F.regexp_replace(n, r"^[\"']|[\"']$", "")).otherwise(n)
    last = F.substring_index(F.lower(let(F.trim(name), unquoted)), ".", -1)
    return let(F.translate(last, "_- ", ""), lambda n: F.when(n.rlike("[^a-z0-9]"), F.regexp_replace(n, "[^a-z0-9]", "")).otherwise(n))


def field_kind(name: Column) -> Column:
    """user, host or ipv4 by the name of a field, else null."""
    def kind(snake: Column) -> Column:
        found = (
            F.when(snake.rlike(f"{fixed.USER_FIELD}|{fixed.ROLE_USER}"), "user")
            .when(snake.rlike(f"{fixed.HOST_FIELD}|{fixed.ROLE_HOST}"), "host")
            .when(snake.rlike(f"{fixed.IP_FIELD}|{fixed.ROLE_IP}"), "ipv4")
        )
        return F.when(has(snake, fixed.IDENTITY_WORDS) & ~snake.rlike(fixed.NOT_IDENTITY), found)

    return let(snake_field(name), kind)


def field_value(raw: Column) -> Column:
    """A parsed value without blanks around it and one pair of quotes."""
    def bare(v: Column) -> Column:
        quoted = F.length(v) > 1
        both = (v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))
        # The pattern's $ stands before a line's end too; elsewhere the ends tell, without reading a long value by a pattern.
        broken = (v.startswith('"') | v.startswith("'")) & F.substring(v, -1, 1).isin("\n", "\r", "\x85", "\u2028", "\u2029")
        inner = F.when(broken, F.trim(F.regexp_replace(v, r"^([\"'])([\s\S]*)\1$", "$2"))).otherwise(v)
        return F.when(quoted & both, F.trim(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(inner)
    return let(F.trim(raw), bare)


def is_never(value: Column) -> Column:
    return F.lower(value).isin(fixed.NEVER)


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# The address blocks of each class, the first that fits.
_IPV4_CLASSES = [
    ("loopback", r"^127\."),
    ("private", r"^10\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\."),
    ("link-local", r"^169\.254\."),
    ("cgnat", r"^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\."),
    ("multicast", r"^(?:22[4-9]|23\d)\."),
    ("reserved", r"^0\.|^2[45]\d\.|^192\.0\.2\.|^198\.51\.100\.|^203\.0\.113\.|^198\.1[89]\."),
]


def ipv4_class(ip: Column) -> Column:
    """The class of a dotted quad; null where it isn't an address."""
    name = F.lit("public")
    for label, block in reversed(_IPV4_CLASSES):
        name = F.when(ip.rlike(block), label).otherwise(name)
    return F.when(ip.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), name)


def ipv6_class(ip: Column) -> Column:
    low, groups = F.lower(ip), F.size(F.split(ip, ":"))
    shape = low.rlike("^[0-9a-f:]+$") & ~low.rlike(":::|[0-9a-f]{5}") & (
        (low.contains("::") & (groups <= 8) & ~low.rlike("::.*::")) | ((groups == 8) & ~low.contains("::") & ~low.rlike("^:|:$"))
    )
    return F.when(
        shape,
        F.when(low.isin("::1", "::"), "loopback").when(low.rlike("^fe[89ab]"), "link-local").when(low.rlike("^f[cd]"), "private")
        .when(low.rlike("^ff"), "multicast").when(low.rlike("^2001:0?db8(:|$)"), "reserved").otherwise("public"),
    )


def card_ok(digits: Column) -> Column:
    """Issuer prefix with its length, and the Luhn sum."""
    n, p2, p3, p4 = F.length(digits), *(F.substring(digits, 1, k).try_cast("int") for k in (2, 3, 4))
    issuer = (
        (digits.startswith("4") & (n == 16))
        | ((p2.between(51, 55) | p4.between(2221, 2720)) & (n == 16))
        | (p2.isin(34, 37) & (n == 15))
        | (((p4 == 6011) | (p2 == 65) | p3.between(644, 649)) & (n == 16))
        | (p4.between(3528, 3589) & (n == 16))
        | ((p2.isin(36, 38) | p3.between(300, 305)) & n.isin(14, 16))
        | ((p2 == 62) & (n == 16))
    )
    return issuer & F.call_function("luhn_check", digits)


def iban_ok(iban: Column) -> Column:
    """Mod-97 check of an IBAN without blanks, 15 to 34 characters."""
    moved = F.upper(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)))
    digits = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    left = F.aggregate(
        F.filter(F.split(F.array_join(digits, ""), ""), lambda c: c != ""), F.lit(0), lambda m, c: ((m * 10 + c.cast("int")) % 97).cast("int")
    )
    return iban.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (left == 1)


def canonical_sourcetype(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[\s:/\-.]+", "_"), "^_|_$", "")


def fingerprint(text: Column) -> Column:
    """djb2 over the characters, 32 bits, as hex and length."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda s, c: ((s * 33).bitwiseXOR(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat_ws("-", F.lower(F.hex(h)), F.length(text).cast("string"))
