"""Aliases: the same shape, one for each value, keyed by a salt, and kept.

``extend`` gives aliases to values that a mapping table doesn't hold yet.  Each
round draws an alias from a keyed hash of the value and the round; an alias
that the mapping has, that equals some value, or that another value drew too
(the least hash keeps it) is drawn again with more digits.  So a mapping that
is kept and extended, as a stream does batch by batch, never changes an alias
and never gives one twice; a round is one aggregate over the values left.

Private addresses need no rounds: networks are permuted within their block
(a Feistel network, so known pairs tell nothing of others) and hosts rotated within their network, both keyed.  Public networks are drawn from
the documentation networks, then from 198.18.0.0/15, then from 240.0.0.0/4, a
million networks in all; past those an address gets an IPv6 documentation one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions import fixed, values
from maskline.sources.store import kept

MAPPING = "kind string, key string, alias string"
ROUNDS = 24
#: Rounds of the keyed permutation of private networks.
FEISTEL = 6
#: Kinds whose values are one in any case.
ANY_CASE = ["host", "user", "email", "fqdn", "ipv6", "mac"]
#: Characters whose number an alias must keep, or the line would parse otherwise.
WIRE = ["\n", "\t", "|", ",", "=", " "]


def _hash(salt: str, value: Column, tag: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}\x00{tag}\x00"), value), 256)


def _number(hash_: Column, place: int, below: int) -> Column:
    return F.conv(F.substring(hash_, 1 + 7 * place, 7), 16, 10).cast("long") % below


def _pick(hash_: Column, place: int, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (_number(hash_, place, len(words)) + 1).cast("int"))


def scrambled(salt: str, value: Column) -> Column:
    """Each letter or digit replaced by one of its class; hex stays hex, the first digit isn't 0."""
    is_hex = value.rlike("^[0-9A-Fa-f]+$") & value.rlike("[A-Fa-f]")
    lower = F.when(is_hex, "abcdef").otherwise("abcdefghijkmnopqrstuvwxyz")
    upper = F.upper(F.when(is_hex, "abcdef").otherwise("abcdefghjklmnpqrstuvwxyz"))

    def one(c: Column, i: Column) -> Column:
        h = F.sha2(F.concat(F.lit(salt + "\x00char\x00"), value, F.lit("\x00"), i.cast("string")), 256)
        n = F.conv(F.substring(h, 1, 7), 16, 10).cast("int")
        return (
            F.when(c.rlike("[0-9]"), F.when(i == 0, n % 9 + 1).otherwise(n % 10).cast("string"))
            .when(c.rlike("[a-z]"), F.substring(lower, n % F.length(lower) + 1, F.lit(1)))
            .when(c.rlike("[A-Z]"), F.substring(upper, n % F.length(upper) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, "(?!^)"), one), "")


def permuted(salt: str, value: Column) -> Column:
    """Each value another of its shape, no two the same: a keyed permutation of the strings of a shape that leaves none in place.

    For shapes that hold nearly as many values as there are, where an alias that
    is no value can't be found.  Digits stay digits, letters a to f and the others
    keep their case and stay so, a first 0 stays.  Feistel rounds, one step
    onwards, and the same rounds back: a permutation's cycle has no fixed point.
    """
    span = lambda low, size: F.struct(low.alias("low"), F.lit(size).alias("size"))

    def part(c: Column, i: Column) -> Column:
        found = F.when((i == 0) & c.rlike("[1-9]"), span(F.lit(49), 9)).when((i > 0) & c.rlike("[0-9]"), span(F.lit(48), 10))
        for letters, low, size in (("[a-f]", 97, 6), ("[g-z]", 103, 20), ("[A-F]", 65, 6), ("[G-Z]", 71, 20)):
            found = found.when(c.rlike(letters), span(F.lit(low), size))
        return found.otherwise(span(F.ascii(c), 1))

    cells = F.transform(F.split(value, "(?!^)"), lambda c, i: F.struct(c.alias("c"), part(c, i).alias("p")))

    def moved(cs: Column) -> Column:
        half = F.floor((F.size(cs) + 1) / 2)

        def step(d: Column, k: Column) -> Column:
            turn, sign = F.least(k, 2 * FEISTEL - k), F.when(k < FEISTEL, 1).otherwise(-1)
            mine = lambda i: (i < half) == (turn % 2 == 0)
            said = F.array_join(F.transform(F.filter(d, lambda x, i: ~mine(i)), lambda x: x.cast("string")), ",")
            mixed = F.sha2(F.concat(F.lit(f"{salt}\x00shape\x00"), turn.cast("string"), F.lit("\x00"), said), 256)
            number = lambda h, i: F.conv(F.substring(h, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("long")
            each = lambda h: F.transform(
                d, lambda x, i: F.when(k == FEISTEL, F.pmod(x + 1, F.get(cs, i)["p"]["size"])).when(mine(i), F.pmod(x + sign * number(h, i), F.get(cs, i)["p"]["size"])).otherwise(x).cast("long")
            )
            return F.get(F.transform(F.array(mixed), each), 0)

        start = F.transform(cs, lambda x: (F.ascii(x["c"]) - x["p"]["low"]).cast("long"))
        after = F.aggregate(F.sequence(F.lit(0), F.lit(2 * FEISTEL)), start, step)
        return F.array_join(F.zip_with(cs, after, lambda x, d: F.when(x["p"]["size"] > 1, F.char(x["p"]["low"] + d)).otherwise(x["c"])), "")

    return F.get(F.transform(F.array(cells), moved), 0)


def _interpreted(x: Column) -> Column:
    """The expression inside a lambda, which Spark interprets: as generated code these are too large to compile, and each try costs seconds."""
    return F.get(F.transform(F.array(F.lit(0)), lambda _: x), 0)


def _cased(value: Column, alias: Column) -> Column:
    return F.when((value == F.upper(value)) & value.rlike("[A-Z]"), F.upper(alias)).when(value.rlike("^[A-Z][a-z]"), F.initcap(alias)).otherwise(alias)


def _at(v: Column) -> Column:
    """What divides a mailbox: @, or %40 in a URL."""
    return F.when(v.contains("%40") & ~v.contains("@"), "%40").otherwise("@")


def shape(kind: Column, value: Column) -> Column:
    """The kind that a value's alias is drawn as: a value picked by hand, or found by its field, as what it looks like."""
    looks = (
        F.when(value.rlike(r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$"), "email").when(values.ipv4_class(value).isNotNull(), "ipv4")
        .when(values.ipv6_class(value).isNotNull(), "ipv6").when(value.rlike(r"(?i)^(?!\d+\.)[a-z0-9\-]+(\.[a-z0-9\-]+)+$") & value.rlike("[A-Za-z]"), "fqdn").otherwise("pii")
    )
    fixed_class = (kind == "ipv4") & ~values.ipv4_class(value).isin("private", "public", "cgnat", "link-local")
    return F.when(kind == "custom", F.when((looks == "ipv4") & values.ipv4_class(value).isin("loopback", "multicast", "reserved"), "pii").otherwise(looks)).when(fixed_class, "pii").otherwise(kind)


def _key(kind: Column, value: Column) -> Column:
    return F.when(kind.isin(ANY_CASE), F.lower(value)).otherwise(value)


def _digits(hash_: Column, place: int, width: int) -> Column:
    """So many decimal digits of a hash."""
    number = F.conv(F.substring(hash_, 1 + place, 12), 16, 10).cast("long")
    return F.call_function("lpad", (number % 10**width).cast("string"), F.lit(width), F.lit("0"))


def _drawn(rows: DataFrame, salt: str, turn: int, width: int, scale: int) -> DataFrame:
    """Rows (kind, key) with the alias of this turn, ``width`` digits longer; ``scale`` widens the networks drawn from."""
    v, kind = F.col("key"), F.col("kind")
    salted = f"{salt}\x00{turn}"
    rows = rows.withColumn("_who", F.when(kind == "email", F.call_function("substring_index", v, _at(v), F.lit(1))).otherwise(v))
    rows = rows.withColumns(
        {
            "_h": _hash(salted, v, "value"),
            "_u": _hash(salted, F.lower("_who"), "user"),
            "_label": F.substring_index(v, ".", 1),
            "_domain": F.when(v.contains("."), F.regexp_replace(v, r"^[^.]*\.", "")),
        }
    )
    rows = rows.withColumns(
        {
            "_d": _hash(salt, F.coalesce("_domain", F.lit("")), "domain"),
            "_given": _pick(F.col("_u"), 0, fixed.GIVEN),
            "_name": _pick(F.col("_u"), 1, fixed.SURNAME),
            "_word": _pick(F.col("_h"), 3, fixed.HOST_WORD),
            "_n": F.least(F.length(F.regexp_extract("_label", r"(\d*)$", 1)), F.lit(12)),
            "_extra": F.size(F.split("_domain", r"\.")) - 2,
        }
    )
    h, u, who, word = F.col("_h"), F.col("_u"), F.col("_who"), F.col("_word")
    more = _digits(u, 20, width)
    user = (
        F.when(who.rlike(r"^\d+$"), F.concat((_number(u, 2, 9) + 1).cast("string"), _digits(u, 30, 6), more))
        .when(who.rlike(r"(?i)^svc[-_]"), F.concat(F.lit("svc-"), word, _digits(u, 30, 2), more))
        .when(who.endswith("$"), F.concat(word, _digits(u, 30, 2), more, F.lit("$")))
        .when(who.rlike(r"\s"), F.concat_ws(" ", "_given", F.concat("_name", more)))
        .when(who.rlike(r"(?i)^[a-z]+\.[a-z]+$"), F.concat_ws(".", "_given", F.concat("_name", more)))
        .when(who.rlike(r"(?i)^[a-z]+_[a-z]+$"), F.concat_ws("_", "_given", F.concat("_name", more)))
        .otherwise(F.concat(F.substring("_given", 1, 1), "_name", more))
    )
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_extra"), F.lit(1))), lambda k: F.concat(F.lit("d"), F.substring(F.col("_d"), k * 3, F.lit(3))))
    number = F.substring(_digits(h, 20, 12), F.lit(1), F.col("_n"))
    host = F.concat(word, number, _digits(h, 40, width))
    safe = F.concat_ws(".", F.when(F.col("_extra") > 0, F.array_join(inner, ".")), _pick(F.col("_d"), 0, fixed.SAFE_DOMAIN))
    quad = lambda k: F.substring(h, 1 + 4 * k, 4)
    six = F.when(v.rlike("^f[cd]"), "fd00:").when(v.rlike("^fe[89ab]"), "fe80:").otherwise("2001:db8:")
    if turn + scale == 0:
        net = _pick(h, 0, ["192.0.2", "198.51.100", "203.0.113"])
    elif turn + scale == 1:
        net = F.concat_ws(".", F.lit("198"), (_number(h, 0, 2) + 18).cast("string"), _number(h, 1, 256).cast("string"))
    elif turn < ROUNDS // 2:
        net = F.concat_ws(".", (_number(h, 0, 16) + 240).cast("string"), _number(h, 1, 256).cast("string"), _number(h, 2, 256).cast("string"))
    else:
        net = F.concat(F.lit("2001:db8:"), quad(3), F.lit(":"), quad(4), F.lit("::"))
    alias = (
        F.when(kind == "net", net)
        .when(kind == "ipv6", F.concat(six, quad(0), F.lit(":"), quad(1), F.lit("::"), quad(2)))
        .when(kind == "mac", F.replace(F.concat_ws(":", F.lit("02"), *[F.substring(h, 1 + 2 * k, 2) for k in range(5)]), F.lit(":"), F.when(v.contains("-"), "-").otherwise(":")))
        .when(kind == "email", F.concat(user, _at(v), _pick(h, 5, fixed.SAFE_DOMAIN)))
        .when(kind.isin("host", "fqdn"), F.when(F.col("_domain").isNotNull(), F.concat_ws(".", host, safe)).otherwise(host))
        .when(kind == "user", user)
    )
    count = lambda c: F.struct(*[F.length(c) - F.length(F.replace(c, F.lit(x), F.lit(""))) for x in WIRE])
    rows = rows.withColumn("_alias", _interpreted(alias))
    same = count(F.col("_alias")) == count(v)
    given = F.when(F.col("_alias").isNotNull() & (same | (kind == "net")), F.col("_alias")).otherwise(scrambled(salted, v))
    rows = rows.withColumn("alias", _interpreted(given))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def _wanted(entries: DataFrame) -> DataFrame:
    """(kind, key) of the aliases that entries need: of public addresses, that of their network."""
    kind, v = shape(F.col("kind"), F.col("original")), F.col("original")
    cls = values.ipv4_class(v)
    key = F.when(kind != "ipv4", F.struct(kind.alias("kind"), _key(kind, v).alias("key")))
    key = F.when((kind == "ipv4") & (cls == "public"), F.struct(F.lit("net").alias("kind"), F.substring_index(v, ".", 3).alias("key"))).otherwise(key)
    return entries.select(key.alias("k")).where("k is not null").select("k.*").distinct()


def extend(mapping: DataFrame | None, entries: DataFrame, salt: str, taken: DataFrame | None = None) -> DataFrame:
    """New rows (kind, key, alias) for entries (original, kind) that the mapping lacks; taken(word) are words no alias may be."""
    left = _wanted(entries)
    used = left.sparkSession.createDataFrame([], "kind string, low string")
    words = entries.select(F.lower("original").alias("low"))
    if taken is not None:
        words = words.unionByName(taken.select(F.lower("word").alias("low")))
    if mapping is not None:
        left = left.join(mapping, ["kind", "key"], "left_anti")
        used = mapping.select("kind", F.lower("alias").alias("low"))
    left = kept(left)
    n, found = left.count(), []
    for turn in range(ROUNDS):
        if not n:
            break
        # Wide enough from the first turn that nearly all draws are unlike.
        scale = 0 if n < 4 else 1 if n < 64 else 2
        drawn = _drawn(left, salt, turn, min(12, len(str(n)) - 1 + 2 * turn), scale).withColumn("low", F.lower("alias"))
        drawn = drawn.join(words, "low", "left_anti").join(used, ["kind", "low"], "left_anti")
        first = F.min_by(F.struct("key", "alias"), F.struct(_hash(salt, F.col("key"), "order"), "key"))
        won = kept(drawn.groupBy("kind", "low").agg(first.alias("f")).select("kind", "f.key", "f.alias"))
        found.append(won)
        used = kept(used.unionByName(won.select("kind", F.lower("alias").alias("low"))))
        left = left.join(won, ["kind", "key"], "left_anti")
        n = left.count()
    if n:
        raise RuntimeError(f"{n} values found no alias of their own in {ROUNDS} rounds")
    out = left.sparkSession.createDataFrame([], MAPPING)
    for rows in found:
        out = out.unionByName(rows)
    return out


def _permuted(salt: str, name: str, number: Column, size: int) -> Column:
    """A keyed permutation of 0..size-1, an even power of two: a Feistel network whose rounds are hashes."""
    half = 1 << (size.bit_length() - 1) // 2
    left, right = F.floor(number / half).cast("long"), (number % half).cast("long")
    for turn in range(FEISTEL):
        mixed = _number(_hash(salt, F.concat(F.lit(f"{name}\x00{turn}\x00"), right.cast("string")), "net"), 0, half)
        left, right = right, left.bitwiseXOR(mixed)
    return left * half + right


def _private(salt: str, v: Column) -> Column:
    """The network of a private, shared or link-local address, permuted within its block."""
    a, b, c = (F.split(v, r"\.")[k].try_cast("long") for k in range(3))
    text = lambda x: x.cast("long").cast("string")

    def two(name: str, first: str, low: int, size: int) -> Column:
        p = _permuted(salt, name, (b - low) * 256 + c, size)
        return F.concat_ws(".", F.lit(first), text(F.floor(p / 256) + low), text(p % 256))

    one = lambda name, first: F.concat_ws(".", F.lit(first), text(_permuted(salt, name, c, 256)))
    return (
        F.when(a == 10, two("10", "10", 0, 65536)).when(a == 172, two("172", "172", 16, 4096)).when(a == 192, one("192", "192.168"))
        .when(a == 100, two("100", "100", 64, 16384)).when(a == 169, one("169", "169.254"))
    )


def aliased(entries: DataFrame, mapping: DataFrame, salt: str) -> DataFrame:
    """Entries with the ``alias`` that the mapping gives them."""
    v = F.col("original")
    kind = shape(F.col("kind"), v)
    public = (kind == "ipv4") & (values.ipv4_class(v) == "public")
    rows = entries.withColumns(
        {
            "_kind": F.when(public, "net").otherwise(kind),
            "_key": F.when(public, F.substring_index(v, ".", 3)).otherwise(_key(kind, v)),
            "_turn": _number(_hash(salt, F.substring_index(v, ".", 3), "host"), 0, 255) + 1,
        }
    )
    given = mapping.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("alias").alias("_given"))
    rows = rows.join(given, ["_kind", "_key"], "left")
    host = ((F.split(v, r"\.")[3].try_cast("long") + F.col("_turn")) % 256).cast("string")
    spilled = F.concat("_given", F.lower(F.hex(host.cast("long"))))
    label = F.substring_index(v, ".", 1)
    cased = F.when(
        F.col("_kind").isin("fqdn", "host") & F.col("_given").contains("."),
        F.concat(_cased(label, F.substring_index("_given", ".", 1)), F.lit("."), F.regexp_replace("_given", r"^[^.]*\.", "")),
    ).otherwise(F.when(F.col("_kind").isin(ANY_CASE), _cased(v, F.col("_given"))).otherwise(F.col("_given")))
    alias = (
        F.when(F.col("_kind") == "net", F.when(F.col("_given").contains(":"), spilled).otherwise(F.concat_ws(".", "_given", host)))
        .when(F.col("_kind") == "ipv4", F.concat_ws(".", _private(salt, v), host)).otherwise(cased)
    )
    return rows.withColumn("alias", _interpreted(alias)).drop("_kind", "_key", "_turn", "_given")


def with_aliases(entries: DataFrame, salt: str, taken: DataFrame | None = None) -> DataFrame:
    """Entries with ``alias``, without a mapping from before; taken(word): tokens of the sample no alias may equal."""
    return aliased(entries, kept(extend(None, entries, salt, taken)), salt)
