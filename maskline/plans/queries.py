"""Queries over the driver tables, one or more for each operator, with their SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.functions import times, values
from maskline.operators import apply, checks, detect, guards, ladder, marks, mint, parsers, patterns, picks, plan, prefixed, profiles, prove, recognise, registry, secret_rules, signatures, steps, vendors
from maskline.plans import render
from maskline.sources import library, lines as src
from maskline.sources.store import fresh, kept

SALT = "fixed-for-tests"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.to_lines(src.spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src.spread(table(spark, sf_dir, "orders"))
    return render.as_lines(orders, "orders", "o_orderkey", render.kvp(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


def event_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as key=value lines with an address, a user, a host and a mailbox derived from the user."""
    u = F.col("user_id")
    rows = src.spread(table(spark, sf_dir, "events")).select(
        "event_id", F.concat_ws(".", F.lit("10"), F.lit("7"), F.floor(u / 200) % 200, u % 200 + 1).alias("src_ip"),
        F.concat(F.lit("person"), u).alias("username"), F.concat(F.lit("srv"), u, F.lit(".corp.acme.io")).alias("hostname"),
        F.concat(F.lit("p"), u, F.lit("@acme.io")).alias("mail"), F.col("event_type").alias("action"),
    )
    return render.as_lines(rows, "events", "event_id", render.kvp(["event_id", "src_ip", "username", "hostname", "mail", "action"]))


def found(lines: DataFrame) -> DataFrame:
    """Entries for the lines: what patterns find in them and what their fields say."""
    return kept(plan.collapse_composites(kept(plan.entries(detect.identities(lines)))))


def planned(lines: DataFrame) -> DataFrame:
    return kept(mint.with_aliases(found(lines), SALT))


LINES = """lines AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, CAST(i AS BIGINT) AS line_no, parts[i] AS raw
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) AS parts FROM documents) s,
    unnest(range(1, len(parts) + 1)) r(i) WHERE trim(parts[i]) <> '')"""
QUADS = LINES + r""", tokens AS (SELECT sample_id, line_no, rtrim(unnest(regexp_extract_all(raw, '[\w.]+')), '.') AS value FROM lines),
    quads AS (SELECT *, CAST(string_split(value, '.')[1] AS INT) a, CAST(string_split(value, '.')[2] AS INT) b,
        CAST(string_split(value, '.')[3] AS INT) c, CAST(string_split(value, '.')[4] AS INT) d
        FROM tokens WHERE regexp_full_match(value, '(\d{1,3}\.){3}\d{1,3}') AND NOT regexp_matches(value, '(^|\.)0\d')),
    addresses AS (SELECT sample_id, line_no, value, CASE WHEN a = 127 THEN 'loopback'
        WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private'
        WHEN a = 169 AND b = 254 THEN 'link-local' WHEN a = 100 AND b BETWEEN 64 AND 127 THEN 'cgnat'
        WHEN a BETWEEN 224 AND 239 THEN 'multicast'
        WHEN a = 0 OR a >= 240 OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b = 51 AND c = 100)
          OR (a = 203 AND b = 0 AND c = 113) OR (a = 198 AND b BETWEEN 18 AND 19) THEN 'reserved' ELSE 'public' END AS ip_class
        FROM quads WHERE a <= 255 AND b <= 255 AND c <= 255 AND d <= 255)"""


@query(f"WITH {LINES} SELECT sample_id, line_no, raw FROM lines")
def lines_from_documents(spark, d):
    return doc_lines(spark, d)


@query(f"WITH {QUADS} SELECT sample_id, line_no, value, ip_class FROM addresses")
def ipv4_detect(spark, d):
    return detect.ipv4(doc_lines(spark, d)).select("sample_id", "line_no", "value", values.ipv4_class(F.col("value")).alias("ip_class"))


@query(f"WITH {QUADS} SELECT ip_class, count(*) AS hits, count(DISTINCT value) AS addresses FROM addresses GROUP BY ip_class")
def ipv4_class_counts(spark, d):
    hits = detect.ipv4(doc_lines(spark, d))
    return hits.groupBy(values.ipv4_class(F.col("value")).alias("ip_class")).agg(F.count("*").alias("hits"), F.count_distinct("value").alias("addresses"))


@query(f"WITH {LINES} SELECT sample_id, line_no, unnest(regexp_extract_all(raw, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{{2,}}')) AS value FROM lines")
def email_detect(spark, d):
    return detect.email(doc_lines(spark, d)).select("sample_id", "line_no", "value")


@query(f"""WITH {LINES}, pluses AS (SELECT sample_id, line_no, string_split(raw, '+') AS parts FROM lines WHERE contains(raw, '+')),
    each AS (SELECT sample_id, line_no, array_to_string(parts[1:i], '+') AS before, '+' || parts[i + 1] AS text FROM pluses, unnest(range(1, len(parts))) r(i)),
    found AS (SELECT *, regexp_extract(text, '^\\+[1-9]\\d{{0,3}}[ .\\-(](?: ?[\\d().\\-]){{4,18}}\\d') AS apart, regexp_extract(text, '^(\\+[1-9]\\d{{7,14}})(?:\\D|$)', 1) AS joined FROM each)
    SELECT sample_id, line_no, CASE WHEN apart <> '' THEN apart ELSE joined END AS value FROM found
    WHERE NOT regexp_matches(before, '[\\w+]$') AND NOT regexp_matches(before, '\\d\\d:\\d\\d([.,]\\d{{1,9}})?\\s?$')
      AND ((apart <> '' AND length(regexp_replace(apart, '\\D', '', 'g')) BETWEEN 8 AND 15)
        OR (joined <> '' AND regexp_matches(right(before, 40), '(?i)(phone|tel|mobile|msisdn|cell|fax|sms|whatsapp|call|contact)')))""")
def phone_detect(spark, d):
    return detect.phone(doc_lines(spark, d)).select("sample_id", "line_no", "value")


@query(f"""WITH {LINES}, tokens AS (SELECT sample_id, line_no, rtrim(unnest(regexp_extract_all(raw, '[\\w.+\\-]+')), '.-+') AS value FROM lines),
    runs AS (SELECT *, length(value) n, CAST(substr(value, 1, 2) AS INT) p2, CAST(substr(value, 1, 3) AS INT) p3, CAST(substr(value, 1, 4) AS INT) p4,
        [CAST(x AS INT) FOR x IN string_split(reverse(value), '')] AS ds FROM tokens WHERE regexp_full_match(value, '\\d{{14,16}}'))
    SELECT sample_id, line_no, value FROM runs WHERE
      ((p2 BETWEEN 40 AND 49 AND n = 16) OR ((p2 BETWEEN 51 AND 55 OR p4 BETWEEN 2221 AND 2720) AND n = 16) OR (p2 IN (34, 37) AND n = 15)
       OR ((p4 = 6011 OR p2 = 65 OR p3 BETWEEN 644 AND 649) AND n = 16) OR (p4 BETWEEN 3528 AND 3589 AND n = 16)
       OR ((p2 IN (36, 38) OR p3 BETWEEN 300 AND 305) AND n IN (14, 16)) OR (p2 = 62 AND n = 16))
      AND list_sum([CASE WHEN i % 2 = 1 THEN ds[i] WHEN ds[i] * 2 > 9 THEN ds[i] * 2 - 9 ELSE ds[i] * 2 END FOR i IN range(1, n + 1)]) % 10 = 0""")
def card_luhn(spark, d):
    return detect.card(doc_lines(spark, d)).where(F.col("value").rlike(r"^\d+$")).select("sample_id", "line_no", "value")


@query("""SELECT 'orders' AS sample_id, o_orderkey AS line_no, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
    o_orderstatus, o_orderpriority FROM orders""")
def kvp_roundtrip_orders(spark, d):
    f = parsers.kvp(F.col("raw"))
    return order_lines(spark, d).select("sample_id", "line_no", *[f[c].alias(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")])


@query("SELECT event_id AS line_no, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props FROM events")
def json_roundtrip_events(spark, d):
    rows = render.as_lines(table(spark, d, "events"), "events", "event_id", render.json(["event_id", "user_id", "event_type", "props"]))
    f = parsers.json(F.col("raw"))
    return rows.select("line_no", *[f[c].alias(c) for c in ("event_id", "user_id", "event_type", "props")])


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]


@query(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in LINEITEM)} FROM lineitem")
def csv_roundtrip_lineitem(spark, d):
    rows = render.as_lines(table(spark, d, "lineitem"), "lineitem", "l_orderkey", render.delimited(LINEITEM))
    f = parsers.delimited(F.col("raw"), LINEITEM)
    return rows.select(*[f[c].alias(c) for c in LINEITEM])


@query("SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS suid, event_type AS act, 'Acme' AS vendor, 'Gate' AS product FROM events")
def cef_roundtrip_events(spark, d):
    e = table(spark, d, "events").withColumn("suid", F.col("user_id")).withColumn("act", F.col("event_type"))
    rows = render.as_lines(e, "cef", "event_id", render.cef("Acme", "Gate", F.lit("100"), F.col("event_type"), ["suid", "act"]))
    f, h = parsers.cef(F.col("raw")), parsers.security_header(F.col("raw"))
    return rows.select("line_no", f["suid"].alias("suid"), f["act"].alias("act"), h.vendor.alias("vendor"), h["product"].alias("product"))


@query("SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS usrId, event_type AS cat FROM events")
def leef_roundtrip_events(spark, d):
    e = table(spark, d, "events").withColumn("usrId", F.col("user_id")).withColumn("cat", F.col("event_type"))
    f = parsers.leef(F.col("raw"))
    return render.as_lines(e, "leef", "event_id", render.leef("Acme", "Gate", F.lit("7"), ["usrId", "cat"])).select("line_no", f["usrId"].alias("usrId"), f["cat"].alias("cat"))


@query("SELECT event_id AS line_no, '10.0.0.' || (user_id % 250 + 1) AS client, 'user' || user_id AS usr, '/' || event_type AS path, '200' AS status FROM events")
def clf_roundtrip_events(spark, d):
    line = F.concat(F.lit("10.0.0."), F.col("user_id") % 250 + 1, F.lit(" - user"), F.col("user_id"), F.lit(' [02/Jan/2024:03:04:05 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" 200 17'))
    f = parsers.clf(F.col("raw"))
    return render.as_lines(table(spark, d, "events"), "clf", "event_id", line).select("line_no", f["client"].alias("client"), f["user"].alias("usr"), f["path"].alias("path"), f["status"].alias("status"))


@query("SELECT event_id AS line_no, 'host' || (user_id % 50) AS host, 'app' AS program, event_type || ' done' AS message FROM events")
def syslog_roundtrip_events(spark, d):
    line = F.concat(F.lit("<134>Jan  2 03:04:05 host"), F.col("user_id") % 50, F.lit(" app[7]: "), F.col("event_type"), F.lit(" done"))
    f = parsers.syslog(F.col("raw"))
    return render.as_lines(table(spark, d, "events"), "syslog", "event_id", line).select("line_no", *[f[c].alias(c) for c in ("host", "program", "message")])


@query("SELECT event_id AS line_no, 'user' || user_id AS TargetUserName, event_type AS Task FROM events")
def xml_roundtrip_events(spark, d):
    line = F.concat(F.lit("<Event><Task>"), F.col("event_type"), F.lit('</Task><Data Name="TargetUserName">user'), F.col("user_id"), F.lit("</Data></Event>"))
    f = parsers.xml(F.col("raw"))
    return render.as_lines(table(spark, d, "events"), "xml", "event_id", line).select("line_no", f["TargetUserName"].alias("TargetUserName"), f["Task"].alias("Task"))


@query("SELECT 'c' AS sample_id, CAST(c_custkey + 1 AS BIGINT) AS line_no, CAST(c_custkey AS VARCHAR) AS id, c_name AS username FROM customer")
def csv_header_customer(spark, d):
    head = spark.createDataFrame([("c", 0, "id,username")], "sample_id string, line_no long, raw string")
    rows = table(spark, d, "customer").select(F.lit("c").alias("sample_id"), (F.col("c_custkey") + 1).alias("line_no"), F.concat_ws(",", "c_custkey", "c_name").alias("raw"))
    f = parsers.with_header(head.unionByName(rows))
    return f.select("sample_id", "line_no", F.col("fields")["id"].alias("id"), F.col("fields")["username"].alias("username"))


@query("""SELECT 'mix' || (event_id % 3) AS sample_id, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'kvp' ELSE 'text' END AS format,
    count(*) AS lines, count(*) AS total FROM events GROUP BY ALL""")
def format_share(spark, d):
    k = F.col("event_id") % 3
    line = F.when(k == 0, render.json(["event_id", "event_type"])).when(k == 1, render.kvp(["event_id", "user_id", "event_type"])).otherwise(F.concat(F.lit("plain "), F.col("event_type")))
    rows = table(spark, d, "events").select(F.concat(F.lit("mix"), k).alias("sample_id"), F.col("event_id").alias("line_no"), line.alias("raw"))
    return recognise.format_shares(rows, most=None)


@query("""SELECT field, CAST(n AS BIGINT) AS occurrences, CAST(u AS BIGINT) AS distinct_values FROM (
    SELECT 'oorderkey' AS field, count(*) n, count(DISTINCT o_orderkey) u FROM orders UNION ALL SELECT 'ocustkey', count(*), count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'oorderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'oorderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders)""")
def field_census(spark, d):
    rows = order_lines(spark, d)
    return plan.census(parsers.long(rows.select("sample_id", "line_no", parsers.kvp(F.col("raw")).alias("fields"))))


FIELD_KINDS = {"src_ip": "ipv4", "ActorUsername": "user", "cs-username": "user", "Caller Computer Name": "host", "user_agent": None, "user_type": None, "clientip": "ipv4", "remoteuser": "user", "desthost": "host", "action": None, "dest_port": None}


def _named_events(spark, d, names) -> DataFrame:
    """Events with one of the names each, by their number."""
    pick = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "event_type", pick.alias("name"))


def _named_sql(rows: list[tuple], columns: str) -> str:
    """The events of ``_named_events`` joined with what each name should give."""
    text = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    values_ = ", ".join(f"({k}, {', '.join(map(text, r))})" for k, r in enumerate(rows))
    return f"FROM events JOIN (VALUES {values_}) t(k, {columns}) ON event_id % {len(rows)} = k"


@query("SELECT event_type, field, kind, count(*) AS events " + _named_sql(list(FIELD_KINDS.items()), "field, kind") + " GROUP BY ALL")
def field_identity_kind(spark, d):
    rows = _named_events(spark, d, list(FIELD_KINDS)).withColumnRenamed("name", "field")
    return rows.groupBy("event_type", "field", values.field_kind(F.col("field")).alias("kind")).agg(F.count("*").alias("events"))


@query(f"""WITH {LINES}, found AS (SELECT unnest(regexp_extract_all(raw, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)*\\.[A-Za-z]{{2,}}')) AS v FROM lines)
    SELECT v AS original, 'email' AS kind, count(*) AS "count" FROM found GROUP BY v""")
def entries_group(spark, d):
    return plan.entries(detect.email(doc_lines(spark, d))).select("original", "kind", "count")


@query("""SELECT kind, count(DISTINCT u) AS entries, true AS same_shape, true AS one_to_one FROM (
    SELECT 'ipv4' AS kind, (user_id // 200) % 200 * 1000 + user_id % 200 AS u FROM events UNION ALL SELECT 'user', user_id FROM events
    UNION ALL SELECT 'email', user_id FROM events UNION ALL SELECT k, user_id FROM events, (VALUES ('fqdn')) t(k)) GROUP BY kind""")
def alias_shape_preserved(spark, d):
    e = planned(event_hosts(spark, d))
    shape = lambda c: F.size(F.split(c, r"[.@]"))
    same = F.when(F.col("kind").isin("ipv4", "fqdn"), shape("original") == shape("alias")).when(F.col("kind") == "email", F.col("alias").contains("@")).otherwise(True)
    return e.groupBy("kind").agg(F.count("*").alias("entries"), F.bool_and(same & (F.col("alias") != F.col("original"))).alias("same_shape"), (F.count_distinct("alias") == F.count("*")).alias("one_to_one"))


@query("SELECT count(*) AS lines, count(*) AS changed, CAST(0 AS BIGINT) AS residual, CAST(0 AS BIGINT) AS broken FROM events")
def apply_residual_zero(spark, d):
    lines = kept(event_hosts(spark, d))
    found = planned(lines)
    changed = kept(apply.applied(lines, found))
    left = prove.residual(changed, found).agg(F.count("*").alias("residual"))
    broken = prove.structure(changed).agg(F.count("*").alias("broken"))
    return changed.agg(F.count("*").alias("lines"), F.count_if(F.col("replaced") > 0).alias("changed")).join(left).join(broken)


@query("""SELECT kind, count(*) AS lines_before, CAST(0 AS BIGINT) AS lines_after
    FROM events, (VALUES ('ipv4'), ('user'), ('pii')) t(kind) GROUP BY kind""")
def residual_detects(spark, d):
    """Lines with a value of each kind inside a range, a path and quotes: the proof sees all before, none after."""
    u = F.col("user_id")
    address = F.concat_ws(".", F.lit("10"), F.lit("7"), F.floor(u / 200) % 200, u % 200 + 1)
    names = {"ipv4": address, "user": F.concat(F.lit("person"), u), "pii": F.concat(F.lit("Given"), u % 90, F.lit(" Family"))}
    rows = table(spark, d, "events").select("event_id", *[x.alias(k) for k, x in names.items()])
    entries = rows.select(F.explode(F.array(*[F.struct(F.col(k).alias("original"), F.lit(k).alias("kind")) for k in names])).alias("e")).select("e.*").distinct()
    entries = kept(mint.with_aliases(entries.withColumn("enabled", F.lit(True)), SALT))
    raw = F.concat(F.lit("from "), "ipv4", F.lit("-"), "ipv4", F.lit("/24 open /home/"), "user", F.lit('/x by "'), "pii", F.lit('"'))
    lines = kept(rows.select(F.lit("events").alias("sample_id"), F.col("event_id").alias("line_no"), raw.alias("raw")))
    counts = lambda changed, name: prove.residual(changed, entries).groupBy("kind").agg(F.count("*").alias(name))
    # Nothing is replaced yet, so all of a line is rest: an original that is another's alias counts too.
    before = counts(lines.withColumns({"after": F.col("raw"), "rest": F.col("raw")}), "lines_before")
    after = counts(kept(apply.applied(lines, entries)), "lines_after")
    return before.join(after, "kind", "left").select("kind", "lines_before", F.coalesce("lines_after", F.lit(0)).cast("long").alias("lines_after"))


@query("""SELECT kind, count(DISTINCT v) AS n_values, count(DISTINCT v) AS n_aliases, true AS first_stay FROM (
    SELECT 'user' AS kind, user_id AS v FROM events UNION ALL SELECT 'ipv4', user_id FROM events) GROUP BY kind""")
def aliases_in_two_batches(spark, d):
    """Aliases of half the values, then of all with the mapping extended: one each, and the first ones stay."""
    u = F.col("user_id")
    address = F.concat_ws(".", u % 90 + 20, F.floor(u / 90) % 250, F.floor(u / 22500) % 250, F.lit("7"))
    both = F.array(F.struct(F.concat(F.lit("person"), u).alias("original"), F.lit("user").alias("kind")), F.struct(address.alias("original"), F.lit("ipv4").alias("kind")))
    every = kept(table(spark, d, "events").select(u, F.explode(both).alias("e")).select("user_id", "e.*").distinct())
    half = every.where("user_id % 2 = 0").drop("user_id")
    first = kept(mint.extend(None, half, SALT))
    mapping = kept(first.unionByName(mint.extend(first, every.drop("user_id"), SALT)))
    before = mint.aliased(half, first, SALT).withColumnRenamed("alias", "was")
    now = mint.aliased(every.drop("user_id"), mapping, SALT).join(before, ["original", "kind"], "left")
    stay = F.bool_and(F.col("was").isNull() | (F.col("was") == F.col("alias")))
    return now.groupBy("kind").agg(F.count("*").alias("n_values"), F.count_distinct("alias").alias("n_aliases"), stay.alias("first_stay"))


@query("""SELECT count(DISTINCT 'a' || ((user_id // 200) % 200 * 1000 + user_id % 200)) + 2 * count(DISTINCT user_id) AS total,
    count(DISTINCT 'a' || ((user_id // 200) % 200 * 1000 + user_id % 200)) + 2 * count(DISTINCT user_id) AS replaced, false AS blind, true AS ok FROM events""")
def coverage_proof(spark, d):
    lines = kept(event_hosts(spark, d))
    changed = kept(apply.applied(lines, planned(lines)))
    pairs = lambda c: parsers.long(changed.select("sample_id", "line_no", parsers.kvp(F.col(c)).alias("fields")))
    return prove.verdict(prove.coverage(pairs("raw"), pairs("after")))


@query("SELECT o_orderkey AS line_no, 'delimiters changed' AS reason FROM orders WHERE o_orderstatus = 'F'")
def structure_diff(spark, d):
    rows = order_lines(spark, d).withColumn("after", F.when(F.col("raw").contains("o_orderstatus=F"), F.concat("raw", F.lit(",x"))).otherwise(F.col("raw")))
    return prove.structure(rows).select("line_no", "reason")


@query("SELECT DISTINCT lower(o_orderpriority) AS word FROM orders")
def vocabulary_words(spark, d):
    rows = order_lines(spark, d)
    return detect.vocabulary(parsers.long(rows.select("sample_id", "line_no", parsers.kvp(F.col("raw")).alias("fields"))), ["o_orderpriority"])


@query("""SELECT sample_id, value, "count", CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY "count" DESC, value) AS rank FROM (
    SELECT 's' || (event_id % 4) AS sample_id, 'node-' || (user_id % 40) AS value, count(*) AS "count", count(DISTINCT event_id) AS df FROM events GROUP BY ALL) a
    JOIN (SELECT 's' || (event_id % 4) AS s, count(*) AS n FROM events GROUP BY 1) b ON a.sample_id = b.s WHERE df < 0.75 * n) WHERE rank <= 25""")
def suspect_topk(spark, d):
    rows = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("event_id") % 4).alias("sample_id"), F.col("event_id").alias("line_no"), F.concat(F.lit("seen node-"), F.col("user_id") % 40, F.lit(" up")).alias("raw"))
    none = spark.createDataFrame([], "sample_id string, value string")
    return detect.suspects(rows, none)


@query("""SELECT r_name AS name, 'system' AS origin FROM region UNION ALL SELECT n_name, 'pack' FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)""")
def catalog_union_anti(spark, d):
    system = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("system").alias("origin"))
    return library.catalogue(system, table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("pack").alias("origin")))


def _overlay(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("doc"))
    segment = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("seg"))
    overlay = c.join(segment, "key").where("seg = 'BUILDING'").select("key", F.concat("doc", F.lit("*")).alias("doc"))
    return c, segment.where("seg = 'MACHINERY'").select("key"), overlay


@query("""SELECT c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name || '*' ELSE c_name END AS doc FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def overlay_merge(spark, d):
    return library.merge_overlay(*_overlay(spark, d))


@query("""SELECT c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'changed' ELSE 'removed' END AS change FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def overlay_diff(spark, d):
    base, removed, overlay = _overlay(spark, d)
    return library.diff_overlay(base, library.merge_overlay(base, removed, overlay))


@query("""SELECT sourcetype, index_name, events FROM (SELECT event_type AS sourcetype, 'index' || (user_id % 4) AS index_name, count(*) AS events,
    row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id % 4) AS r FROM events GROUP BY event_type, user_id % 4) WHERE r = 1""")
def availability_max(spark, d):
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("sourcetype"), (F.col("user_id") % 4).alias("rank")).agg(F.count("*").alias("events"))
    return library.availability(rows.withColumn("index_name", F.concat(F.lit("index"), F.col("rank"))))


@query("""WITH f AS (SELECT event_type, 'user ' || user_id AS raw, min(event_id) AS line_no FROM events GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY line_no) AS turn FROM f),
    p AS (SELECT *, row_number() OVER (ORDER BY turn, event_type) AS place FROM t WHERE turn <= 20)
    SELECT 'e' AS sample_id, event_type, raw, line_no, CAST(place AS INT) AS place FROM p WHERE place <= 20""")
def round_robin_select(spark, d):
    rows = table(spark, d, "events").select(F.lit("e").alias("sample_id"), F.col("event_id").alias("line_no"), "event_type", F.concat(F.lit("user "), F.col("user_id")).alias("raw"))
    return guards.round_robin(rows, "event_type")


@query(f"""WITH {LINES} SELECT sample_id, count(*) AS lines, count(*) FILTER (WHERE trim(raw) IN ('{{}}', '[]', 'null', '""')) AS empty, count(DISTINCT raw) AS distinct_lines FROM lines GROUP BY sample_id""")
def usability_ratio(spark, d):
    return guards.usability(doc_lines(spark, d)).select("sample_id", "lines", "empty", "distinct_lines")


NAMES = {"Cisco:ASA": ("exact", "cisco_asa"), "cisco_asa.log": ("stripped", "cisco_asa"), "cisco_as": ("fuzzy", "cisco_asa"), "linux secure": ("exact", "linux_secure"), "linux_secur": ("fuzzy", "linux_secure"), "nothing_like_it": ("unresolved", None), "my_vmstat": ("non-event", None), "aws/cloudtrail-2024": ("stripped", "aws_cloudtrail")}


@query("SELECT event_type, name, tier, match, count(*) AS events " + _named_sql([(k, *v) for k, v in NAMES.items()], "name, tier, match") + " GROUP BY ALL")
def fuzzy_sourcetype(spark, d):
    """Events under names of eight spellings; what each name means is found once and joined back."""
    known = spark.createDataFrame([(x,) for x in ("cisco_asa", "linux_secure", "aws_cloudtrail", "okta_system")], "sourcetype string")
    rows = _named_events(spark, d, list(NAMES)).groupBy("event_type", "name").agg(F.count("*").alias("events"))
    return rows.join(recognise.recognise_names(rows.select("name").distinct(), known).select("name", "tier", "match"), "name")


@query("SELECT n_name AS name, trim(regexp_replace(lower(trim(n_name)), '[\\s:/\\-.]+', '_', 'g'), '_') AS canonical FROM nation")
def canonical_sourcetype(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), values.canonical_sourcetype(F.col("n_name")).alias("canonical"))


@query("SELECT DISTINCT event_type || ' ' || user_id AS raw FROM events")
def dedup_capture(spark, d):
    from maskline.streaming import capture

    return capture.distinct_lines(table(spark, d, "events").select(F.concat_ws(" ", "event_type", "user_id").alias("raw")))


VENDOR_NAMES = {"citrix:netscaler:syslog": ("Citrix", "NetScaler ADC"), "CloudflareGatewayDNS": ("Cloudflare", "Cloudflare Gateway"), "trellixtie_syslog": ("Trellix", "Trellix"), "oraaudit": ("Oracle", "Oracle"), "ldap_access_log": ("LDAP server", "Directory access log")}


@query("SELECT event_type, name, vendor, product, count(*) AS events " + _named_sql([(k, *v) for k, v in VENDOR_NAMES.items()] + [("orange", None, None), ("broker", None, None)], "name, vendor, product") + " WHERE vendor IS NOT NULL GROUP BY ALL")
def vendor_hints(spark, d):
    rows = _named_events(spark, d, [*VENDOR_NAMES, "orange", "broker"]).groupBy("event_type", "name").agg(F.count("*").alias("events"))
    return rows.join(signatures.vendor_hints(rows.select("name").distinct()).select("name", "vendor", "product"), "name")


@query("SELECT event_type AS sample_id, 'checkpoint_firewall' AS sourcetype FROM events GROUP BY 1")
def json_signature(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("sample_id"), F.to_json(F.struct(F.col("event_id").alias("loguid"), F.col("user_id").alias("OriginSicName"))).alias("raw"))
    return signatures.json_signature(rows)


@query("""SELECT event_type AS sample_id, 'windows_security' AS sourcetype, 'Security' AS channel, count(*) FILTER (WHERE user_id % 4 > 0) / count(*) AS share
    FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE user_id % 4 > 0) * 2 > count(*)""")
def windows_channel(spark, d):
    channel = F.when(F.col("user_id") % 4 > 0, "Security").otherwise("Directory Service")
    line = F.concat(F.lit("<Event xmlns='http://schemas.microsoft.com/win/2004/08/events/event'><System><Channel>"), channel, F.lit("</Channel></System></Event>"))
    return signatures.windows_channel(table(spark, d, "events").select(F.col("event_type").alias("sample_id"), line.alias("raw")))


@query("""SELECT event_type AS sample_id, 'acme_gate' AS form, 'field-name' AS position, count(*) FILTER (WHERE user_id % 3 > 0) AS lines, count(*) AS checked
    FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE user_id % 3 > 0) * 2 > count(*)""")
def key_echo(spark, d):
    line = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("x=1 acme_gate="), F.col("user_id"))).otherwise("x=1 y=2")
    rows = table(spark, d, "events").select(F.col("event_type").alias("sample_id"), line.alias("raw"))
    return guards.key_echo(rows, rows.select("sample_id", F.lit("Acme:Gate").alias("sourcetype")).distinct())


@query("""SELECT event_id AS line_no, '10.0.0.' || (user_id % 250 + 1) AS src_ip, 'eni-' || user_id AS dev_id, CASE WHEN user_id % 2 = 0 THEN 'us-east-1' END AS cloud_region FROM events""")
def aws_vpc_events(spark, d):
    u = F.col("user_id")
    head = F.concat(F.lit("5 123456789012 eni-"), u, F.lit(" 10.0.0."), u % 250 + 1, F.lit(" 10.1.1.1 443 5000 6 3 180 1 61 ACCEPT OK"))
    line = F.when(u % 2 == 0, F.concat(head, F.lit(" vpc-1 subnet-1 i-1 2 IPv4 10.0.0.9 10.1.1.1 us-east-1 use1-az1 - - - - egress 8"))).otherwise(head)
    f = F.col("fields")
    rows = vendors.parsed(render.as_lines(table(spark, d, "events"), "vpc", "event_id", line), "aws_vpc_v5")
    return rows.select("line_no", *[f[c].alias(c) for c in ("src_ip", "dev_id", "cloud_region")])


@query("""SELECT event_id AS line_no, 'u' || user_id AS "user", event_type AS action, '10.0.0.' || (user_id % 250 + 1) AS src_ip, CASE WHEN user_id % 2 = 0 THEN 'seen' ELSE event_type END AS signature
    FROM events""")
def okta_events(spark, d):
    u = F.col("user_id")
    event = F.struct(
        F.struct(F.concat(F.lit("u"), u).alias("alternateId")).alias("actor"), F.struct(F.concat(F.lit("10.0.0."), u % 250 + 1).alias("ipAddress")).alias("client"),
        F.struct(F.col("event_type").alias("result")).alias("outcome"), F.when(u % 2 == 0, "seen").alias("displayMessage"), F.col("event_type").alias("eventType"),
    )
    rows = vendors.parsed(render.as_lines(src.spread(table(spark, d, "events")), "okta", "event_id", F.to_json(event)), "okta_system")
    return rows.select("line_no", *[F.col("fields")[c].alias(c) for c in ("user", "action", "src_ip", "signature")])


@query("SELECT event_type AS sample_id, CASE WHEN event_type < 'm' THEN 'apache_access' ELSE 'linux_audit' END AS sourcetype, least(count(*), 12) AS parsed FROM events GROUP BY 1, 2")
def parser_scoring(spark, d):
    web = F.concat(F.lit('10.1.1.1 - bob [02/Jan/2024:03:04:05 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" 200 17'))
    audit = F.concat(F.lit("type=USER_CMD msg=audit(1700000000.1:"), F.col("event_id"), F.lit("): pid=1 uid=0 comm=x exe=/bin/x res=success key=k"))
    rows = table(spark, d, "events").select(F.col("event_type").alias("sample_id"), F.col("event_id").alias("line_no"), F.when(F.col("event_type") < "m", web).otherwise(audit).alias("raw"))
    return vendors.best_parser(rows).select("sample_id", "sourcetype", "parsed")


@query("SELECT 'order ' || o_orderkey AS line, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT 'order ' || o_orderkey, o_orderpriority FROM orders")
def extra_patterns(spark, d):
    extras = patterns.split_extras(r"re:o_custkey=(?<who>\d{1,9})(\s)|who" + "\nfield:O_OrderPriority, some name")
    lines = order_lines(spark, d)
    pairs = parsers.long(lines.select("sample_id", "line_no", parsers.kvp(F.col("raw")).alias("fields")))
    return patterns.hits(lines, extras, pairs).select(F.concat(F.lit("order "), "line_no").alias("line"), "value")


@query("SELECT count(*) AS matches, count(*) AS lines FROM orders WHERE o_orderstatus = 'F'")
def pattern_count(spark, d):
    return patterns.count_matches(order_lines(spark, d), patterns.from_selection("o_orderstatus=F"))


@query("""SELECT event_id AS line_no, ': port ' || event_id || ' by person' || user_id AS context, CAST(length(event_type) AS INT) AS prog_len,
    CAST(length(CAST(event_id AS VARCHAR)) AS INT) AS pid_len, true AS unlike, CAST(2 AS INT) AS replaced FROM events""")
def pattern_picks(spark, d):
    """Two groups of one match get aliases of their shape; the same number later in the line, and all else, stays."""
    line = F.concat("event_type", F.lit("["), F.col("event_id"), F.lit("]: port "), F.col("event_id"), F.lit(" by person"), F.col("user_id"))
    lines = kept(render.as_lines(src.spread(table(spark, d, "events")), "events", "event_id", line))
    found = kept(picks.found(lines, [(r"(?<prog>\w+)\[(?<pid>\d+)\]", ["pid", "prog"])]))
    none = spark.createDataFrame([], "original string, alias string, kind string, enabled boolean")
    after = picks.applied(lines, found, kept(picks.aliases(found, SALT)), none)
    now, was = (F.regexp_extract(c, r"^(\w+)\[(\d+)\](.*)$", k) for c, k in (("after", 1), ("raw", 1)))
    part = lambda c, k: F.regexp_extract(c, r"^(\w+)\[(\d+)\](.*)$", k)
    unlike = (now != was) & (part("after", 2) != part("raw", 2))
    return after.select("line_no", part("after", 3).alias("context"), F.length(part("after", 1)).alias("prog_len"), F.length(part("after", 2)).alias("pid_len"), unlike.alias("unlike"), "replaced")


@query("""SELECT match, count(*) AS "count", true AS rest_stays FROM (SELECT event_type || '[' || (user_id % 50) || ']' AS match FROM events) GROUP BY match""")
def pick_entries(spark, d):
    """One entry for each distinct match; its alias differs in the chosen group alone."""
    line = F.concat("event_type", F.lit("["), F.col("user_id") % 50, F.lit("]: ok"))
    found = kept(picks.found(render.as_lines(src.spread(table(spark, d, "events")), "events", "event_id", line), [(r"(?<prog>\w+)\[(?<pid>\d+)\]", ["pid"])]))
    entries = picks.entries(found, kept(picks.aliases(found, SALT)))
    head = lambda c: F.regexp_replace(c, r"\d+", "")
    return entries.select(F.col("original").alias("match"), "count", (head("original") == head("alias")).alias("rest_stays"))


def _known_users(spark, d):
    """Lines of events that name a person twice and a host, and entries with aliases of other lengths; every third host is off."""
    u = F.col("user_id")
    events = src.spread(table(spark, d, "events"))
    line = F.concat(F.lit("by person"), u, F.lit(" on srv"), u, F.lit(".corp: person"), u, F.lit(" left"))
    person = F.struct(F.concat(F.lit("person"), u).alias("original"), F.concat(F.lit("p"), u).alias("alias"), F.lit("user").alias("kind"), F.lit(True).alias("enabled"))
    off = F.concat(F.lit("machine-"), u, F.lit(".example.com"))
    host = F.struct(F.concat(F.lit("srv"), u, F.lit(".corp")).alias("original"), off.alias("alias"), F.lit("host").alias("kind"), (u % 3 != 0).alias("enabled"))
    return kept(render.as_lines(events, "events", "event_id", line)), kept(events.select(F.inline(F.array(person, host))).distinct())


MARKED_USERS = """e AS (SELECT event_id AS line_no, user_id AS u, CAST(length(CAST(user_id AS VARCHAR)) AS INT) AS n FROM events)"""


@query(f"""WITH {MARKED_USERS} SELECT line_no, 3 AS start, 9 + n AS finish, 'person' || u AS original, true AS enabled FROM e
    UNION ALL SELECT line_no, 13 + n, 21 + 2 * n, 'srv' || u || '.corp', u % 3 <> 0 FROM e
    UNION ALL SELECT line_no, 23 + 2 * n, 29 + 3 * n, 'person' || u, true FROM e""")
def marked_spans(spark, d):
    return marks.marked(*_known_users(spark, d)).select("line_no", "start", "finish", "original", "enabled")


@query(f"""WITH {MARKED_USERS} SELECT line_no, 3 AS start, 9 + n AS finish, 3 AS after_start, 4 + n AS after_finish FROM e
    UNION ALL SELECT line_no, 13 + n, 21 + 2 * n, 8 + n, 28 + 2 * n FROM e WHERE u % 3 <> 0
    UNION ALL SELECT line_no, 23 + 2 * n, 29 + 3 * n, CASE WHEN u % 3 <> 0 THEN 30 + 2 * n ELSE 18 + 2 * n END, CASE WHEN u % 3 <> 0 THEN 31 + 3 * n ELSE 19 + 3 * n END FROM e""")
def span_map(spark, d):
    """Places before and after; the pieces after are the aliases."""
    lines, entries = _known_users(spark, d)
    return marks.mapped(lines, entries).select("line_no", "start", "finish", "after_start", "after_finish")


@query()
def deidentify_documents(spark, d):
    """Lines of all documents with every identifier replaced; a line that the proof still objects to is withheld. The flagship."""
    lines = doc_lines(spark, d)
    found = planned(lines)
    changed = kept(apply.applied(lines, found))
    return prove.released(changed, prove.residual(changed, found))


@query(f"WITH {LINES} SELECT count(*) AS lines, CAST(0 AS BIGINT) AS residual, true AS all_there FROM lines")
def deidentify_residual(spark, d):
    """What the proof finds in the documents' lines that are given out: nothing."""
    lines = kept(doc_lines(spark, d))
    found = planned(lines)
    changed = kept(apply.applied(lines, found))
    out = kept(prove.released(changed, prove.residual(changed, found)))
    given = out.where("not withheld").select("sample_id", "line_no", F.col("rest"))
    left = prove.residual(given, found).agg(F.count("*").alias("residual"))
    there = out.join(lines, ["sample_id", "line_no"], "left_anti").agg((F.count("*") == 0).alias("all_there"))
    return out.agg(F.count("*").alias("lines")).join(left).join(there)


@query("""SELECT DISTINCT k AS key FROM (SELECT lower(replace(c_name, '#', '')) AS k, c_custkey FROM customer WHERE c_custkey % 3 <> 0) p
    WHERE EXISTS (SELECT 1 FROM customer c WHERE c_custkey % 2 = 0 AND lower(replace(c.c_name, '#', '')) = p.k)""")
def squashed_duplicate_keys(spark, d):
    c = table(spark, d, "customer")
    plain = F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "")
    names = c.where("c_custkey % 3 <> 0").select(plain.alias("key")).unionByName(c.where("c_custkey % 2 = 0").select(F.concat(F.lit("-"), "c_name").alias("key")))
    return checks.squashed_duplicates(names)


@query("""SELECT event_type AS name, max(n) AS events FROM (SELECT event_type, user_id % 2 AS half, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def volume_index(spark, d):
    e = table(spark, d, "events")
    spelled = F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.concat(F.lit("_"), "event_type"))
    index = checks.volumes(e.groupBy(spelled.alias("name")).agg(F.count("*").alias("events")))
    return checks.with_volume(e.select(F.col("event_type").alias("name")).distinct(), index)


@query("""SELECT r_name AS "group", count(n_nationkey) AS members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_regionkey > 0 GROUP BY r_name""")
def group_members(spark, d):
    groups = table(spark, d, "region").select(F.col("r_name").alias("group"), "r_regionkey")
    members = table(spark, d, "nation").where("n_regionkey > 0").join(groups, F.col("n_regionkey") == F.col("r_regionkey")).select("group")
    return checks.member_counts(groups.select("group"), members)


@query("""SELECT 'e' AS sample_id, event_id AS line_no, CAST(CASE event_id % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 6 END AS INT) AS rule FROM events WHERE event_id % 4 <> 0""")
def credential_lint(spark, d):
    k, u = F.col("event_id") % 4, F.lpad(F.col("user_id").cast("string"), 36, "0")
    secret = F.when(k == 1, F.concat(F.lit("AKIA"), F.right(u, F.lit(16)))).when(k == 2, F.concat(F.lit("ghp_"), u)).when(k == 3, F.concat(F.lit("npm_"), u)).otherwise("npm_short")
    return checks.credentials(render.as_lines(table(spark, d, "events"), "e", "event_id", F.concat(F.lit("key "), secret, F.lit(" end"))))


@query("""SELECT CASE event_id % 5 WHEN 0 THEN 'refusal' WHEN 1 THEN 'empty' ELSE 'event' END AS label, count(*) AS lines FROM events GROUP BY 1""")
def event_label_counts(spark, d):
    k = F.col("event_id") % 5
    line = F.when(k == 0, "I'm sorry, I can't").when(k == 1, " {} ").otherwise(F.concat(F.lit("seen "), F.col("event_type")))
    return checks.event_labels(render.as_lines(table(spark, d, "events"), "e", "event_id", line)).groupBy("label").agg(F.count("*").alias("lines"))


@query("""SELECT 'e' AS sample_id, 'json' AS format, count(*) AS lines FROM events WHERE event_id % 20 > 0 HAVING count(*) > 0""")
def variants_present(spark, d):
    line = F.when(F.col("event_id") % 20 > 0, render.json(["event_id", "event_type"])).otherwise(F.concat(F.lit("plain "), F.col("event_type")))
    return checks.variants(render.as_lines(table(spark, d, "events"), "e", "event_id", line))


@query("""SELECT 's' || k AS sample_id, k < 2 AS cef FROM (SELECT DISTINCT event_id % 3 AS k FROM events)""")
def cef_start_share(spark, d):
    k = F.col("event_id") % 3
    line = F.when((k == 0) | ((k == 1) & (F.col("event_id") % 10 < 8)), "CEF:0|a|b|1|2|n|5|x=1").otherwise("Jan  2 03:04:05 h CEF:0|a|b|1|2|n|5|x=1")
    rows = table(spark, d, "events").select(F.concat(F.lit("s"), k).alias("sample_id"), F.col("event_id").alias("line_no"), line.alias("raw"))
    return checks.starts_with_cef(rows)


@query("""SELECT 'orderid' AS field, count(DISTINCT o_orderkey) AS distinct_values FROM orders UNION ALL SELECT 'customerid', count(DISTINCT o_custkey) FROM orders""")
def business_id_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("CustomerID"), F.col("o_orderstatus").alias("status"))
    rows = o.select(F.lit("o").alias("sample_id"), F.col("order_id").alias("line_no"), render.kvp(["order_id", "CustomerID", "status"]).alias("raw"))
    return checks.business_ids(parsers.long(rows.select("sample_id", "line_no", parsers.kvp(F.col("raw")).alias("fields"))))


@query("""SELECT kind, count(*) AS replaced FROM events, (VALUES ('ipv4'), ('user')) t(kind) GROUP BY kind""")
def replacement_counts(spark, d):
    lines = kept(event_hosts(spark, d))
    found = kept(mint.with_aliases(plan.entries(detect.fields(parsers.long(lines.select("sample_id", "line_no", parsers.kvp(F.col("raw")).alias("fields"))))), SALT))
    return apply.counts(lines, found.where("kind in ('ipv4', 'user')")).groupBy("kind").agg(F.sum("replaced").cast("long").alias("replaced"))


# Samples of events: one for each event type and user modulo five, whose lines have the keys of their class.
SAMPLE_KEYS = {
    0: ["srcip", "dstip", "policyid", "devname"], 1: ["srcip", "dstip", "other", "more"], 2: ["query", "answer", "rcode"],
    3: ["src", "spt", "dst", "dpt", "act"], 4: ["x1", "x2", "x3"],
}
EXPECTED = [
    ("fortinet_fortigate", "kvp", ["cef"], ["srcip", "dstip", "srcport", "dstport", "policyid", "devname", "logid", "action"], [], False, False),
    ("infoblox_dns", "kvp", [], ["query", "answer", "rcode"], [], False, False),
    ("plain_text", "unstructured", [], [], [r"seen \d+ times"], True, False),
    ("json_only", "json", [], ["srcip"], [], False, False),
]
KNOWN_TYPES = [
    ("flow", [], ["src", "spt", "dst", "dpt", "act", "proto"], None), ("dns", [], ["query", "answer", "rcode", "ttl"], None),
    ("firewall", [], ["srcip", "dstip", "policyid", "srcport"], None), ("wide", [], ["srcip", "dstip", "policyid", "devname", "src", "dst", "query"], None),
    ("few", [], ["src", "dst"], None), ("counter", [r"^(?<kind>\w+) seen (?<n>\d+) times$"], [], None), ("envelope", [r"^(?<host>\w+) (?<message>.*)$"], [], None),
]


def _keyed_samples(spark, d) -> DataFrame:
    """Samples named <event type>-<class>; class 5 holds plain text."""
    k = F.col("user_id") % 6
    line = F.concat(F.col("event_type"), F.lit(" seen "), F.col("event_id"), F.lit(" times"))
    for n, keys in SAMPLE_KEYS.items():
        line = F.when(k == n, F.concat_ws(" ", *[F.concat(F.lit(f"{x}=v"), F.col("user_id")) for x in keys])).otherwise(line)
    rows = src.spread(table(spark, d, "events"))
    return rows.select(F.concat_ws("-", "event_type", k).alias("sample_id"), F.col("event_id").alias("line_no"), line.alias("raw"))


@query("""WITH s AS (SELECT DISTINCT event_type || '-' || (user_id % 6) AS sample_id, user_id % 6 AS k FROM events)
    SELECT sample_id, sourcetype, CASE WHEN sourcetype = 'nobody_knows' THEN 'unknown'
      WHEN (sourcetype, k) IN (('fortinet_fortigate', 0), ('infoblox_dns', 2), ('plain_text', 5)) THEN 'match' ELSE 'mismatch' END AS verdict
    FROM s, (VALUES ('fortinet_fortigate'), ('infoblox_dns'), ('plain_text'), ('json_only'), ('nobody_knows')) t(sourcetype)""")
def source_expectations(spark, d):
    """Every sample asked about five names: four of eight critical keys, all of three, a pattern, a form that isn't there."""
    lines = kept(_keyed_samples(spark, d))
    registry_rows = spark.createDataFrame(EXPECTED, registry.EXPECTATIONS)
    asked = F.explode(F.array(*[F.lit(x[0]) for x in EXPECTED], F.lit("nobody_knows")))
    return registry.verdicts(lines, lines.select("sample_id").distinct().withColumn("sourcetype", asked), registry_rows)


@query("SELECT DISTINCT event_type || '-5' AS sample_id, 'plain_text' AS sourcetype FROM events WHERE user_id % 6 = 5")
def golden_signature(spark, d):
    return registry.golden(kept(_keyed_samples(spark, d)), spark.createDataFrame(EXPECTED, registry.EXPECTATIONS))


_SETS = lambda rows: ", ".join(f"('{a}', [{', '.join(repr(x) for x in b)}])" for a, b in rows)


@query(f"""WITH c(k, keys) AS (VALUES {", ".join(f"({k}, [{', '.join(map(repr, v))}])" for k, v in SAMPLE_KEYS.items())}),
    t(datatype, fields) AS (VALUES {_SETS((x[0], x[2]) for x in KNOWN_TYPES if x[2])}),
    s AS (SELECT DISTINCT event_type || '-' || k AS sample_id, keys FROM events JOIN c ON user_id % 6 = k)
    SELECT sample_id, datatype, CAST(len(list_intersect(keys, fields)) AS INT) AS hit, len(list_intersect(keys, fields)) / len(keys) AS share
    FROM s, t WHERE len(list_intersect(keys, fields)) >= 3 AND len(list_intersect(keys, fields)) >= 0.6 * len(keys)""")
def datatype_overlaps(spark, d):
    """Found by the rarest keys; the SQL looks at all pairs."""
    samples = registry.fingerprints(kept(_keyed_samples(spark, d))).select("sample_id", "keys")
    return registry.overlaps(samples, spark.createDataFrame(KNOWN_TYPES, registry.DATATYPES))


@query("""WITH s AS (SELECT DISTINCT event_type || '-' || (user_id % 6) AS sample_id, user_id % 6 AS k FROM events)
    SELECT sample_id, CASE k WHEN 0 THEN 'wide' WHEN 2 THEN 'dns' WHEN 3 THEN 'flow' ELSE 'counter' END AS datatype, CAST(1 AS DOUBLE) AS confidence,
    CASE k WHEN 5 THEN 'regex' ELSE 'fields' END AS method FROM s WHERE k IN (0, 2, 3, 5)""")
def datatype_match(spark, d):
    return registry.datatype(kept(_keyed_samples(spark, d)), spark.createDataFrame(KNOWN_TYPES, registry.DATATYPES))


@query("""SELECT p_name AS name, profile FROM (SELECT p_name, profile, row_number() OVER (PARTITION BY p_name ORDER BY rank) AS r
    FROM (SELECT DISTINCT p_name FROM part) p JOIN (SELECT n_nationkey AS rank, 'profile-' || n_nationkey AS profile, lower(left(n_name, 1 + n_nationkey % 3)) AS part FROM nation) n
    ON contains(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), part)) WHERE r = 1""")
def hint_profiles(spark, d):
    """Parts' names against profiles whose parts are beginnings of nations' names, of one to three letters."""
    n = table(spark, d, "nation")
    part = F.expr("left(n_name, 1 + cast(n_nationkey % 3 as int))")
    rows = n.select(F.col("n_nationkey").cast("int").alias("rank"), F.concat(F.lit("profile-"), "n_nationkey").alias("profile"), F.array(part).alias("match"), *[F.array().cast("array<string>").alias(c) for c in ("identity_fields", "never")], F.lit("").alias("note"))
    return profiles.matched(table(spark, d, "part").select(F.col("p_name").alias("name")), rows)


@query("""WITH e AS (SELECT event_id, event_id % 6 AS k, lpad(CAST(user_id AS VARCHAR), 8, '4') AS num, md5(CAST(user_id AS VARCHAR)) AS hex FROM events)
    SELECT event_id AS line_no, 'one-time-code' AS rule, num AS value FROM e WHERE k = 0
    UNION ALL SELECT event_id, 'connection', 'p' || num FROM e WHERE k = 2 UNION ALL SELECT event_id, 'hex-key', hex FROM e WHERE k = 3
    UNION ALL SELECT event_id, 'issued-3', 'ghp_' || hex FROM e WHERE k = 5""")
def secret_rule_hits(spark, d):
    """Planted secrets, and near misses: the word too far before the number, no word at all."""
    k, num, hex_ = F.col("event_id") % 6, F.lpad(F.col("user_id").cast("string"), 8, "4"), F.md5(F.col("user_id").cast("string").cast("binary"))
    far = F.lit(" and then a good deal of other words come ")
    line = (
        F.when(k == 0, F.concat(F.lit("Your OTP: "), num)).when(k == 1, F.concat(F.lit("otp"), far, num))
        .when(k == 2, F.concat(F.lit("open postgres://svc:p"), num, F.lit("@db.internal/x"))).when(k == 3, F.concat(F.lit("api_key="), hex_))
        .when(k == 4, F.concat(F.lit("order "), num)).otherwise(F.concat(F.lit("pushed with ghp_"), hex_))
    )
    lines = render.as_lines(src.spread(table(spark, d, "events")), "e", "event_id", line)
    return secret_rules.findings(lines, secret_rules.defaults(lines)).select("line_no", "rule", "value")


@query("""SELECT event_id AS line_no, repeat(event_type || ' ', 400) AS msg, 'u' || user_id AS "user", repeat(event_type || ' x ', 300) || 'end' AS note FROM events""")
def long_values(spark, d):
    """Pairs and CEF extensions with values of some thousand characters."""
    rows = src.spread(table(spark, d, "events"))
    pairs = parsers.kvp(F.concat(F.lit('a=1 msg="'), F.expr("repeat(concat(event_type, ' '), 400)"), F.lit('" user=u'), F.col("user_id")))
    cef = parsers.cef(F.concat(F.lit("CEF:0|v|p|1|7|n|5|note="), F.expr("repeat(concat(event_type, ' x '), 300)"), F.lit("end suid="), F.col("user_id")))
    msg = F.concat(pairs["msg"], F.lit(" "))  # blanks at the ends of a value go
    return rows.select(F.col("event_id").alias("line_no"), msg.alias("msg"), pairs["user"].alias("user"), cef["note"].alias("note"))


# Lines of vendors' layouts made from events: the pieces of each line, a column's name in braces.
VENDOR_LINES = {
    "fortinet_fortigate": (
        'date=2024-01-02 devname="fw {n}" srcip={ip} dstip=10.2.2.2 dstport=443 action="{event_type}" policyid={user_id}',
        {"src_ip": "{ip}", "dest_ip": "10.2.2.2", "dest_port": "443", "action": "{event_type}", "host": "fw {n}", "policy_id": "{user_id}"},
    ),
    "linux_secure": (
        "<38>Jan  2 03:04:05 web{n} sshd[{event_id}]: Failed password for user{user_id} from {ip} port 4000 ssh2",
        {"host": "web{n}", "pid": "{event_id}", "action": "Failed", "user": "user{user_id}", "src_ip": "{ip}", "app": "sshd"},
    ),
    "cisco_asa": (
        "Jan  2 2024 03:04:05 fw{n} : %ASA-6-302013: Built inbound TCP connection {event_id} for outside:{ip}/4000 ({ip}/4000) to inside:10.2.2.2/443 (10.2.2.2/443)",
        {"host": "fw{n}", "event_code": "302013", "action": "Built", "src_ip": "{ip}", "src_port": "4000", "dest_ip": "10.2.2.2", "dest_port": "443"},
    ),
    "windows_security": (
        "<Event><System><EventID>4624</EventID><Computer>pc{n}</Computer></System><EventData><Data Name='TargetUserName'>user{user_id}</Data>"
        "<Data Name='IpAddress'>{ip}</Data></EventData></Event>",
        {"event_code": "4624", "host": "pc{n}", "user": "user{user_id}", "src_ip": "{ip}"},
    ),
    "zeek_conn": (
        '<1>Jan 2 zeek: {{"id.orig_h":"{ip}","id.resp_p":443,"uid":"C{event_id}","proto":"tcp"}}',
        {"src_ip": "{ip}", "dest_port": "443", "session_id": "C{event_id}", "transport": "tcp"},
    ),
    "juniper_srx": (
        '<14>1 2024-01-02T03:04:05Z srx{n} RT_FLOW - DENY [x source-address="{ip}" source-port="4" destination-address="10.2.2.2" destination-port="80" policy-name="{event_type}"]',
        {"host": "srx{n}", "src_ip": "{ip}", "dest_ip": "10.2.2.2", "dest_port": "80", "action": "{event_type}"},
    ),
    "infoblox_dns": (
        "<30>Jan  2 03:04:05 ns{n} named[5]: client {ip}#53 (a.b): UDP: query: h{user_id}.b IN AAAA response: NXDOMAIN +",
        {"host": "ns{n}", "src_ip": "{ip}", "query": "h{user_id}.b", "event_code": "NXDOMAIN"},
    ),
    "pfsense": (
        "<134>Jan  2 03:04:05 filterlog[7]: 5,,,100,igb0,match,block,in,4,0x0,,64,1,0,DF,6,tcp,60,{ip},10.2.2.2,5,6,0",
        {"action": "block", "direction": "in", "transport": "tcp", "src_ip": "{ip}", "dest_port": "6"},
    ),
    "cef": (
        "<134>Jan  2 03:04:05 gw{n} CEF:0|Acme|Gate|1.0|{event_id}|{event_type} seen|High|src={ip} spt=4000 suser=user{user_id} cs1Label=Rule Name cs1={event_type} all",
        {
            "vendor_product": "Acme Gate", "event_code": "{event_id}", "signature": "{event_type} seen", "severity": "8", "src_ip": "{ip}", "user": "user{user_id}",
            "Rule_Name": "{event_type} all", "host": "gw{n}",
        },
    ),
    "checkpoint_firewall": (
        '<134>1 2024-01-02T03:04:05Z gw{n} CheckPoint 7 - [action:"{event_type}"; src:"{ip} (host)"; dst:"10.2.2.2"; service:"443"; loguid:"u{event_id}"; rule_name:"Out; {user_id}"]',
        {"action": "{event_type}", "src_ip": "{ip}", "dest_ip": "10.2.2.2", "dest_port": "443", "session_id": "u{event_id}", "rule": "Out; {user_id}", "host": "gw{n}", "severity": "6"},
    ),
    "cisco_esa": (
        "Tue Jan  2 03:04:05 2024 Info: MID {event_id} ICID {user_id} From: <{event_type}@a{n}.example>",
        {"mid": "{event_id}", "icid": "{user_id}", "sender": "{event_type}@a{n}.example", "severity": "Info"},
    ),
    "cisco_umbrella": (
        '"2024-01-02 03:04:05","user{user_id}","net{n}","{ip}","9.9.9.1","Allowed","1 (A)","NOERROR","{event_type}.example."',
        {"user": "user{user_id}", "src_ip": "{ip}", "dns_query": "{event_type}.example.", "app": "DNS", "identities": "net{n}"},
    ),
    "f5_bigip": (
        "<134>Jan  2 03:04:05 lb{n} notice mcpd[{event_id}]: 01070638:5: Pool /Common/{event_type} member /Common/{ip}:80 monitor status down.",
        {"host": "lb{n}", "pid": "{event_id}", "msg_id": "01070638:5", "pool": "/Common/{event_type}", "dest_ip": "{ip}", "dest_port": "80", "action": "down"},
    ),
    "salesforce_setupaudittrail": (
        '{{"Action":"{event_type}","Section":"Users","Display":"Changed {event_id}","CreatedById":"005{user_id}","CreatedDate":"2022-08-16T09:26:38.000+0000"}}',
        {"action": "{event_type}", "user": "005{user_id}", "object": "Users", "message": "Changed {event_id}", "outcome": "success"},
    ),
    "zscaler_web": (
        "datetime=Tue Jan 2 03:04:05 2024\tlogin=user{user_id}@a.example\tClientIP={ip}\turl=a.example/{event_type} x\tresponsesize={event_id}",
        {"user": "user{user_id}@a.example", "src_ip": "{ip}", "url": "a.example/{event_type} x", "bytes_in": "{event_id}", "vendor_product": "Zscaler ZIA"},
    ),
}


def _vendor_line(text: str):
    """The text with columns in its braces."""
    u = F.col("user_id")
    ip = F.concat_ws(".", F.lit("10"), F.lit("7"), F.floor(u / 200) % 200, u % 200 + 1)
    return F.format_string(
        text.replace("%", "%%").replace("{{", "{").replace("}}", "}").replace("{n}", "%1$s").replace("{ip}", "%2$s").replace("{event_type}", "%3$s").replace("{user_id}", "%4$s").replace("{event_id}", "%5$s"),
        u % 9, ip, F.col("event_type"), u, F.col("event_id"),
    )


def _vendor_sql(text: str) -> str:
    """The same text in SQL."""
    for name, sql in {"n": "user_id % 9", "ip": "'10.7.' || (user_id // 200) % 200 || '.' || (user_id % 200 + 1)", "event_type": "event_type", "user_id": "user_id", "event_id": "event_id"}.items():
        text = text.replace("{" + name + "}", f"' || ({sql}) || '")
    return f"'{text}'"


def _vendor_samples(spark, d) -> DataFrame:
    """A sample of each kind of vendor line."""
    rows = src.spread(table(spark, d, "events"))
    parts = [render.as_lines(rows, name, "event_id", _vendor_line(line)) for name, (line, _) in VENDOR_LINES.items() if name in LADDER]
    cef = render.cef("Fortinet", "FortiGate", F.lit("100"), F.col("event_type"), ["event_id", "user_id", "event_type"])
    parts += [render.as_lines(rows, "cef_maker", "event_id", cef), render.as_lines(rows, "plain", "event_id", F.concat(F.lit("just "), F.col("event_type")))]
    return reduce(DataFrame.unionByName, parts)


LADDER = ("fortinet_fortigate", "cisco_asa")


@query("""SELECT sample_id, sourcetype, tier, verdict, method, (SELECT count(*) FROM events) AS lines FROM (VALUES
    ('fortinet_fortigate', 'fortinet_fortigate', 'layout', 'pass', 'parser-emulation'), ('cisco_asa', 'cisco_asa', 'layout', 'pass', 'parser-emulation'),
    ('cef_maker', 'fortinet_fortigate', 'cef', 'pass', 'parser-emulation'), ('plain', CAST(NULL AS VARCHAR), 'format', 'unverified', 'structure'))
    t(sample_id, sourcetype, tier, verdict, method)""")
def recognition_ladder(spark, d):
    """Samples recognised, read by the layout found, and verified."""
    lines = kept(_vendor_samples(spark, d))
    sources = kept(ladder.recognised(lines))
    proof = ladder.verified(lines, sources).select("sample_id", "verdict", "method", "lines")
    return sources.select("sample_id", "sourcetype", "tier").join(proof, "sample_id")


#: The layouts of three sources as steps, which give the same fields as the layouts.
STEPS = {
    "fortinet_fortigate": [
        {"id": "serde", "type": "kvp"}, {"id": "comment"},
        {"id": "eval", "add": {"src_ip": "srcip src", "dest_ip": "dstip", "dest_port": "dstport", "host": "devname devid", "policy_id": "policyid"}},
    ],
    "linux_secure": [
        {"id": "regex_extract", "regex": r"^<\d+>\w+\s+\d+ [\d:]+ (?<host>\S+) (?<process>[^\s\[:]+)\[(?<pid>\d+)\]: (?<__message>.*)$"},
        {"id": "regex_extract", "source": "__message", "regex": r"^(?<action>\w+) \S+ for (?<user>\S+) from (?<src_ip>\S+)", "when": {"field": "process", "equals": "sshd"}},
        {"id": "rename", "names": {"process": "app"}, "final": True}, {"id": "eval", "set": {"host": "never"}},
    ],
    "zeek_conn": [
        {"id": "regex_extract", "regex": r"(?<__body>\{.*)$"}, {"id": "serde", "type": "json", "source": "__body"},
        {"id": "eval", "add": {"src_ip": "id.orig_h", "dest_port": "id.resp_p", "session_id": "uid", "transport": "proto"}, "remove": ["uid", "proto"]},
    ],
}


def _steps_query(source: str) -> None:
    line, fields = VENDOR_LINES[source]

    def run(spark, d):
        rows = render.as_lines(src.spread(table(spark, d, "events")), source, "event_id", _vendor_line(line))
        return steps.run(rows, STEPS[source]).select("line_no", *[F.col("fields")[x].alias(x) for x in fields])

    run.__name__ = f"steps_{source}"
    query("SELECT event_id AS line_no, " + ", ".join(f"{_vendor_sql(v)} AS {k}" for k, v in fields.items()) + " FROM events")(run)


for _source in STEPS:
    _steps_query(_source)


@query("""SELECT event_id AS line_no, CAST(i AS INT) AS item, 'v' || (user_id + i) AS value, CASE WHEN i = 0 THEN 'first' END AS place FROM events, unnest(range(0, 2 + user_id % 2)) t(i)""")
def steps_unroll(spark, d):
    """A list of each event unrolled to rows, and a lookup on what came of it."""
    u = F.col("user_id")
    items = F.transform(F.sequence(F.lit(0).cast("long"), 1 + u % 2), lambda i: F.struct(F.concat(F.lit("v"), u + i).alias("v"), i.cast("string").alias("n")))
    rows = render.as_lines(src.spread(table(spark, d, "events")), "list", "event_id", F.to_json(F.struct(items.alias("items"))))
    plan_ = [
        {"id": "serde", "type": "json"}, {"id": "unroll", "source": "items", "into": "item"}, {"id": "flatten", "source": "item"},
        {"id": "lookup", "source": "item.n", "table": {"0": "first"}, "into": "place"},
    ]
    return steps.run(rows, plan_).select("line_no", "item", F.col("fields")["item.v"].alias("value"), F.col("fields")["place"].alias("place"))


@query("""SELECT event_id AS line_no, CAST(i AS INT) AS item, true AS whole, 'user' || user_id AS "user", 'h' || i AS terminal, '10.0.0.' || (user_id % 250) AS ip
    FROM events, unnest(range(0, 1 + event_id % 3)) t(i) UNION ALL
    SELECT event_id, CAST(1 + event_id % 3 AS INT), false, 'user' || user_id, NULL, NULL FROM events WHERE event_id % 5 = 0""")
def prefixed_records(spark, d):
    """Records of length-prefixed values, one to three a line, and a truncated one behind some."""
    u, e = F.col("user_id"), F.col("event_id")
    user, time = F.concat(F.lit("user"), u), F.lit("20240102030405")
    one = lambda i: prefixed.rendered(F.lit("AU1"), time, F.lit("100"), F.lit("PRD"), user, F.lit("D"), F.lit("SAPMSYST"), F.concat(F.lit("h"), i), F.concat(F.lit("10.0.0."), u % 250), F.lit(""))
    cut = F.expr("left(t, length(t) - 3)")
    short = prefixed.rendered(F.lit("AU2"), time, F.lit("100"), F.lit("PRD"), user, F.lit("dialogue"))
    whole = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), e % 3), one), "")
    rows = src.spread(table(spark, d, "events")).withColumn("t", short)
    lines = render.as_lines(rows, "sal", "event_id", F.concat(whole, F.when(e % 5 == 0, cut).otherwise("")))
    f = F.col("fields")
    return prefixed.records(lines).select("line_no", "item", "whole", *[f[x].alias(x) for x in ("user", "terminal", "ip")])


@query("""SELECT count(DISTINCT user_id) AS hidden, CAST(0 AS BIGINT) AS gaps, true AS ends FROM events""")
def coverage_closed(spark, d):
    """Users known by a field alone, left out of the plan: the proof names them, they are added, and no gap is left."""
    line = F.concat(F.lit("user=Tina"), F.col("user_id"), F.lit(" action="), F.col("event_type"))
    lines = kept(render.as_lines(src.spread(table(spark, d, "events")), "e", "event_id", line))
    found = kept(plan.entries(detect.everything(lines)))
    entries, _, gaps = plan.closed(lines, found, SALT)
    return entries.agg(F.count("*").alias("hidden")).join(gaps.agg(F.count("*").alias("gaps"), (F.count("*") == 0).alias("ends")))


#: What stands in a stored document for its long event until that is put in.
LONG_EVENT = "@long@"


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 1 THEN 'fingerprint' WHEN 2 THEN 'stored under another key' WHEN 3 THEN 'too large' WHEN 4 THEN 'provenance' WHEN 5 THEN 'not JSON' END AS reason,
    CASE WHEN c_custkey % 6 = 0 THEN c_name END AS event FROM customer""")
def stored_documents(spark, d):
    """Documents wrapped in a JSON string: tampered, under a foreign key, too large, without provenance, no JSON, and good ones."""
    k = F.col("c_custkey") % 6
    # A long event is put where its mark stands in the text, escaped as its document is: that gives the same text, without writing it as JSON twice.
    long = (k == 3) & F.col("c_name").isNotNull()
    events = F.array(F.when(long, LONG_EVENT).otherwise(F.col("c_name")))
    proof = F.struct(F.lit(1).alias("total"), F.lit(1).alias("replaced"), F.lit(True).alias("ok"), F.lit(False).alias("blind"))
    origin = F.struct(F.when(k == 4, "elsewhere").otherwise("paste").alias("sourceMode"), F.lit("x").alias("sourceLabel"), F.lit(1).alias("replacementsApplied"), F.lit(True).alias("structurePreserved"), proof.alias("coverage"), F.lit("now").alias("sanitisedAt"))
    # Where only the fingerprint is wrong, it is that of other text; long texts' are not worked out here.
    print_ = F.when(k == 3, values.fingerprint(F.col("c_name"))).when(k == 1, "0-0").otherwise(values.fingerprint(F.col("c_name")))
    doc = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("acme_gate").alias("key"), F.lit("Acme:Gate").alias("sourcetype"), events.alias("events"), print_.alias("fingerprint"), F.lit(True).alias("sanitised"), origin.alias("provenance"), F.lit(7).alias("unknownField")))
    quoted = lambda text: F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    inside = lambda text: F.regexp_replace(quoted(text), '^"|"$', "")
    parts = F.split(quoted(doc), LONG_EVENT)
    wrapped = F.when(k == 5, F.lit("{broken")).when(long, F.concat(F.get(parts, 0), F.repeat(inside(inside(F.col("c_name"))), F.lit(60000)), F.get(parts, 1))).otherwise(quoted(doc))
    rows = src.spread(table(spark, d, "customer").select("c_custkey", "c_name")).select(F.col("c_custkey").alias("id"), F.when(k == 2, "acme_other").otherwise("acme_gate").alias("key"), wrapped.alias("text"))
    return library.parsed_documents(rows).select("id", "reason", F.get("doc.events", 0).alias("event"))


def _vendor_query(source: str, line: str, fields: dict[str, str]) -> None:
    def run(spark, d):
        rows = render.as_lines(src.spread(table(spark, d, "events")), source, "event_id", _vendor_line(line))
        f = F.col("fields")
        return vendors.parsed(rows, source).select("line_no", *[f[x].alias(x) for x in fields])

    run.__name__ = f"{source}_fields"
    query("SELECT event_id AS line_no, " + ", ".join(f"{_vendor_sql(v)} AS {k}" for k, v in fields.items()) + " FROM events")(run)


for _source, (_line, _fields) in VENDOR_LINES.items():
    _vendor_query(_source, _line, _fields)


@query("""SELECT event_id AS line_no, s AS iso, s AS millis, s AS access, s - 3600 AS zoned, user_id AS length,
    epoch_us(date_trunc('second', ts) - CASE WHEN date_trunc('second', ts) > TIMESTAMP '2024-01-16' THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END) // 1000000 AS syslog
    FROM (SELECT *, epoch_us(ts) // 1000000 AS s FROM events)""")
def line_times(spark, d):
    """Times of events in five forms, read back; a syslog time gets the year before where it would lie ahead; a duration of so many seconds."""
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp_ntz"))
    now = datetime.datetime(2024, 1, 15, tzinfo=datetime.UTC)
    shown = lambda form, tail="": F.concat(F.date_format("t", form), F.lit(tail))
    read = lambda text: times.epoch(text, now)
    u = F.col("user_id")
    clock = F.format_string("%d:%02d:%02d", F.floor(u / 3600), F.floor(u / 60) % 60, u % 60)
    return rows.select(
        F.col("event_id").alias("line_no"), read(shown("yyyy-MM-dd'T'HH:mm:ss.SSS", "Z")).alias("iso"), read(F.concat(F.unix_timestamp(F.to_timestamp_ltz(shown("yyyy-MM-dd HH:mm:ss", "Z"))).cast("string"), F.lit("007"))).alias("millis"),
        read(shown("dd/MMM/yyyy:HH:mm:ss", " +0000")).alias("access"), read(shown("yyyy-MM-dd'T'HH:mm:ss", "+01:00")).alias("zoned"),
        read(shown("MMM d HH:mm:ss")).alias("syslog"), times.seconds(clock).alias("length"),
    )


@query("""SELECT sample_id, raw, row_number() OVER (PARTITION BY sample_id ORDER BY first_ts, raw) AS line_no FROM (
    SELECT sample_id, raw, min(ts) AS first_ts FROM (
        SELECT *, min(ts) OVER (PARTITION BY sample_id) AS start FROM (SELECT 's' || (user_id % 7) AS sample_id, event_type || ' ' || user_id AS raw, ts FROM events WHERE event_type <> 'view'))
    WHERE ts <= start + INTERVAL 10 DAY GROUP BY 1, 2) QUALIFY line_no <= 40""")
def capture_bounded(spark, d):
    """A stream of all events: of each sample the first 40 distinct lines of its first ten days."""
    from maskline.streaming import capture

    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    lines = stream.select(F.format_string("s%d", F.col("user_id") % 7).alias("sample_id"), F.concat_ws(" ", "event_type", "user_id").alias("raw"), "ts", "event_type")
    out = fresh(spark)
    found = capture.bounded(lines, 40, 10 * 86_400, F.col("event_type") != "view")
    found.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/lines", format="parquet").awaitTermination()
    return spark.read.schema("sample_id string, line_no long, raw string").parquet(f"{out}/lines").select("sample_id", "raw", "line_no")


#: Selections in a line of events, and what patterns they suggest in another engine's form.
SELECTED = 'id=EV-7_x user="ann.3" type=click'
SUGGESTED = {
    "EV-7_x": [r"EV-7_x", r"\bid=[^\s,;|]+", r"[A-Za-z]+-\d+_[A-Za-z]+"],
    "ann.3": [r"ann\.3", r"\buser=\"[^\"]+\"", r"[A-Za-z]+\.\d+"],
}


@query(" UNION ALL ".join(
    f"""SELECT '{text}' AS chosen, CAST({k} AS INT) AS place, CAST(coalesce(sum(len(regexp_extract_all(raw, '{source}'))), 0) AS BIGINT) AS matches, count(*) FILTER (len(regexp_extract_all(raw, '{source}')) > 0) AS "lines"
    FROM (SELECT 'id=EV-' || event_id || '_x user="' || event_type || '.' || user_id || '" type=' || event_type || ' ref=ann.3 EV-7_x' AS raw FROM events)"""
    for text, sources in SUGGESTED.items() for k, source in enumerate(sources)
))
def shape_suggestions(spark, d):
    """How often each pattern that a selection suggests is found in all lines of events."""
    line = F.format_string('id=EV-%s_x user="%s.%s" type=%s ref=ann.3 EV-7_x', "event_id", "event_type", "user_id", "event_type")
    rows = render.as_lines(src.spread(table(spark, d, "events")), "e", "event_id", line)
    found = [(text, k, x) for text in SUGGESTED for k, x in enumerate(patterns.suggestions(SELECTED, SELECTED.index(text), SELECTED.index(text) + len(text)))]
    names = spark.createDataFrame(found, "chosen string, place int, source string")
    return patterns.count_all(rows, [x for _, _, x in found]).join(F.broadcast(names), "source").select("chosen", "place", "matches", "lines")
