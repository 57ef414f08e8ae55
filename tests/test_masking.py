from pyspark.sql import functions as F

from maskline.functions import values
from maskline.operators import apply, detect, guards, mint, parsers, patterns, plan, prove, recognise, signatures, vendors
from maskline.sources import library, lines
from maskline.streaming import capture


def frame(spark, *raws):
    return spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(raws)], "sample_id string, line_no long, raw string")


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("x")).first().x


def test_address_classes(spark):
    for ip, cls in {"10.1.2.3": "private", "8.8.8.8": "public", "127.0.0.1": "loopback", "256.1.1.1": None, "01.2.3.4": None, "100.64.0.1": "cgnat", "203.0.113.9": "reserved"}.items():
        assert one(spark, values.ipv4_class, ip) == cls
    assert one(spark, values.ipv6_class, "2a00:1450::1") == "public"
    assert one(spark, values.ipv6_class, "12:30:45") is None


def test_checksums(spark):
    assert one(spark, values.card_ok, "4111111111111111") is True
    assert one(spark, values.card_ok, "4111111111111112") is False
    assert one(spark, values.iban_ok, "DE89370400440532013000") is True
    assert one(spark, values.iban_ok, "DE89370400440532013001") is False


def test_version_is_not_an_address(spark):
    got = detect.ipv4_identities(frame(spark, "agent version 10.1.2.3", "peer 10.9.9.9 up")).collect()
    assert [r.value for r in got] == ["10.9.9.9"]


def test_parsers(spark):
    row = frame(spark, 'a=1 b="x y" a=2')
    assert row.select(parsers.kvp(F.col("raw")).alias("f")).first().f == {"a": "2", "b": "x y"}
    row = frame(spark, "CEF:0|V|P|1|7|n|5|src=1.2.3.4 msg=hello world dst=x")
    assert row.select(parsers.cef(F.col("raw")).alias("f")).first().f == {"src": "1.2.3.4", "msg": "hello world", "dst": "x"}
    row = frame(spark, '{"a":{"b":"c"},"d":null}')
    assert row.select(parsers.json_leaves(F.col("raw")).alias("f")).first().f == {"a.b": "c"}
    row = frame(spark, "user bob did it")
    assert row.select(parsers.regex(F.col("raw"), r"user (?<who>\w+)").alias("f")).first().f == {"who": "bob"}


def test_whole_run_keeps_shape_and_leaves_nothing(spark):
    rows = frame(spark, "login from 10.0.0.5 by Bob.Smith@corp.acme.io", "src=10.0.0.5, card 4111111111111111.", "plain text")
    found = mint.with_aliases(plan.entries(detect.everything(rows)), "salt").cache()
    changed = apply.applied(rows, found)
    assert prove.residual(changed, found).count() == 0
    assert prove.structure(changed).count() == 0
    out = [r.after for r in changed.orderBy("line_no").collect()]
    assert "10.0.0.5" not in "".join(out) and out[2] == "plain text" and out[1].endswith(".")
    again = mint.with_aliases(plan.entries(detect.everything(rows)), "salt")
    assert sorted(found.select("original", "alias").collect()) == sorted(again.select("original", "alias").collect())


def test_all_endings_cases_and_encoded_mailboxes(spark):
    rows = frame(spark, "peer srv1.acme.nl up", "peer DB1.ACME.COM up", "GET /x?u=jsmith%40acme.com&v=1")
    found = mint.with_aliases(plan.entries(detect.everything(rows)), "salt").cache()
    assert {r.original: r.kind for r in found.collect()} == {"srv1.acme.nl": "fqdn", "DB1.ACME.COM": "fqdn", "jsmith%40acme.com": "email"}
    out = "\n".join(r.after for r in apply.applied(rows, found).orderBy("line_no").collect())
    assert "acme" not in out.lower() and "jsmith" not in out and "%40" in out and out.endswith("&v=1")


def test_formats(spark):
    for raw, want in {"CEF:0|a|b|c|d|e|5|x=1": "cef", '{"a":1}': "json", "a=1 b=2 c=3": "kvp", "<a>b</a>": "xml", "hello": "text", "<13>Jan  2 03:04:05 h p: m": "syslog"}.items():
        assert one(spark, recognise.line_format, raw) == want


def test_documents_and_guards(spark):
    rows = frame(spark, "a=1 b=2 c=3", "a=4 b=5 c=6")
    docs = library.documents(rows, "acme")
    assert library.intact(docs).count() == 1
    assert library.intact(docs.withColumn("events", F.array(F.lit("changed")))).count() == 0
    universe = guards.shape_universe(rows)
    got = guards.guard_extension(frame(spark, "a=1 b=2 c=3", "x", "a=7 b=8 c=9"), universe, rows)
    assert {r.raw: r.reason for r in got.collect()} == {"a=1 b=2 c=3": "duplicate", "x": "too short", "a=7 b=8 c=9": None}


def test_lines_of_events(spark):
    texts = spark.createDataFrame([("d", '[{"_raw":"one"},{"a":1}]')], "id string, text string")
    assert [r.raw for r in lines.events_array(texts, "id", "text").orderBy("line_no").collect()] == ["one", '{"a":1}']
    texts = spark.createDataFrame([("d", "x\r\n\r\ny")], "id string, text string")
    assert [(r.line_no, r.raw) for r in lines.to_lines(texts, "id", "text").collect()] == [(1, "x"), (3, "y")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("from 10.1.1.1\nfrom 10.1.1.1\nfrom 10.2.2.2\n")
    stream = capture.distinct_lines(capture.source(spark, str(tmp_path / "in")))
    run = capture.deidentified(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "salt", seconds=None)
    run.awaitTermination(120)
    got = [r.after for r in spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()]
    assert len(got) == 2 and not any("10.1.1.1" in x or "10.2.2.2" in x for x in got)


def test_extras():
    got = patterns.split_extras("acme, field:quoteNumber,re:x|\nre:a{1,2}(?<g1>\\d),b|g1\nre:broken")
    assert got == (["acme"], ["quoteNumber"], [("a{1,2}(?<g1>\\d),b", ["g1"])])
    assert patterns.parse_pattern(patterns.pattern_extra("(?<x>a)|b", ["x"])) == ("(?<x>a)|b", ["x"])
    assert patterns.named_groups("(?<=k)(?<a>x)(?<b>y)(?<a>z)") == ["a", "b"]
    assert patterns.from_selection(" test 12.4 ") == r"(?<g1>test)\s+(?<g2>12\.4)"
    assert patterns.split_extras("") == ([], [], [])


def test_pattern_groups_beside_other_groups(spark):
    extras = patterns.split_extras(r"re:(id|no)=[(](?<n>\d+)[)](?<rest>\w*)|n+rest")
    got = patterns.hits(frame(spark, "id=(12)ab no=(3)", "none"), extras).select("line_no", "value", "kind").collect()
    assert sorted(map(tuple, got)) == [(1, "12", "custom"), (1, "3", "custom"), (1, "ab", "custom")]


def test_vendor_layouts(spark):
    tokens = spark.createDataFrame([("McAfeeEPO-f5_log",)], "v string").select(signatures.name_tokens(F.col("v"))).first()[0]
    assert tokens == ["mc", "afee", "epo", "f", "5", "log"]
    got = vendors.parsed(frame(spark, '10.0.0.1 - - [x] "GET /a HTTP/1.1" 200 5 "ref" "agent"', "no"), "nginx_access").orderBy("line_no").collect()
    assert got[0].fields["url"] == "/a" and got[0].fields["http_user_agent"] == "agent" and not got[1].fields
    got = vendors.parsed(frame(spark, ",".join(str(i) for i in range(23)), "1,2"), "palo_alto_system").orderBy("line_no").collect()
    assert got[0].fields["host"] == "22" and got[0].fields["message"] == "14" and not got[1].fields
    got = vendors.parsed(frame(spark, 'device_name="XG" dst_ip=1.2.3.4 user_name="" user=bob'), "sophos_xg").first().fields
    assert (got["host"], got["dest_ip"], got["user"]) == ("XG", "1.2.3.4", "bob")
    got = vendors.parsed(frame(spark, '{"message":"2 123456789012 eni-1 a b 1 2 6 3 4 5 6 ACCEPT OK"}', "2 vpc-1 x"), "aws_vpc_v2").orderBy("line_no").collect()
    assert got[0].fields["log_status"] == "OK" and not got[1].fields


def test_echo_and_evidence(spark):
    names = spark.createDataFrame([("s", "acme:gate")], "sample_id string, sourcetype string")
    assert guards.key_echo(frame(spark, "Jan 1 acme-gate[1]: up", "acme-gate: x"), names).first().position == "syslog-program"
    assert guards.key_echo(frame(spark, "a acme_gate=1", "b", "c"), names).count() == 0
    one_word = spark.createDataFrame([("s", "haproxy")], "sample_id string, sourcetype string")
    assert guards.key_echo(frame(spark, "haproxy: x"), one_word).count() == 0
    row = spark.createDataFrame([("pass", "structure"), ("fail", "structure")], "v string, m string").select(guards.evidence(F.col("v"), F.col("m")).alias("e")).collect()
    assert [r.e for r in row] == ["structure-only", "none"]


def test_every_layout_stands_odd_lines(spark):
    odd = frame(spark, "", "{", '{"a":{"b":null}}', "[]", "=,=", "<x", "0", '"', "CEF:0|", None)
    for name in vendors.CATALOGUE:
        assert vendors.parsed(odd, name).count() == 10
        vendors.parsed(odd, name).selectExpr("sum(size(fields))").first()
    assert vendors.best_parser(odd).count() == 0
    assert vendors.best_parser(odd.where("false")).count() == 0
