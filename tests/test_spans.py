"""Replacing and proving: values inside longer texts, aliases that stay, fields of many forms."""

import collections

import pytest
from pyspark.sql import functions as F

from maskline.operators import apply, detect, mint, parsers, plan, prove
from maskline.streaming import capture

VALUES = {
    "10.0.0.1": "ipv4", "10.0.0.5": "ipv4", "jsmith": "user", "Bob Smith": "user", "John Doe": "user", "+49 30 123456": "pii", "abc/def+ghi==": "secret",
    "bob@corp.acme.io": "email", "u%40corp.acme.io": "email", "00:1b:44:11:3a:b7": "mac", "fe80::1": "ipv6", "fe80::5": "ipv6", "\u03a9\u03bb\u03c6": "user",
    "a b c d e f g h i j k": "user", "x" * 300: "secret",
}
CASES = [
    ("from 10.0.0.1-10.0.0.5 up", "from <0>-<1> up"),
    ("net 10.0.0.1/24.", "net <0>/24."),
    ("http://10.0.0.1:80/x", "http://<0>:80/x"),
    ("ip-10.0.0.1 and 1.10.0.0.1 and 10.0.0.12", "ip-<0> and 1.10.0.0.1 and 10.0.0.12"),
    ("open /home/jsmith/docs", "open /home/<2>/docs"),
    ('owner="Bob Smith" CN=John Doe,OU=x', 'owner="<3>" CN=<4>,OU=x'),
    ("Bob  Smith, BOB SMITH", "Bob  Smith, <3>"),
    ("call +49 30 123456, 49 30 123456", "call <5>, 49 30 123456"),
    ("s=abc/def+ghi==; ABC/def+ghi==", "s=<6>; ABC/def+ghi=="),
    ("mail BOB@corp.acme.io. u%40corp.acme.io&", "mail <7>. <8>&"),
    ("mac 00:1b:44:11:3a:b7 fe80::1-fe80::5", "mac <9> <10>-<11>"),
    ("jsmith2 xjsmith jsmith-x jsmith", "jsmith2 xjsmith jsmith-x <2>"),
    ("Zo\u00eb \u03a9\u03bb\u03c6 end", "Zo\u00eb <12> end"),
    ("is a b c d e f g h i j k l", "is <13> l"),
    ("k=" + "x" * 300, "k=<14>"),
    ('{"jsmith":"jsmith","10.0.0.1":{"a b":"say \\"jsmith\\""}}', '{"jsmith":"<2>","<0>":{"a b":"say \\"<2>\\""}}'),
    ("", ""),
    ("nothing here", "nothing here"),
]


def frame(spark, *raws):
    return spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(raws)], "sample_id string, line_no long, raw string")


def known(spark, values):
    rows = [(v, k, f"<{i}>", True) for i, (v, k) in enumerate(values.items())]
    return spark.createDataFrame(rows, "original string, kind string, alias string, enabled boolean")


def test_values_inside_longer_texts(spark):
    entries = known(spark, VALUES)
    changed = apply.applied(frame(spark, *(a for a, _ in CASES)), entries).orderBy("line_no").collect()
    assert [r.after for r in changed] == [b for _, b in CASES]
    assert [r.replaced for r in changed] == [b.count("<") for _, b in CASES]


def test_longest_of_overlapping_values(spark):
    entries = known(spark, {"ann": "user", "ann lee": "user", "lee king": "user", "off": "user"}).withColumn("enabled", F.col("original") != "off")
    got = apply.applied(frame(spark, "ann lee king ann off"), entries).first()
    assert got.after == "<1> king <0> off"


def test_the_proof_sees_what_the_replacer_leaves(spark):
    entries = known(spark, VALUES)
    changed = apply.applied(frame(spark, *(a for a, _ in CASES)), entries)
    got = {(r.line_no, r.value) for r in prove.residual(changed, entries).collect()}
    # Inside longer names, beside another case of a secret, or as a part of another address.
    assert got == {(4, "10.0.0.1"), (9, "abc/def+ghi=="), (12, "jsmith")}
    untouched = frame(spark, "10.0.0.1-10.0.0.5", "/home/jsmith/docs", "owner=Bob Smith", "fine").withColumn("after", F.col("raw"))
    got = {(r.line_no, r.value) for r in prove.residual(untouched, entries).collect()}
    assert got == {(1, "10.0.0.1"), (1, "10.0.0.5"), (2, "jsmith"), (3, "bob smith")}


def test_structure_of_nested_keys(spark):
    pairs = [('{"a":{"b":1}}', '{"a":{"c":1}}'), ('{"a":{"10.0.0.1":1}}', '{"a":{"10.9.9.9":1}}'), ('{"a":[{"x@y.io":"b:c"}]}', '{"a":[{"p@q.io":"d:e"}]}'), ('{"a":1}', '{"a":}'), ("a=1,b", "a=1;b")]
    rows = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(pairs)], "sample_id string, line_no long, raw string, after string")
    got = {r.line_no: r.reason for r in prove.structure(rows).collect()}
    assert got == {0: "json keys changed", 3: "json no longer valid", 4: "delimiters changed"}


def test_what_the_whole_run_finds_goes(spark):
    raws = [
        "range 10.1.2.3-10.1.2.9 net 10.9.0.1/24 http://db1.corp.acme.io/x",
        "Accepted publickey for jdoe from 10.1.2.3", "session opened for user kgrant(uid=7)", "key +1 415-555-0132 at 10:00:00 +1000 2024 05",
        "ACME\\mlowe logged on", '{"user":"ACME\\\\mlowe","pan":"DE89 3704 0044 0532 0130 00"}', "password=hunter2hunter2 Authorization: Bearer " + "t0ken" * 40,
        "dn CN=Rita Moss,OU=Sales,DC=acme", "-----BEGIN RSA PRIVATE KEY-----MIIE", "agent 10.7.7.7 10.7.7.7",
    ]
    lines = frame(spark, *raws)
    entries = mint.with_aliases(plan.entries(detect.everything(lines)), "salt").cache()
    values = {r.original for r in entries.collect()}
    assert {"10.1.2.3", "10.1.2.9", "10.9.0.1", "db1.corp.acme.io", "jdoe", "kgrant", "+1 415-555-0132", "mlowe", "ACME", "t0ken" * 40, "Rita Moss", "DE89 3704 0044 0532 0130 00", "hunter2hunter2", "10.7.7.7"} <= values
    assert not any("1000" in v for v in values)
    changed = apply.applied(lines, entries).cache()
    assert prove.residual(changed, entries).count() == 0
    out = "\n".join(r.after for r in changed.collect())
    assert not [v for v in values if v in out]


def test_aliases_are_one_to_one_and_stay(spark):
    def entries(low, high):
        rows = [(f"10.{i % 7}.{i // 7}.9", "ipv4") for i in range(low, high)] + [(f"{20 + i % 90}.{i // 90}.1.{i % 250}", "ipv4") for i in range(low, high)]
        rows += [(f"user{i}", "user") for i in range(low, high)] + [(f"s3cret{i}key", "secret") for i in range(low, high)] + [(f"h{i}.acme.io", "fqdn") for i in range(low, high)]
        return spark.createDataFrame(rows, "original string, kind string")

    first = mint.extend(None, entries(0, 300), "salt").cache()
    second = mint.extend(first, entries(200, 600), "salt")
    both = first.unionByName(second).cache()
    one = {r.original: r.alias for r in mint.aliased(entries(0, 300), first, "salt").collect()}
    two = {r.original: r.alias for r in mint.aliased(entries(0, 600), both, "salt").collect()}
    assert all(two[k] == v for k, v in one.items())
    assert len(two) == len(set(two.values())) == 3000 and not set(two) & set(two.values())
    addresses = [v for k, v in two.items() if k[:2].isdigit() and k.count(".") == 3]
    assert all(len(v.split(".")) == 4 and all(0 <= int(x) < 256 for x in v.split(".")) for v in addresses)
    nets = collections.defaultdict(set)
    for k, v in two.items():
        if k.startswith("10."):
            nets[v.rsplit(".", 1)[0]].add(k.rsplit(".", 1)[0])
    assert all(len(x) == 1 for x in nets.values())


def test_aliases_in_a_stream_of_two_batches(spark, tmp_path):
    place = lambda name: str(tmp_path / name)
    (tmp_path / "in").mkdir()
    for number, text in enumerate(["from 4.4.4.4 x\nfrom 1.1.1.1 x\n", "from 4.4.4.4 y\nfrom 9.9.9.9 y\n"]):
        (tmp_path / "in" / f"{number}.log").write_text(text)
        run = capture.deidentified(capture.source(spark, place("in")), place("out"), place("ck"), "salt", seconds=None)
        run.awaitTermination(120)
    got = collections.Counter(r.after.split()[1] for r in spark.read.parquet(place("out")).collect())
    assert sorted(got.values()) == [1, 1, 2] and not set(got) & {"4.4.4.4", "1.1.1.1", "9.9.9.9"}
    again = capture.Mapping(spark, place("out-mapping"))
    before = again.read().count()
    again.aliased(spark.createDataFrame([("4.4.4.4", "ipv4")], "original string, kind string"), "salt", 1)
    assert again.read().count() == before


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"a.b":1,"a":{"b":2,"c":{"d":{"e":{"f":"x"}}}}}', {"a.b": "2", "a.c.d.e.f": "x"}),
        ('10.0.0.1 - bob [x] "GET / HTTP/1.1" 200 5', {"client_ip": "10.0.0.1", "user": "bob"}),
        ("<13>Jan  2 03:04:05 web1 sshd[1]: user=ann", {"host": "web1", "user": "ann"}),
        ("<Event><Data Name='TargetUserName'>ann</Data><n></n></Event>", {"TargetUserName": "ann"}),
        ("{broken", {}),
        ("", {}),
    ],
)
def test_fields_of_a_line(spark, raw, want):
    assert frame(spark, raw).select(parsers.fields(F.col("raw")).alias("f")).first().f == want


def test_hits_by_field_name(spark):
    pairs = [("username", "ann"), ("src_ip", "10.0.0.1"), ("src_ip", "127.0.0.1"), ("src_ip", "n.a"), ("password", "Bearer abcdefgh1"), ("pwd", "short"), ("ssn", "123-45-6789"), ("device_model", "X"), ("user", "a@b.io"), ("count", "7"), ("zip", "12345"), ("owner", "root")]
    rows = spark.createDataFrame([("s", i, f, v) for i, (f, v) in enumerate(pairs)], "sample_id string, line_no long, field string, value string")
    got = {r.value: r.kind for r in detect.fields(rows).collect()}
    assert got == {"ann": "user", "10.0.0.1": "ipv4", "n.a": "pii", "abcdefgh1": "secret", "123-45-6789": "pii", "a@b.io": "email", "12345": "pii"}


def test_literals_in_one_pass(spark):
    lines = frame(spark, "project x.y and x.y", "other")
    found = plan.entries(detect.everything(lines))
    got = plan.with_literals(found, lines, ["x.y", "absent", "project"]).collect()
    assert {(r.original, r.kind, r["count"]) for r in got} == {("x.y", "custom", 2), ("project", "custom", 1)}
