"""No line may stop an executor or hold a task: parsers, layouts and detectors over values of a megabyte."""

import time

import pytest
from pyspark.sql import functions as F

from maskline.operators import detect, parsers, patterns, prove, recognise, spans, vendors

N = 1 << 20


def cases(N):
    return {
        "quoted": 'a=1 msg="' + "x y" * (N // 3) + '" b=2',
        "open quote": 'a=1 msg="' + "x" * N,
        "escapes": 'a=1 msg="' + '\\"' * (N // 2) + '" b=2',
        "word": "a" * N,
        "word and at": "a" * N + " x@y.io",
        "at": "a@" * (N // 2),
        "labels": "a." * (N // 2) + "com",
        "labels of hyphens": "a-" * (N // 2) + "a.com",
        "mailbox labels": "x@" + "a." * (N // 2) + "com",
        "equals": "=" * N,
        "pairs": "k=v " * (N // 4),
        "blanks": "k= " + " " * N + "x=1",
        "digits": "1" * N,
        "dots": "." * N,
        "quads": "1.2.3.4." * (N // 8),
        "colons": "a:" * (N // 2),
        "cef": "CEF:0|v|p|1|7|n|5|msg=" + "word " * (N // 5) + " src=1.2.3.4",
        "cef escapes": "CEF:0|v" + "\\|" * (N // 2) + "|p|1|7|n|5|msg=" + "\\=" * (N // 2) + " src=1.2.3.4",
        "leef": "LEEF:1.0|v|" + "\\\\" * (N // 2) + "|1|7|usrName=" + "x" * N + "\tsrc=1.2.3.4",
        "json": '{"a":"' + "\\n" * (N // 2) + '","username":"ann"}',
        "json list": '{"users":[' + '{"username":"u1"},' * (N // 18) + '{"username":"jdoe77"}]}',
        "xml": "<Event><Data Name='TargetUserName'>" + "x" * N + "</Data></Event>",
        "tags": "<a>" * (N // 3),
        "syslog": "<13>Jan  2 03:04:05 web1 sshd[1]: Failed password for " + "x" * N,
        "access": '10.0.0.1 - - [x] "GET /' + "a" * N + ' HTTP/1.1" 200 5',
        "plus": "+1 " * (N // 3),
        "certificate": "-----BEGIN " + "A " * (N // 2),
        "commas": "," * N,
        "cisco": "<1>Jan  2 2024 03:04:05 fw1 : %ASA-6-302013: Built inbound TCP connection 1 for " + "a:" * (N // 2),
        "braces": "{" * 1000,
    }


LINES = cases(N)


def table(spark, folder, found):
    rows = [(k, i, v) for i, (k, v) in enumerate(found.items())]
    spark.createDataFrame(rows, "sample_id string, line_no long, raw string").write.parquet(f"{folder}/lines")
    return spark.read.parquet(f"{folder}/lines").repartition(8)


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    return table(spark, tmp_path_factory.mktemp("long"), LINES)


@pytest.fixture(scope="module")
def shorter(spark, tmp_path_factory):
    """For the many layouts: long enough to see a square."""
    return table(spark, tmp_path_factory.mktemp("shorter"), cases(N >> 3))


def within(seconds, df):
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    assert time.time() - began < seconds


PARSERS = {name: getattr(parsers, name) for name in ("kvp", "json", "json_leaves", "json_pairs", "fields", "cef", "leef", "clf", "syslog", "xml", "security_header")}


@pytest.mark.parametrize("name", sorted(PARSERS))
def test_parsers(lines, name):
    within(60, lines.select(PARSERS[name](F.col("raw")).alias("x")))


@pytest.mark.parametrize("name", sorted(vendors.CATALOGUE))
def test_layouts(shorter, name):
    within(15, vendors.parsed(shorter, name))


DETECTORS = ["ipv4", "ipv4_identities", "email", "card", "iban", "phone", "logins", "fqdn", "secrets", "everything"]


@pytest.mark.parametrize("name", DETECTORS)
def test_detectors(lines, name):
    within(60, getattr(detect, name)(lines))


def test_formats_and_patterns(lines):
    within(60, lines.select(recognise.line_format(F.col("raw"))))
    within(60, patterns.count_matches(lines, r"user=(?<who>\w+)"))
    within(60, lines.select(*spans.cut(F.col("raw"), spans.RUN, keys=True)))
    within(60, lines.select(*spans.cut(F.col("raw"), spans.WORD, keys=False)))
    within(60, prove.structure(lines.withColumn("after", F.col("raw"))))


def test_long_values_are_read_whole(lines):
    got = {r.sample_id: r.f for r in lines.where("sample_id in ('quoted', 'cef', 'escapes')").select("sample_id", F.when(F.col("sample_id") == "cef", parsers.cef(F.col("raw"))).otherwise(parsers.kvp(F.col("raw"))).alias("f")).collect()}
    assert got["quoted"]["msg"] == "x y" * (N // 3) and got["quoted"]["b"] == "2"
    assert got["cef"]["msg"] == ("word " * (N // 5)).strip() and got["cef"]["src"] == "1.2.3.4"
    assert len(got["escapes"]["msg"]) == N
    hosts = {r.sample_id: r.value for r in detect.fqdn(lines.where("sample_id like 'labels%'")).collect()}
    assert hosts == {k: v for k, v in LINES.items() if k.startswith("labels")}
