"""Picks, marks, registries, profiles and secret rules against plain Python."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from maskline.operators import apply, marks, picks, profiles, registry, secret_rules


def frame(spark, *raws):
    return spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(raws)], "sample_id string, line_no long, raw string")


def known(spark, *rows):
    return spark.createDataFrame(list(rows), "original string, alias string, kind string, enabled boolean")


def test_picks_replace_their_groups_alone(spark):
    raws = ["svc[4212]: id 4212 by jsmith", "1.2.3.4 - 4 [x] jsmith", "", "none", "a=1 b=22 a=333", "svc[7]: "]
    patterns = [(r"(?<prog>\w+)\[(?<pid>\d+)\]", ["pid"]), (r"- (?<n>\d) \[", ["n"]), (r"(?:a=(?<a>\d+)|b=(?<b>\d+))", ["a", "b", "absent"]), (r"(?<all>svc\[(?<in>\d+)\])", ["all", "in"])]
    lines = frame(spark, *raws)
    found = picks.found(lines, patterns[:3]).cache()
    assert sorted((r.line_no, r.match, [p.value for p in r.parts]) for r in found.collect()) == [
        (1, "svc[4212]", ["4212"]), (2, "- 4 [", ["4"]), (5, "a=1", ["1"]), (5, "a=333", ["333"]), (5, "b=22", ["22"]), (6, "svc[7]", ["7"]),
    ]
    named = picks.aliases(found, "salt").cache()
    alias = {r.value: r.alias for r in named.collect()}
    assert set(alias) == {"4212", "4", "1", "22", "333", "7"} and all(len(k) == len(v) and k != v and v.isdigit() for k, v in alias.items())
    got = picks.applied(lines, found, named, known(spark, ("jsmith", "<u>", "user", True), ("4212", "<n>", "custom", True))).orderBy("line_no").collect()
    want = [f"svc[{alias['4212']}]: id <n> by <u>", f"1.2.3.4 - {alias['4']} [x] <u>", "", "none", f"a={alias['1']} b={alias['22']} a={alias['333']}", f"svc[{alias['7']}]: "]
    assert [r.after for r in got] == want and [r.replaced for r in got] == [3, 2, 0, 0, 3, 1]
    whole = picks.found(lines, patterns[3:]).where("line_no = 1").first()
    assert [p.value for p in whole.parts] == ["svc[4212]"]  # the inner group lies in the first
    assert picks.found(lines, []).count() == 0


def test_entries_of_picks_can_be_edited(spark):
    found = picks.found(frame(spark, "ab[12]", "ab[12] cd[34]"), [(r"(?<p>\w+)\[(?<n>\d+)\]", ["n", "p"])]).cache()
    entries = picks.shown(picks.entries(found, picks.aliases(found, "salt"))).cache()
    got = {r.original: r for r in entries.collect()}
    assert {k: r["count"] for k, r in got.items()} == {"ab[12]": 2, "cd[34]": 1} and got["ab[12]"]["from"] == "ab+12"
    assert all(regex.fullmatch(r"[a-z]{2}\[\d\d\]", r.alias) and r.to == "+".join(p.alias for p in r.patches) for r in got.values())
    edited = {r.original: r.alias for r in picks.edited(entries, F.lit("x+y")).collect()}
    assert edited == {"ab[12]": "x[y]", "cd[34]": "x[y]"}
    assert {r.alias for r in picks.edited(entries, F.lit("x")).collect()} == {f"x[{got[k].patches[1].alias}]" for k in got}


def test_spans_rebuild_both_texts(spark):
    draw = random.Random(3)
    values = [("10.0.0.1", "ipv4"), ("jsmith", "user"), ("Bob Smith", "user"), ("+49 30 123456", "pii"), ("a@b.io", "email"), ("web01$", "host")]
    raws = [draw.choice([" ", ", ", "; (", '"']).join(draw.choices([v for v, _ in values] + ["x", "10.0.0.12", "JSMITH.", "web01", "\U0001f600"], k=8)) for _ in range(60)]
    raws += ['{"a@b.io":{"k":"jsmith"}}', "", "jsmith"]
    entries = known(spark, *[(v, f"<{i}>" * (i + 1), k, True) for i, (v, k) in enumerate(values)]).cache()
    lines = frame(spark, *raws).cache()
    after = {r.line_no: r.after for r in apply.applied(lines, entries).collect()}
    spans = {}
    for r in marks.mapped(lines, entries).collect():
        spans.setdefault(r.line_no, []).append(r)
    assert sum(map(len, spans.values())) > 100
    for number, raw in enumerate(raws, 1):
        out, at = "", 0
        for r in sorted(spans.get(number, []), key=lambda r: r.start):
            assert raw[r.start : r.finish].lower() == r.original.lower()
            out += raw[at : r.start]
            assert len(out) == r.after_start
            out += r.alias
            assert len(out) == r.after_finish
            at = r.finish
        assert out + raw[at:] == after[number]
    off = entries.withColumn("enabled", F.col("original") != "jsmith")
    flags = {(r.original, r.enabled) for r in marks.marked(lines, off).collect()}
    assert ("jsmith", False) in flags and ("10.0.0.1", True) in flags
    shown = marks.preview(lines, entries, most=3, bad=F.col("kind") == "pii").orderBy("line_no").collect()
    assert len(shown) == 3 and all(len(r.before_spans) == len(r.after_spans) == len(spans[r.line_no]) for r in shown)


CASES = [
    ("kvp four of eight", ["a=1 b=2 c=3 d=4"], ("kvp", [], list("abcdefgh"), [], False, False), "match"),
    ("kvp three of eight", ["a=1 b=2 c=3"], ("kvp", [], list("abcdefgh"), [], False, False), "mismatch"),
    ("upper case", ["A=1 B=2 C=3"], ("kvp", [], ["a", "b"], [], False, False), "match"),
    ("json for pairs", ['{"a":1,"b":2}'], ("kvp", [], ["a"], [], False, False), "mismatch"),
    ("json allowed too", ['{"a":1,"b":2}'], ("kvp", ["json"], ["a", "b"], [], False, False), "match"),
    ("cef for pairs", ["CEF:0|v|p|1|7|n|5|zzz=1"], ("kvp", [], ["a"], [], False, False), "match"),
    ("one key in text", ["some words a=1", "plain", "plain"], ("json", [], ["a", "b"], [], False, False), "match"),
    ("no key in text", ["some words", "plain"], ("json", [], ["a", "b"], [], False, False), "mismatch"),
    ("text without keys asked", ["some words"], ("json", [], [], [], False, False), "match"),
    ("pattern", ["x %ASA-6-302013: y", "plain"], ("unstructured", [], [], [r"%ASA-\d"], False, False), "match"),
    ("pattern in pairs", ["a=1 b=2 c=3 d=4 %ASA-6"], ("unstructured", [], [], [r"%ASA-\d"], False, False), "match"),
    ("pairs for text", ["a=1 b=2 c=3 d=4"], ("unstructured", [], [], [], False, False), "mismatch"),
    ("few pairs for text", ["a=1 b=2 c=3"], ("unstructured", [], [], [], False, False), "match"),
    ("header", ["CEF:0|v|p|1|7|n|5|x=1"], ("cef", [], [], [], False, True), "match"),
    ("no header", ["x=1 y=2 z=3"], ("cef", [], [], [], False, True), "mismatch"),
]


def test_expectations(spark):
    lines = spark.createDataFrame([(name, i, raw) for name, raws, _, _ in CASES for i, raw in enumerate(raws)], "sample_id string, line_no long, raw string")
    rows = spark.createDataFrame([(f"source_{k}", *x) for k, (_, _, x, _) in enumerate(CASES)], registry.EXPECTATIONS)
    named = spark.createDataFrame([(name, f"Source:{k}") for k, (name, *_) in enumerate(CASES)] + [("header", "unheard of"), ("no such sample", "source_0")], "sample_id string, sourcetype string")
    got = {(r.sample_id, r.sourcetype): r.verdict for r in registry.verdicts(lines, named, rows).collect()}
    assert got == {(name, f"Source:{k}"): want for k, (name, _, _, want) in enumerate(CASES)} | {("header", "unheard of"): "unknown", ("no such sample", "source_0"): "unknown"}


def test_golden_wants_one(spark):
    rows = spark.createDataFrame([(x, "unstructured", [], [], [p], on, False) for x, p, on in [("a", "alpha", True), ("b", "al", True), ("c", "gamma", True), ("d", "gamma", False)]], registry.EXPECTATIONS)
    lines = spark.createDataFrame([(x, 1, x) for x in ("alpha", "also", "gamma", "none")], "sample_id string, line_no long, raw string")
    assert {(r.sample_id, r.sourcetype) for r in registry.golden(lines, rows).collect()} == {("also", "b"), ("gamma", "c")}


@pytest.mark.parametrize("seed", range(2))
def test_key_searches_are_those_of_all_pairs(spark, seed):
    draw = random.Random(seed)
    words = [f"k{i}" for i in range(14)]
    sets = lambda n: [draw.sample(words, draw.randrange(9)) for _ in range(n)]
    samples, fields = sets(80), sets(60)
    s = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(samples)], "sample_id string, keys array<string>")
    t = spark.createDataFrame([(f"t{i}", [], [k.upper() for k in x], None) for i, x in enumerate(fields)], registry.DATATYPES)
    want = {(f"s{i}", f"t{j}", len({*a} & {*b})) for i, a in enumerate(samples) for j, b in enumerate(fields) if len({*a} & {*b}) >= 3 and len({*a} & {*b}) >= 0.6 * len(a)}
    assert {(r.sample_id, r.datatype, r.hit) for r in registry.overlaps(s, t).collect()} == want and len(want) > 20
    e = spark.createDataFrame([(f"t{i}", "json", [], x, [], False, False) for i, x in enumerate(fields)], registry.EXPECTATIONS)
    want = {(f"s{i}", f"t{j}") for i, a in enumerate(samples) for j, b in enumerate(fields) if b and {*b} <= {*a}}
    assert {(r.sample_id, r.sourcetype) for r in registry.contained(s, e).collect()} == want
    best = {r.sample_id: r.sourcetype for r in registry.by_keys(s, e).collect()}
    assert best == {x: max((len(fields[int(t[1:])]), t) for y, t in want if y == x)[1] for x, _ in want}


def test_anchors_need_content_or_evidence(spark):
    lines = spark.createDataFrame([(x, i, r) for x, rs in {"dns": ["q a.b from 1.2.3.4", "q c.d from 5.6.7.8", "q e from 9", "odd"], "host": ["h1: text"] * 2, "own": ["h1: dhcpd up"] * 2}.items() for i, r in enumerate(rs)], "sample_id string, line_no long, raw string")
    types = spark.createDataFrame(
        [("query", [r"^q (?<query>\S+) from (?<client>\S+)$", r"^(?<all>.*)$"], [], None), ("syslog", [r"^(?<host>\w+): (?<message>.*)$"], [], None), ("dhcp", [r"^(?<host>\w+): (?<message>.*)$"], [], "dhcp")], registry.DATATYPES
    )
    got = {(r.sample_id, r.datatype, r.confidence, r.method) for r in registry.datatype(lines, types).collect()}
    assert got == {("dns", "query", 0.75, "regex"), ("own", "dhcp", 1.0, "regex")}


def test_profiles_are_the_first_that_fit(spark):
    draw = random.Random(5)
    word = lambda n: "".join(draw.choices("abc:_", k=n))
    rows = [(k, f"p{k}", [word(draw.randrange(1, 6)) for _ in range(draw.randrange(3))], ["caller"], ["Inside"], "") for k in range(40)]
    names = ["", "p7 Log"] + [word(draw.randrange(1, 12)) for _ in range(200)]
    plain = lambda x: regex.sub("[^a-z0-9]+", "_", x.lower()).strip("_")
    want = {}
    for name in names:
        hit = next((p for _, p, parts, *_ in rows if any(plain(x) and plain(x) in plain(name) for x in parts or [p])), None)
        if hit:
            want[name] = hit
    table = spark.createDataFrame(rows, profiles.PROFILES)
    assert {r.name: r.profile for r in profiles.matched(spark.createDataFrame([(x,) for x in names], "name string"), table).collect()} == want and len(want) > 100
    sources = spark.createDataFrame([("s", "p1")], "sample_id string, profile string")
    pairs = spark.createDataFrame([("s", 1, "Caller", "ann"), ("s", 2, "other", "bob"), ("s", 3, "caller", "10.0.0.1"), ("s", 4, "caller", "inside"), ("t", 5, "caller", "eve")], "sample_id string, line_no long, field string, value string")
    hits = profiles.without_words(profiles.identity_hits(pairs, sources, table), sources, table)
    assert {(r.value, r.kind) for r in hits.collect()} == {("ann", "user"), ("10.0.0.1", "ipv4")}


def test_secret_rules(spark):
    rules = spark.createDataFrame(
        [("a-literal", r"LIT[0-9]{8}", "literal", []), ("b-near", r"\b[0-9a-f]{10}\b", "structural", ["Key", "a.b"]), ("c-pair", r"\w+=[A-Z]{9}", "structural", ["set "]), ("d-uri", r"\w+://\S+", "literal", []), ("e-none", r"zzz", "numeric", [])],
        secret_rules.RULES,
    )
    cases = {
        "x LIT12345678 y": [("a-literal", "LIT12345678")], "LIT1234567": [], "KEY 0123456789": [("b-near", "0123456789")], "key" + " " * 37 + "0123456789": [("b-near", "0123456789")],
        "key" + " " * 38 + "0123456789": [], "0123456789 key": [], "aXb 0123456789": [], "a.b 0123456789": [("b-near", "0123456789")], "set name=ABCDEFGHI": [("c-pair", "ABCDEFGHI")],
        "pg://me:pw@host/x": [("d-uri", "pw")], "pg://host/x": [("d-uri", "pg://host/x")], "pg://h": [], "zzz": [], "": [], "key 0123456789 0123456789": [("b-near", "0123456789")],
    }
    got = {}
    for r in secret_rules.findings(frame(spark, *cases), rules).collect():
        got.setdefault(list(cases)[r.line_no - 1], []).append((r.rule, r.value))
    assert got == {k: v for k, v in cases.items() if v}
    assert secret_rules.findings(frame(spark, "x"), rules.limit(0)).count() == 0
    assert {r.kind for r in secret_rules.hits(frame(spark, *cases), rules).collect()} == {"secret"}
