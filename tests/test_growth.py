"""Work that must not grow by more than its input: plans and shapes that large tables showed."""

import json
import re

from pyspark.sql import functions as F

from maskline.functions import fixed, values
from maskline.operators import detect, ladder, layouts, mint, parsers, picks, prove, spans
from maskline.plans import queries
from maskline.sources import library


def _evaluations(spark, build) -> int:
    """How often one row's expression computes its input, counted by a line that is slow to read."""
    tree = build(F.regexp_replace(F.col("raw"), "needle", "needle"))
    plan = spark.createDataFrame([("x",)], "raw string").select(tree.alias("x"))._jdf.queryExecution().analyzed().toString()
    return plan.count("needle, needle")


def test_canonical_names_read_their_fields_once(spark):
    """F5 to F7, F20: the input of ``aliased`` and the first map of ``merged`` stand in the expression once, not once a name and key."""
    chains = {f"n{k}": "a b c" for k in range(9)}
    assert _evaluations(spark, lambda raw: parsers.aliased(parsers.kvp(raw), chains)) <= 2  # keys and values
    assert _evaluations(spark, lambda raw: layouts.merged(parsers.kvp(raw), parsers.kvp(F.col("raw")))) <= 2


def test_verified_reads_each_line_once(spark, monkeypatch):
    """F8: the layouts run once over the lines, and lines that nothing reads still count."""
    calls, own = [], ladder.read
    monkeypatch.setattr(ladder, "read", lambda *x: calls.append(1) or own(*x))
    lines = spark.createDataFrame([("s", k, f"srcip=10.0.0.{k} dstip=10.0.0.9 devname=fw{k} policyid={k}" if k else "none") for k in range(10)], "sample_id string, line_no long, raw string")
    sources = spark.createDataFrame([("s", "fortinet_fortigate")], "sample_id string, sourcetype string")
    row = ladder.verified(lines, sources).first()
    assert (row.verdict, row.lines, row.parsed) == ("pass", 10, 9)
    plan = ladder.verified(lines, sources)._jdf.queryExecution().optimizedPlan().toString()
    assert "srcaddr" not in plan  # the layout is not in the plan that is read several times


def test_crowded_shapes_are_permuted(spark):
    """numbers of which nearly all are taken get aliases one to one, of their shape, none its own."""
    values = spark.range(1, 100).select(F.format_string("x-%02d", "id").alias("v")).unionByName(spark.range(100, 1000).select(F.col("id").cast("string").alias("v")))
    rows = values.select("v", mint.permuted("salt", F.col("v")).alias("a")).collect()
    assert len({r.a for r in rows}) == len(rows) and all(r.a != r.v for r in rows)
    assert all(re.fullmatch(r"x-\d\d" if "-" in r.v else r"[1-9]\d\d", r.a) or (r.v[0] == "x" and re.fullmatch(r"[g-z]-\d\d", r.a)) for r in rows)


def test_picks_of_dense_numbers(spark):
    """seven digits, of which a sixteenth or more are values, ran out of aliases that are no values."""
    part = F.array(F.struct(F.col("id").cast("string").alias("value")))
    rows = picks.aliases(spark.range(1_000_000, 1_700_000).select(part.alias("parts")), "salt")
    n, aliases, same, shaped = rows.agg(F.count("*"), F.count_distinct("alias"), F.count_if(F.col("alias") == F.col("value")), F.count_if(F.col("alias").rlike("^[1-9][0-9]{6}$"))).first()
    assert (n, aliases, same, shaped) == (700_000, 700_000, 0, 700_000)
    assert rows.join(rows.select(F.col("value").alias("alias")), "alias", "left_semi").limit(1).count() == 1  # permuted, not drawn


def test_stored_text_is_unwrapped_once_a_layer(spark):
    """three layers of strings were read eight times."""
    assert _evaluations(spark, library._unwrapped) == 1


def test_a_field_name_is_normalised_once(spark):
    """of every pair the name was brought to its form again for each case that looks at it."""
    assert _evaluations(spark, values.field_kind) == 1


def test_addresses_share_no_anchor(spark):
    """the proof knew an address by one number of it, which met all addresses with that number."""
    address = F.format_string("10.7.%d.%d", F.floor(F.col("id") / 20), F.col("id") % 20)
    entries = spark.range(400).select(address.alias("original"), F.lit("ipv4").alias("kind"), F.lit(True).alias("enabled"))
    sought = spans.sought(entries, spans.WORD)
    assert (sought.count(), sought.select("anchor").distinct().count()) == (400, 400)
    lines = entries.select(F.lit("s").alias("sample_id"), F.monotonically_increasing_id().alias("line_no"), F.concat(F.lit("x-"), "original", F.lit("/24")).alias("raw"))
    found = spans.matches(lines, sought, spans.WORD, keys=False)
    assert (found.count(), found.where("concat('x-', original, '/24') = concat('x-', hit, '/24')").count()) == (400, 400)


def test_patterns_stand_behind_their_words(spark):
    """every line was searched by all patterns of credentials, logins and distinguished names."""
    lines = ["key AKIA" + "A1" * 8, "tok gho_" + "a" * 36, "npm_" + "b" * 36, "sk_live_" + "c" * 16, "Illegal user bob from 1.2.3.4", "new session for user kim", "Account Name: eva", "cn CN=Ann Lee,O=Acme", "API_Key = abcdefgh1", "nothing here"]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate(lines)], "sample_id string, line_no long, raw string")
    plan = detect.everything(rows)._jdf.queryExecution().analyzed().toString()
    for word in [w for words in [*fixed.CREDENTIAL_WORDS, *fixed.LOGIN_WORDS, fixed.DN_WORDS] for w in words]:
        assert f"contains(raw, {word})" in plan or f"Contains(raw, {word})" in plan or re.search(rf"[Cc]ontains\(raw#\d+, {re.escape(word)}\)", plan)
    found = {(r.line_no, r.kind) for r in detect.everything(rows).collect()}
    assert {(k, "secret") for k in (0, 1, 2, 3, 8)} | {(k, "user") for k in (4, 5, 6, 7)} | {(7, "host")} <= found and not any(k == 9 for k, _ in found)


def test_an_original_that_is_an_alias_counts_before(spark, tmp_path):
    """of many addresses some are others' aliases, and the proof left them out of what stands in lines that nothing has replaced yet."""
    address = lambda u: f"10.7.{u // 200 % 200}.{u % 200 + 1}"
    users = [19600, 22443]
    entries = spark.createDataFrame([(address(u), "ipv4", True) for u in users], "original string, kind string, enabled boolean")
    assert {r.original: r.alias for r in mint.with_aliases(entries, queries.SALT).collect()}[address(users[0])] == address(users[1])
    events = spark.createDataFrame(list(enumerate(users)), "event_id long, user_id long").withColumns({"event_type": F.lit("view"), "props": F.lit("{}")})
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = queries.residual_detects(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {(kind, 2, 0) for kind in ("ipv4", "user", "pii")}


def test_longer_counts_characters(spark):
    """the characters of a text were counted one by one where its bytes tell already."""
    texts = ["", "abcd", "abcde", "äöüß", "äöüßx", "𝄞" * 4, "𝄞" * 5, "ab𝄞ü", "abc𝄞ü", None, "x" * 16, "x" * 17]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("t", library.longer(F.col("t"), 4).alias("l")).collect()
    assert all(bool(r.l) == (len(r.t or "") > 4) for r in rows)


def test_long_events_are_not_written_as_json_twice(spark, monkeypatch, tmp_path):
    """a megabyte was escaped twice and searched once more to build each text; the texts are the same."""
    names = ["Customer#000000001", 'a"b\\c of some length', "$1\\2 ü𝄞 of some length", "@long of some length", "", None]
    spark.createDataFrame([(3 + 6 * k, n) for k, n in enumerate(names)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    seen, own = [], library.parsed_documents
    monkeypatch.setattr(library, "parsed_documents", lambda rows: seen.append(rows) or own(rows))
    reasons = {r.id: r.reason for r in queries.stored_documents(spark, str(tmp_path)).collect()}
    assert reasons == {3: "too large", 9: "too large", 15: "too large", 21: "too large", 27: "no events", 33: "no events"}
    for r in seen[0].collect():
        name = names[(r.id - 3) // 6]
        assert json.loads(json.loads(r.text))["events"] == [name and name * 60000]
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(c_name" not in plan


def test_coverage_reads_lines_and_values_once(spark):
    """lines were read again to see whether they have fields, and each value was brought to its form for every test of it."""
    lines = spark.createDataFrame([("s", 1, "user=ann id=7 host=web1 note=x"), ("s", 2, "user=ann host=none src_ip=10.0.0.1")], "sample_id string, line_no long, raw string")
    after = lines.withColumn("raw", F.replace("raw", F.lit("ann"), F.lit("bob")))
    read = lambda rows: parsers.long(rows.select("sample_id", "line_no", parsers.kvp(F.regexp_replace("raw", "needle", "needle")).alias("fields")))
    proof = prove.coverage(read(lines), read(after))
    assert sorted(tuple(r) for r in proof.collect()) == [("s", 1, "host", "web1", False), ("s", 1, "user", "ann", True), ("s", 2, "src_ip", "10.0.0.1", False)]
    assert proof._jdf.queryExecution().optimizedPlan().toString().count("needle, needle") == 2
    formed = prove.coverage(read(lines).withColumn("value", F.regexp_replace("value", "pin", "pin")), read(after))
    assert formed._jdf.queryExecution().optimizedPlan().toString().count("pin, pin") == 1


def test_runs_are_hashed_without_patterns(spark):
    """each run of each line was cut by two patterns, and windows made of every run."""
    entries = spark.createDataFrame([(x, "user", True) for x in ("acme.", "ann$", "a b c d e f", "-", "x y.")], "original string, kind string, enabled boolean")
    raws = ["by Acme. and ANN$", "see acme-", '{"acme.": "ann", "k": "x Y."}', "z a B c d e F", "- b", "x y z", ""]
    lines = spark.createDataFrame([("s", k, x) for k, x in enumerate(raws)], "sample_id string, line_no long, raw string")
    met = spans.matches(lines, spans.sought(entries, spans.RUN), spans.RUN)
    assert sorted((r.line_no, r.original, r.key) for r in met.collect()) == [
        (0, "acme.", False), (0, "ann$", False), (2, "acme.", True), (2, "x y.", False), (3, "a b c d e f", False), (4, "-", False),
    ]
    hashed = [x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in x and "xxhash64" in x]
    assert hashed and not any("regexp_replace" in x for x in hashed)
