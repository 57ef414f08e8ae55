"""Patterns from a selection, and their counts in one scan."""

import re

from maskline.operators import patterns


def test_shapes():
    assert patterns.shape("svc_01") == r"(?<g1>[A-Za-z]+)_(?<g2>\d+)"
    assert patterns.shape("a1-b") == r"(?<g1>[A-Za-z0-9]+)\-(?<g2>[A-Za-z]+)"
    assert [patterns.shape(x) for x in ("", "  ", "web01", "--", "a-" * 61)] == [None] * 5


def test_suggestions_find_what_was_selected():
    lines = {'x user="ann.3" y': "ann.3", "id=EV-7_x z": "EV-7_x", '{"host": "web-1.example", "n": 1}': "web-1", "host: pc7 up": "pc7", "\u00e9t\u00e9-7 a": "7", "a(b)=c": "(b)"}
    for line, text in lines.items():
        found = patterns.suggestions(line, line.index(text), line.index(text) + len(text))
        assert found and len(set(found)) == len(found)
        for source in found:
            hit = re.search(source.replace("(?<g", "(?P<g"), line)
            assert hit and text in hit[0] or hit[0] in text, (source, line)
    assert any('"host"' in x for x in patterns.suggestions('{"host": "web-1.example"}', 10, 15))
    assert patterns.suggestions("a  b", 1, 3) == [] and patterns.suggestions("", 0, 0) == []


def test_counts_equal_one_scan_each(spark):
    raws = ['id=EV-1_x user="a.1"', 'id=EV-7_x id=EV-8_y', "", None, "EV-7_x EV-7_x"]
    rows = spark.createDataFrame([("s", k, x) for k, x in enumerate(raws)], "sample_id string, line_no long, raw string")
    sources = patterns.suggestions("id=EV-7_x z", 3, 9) + [r"never(?<g1>\d)"]
    got = {r.source: (r.matches, r.lines) for r in patterns.count_all(rows, sources).collect()}
    want = {x: tuple(patterns.count_matches(rows, x).select("matches", "lines").first()) for x in sources}
    assert got == want and got[sources[-1]] == (0, 0) and len(got) == len(sources)
    assert {tuple(r)[1:] for r in patterns.count_all(rows.limit(0), sources).collect()} == {(0, 0)}
