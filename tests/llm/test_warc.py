import hashlib
import re

import pytest
from pyspark.sql import functions as F

from maskline.llm import warc

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: {}\r\n\r\n{}\r\n\r\n"
BIG = "<p>big</p>" * 200


def walked(data: bytes) -> list[tuple[int, int]]:
    """Records from the start, one after the other."""
    at, out = 0, []
    while m := re.compile(rb"WARC/1\.\d\r\n(?:[^\r\n]+\r\n)+\r\n").match(data, at):
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)\r\n", m[0])
        end = m.end() + int(length[1]) + 4 if length else len(data) + 1
        if end > len(data):
            break
        out.append((at, end))
        at = end
    return out


@pytest.fixture(scope="module")
def pages(spark):
    inner = RECORD.format(5, "hello")
    html = [
        None, "", "x", "WARC/1.1", "a\nWARC/1.1\r\nb", inner, "\n" + inner * 3, "\n" + RECORD.format(50_000, "runs past its payload"), BIG, BIG, BIG + "\r\n\r\n" + inner,
        "\n" + RECORD.format(len(inner), inner), "y" * 20_000, "\nWARC/1.0\r\n" + "A: b\r\n" * 3000, "short", "short", "é\u2028\x00\r\n" * 300, "\n" + inner.removesuffix("\r\n\r\n"),
    ]
    rows = [(i, "http://h/\r\nWARC/1.1 x" if i % 2 else None, h, "clash") for i, h in enumerate(html)]
    rows += [(None, "u", BIG, "clash"), (9, "u", BIG, "clash"), (100, "u", None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def expected(rows):
    out, last = [], {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 1000:
            last[body] = max(last.get(body, -1), -1 if r.page_id is None else r.page_id)
    for r in rows:
        body = (r.html or "").encode()
        again = body in last and r.page_id != last[body]
        out.append((r.page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[body] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("each", [None, 5000])
def test_round_trip_with_magic_inside(spark, pages, tmp_path, each):
    folder = f"file://{tmp_path}/a"
    warc.write(pages.repartition(2), folder)
    got = warc.digest(warc.records(spark, folder, each)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages.collect())
    assert all(r.complete for r in warc.coverage(spark, folder, each).collect())


def test_broken_archives(spark, tmp_path):
    whole = RECORD.format(3, "abc") + RECORD.format(0, "") + RECORD.format(4, "\r\n\r\n")
    bad = {
        "whole": whole, "cut": whole[:-3], "junk": whole + "junk" + whole, "late": "junk\r\n\r\n" + whole, "none": "x" * 100,
        "long": whole + RECORD.format(10**17, "x") + whole, "fold": whole.replace("<urn:page:666>\r\n", "<urn:page:666>\r\nX-Note: a\r\n b\r\n"), "size": whole.replace("Content-Length: 0", "Content-Length: zero"),
    }
    (tmp_path / "b").mkdir()
    for name, text in bad.items():
        (tmp_path / "b" / name).write_bytes(text.encode())
    for each in (None, 60):
        got = warc.records(spark, f"file://{tmp_path}/b", each, payloads=False).groupBy("path").agg(F.sort_array(F.collect_list("offset")).alias("o"))
        found = {r.path.rpartition("/")[2]: r.o for r in got.collect()}
        assert found == {k: [a for a, _ in walked(t.encode())] for k, t in bad.items() if walked(t.encode())}
        reach = {r.path.rpartition("/")[2]: (r.read_to, r.complete) for r in warc.coverage(spark, f"file://{tmp_path}/b", each).collect()}
        assert reach == {k: (max((b for _, b in walked(t.encode())), default=0), max((b for _, b in walked(t.encode())), default=0) == len(t)) for k, t in bad.items()}
    payloads = {r.offset: bytes(r.payload) for r in warc.records(spark, f"file://{tmp_path}/b/whole").collect()}
    assert list(payloads.values()) == [b"abc", b"", b"\r\n\r\n"]


def test_empty(spark, pages, tmp_path):
    warc.write(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.records(spark, f"file://{tmp_path}/c").count() == 0


def test_many_ranges_a_file(spark, tmp_path):
    text = "".join(RECORD.format(len(x), x) for x in (f"record {i} " * (i % 7) for i in range(250)))
    (tmp_path / "d").write_bytes(text.encode())
    got = sorted(r.offset for r in warc.records(spark, f"file://{tmp_path}/d", 700).collect())
    assert got == [a for a, _ in walked(text.encode())] and len(got) == 250
