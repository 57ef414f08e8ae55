"""records of a batch are read together, not character by character of each."""

import random
import re

from maskline.operators import prefixed

MARK = re.compile(r"\d{4}[A-Z]{2}[A-Z0-9]\d{14}", re.ASCII)
ADDRESS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}", re.ASCII)


def one(text):
    """A record read by itself."""
    digits = lambda x: len(x) == 4 and x.isascii() and x.isdigit()
    values, at, head = [], 4 + int(text[:4]), int(text[:4])
    while head and digits(text[at : at + 4]) and at + 4 + int(text[at : at + 4]) <= len(text):
        n = int(text[at : at + 4])
        values.append(text[at + 4 : at + 4 + n])
        at += 4 + n
    first = (values + [""] * 7)[:7]
    address = next((x for x in (first[5], first[4]) if ADDRESS.fullmatch(x)), "")
    found = {"msg_id": text[4:7], "ts": text[7:21], "mandt": text[21:24], **dict(zip(prefixed.NAMES, first))}
    found |= {"terminal": "" if ADDRESS.fullmatch(first[4]) else first[4], "ip": address, "var_data": first[6]}
    return head > 0 and at == len(text), {k: v for k, v in found.items() if v}


def test_records_are_those_read_one_by_one(spark):
    draw = random.Random(3)
    values = ["", "é", "€uro", "user", "10.0.0.7", "999.1.1.1", "10.0.0.7\n", "😀x", "0020AU120240102030405", "٣٣", "0004", "x" * 300]
    part = lambda v: f"{len(v):04d}{v}"

    def record():
        head = draw.choice(["AU1", "BX9"]) + "20240102030405" + draw.choice(["100", "1", "", "€10"])
        return part(head) + "".join(part(draw.choice(values)) for _ in range(draw.choice([0, 3, 6, 7, 7, 7, 8, 12])))

    def line():
        text = draw.choice(["", "", "ab", "é"]) + "".join(record() for _ in range(draw.randrange(4)))
        return text[: len(text) - draw.randrange(40)] if draw.random() < 0.3 else text

    lines = [line() for _ in range(3000)] + ["", "0000AU120240102030405100", "0020AU120240102030405100²²²²", "0017AU120240102030405" + "0000" * 5000, None, "none"]
    rows = [("s", k, x) for k, x in enumerate(lines)]
    got = prefixed.records(spark.createDataFrame(rows, "sample_id string, line_no long, raw string")).collect()
    want = []
    for k, x in enumerate(lines):
        starts = [m.start() for m in MARK.finditer(x or "")]
        want += [(k, i, *one(x[a:b])) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(x or "")]))]
    assert sorted(((r.line_no, r.item, r.whole, r.fields) for r in got), key=lambda r: r[:2]) == want
    assert any(w for *_, w, _ in want) and not all(w for *_, w, _ in want)
    assert prefixed.records(spark.createDataFrame(rows[:0], "sample_id string, line_no long, raw string")).count() == 0
