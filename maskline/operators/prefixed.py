"""Length-prefixed audit records: several in one line, none of them with a separator.

A record is its header's length in four digits, the header (message id of two
letters and a letter or digit, fourteen digits of time, three of the client), and
values, each behind its length in four digits.  Where the lengths don't add up to
the record's end it is truncated, and is a reject.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions.values import let

#: A record's beginning.
MARK = re.compile(rb"\d{4}[A-Z]{2}[A-Z0-9]\d{14}")
_ADDRESS = r"\A\d{1,3}(?:\.\d{1,3}){3}\z"
NAMES = ["sid", "user", "dialog", "program"]
FIELDS = ["msg_id", "ts", "mandt", *NAMES, "terminal", "ip", "var_data"]
ROWS = "sample_id string, line_no long, item int, whole boolean, fields map<string,string>"


class _Texts:
    """The lines of a batch as one text: ``first`` has the first byte of each character, ``at`` its place in ``data``."""

    def __init__(self, lines: pa.Array):
        lines = pc.fill_null(lines, "").cast(pa.large_string())
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        self.data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[low:high]
        self.lines = offsets - low
        leads = (self.data & 0xC0) != 0x80
        self.at = np.append(np.flatnonzero(leads), len(self.data))
        self.first = self.data[self.at[:-1]]
        self.place = np.append(np.cumsum(leads) - leads, len(self.first))  # of the character that begins at a byte

    def cut(self, start: np.ndarray, length: np.ndarray) -> pa.Array:
        """The texts that begin at these characters."""
        low = self.at[start]
        sizes = self.at[start + length] - low
        ends = np.append(0, np.cumsum(sizes))
        body = self.data[np.repeat(low - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)).cast(pa.string())


def _sizes(texts: _Texts, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The four digits at each place, and whether they and as many characters stand before the end."""
    digits = texts.first[np.minimum(at[:, None] + np.arange(4), len(texts.first) - 1)].astype(np.int64) - 48
    size = digits @ np.array([1000, 100, 10, 1])
    return size, ((digits >= 0) & (digits <= 9)).all(1) & (at + 4 + size <= end)


def _read(texts: _Texts, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Whether each record is whole, and the map of its fields that are filled."""
    n = len(begin)
    head, _ = _sizes(texts, begin, end)
    at, live = begin + 4 + head, head > 0
    starts, lengths = np.zeros((n, 7), np.int64), np.zeros((n, 7), np.int64)
    for k in range(7):
        size, ok = _sizes(texts, at, end)
        live = live & ok
        starts[:, k], lengths[:, k] = np.where(live, at + 4, 0), np.where(live, size, 0)
        at = np.where(live, at + 4 + size, at)
    more = np.flatnonzero(live & (at < end))
    text = texts.first.tobytes() if len(more) else b""
    for k in more:  # values behind the seventh, as many as there are
        place, stop = int(at[k]), int(end[k])
        while place + 4 <= stop and text[place : place + 4].isdigit() and place + 4 + int(text[place : place + 4]) <= stop:
            place += 4 + int(text[place : place + 4])
        at[k] = place
    address = [np.asarray(pc.match_substring_regex(texts.cut(starts[:, k], lengths[:, k]), _ADDRESS).to_numpy(zero_copy_only=False)) for k in (4, 5)]
    ip = np.where(address[1], 5, 4)
    every = np.arange(n)
    start = np.column_stack([begin + 4, begin + 7, begin + 21, starts[:, :5], starts[every, ip], starts[:, 6]])
    length = np.column_stack([
        np.full(n, 3), np.full(n, 14), np.minimum(3, end - begin - 21), lengths[:, :4], np.where(address[0], 0, lengths[:, 4]),
        np.where(address[0] | address[1], lengths[every, ip], 0), lengths[:, 6],
    ])
    filled = length > 0
    keys = pa.array(FIELDS).take(pa.array(np.nonzero(filled)[1]))
    ends = pa.array(np.append(0, np.cumsum(filled.sum(1))), pa.int32())
    return (head > 0) & (at == end), pa.MapArray.from_arrays(ends, keys, texts.cut(start[filled], length[filled]))


def records(lines: DataFrame) -> DataFrame:
    """One row a record (ROWS), truncated ones with ``whole`` false."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _Texts(batch.column(2))
            data, ends = texts.data.tobytes(), texts.lines.tolist()
            found = [[m.start() for m in MARK.finditer(data, a, b)] for a, b in zip(ends, ends[1:])]
            counts = np.array([len(x) for x in found], np.int64)
            row = np.repeat(np.arange(len(found)), counts)
            item = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = texts.place[np.array([x for own in found for x in own], np.int64)]
            end = np.append(begin[1:], 0)
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            end[: len(row)][last] = texts.place[texts.lines[row[last] + 1]]
            for low in range(0, len(row), 10_000):
                own = slice(low, min(low + 10_000, len(row)))
                whole, fields = _read(texts, begin[own], end[own])
                at = pa.array(row[own])
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(item[own], pa.int32()), pa.array(whole), fields]
                yield pa.RecordBatch.from_arrays(columns, ["sample_id", "line_no", "item", "whole", "fields"])

    # Null where no record begins: a filter would make the line, which may be made here, twice.
    raw = let(F.col("raw"), lambda r: F.when(r.rlike(MARK.pattern.decode()), r))
    return lines.select("sample_id", "line_no", raw.alias("raw")).mapInArrow(read, ROWS)


def rendered(msg_id: Column, ts: Column, mandt: Column, *parts: Column) -> Column:
    """A record as ``records`` reads it."""
    size = lambda x: F.lpad(F.length(x).cast("string"), 4, "0")
    head = F.concat(msg_id, ts, mandt)
    return F.concat(size(head), head, *[x for p in parts for x in (size(p), p)])
