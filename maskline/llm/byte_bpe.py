"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

A pre-token here is a word with the white space before it (or the white space
that ends a text).  The splitting pattern never makes a token of a word and
white space after it, so such a pre-token splits and encodes the same wherever
it stands.  Each block of documents cuts its texts into pre-tokens, keeps their
numbers by position, and asks for its distinct ones; hash buckets encode every
distinct pre-token once for the whole corpus; the ids come back and are put
together by position.  Decoding joins each id with the token-byte table, whose
size is that of the vocabulary file whatever the corpus.

Defined cases: null text is empty and has no ids; repeated rows give repeated
results; special tokens are ordinary text; an id outside the table makes the
decoded value null; an empty table gives an empty result; columns other than
id and text are not carried.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm import blocks as bl
from maskline.llm import text as tx


#: Rows decoded at a time, to bound what a task holds.
DECODE_ROWS = 1_000


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, one pair a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merged(token: bytes, table: dict[bytes, int]) -> list[int]:
    """The ids of one match of the pattern: of all neighbouring parts, the pair of least rank is joined first.

    Pairs wait in a heap, so a token of n bytes takes about n log n steps; of
    equal ranks the leftmost comes first.
    """
    if (whole := table.get(token)) is not None:
        return [whole]
    n = len(token)
    # The part that begins at i ends at end[i] (0: it is joined to the one before, which begins at before[i]).
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [(rank, i, i + 2) for i in range(n - 1) if (rank := table.get(token[i : i + 2])) is not None]
    heapq.heapify(waiting)
    while waiting:
        _, i, stop = heapq.heappop(waiting)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := table.get(token[i : end[stop]])) is not None:
                heapq.heappush(waiting, (rank, i, end[stop]))
        if (left := before[i]) >= 0 and (rank := table.get(token[left:stop])) is not None:
            heapq.heappush(waiting, (rank, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(table[token[i : end[i]]])
        i = end[i]
    return ids


def encoded(text: str, table: dict[bytes, int], pattern: str) -> list[int]:
    """The ids of a text: each match of the pattern by itself."""
    return [x for match in regex.findall(pattern, text) for x in merged(match.encode(), table)]


@lru_cache(maxsize=4)
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: bytes of all tokens, where each begins, its length (-1: no token)."""
    table = ranks(path)
    size = max(table.values()) + 1
    each = [b""] * size
    length = np.full(size, -1, np.int64)
    for token, rank in table.items():
        each[rank], length[rank] = token, len(token)
    begin = np.concatenate([[0], np.cumsum(np.maximum(length, 0))])[:-1]
    return np.frombuffer(b"".join(each), np.uint8), begin, length


def _blank(data: np.ndarray) -> np.ndarray:
    """Mask of the bytes of white space characters, all of Unicode's."""
    out = ((data >= 0x09) & (data <= 0x0D)) | (data == 0x20)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        three |= (a == 0xE2) & (b == 0x80) & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        for k in (0, 1):
            out[lead[two] + k] = True
        for k in (0, 1, 2):
            out[lead[three] + k] = True
    return out


def _gathered(values: np.ndarray, begin: np.ndarray, length: np.ndarray, take: np.ndarray):
    """values[begin:begin+length] for each of take, one after the other, and where each ends."""
    n = length[take]
    stop = np.cumsum(n, dtype=np.int64)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((begin[take] - (stop - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return values[at], stop


class _Pieces:
    """Distinct pieces of a block by hash, and each document's piece numbers by position."""

    def __init__(self, texts: pa.ChunkedArray):
        each = {x: [np.zeros(0, kind)] for x, kind in zip(("key", "check", "start", "end", "doc"), ("u8", "u8", *["i4"] * 3))}
        data, base = [np.zeros(0, np.uint8)], 0
        for chunk in tx.chunks(texts):
            blank = _blank(chunk.data)
            closes = ~blank
            closes[:-1] &= blank[1:]
            bounds = chunk.bounds
            closes[bounds[1:][bounds[1:] > 0] - 1] = True
            end = np.flatnonzero(closes) + 1
            start = np.concatenate([[0], end[:-1]])[: len(end)]
            each["key"].append(tx.LANES[0].hashes(chunk.data, start, end))
            each["check"].append(tx.LANES[1].hashes(chunk.data, start, end))
            each["start"].append((start + base).astype(np.int32))
            each["end"].append((end + base).astype(np.int32))
            each["doc"].append(np.diff(np.searchsorted(end, bounds, "right")).astype(np.int32))
            data.append(chunk.data)
            base += len(chunk.data)
        got = {x: np.concatenate(each.pop(x)) for x in list(each)}
        data = np.concatenate(data)
        self.per_doc = got["doc"]
        order, new = tx.grouped(got["key"], got["check"])
        self.numbers = np.empty(len(order), np.int32)
        self.numbers[order] = np.cumsum(new, dtype=np.int32) - 1
        one = order[new]
        del order, new
        self.keys, self.length = got["key"][one], (got["end"] - got["start"])[one]
        self.bytes, self.stop = _gathered(data, got["start"][one], self.length, np.arange(len(one)))


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>): the token ids of each text."""
    n_blocks = bl.block_count(bl.text_bytes(docs, text_col))
    n_buckets = bl.power_of_two(n_blocks)
    by_block = bl.in_blocks(docs.select(id_col, text_col), id_col, text_col, n_blocks).groupBy("_block")

    def ask(key: tuple[pa.Scalar, ...], bundles: pa.Table) -> pa.Table:
        pieces = _Pieces(bl.unbundled(bundles)[text_col])
        at = bl.cuts(pieces.keys, 64, n_buckets)
        stop = np.concatenate([[0], pieces.stop])
        out = []
        for k in np.flatnonzero(np.diff(at)):
            i, j = at[k], at[k + 1]
            body = bl.frames(
                bl.pack(pieces.length[i:j].astype(np.uint32)), bl.pack(pieces.bytes[stop[i] : stop[j]])
            )
            out.append((int(k), key[0].as_py(), int(j - i), body))
        return bl.rows(out)

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        known: dict[bytes, list[int]] = {}
        table_of_ranks, out = ranks(path), []
        for block, n, body in zip(*(table[x].to_pylist() for x in ("_block", "_n", "_body"))):
            length, raw = bl.unframe(body)
            stop = np.cumsum(bl.unpack(length, n, np.uint32), dtype=np.int64)
            raw = bl.unpack(raw, int(stop[-1]), np.uint8).tobytes()
            ids: list[list[int]] = []
            for i, j in zip([0, *stop[:-1].tolist()], stop.tolist()):
                piece = raw[i:j]
                if (got := known.get(piece)) is None:
                    got = known[piece] = encoded(piece.decode(), table_of_ranks, pattern)
                ids.append(got)
            count = np.fromiter(map(len, ids), np.uint32, n)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32)
            out.append((key[0].as_py(), block, n, bl.frames(bl.pack(count), bl.pack(flat))))
        return bl.rows(out)

    def assemble(key: tuple[pa.Scalar, ...], bundles: pa.Table, replies: pa.Table) -> pa.Table:
        table = bl.unbundled(bundles)
        pieces = _Pieces(table[text_col])
        counts, ids = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for _, n, body in sorted(zip(*(replies[x].to_pylist() for x in ("_bucket", "_n", "_body")))):
            count, body = bl.unframe(body)
            counts.append(bl.unpack(count, n, np.uint32))
            ids.append(bl.unpack(body, int(counts[-1].sum()), np.uint32))
        count, ids = np.concatenate(counts).astype(np.int64), np.concatenate(ids).astype(np.int32)
        all_ids, stop = _gathered(ids, np.cumsum(count) - count, count, pieces.numbers)
        per_doc = np.concatenate([[0], np.cumsum(pieces.per_doc)])
        offsets = np.concatenate([[0], stop])[per_doc]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(all_ids, pa.int32()))
        return pa.table({id_col: table[id_col], "ids": lists.cast(pa.list_(pa.int32()))})

    replies = by_block.applyInArrow(bl.lean(ask), bl.ROWS).groupBy("_bucket").applyInArrow(bl.lean(answer), bl.ROWS)
    kind = docs.schema[id_col].dataType.simpleString()
    return by_block.cogroup(replies.groupBy("_block")).applyInArrow(bl.lean_pair(assemble), f"`{id_col}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes of each row's ids, joined from the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin, length = _bytes_of(path)
        for whole in batches:
            for low in range(0, whole.num_rows, DECODE_ROWS):
                yield decoded(whole.slice(low, DECODE_ROWS), data, begin, length)

    def decoded(batch: pa.RecordBatch, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        lists = batch.column(1)
        ids = lists.flatten().fill_null(-1).to_numpy()
        sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy().astype(np.int64)
        bound = np.concatenate([[0], np.cumsum(sizes)])
        known = (ids >= 0) & (ids < len(length))
        known[known] = length[ids[known]] >= 0
        missing = tx.sums(~known, bound) > 0
        out = []
        for i, (a, b) in enumerate(zip(bound[:-1], bound[1:])):
            if missing[i] or not lists[i].is_valid:
                out.append(None)
            else:
                out.append(_gathered(data, begin, length, ids[a:b])[0].tobytes())
        names = [id_col, ids_col, "decoded"]
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], names)

    kind = tokens.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded binary"
    return tokens.select(id_col, ids_col).mapInArrow(bl.lean_batches(run), schema)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
