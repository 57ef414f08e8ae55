"""Substring dedup with a count-min prefilter.

Every block of documents counts the cells of its word windows; the sketches
are merged cell by cell, so a window's smallest cell count never falls below
its true count.  A second pass groups exactly, by two independent 64-bit
hashes, the windows whose estimate is at least two: no repeated window is
lost, and most single ones never travel.  The sketch has a number of cells
in proportion to the corpus and lives in buckets; it is neither broadcast nor
collected.

A word goes if a window covering it also starts in a document with a smaller
id; the windows are those of the input.  Shuffled: the texts once, about one
byte for each window and sketch row, and about 24 bytes for each distinct
window of a block that is estimated repeated.

Ids may be of any type that has an order: those that are no whole numbers are
numbered in their order first, in a sort of the distinct ids.

Defined cases: null text is empty; rows that share an id keep each other's
windows; a null id counts as the largest id; texts shorter than a window stay
whole; an empty table gives an empty result; further columns pass through,
and columns named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskline.llm import blocks as bl
from maskline.llm import text as tx
from maskline.llm.store import stored

WINDOW = 50
DEPTH = 2
_SEEDS = [np.uint64(x) for x in (0x51_7C_C1_B7_27_22_0A_95, 0xA0_76_1D_64_78_BD_64_2F, 0xE7_03_7E_D1_A0_B4_28_DB)]
_LAST = np.iinfo(np.int64).max


class _Windows:
    """The windows of a block: both hashes and the id of each one's document."""

    def __init__(self, texts: pa.ChunkedArray, ids: np.ndarray, size: int, lanes: int):
        found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(lanes)]
        self.doc = [np.zeros(0, np.int64)]
        for chunk in tx.chunks(texts):
            words = tx.words(chunk)
            for lane in range(lanes):
                at, key = tx.windows(words, tx.word_hashes(chunk, words, lane), size)
                found[lane].append(key)
            self.doc.append(ids[chunk.low + words.doc[at]])
        self.keys = []
        while found:
            self.keys.append(np.concatenate(found.pop(0)))
        self.doc = np.concatenate(self.doc)


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return table[id_col].cast(pa.int64()).fill_null(_LAST).to_numpy()


def _cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return tx.mix(keys ^ _SEEDS[row]) >> np.uint64(64 - bits)


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    join_all: bool = True,
) -> DataFrame:
    """The rows with the text left after dedup, ``n_words`` and ``n_removed``.

    Kept words are joined by one space; with ``join_all`` false, texts from
    which nothing goes stay as they are.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        ids = docs.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(id_col)
        numbered = stored(ids.withColumn("_number", F.monotonically_increasing_id()))
        found = substring_dedup(docs.drop("_number").join(numbered, id_col, "left"), "_number", text_col, window, join_all)
        return found.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed")
    size = bl.text_bytes(docs, text_col)
    n_blocks = bl.block_count(size)
    n_buckets = bl.power_of_two(n_blocks)
    # About four cells for each window of the usual six to seven bytes a word.
    bits = max(16, (bl.power_of_two(size // 2)).bit_length() - 1)
    cell_bits = bits - (n_buckets.bit_length() - 1)
    docs = docs.drop("n_words", "n_removed", "_block")
    dealt = bl.in_blocks(docs, id_col, text_col, n_blocks)

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = bl.unbundled(table)
        keys = _Windows(table[text_col], _ids(table, id_col), window, 1).keys[0]
        out = []
        for row in range(DEPTH):
            cells, times = np.unique(_cells(keys, row, bits), return_counts=True)
            at = bl.cuts(cells, bits, n_buckets)
            for k in np.flatnonzero(np.diff(at)):
                own = slice(at[k], at[k + 1])
                inner = (cells[own] & np.uint64((1 << cell_bits) - 1)).astype(np.uint32)
                body = bl.frames(bl.pack_sorted(inner), np.packbits(times[own] > 1).tobytes())
                out.append((row * n_buckets + int(k), key[0].as_py(), len(inner), body))
        return bl.rows(out)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sketch = np.zeros(1 << cell_bits, np.uint8)  # counts up to 2 are enough
        sent = []
        for block, n, body in zip(*(table[x].to_pylist() for x in ("_block", "_n", "_body"))):
            cells, more = bl.unframe(body)
            cells = bl.unpack_sorted(cells, n, np.uint32)
            twice = np.unpackbits(np.frombuffer(more, np.uint8), count=n)
            sketch[cells] = np.minimum(sketch[cells] + 1 + twice, 2)
            sent.append((block, cells))
        return bl.rows([(key[0].as_py(), b, len(c), np.packbits(sketch[c] > 1).tobytes()) for b, c in sent])

    def estimated(found: _Windows, replies: pa.Table) -> np.ndarray:
        """Mask of the windows whose smallest cell count is two or more."""
        by = {
            bucket: np.unpackbits(np.frombuffer(body, np.uint8), count=n)
            for bucket, n, body in zip(*(replies[x].to_pylist() for x in ("_bucket", "_n", "_body")))
            if bucket >= 0
        }
        mask = np.ones(len(found.doc), bool)
        for row in range(DEPTH):
            _, inverse = np.unique(_cells(found.keys[0], row, bits), return_inverse=True)
            bits_of_row = [by[k] for k in range(row * n_buckets, (row + 1) * n_buckets) if k in by]
            if len(mask):
                mask &= np.concatenate(bits_of_row)[inverse].astype(bool)
        return mask

    def keyed(found: _Windows, mask: np.ndarray):
        """Order of the masked windows by both hashes, and where each key begins."""
        one, two = (x[mask] for x in found.keys)
        order, new = tx.grouped(one, two)
        return one[order], two[order], order, new

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(table):
            return bl.rows([])
        table = bl.unbundled(table)
        found = _Windows(table[text_col], _ids(table, id_col), window, 2)
        mask = estimated(found, replies)
        one, two, order, new = keyed(found, mask)
        if not len(one):
            return bl.rows([])
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(found.doc[mask][order], begin)
        one, two = one[begin], two[begin]
        at = bl.cuts(one, 64, n_buckets)
        out = []
        for k in np.flatnonzero(np.diff(at)):
            own = slice(at[k], at[k + 1])
            body = bl.frames(bl.pack_sorted(one[own]), two[own].tobytes(), bl.pack(least[own]))
            out.append((int(k), key[0].as_py(), len(one[own]), body))
        return bl.rows(out)

    def group(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block, n, body = (table[x].to_pylist() for x in ("_block", "_n", "_body"))
        parts = [bl.unframe(x) for x in body]
        one = np.concatenate([bl.unpack_sorted(p[0], k, np.uint64) for p, k in zip(parts, n)])
        two = np.concatenate([np.frombuffer(p[1], np.uint64) for p in parts])
        least = np.concatenate([bl.unpack(p[2], k, np.int64) for p, k in zip(parts, n)])
        order, new = tx.grouped(one, two)
        smallest = np.empty(len(one), np.int64)
        smallest[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        ends = np.cumsum([0, *n])
        # Answers carry buckets below zero, apart from those of the sketch.
        return bl.rows(
            [(-1 - key[0].as_py(), b, k, bl.pack(smallest[i : i + k])) for b, k, i in zip(block, n, ends)]
        )

    types = {f.name: f.dataType for f in docs.schema}
    schema = T.StructType([T.StructField(x, t) for x, t in types.items()])
    schema = schema.add("n_words", T.LongType()).add("n_removed", T.LongType())

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        table = bl.unbundled(table)
        ids = _ids(table, id_col)
        found = _Windows(table[text_col], ids, window, 2)
        mask = estimated(found, replies)
        _, _, order, new = keyed(found, mask)
        answers = sorted(
            (-1 - bucket, n, body)
            for bucket, n, body in zip(*(replies[x].to_pylist() for x in ("_bucket", "_n", "_body")))
            if bucket < 0
        )
        gone = np.zeros(len(found.doc), bool)
        if answers:
            smallest = np.concatenate([bl.unpack(body, n, np.int64) for _, n, body in answers])
            of = np.empty(len(order), np.int64)
            of[order] = smallest[np.cumsum(new) - 1]
            gone[mask] = of < found.doc[mask]
        texts: list[str] = []
        n_words, n_removed = [], []
        seen = 0
        for chunk in tx.chunks(table[text_col]):
            words = tx.words(chunk)
            inside = words.doc[: max(0, len(words.doc) - window + 1)] == words.doc[window - 1 :]
            at = np.flatnonzero(inside)
            drop = tx.covered(at[gone[seen : seen + len(at)]], window, len(words.start))
            seen += len(at)
            removed = tx.sums(drop, words.first)
            n_words.append(np.diff(words.first))
            n_removed.append(removed)
            texts += joined(chunk, words, ~drop, None if join_all else removed)
        out = table.set_column(table.column_names.index(text_col), text_col, pa.array(texts, pa.string()))
        whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        out = out.append_column("n_words", whole(n_words)).append_column("n_removed", whole(n_removed))
        return out.select(schema.names)

    by_block = dealt.groupBy("_block")
    sketch = by_block.applyInArrow(bl.lean(count), bl.ROWS).groupBy("_bucket").applyInArrow(bl.lean(merge), bl.ROWS)
    asked = by_block.cogroup(sketch.groupBy("_block")).applyInArrow(bl.lean_pair(ask), bl.ROWS)
    least = asked.groupBy("_bucket").applyInArrow(bl.lean(group), bl.ROWS)
    return by_block.cogroup(sketch.unionByName(least).groupBy("_block")).applyInArrow(bl.lean_pair(remove), schema)


def joined(chunk: tx.Chunk, words: tx.Words, keep: np.ndarray, removed: np.ndarray | None = None) -> list[str]:
    """Each document's kept words joined by one space; where removed is 0, its text."""
    start, end = words.start[keep], words.end[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[words.first]
    length = end - start + 1
    stop = np.cumsum(length)
    take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)
    data = chunk.data[np.minimum(take, max(0, len(chunk.data) - 1))] if len(take) else np.zeros(0, np.uint8)
    data[stop - 1] = 0x20
    raw, stop = data.tobytes(), np.concatenate([[0], stop])[first]
    out = []
    for i, (a, b) in enumerate(zip(stop[:-1].tolist(), stop[1:].tolist())):
        if removed is not None and not removed[i]:
            out.append(chunk.data[chunk.bounds[i] : chunk.bounds[i + 1]].tobytes().decode())
        else:
            out.append(raw[a : max(a, b - 1)].decode())
    return out


def digest(result: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns that a check compares instead of the texts."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col(text_col), 256).alias("kept_sha256"))
