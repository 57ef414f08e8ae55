"""Benchmark decontamination: SimHash of item-sized windows.

For every benchmark item, windows of the item's number of words are
fingerprinted (64-bit SimHash of five-word shingles).  Fingerprints within
RADIUS bits of an item's share at least one of RADIUS + 1 blocks with it, so
looking up each block finds all of them.  A similar window can have a print
further away, so windows are also looked up by the rarest shingles of each item:
so many of them that a window without any cannot reach the similarity.  The
exact weighted Jaccard similarity of the shingles then decides, so nothing is
lost by the fingerprints.  Only windows that can reach the similarity are looked
up: one whose shingles, counted over all items, are too few for any item of that
length is skipped, which loses nothing either.

The documents are read in one map over Arrow batches without a shuffle.  The
items are a query set: they travel to the tasks in blocks of about ITEM_BLOCK
items or ITEM_BYTES bytes at most, one pass over the documents for each block.
What a task holds follows the block, the chunk of texts and the longest text.

Words are compared in lower case (ASCII) and without ASCII punctuation.
Defined cases: null or empty texts and items match nothing; equal items are
each reported; repeated rows are each reported; items of fewer than five words
have one shingle, the whole item; documents shorter than an item have one
window, the whole text; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskline.llm import text as tx

SHINGLE = 5
SIMILAR = 0.8
#: Eight blocks of eight bits, so that a lookup meets one item in 256; further windows are found by rare shingles.
RADIUS = 7
ITEM_BLOCK = 20_000
ITEM_BYTES = 32 << 20
_U = np.uint64

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[0x41:0x5B] += 0x20
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20


def plain(column) -> Iterator[tuple[tx.Chunk, tx.Words, np.ndarray]]:
    """Chunks with punctuation blanked and ASCII case folded, their words and hashes."""
    for chunk in tx.chunks(column):
        chunk = chunk._replace(data=_PLAIN[chunk.data])
        found = tx.words(chunk)
        yield chunk, found, tx.word_hashes(chunk, found)


def fingerprints(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """SimHash of shingles low:high from running sums of their bits."""
    votes = (sums[high] - sums[low]) * 2 > (high - low)[:, None]
    return np.packbits(votes, axis=1).view(">u8").ravel().astype(_U)


def _bit_sums(keys: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(keys.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


class MultiIndex:
    """Fingerprints by each of their RADIUS + 1 blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:]):
            value = (prints >> _U(a)) & _U((1 << (b - a)) - 1)
            order = np.argsort(value, kind="stable")
            self.blocks.append((_U(a), _U((1 << (b - a)) - 1), value[order], order))

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, stored) pairs within the radius."""
        pairs = set()
        for shift, mask, values, order in self.blocks:
            value = (queries >> shift) & mask
            low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            n = high - low
            q = np.repeat(np.arange(len(queries)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            close = np.bitwise_count(queries[q] ^ self.prints[order[at]]) <= self.radius
            pairs |= set(zip(q[close].tolist(), order[at[close]].tolist()))
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]


class RareShingles:
    """The rarest shingles of each item, one of which any similar window holds."""

    def __init__(self, bags: list[Counter], seen: Counter, similar: float):
        found = []
        for i, bag in enumerate(bags):
            size = sum(bag.values())
            # A similar window shares similar * size shingles at least, so it lacks fewer than this.
            left = size - math.ceil(similar * size - 1e-9) + 1
            for key in sorted(bag, key=lambda x: (seen[x], x)):
                if left <= 0:
                    break
                found.append((key, i))
                left -= bag[key]
        keys = np.array([k for k, _ in found], _U)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items, self.n = keys[order], np.array([i for _, i in found], np.int64)[order], len(bags)

    def near(self, at: np.ndarray, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs with such a shingle, of shingles at these places and ascending windows."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        place, entry = _ranges(low, high)
        pairs = np.unique(at[place] * self.n + self.items[entry])
        at, item = pairs // self.n, pairs % self.n
        which, window = _ranges(np.searchsorted(end, at, "right"), np.searchsorted(begin, at, "right"))
        pairs = np.unique(window * self.n + item[which])
        return pairs // self.n, pairs % self.n


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) for each x of low[k]:high[k]."""
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _within(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """The places below n that any of low[k]:high[k] holds, ascending."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, low, 1)
    np.subtract.at(step, high, 1)
    return np.flatnonzero(np.cumsum(step[:-1]))


class Items:
    """A block of benchmark items, ready for lookups by length."""

    def __init__(self, rows: list[tuple[int, str]], similar: float = SIMILAR):
        self.ids, self.similar = [i for i, _ in rows], similar
        by_length: dict[int, list[int]] = defaultdict(list)
        self.bags: dict[int, Counter] = {}
        prints: dict[int, int] = {}
        for chunk, found, hashes in plain(pa.array([t for _, t in rows], pa.string())):
            for k in range(chunk.high - chunk.low):
                own = hashes[found.first[k] : found.first[k + 1]]
                if not len(own):
                    continue
                keys = tx.runs(own, min(SHINGLE, len(own)))
                i = chunk.low + k
                by_length[len(own)].append(i)
                self.bags[i] = Counter(keys.tolist())
                prints[i] = int(fingerprints(_bit_sums(keys), np.array([0]), np.array([len(keys)]))[0])
        self.lengths = {
            n: (own, MultiIndex(np.array([prints[i] for i in own], _U))) for n, own in sorted(by_length.items())
        }
        # Shingles of each size that occur in items, for the test that skips windows.
        self.known = {}
        for size in {min(SHINGLE, n) for n in self.lengths}:
            keys = [x for n, (own, _) in self.lengths.items() if min(SHINGLE, n) == size for i in own for x in self.bags[i]]
            self.known[size] = np.unique(np.array(keys, _U))
        seen = Counter(x for bag in self.bags.values() for x in bag)
        self.rare = {n: RareShingles([self.bags[i] for i in own], seen, similar) for n, (own, _) in self.lengths.items()}
        self.maps = {}
        for size, keys in self.known.items():
            self.maps[size] = np.zeros(1 << 20, bool)
            self.maps[size][keys >> _U(44)] = True

    def hits(self, keys: np.ndarray, size: int) -> np.ndarray:
        at = np.flatnonzero(self.maps[size][keys >> _U(44)])
        known = self.known[size]
        place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
        return at[known[place] == keys[at]]

    def leaks(self, column) -> list[list[dict]]:
        """For each text: the items found, with the best window of each."""
        out: list[list[dict]] = []
        for chunk, found, hashes in plain(column):
            best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(chunk.high - chunk.low)]
            for size in self.known:
                self._search(best, found, hashes, size)
            for own in best:
                out.append(
                    [
                        {"item_id": self.ids[i], "similarity": s, "first_word": a, "n_words": n}
                        for i, (s, a, n) in sorted(own.items(), key=lambda x: self.ids[x[0]])
                    ]
                )
        return out

    def _search(self, best: list[dict], found: tx.Words, hashes: np.ndarray, size: int) -> None:
        similar = self.similar
        at, keys = tx.windows(found, hashes, size)
        hit = np.zeros(len(keys), np.int64)
        hit[self.hits(keys, size)] = 1
        if not hit.any():
            return
        doc = found.doc[at]
        # Shingles of a document lie together: doc d has low[d]:low[d + 1].
        low = np.searchsorted(doc, np.arange(len(best) + 1))
        total = np.concatenate([[0], np.cumsum(hit)])
        hits = np.flatnonzero(hit)
        for n_words, (own, index) in self.lengths.items():
            if min(SHINGLE, n_words) != size:
                continue
            m = n_words - size + 1
            # A window must hold so many shingles of items to reach the similarity, clipped or not.
            begin = _within(np.maximum(hits - (m - 1), low[doc[hits]]), hits + 1, len(keys))
            d = doc[begin]
            begin = np.minimum(begin, np.maximum(low[d + 1] - m, low[d]))
            begin = np.unique(begin)
            end = np.minimum(begin + m, low[doc[begin] + 1])
            enough = (total[end] - total[begin]) * (1 + similar) >= similar * (m + end - begin) - 1e-9
            begin, end = begin[enough], end[enough]
            if not len(begin):
                continue
            # Running sums over the shingles in use only.
            used = np.zeros(len(keys) + 1, np.int64)
            np.add.at(used, begin, 1)
            np.subtract.at(used, end, 1)
            used = np.cumsum(used[:-1]) > 0
            place = np.concatenate([[0], np.cumsum(used)])
            prints = fingerprints(_bit_sums(keys[used]), place[begin], place[end])
            near = {*zip(*index.near(prints)), *zip(*self.rare[n_words].near(hits, keys[hits], begin, end))}
            for q, i in sorted(near):
                item = own[i]
                a, b = int(begin[q]), int(end[q])
                score = self._similarity(item, keys[a:b])
                d = int(doc[a])
                if score >= similar and score > best[d].get(item, (0.0,))[0]:
                    words = b - a + size - 1
                    best[d][item] = (score, int(at[a] - found.first[d]), words)

    def _similarity(self, item: int, keys: np.ndarray) -> float:
        bag, window = self.bags[item], Counter(keys.tolist())
        both = sum(min(n, window[x]) for x, n in bag.items() if x in window)
        return both / (sum(bag.values()) + len(keys) - both)


LEAK = T.ArrayType(
    T.StructType()
    .add("item_id", T.LongType())
    .add("similarity", T.DoubleType())
    .add("first_word", T.LongType())
    .add("n_words", T.LongType())
)


def with_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", similar: float = SIMILAR, item_block: int = ITEM_BLOCK
) -> DataFrame:
    """The rows with ``leaks``: benchmark items found and where (an input column of that name goes)."""
    docs = docs.drop("leaks")
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(1, -(-size[0] // item_block), -(-(size[1] or 0) // ITEM_BYTES))
    dealt = items.where("text is not null").select(
        "item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block")
    )
    out = docs.withColumn("leaks", F.array().cast(LEAK))
    names = docs.columns
    for k in range(n_blocks):
        rows = [(r.item_id, r.text) for r in dealt.where(F.col("block") == k).orderBy("item_id", "text").collect()]
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            found = Items(shared.value, similar)
            kind = pa.list_(
                pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
            )
            for batch in batches:
                got = found.leaks(batch.column(names.index(text_col)))
                before = batch.column(len(names)).to_pylist() if n_blocks > 1 else []
                if before:
                    got = [sorted(x + y, key=lambda z: z["item_id"]) for x, y in zip(before, got)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got, kind)], [*names, "leaks"])

        out = out.mapInArrow(run, out.schema)
    return out


def leak_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item found in it."""
    found = with_leaks(docs.select(id_col, text_col), items, text_col)
    return found.select(id_col, F.explode("leaks").alias("leak")).select(id_col, "leak.*")
