"""Near-duplicate classes by ProbMinHash, banding and verification.

Shingles of five words are weighted by how often they occur.  Every shingle
starts a Poisson process whose rate is its weight; arrivals hit random
registers, and a process ends early once its next arrival comes after the
latest register of its document.  Two signatures agree in a register with the
probability Jaccard similarity of the documents.  36 bands of 7 registers find
a pair of similarity 0.8 with probability 0.9998.

Texts with equal words are one class first, and one document of it goes on.
In each bucket of a band, documents are compared with two centres: one drawn
(out of four over all bands, so that a failed comparison is tried against
others) and the one that shares most buckets with others; exact probability
Jaccard decides.  Documents of a bucket that are then still in different
components are compared too: in buckets of up to 64 documents as pairs, in
larger ones those outside the bucket's main component against all of that
component and each other, in blocks of up to 64 texts or BLOCK_BYTES inside a
task.  So no pair
that shares a band is left undecided unless its documents are in one class
already, and no group lists its pairs.

Defined cases: null and empty texts have no shingles, and each is a class of
its own; texts of one to four words have one shingle, the whole text; rows
with equal words share a class, and so do repeated rows; a null id is a class
of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.llm import blocks as bl
from maskline.llm import text as tx
from maskline.llm.components import components
from maskline.llm.store import stored

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 36, 7
CENTRES = 4
LARGE = 64
#: A block of texts compared at once ends after so many bytes (or its one longer text).
BLOCK_BYTES = 256 << 10
#: Hashed parts of a large component.
PARTS = 16
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(chunk: tx.Chunk, found: tx.Words, hashes: np.ndarray, size: int = SHINGLE):
    """(document, shingle hash, weight) of each distinct shingle, by document."""
    at, key = tx.windows(found, hashes, size)
    doc = found.doc[at]
    n_words = np.diff(found.first)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        begin = found.first[short]
        whole = hashes[begin].copy()
        for i in range(1, size - 1):
            more = n_words[short] > i
            whole[more] = tx.mix(whole[more] * _GOLD + hashes[begin[more] + i])
        doc, key = np.concatenate([doc, short]), np.concatenate([key, whole])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], key[begin], np.diff(np.append(begin, len(key)))


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash registers, n_docs x m shingle hashes; 0 where a document has no shingle."""
    first = np.full(n_docs * m, np.inf)
    owner = np.zeros(n_docs * m, _U)
    now = np.zeros(len(key))
    step = 0
    live = np.arange(len(key))
    while len(live):
        elements = len(live) / max(1, len(np.unique(doc[live])))
        many = int(np.clip(2 * m / elements, 1, 64))
        numbers = np.arange(step, step + many, dtype=_U) * _GOLD
        random = tx.mix(key[live][:, None] + numbers[None, :])
        gap = -np.log(((random >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / weight[live][:, None]
        time = now[live][:, None] + np.cumsum(gap, axis=1)
        at = (doc[live] * m)[:, None] + (tx.mix(random) % _U(m)).astype(np.int64)
        at, flat = at.ravel(), time.ravel()
        np.minimum.at(first, at, flat)
        won = first[at] == flat
        owner[at[won]] = np.repeat(key[live], many)[won]
        now[live] = time[:, -1]
        step += many
        last = first.reshape(n_docs, m).max(axis=1)
        live = live[now[live] < last[doc[live]]]
    return owner.reshape(n_docs, m)


def _bands(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    parts = signature.reshape(n, BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _GOLD, (n, BANDS)).copy()
    for i in range(ROWS):
        out = tx.mix(out * _U(0xD6E8FEB86659FD93) + parts[:, :, i])
    return out


def _content(found: tx.Words, hashes: np.ndarray) -> np.ndarray:
    """Hash of each document's sequence of words."""
    place = np.arange(len(hashes)) - found.first[found.doc]
    total = np.concatenate([np.zeros(1, _U), np.cumsum(tx.mix(hashes + tx.mix(place.astype(_U) * _GOLD)))])
    return tx.mix(total[found.first[1:]] - total[found.first[:-1]])


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, one, two, bands): both hashes of the words, and the band values (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1), tx.CHUNK_BYTES // 4):
                found = tx.words(chunk)
                hashes = tx.word_hashes(chunk, found)
                n = chunk.high - chunk.low
                sets = shingles(chunk, found, hashes)
                values = _bands(signatures(*sets, n, BANDS * ROWS)).view(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), BANDS)
                empty = np.diff(found.first) == 0
                lists = lists.cast(pa.list_(pa.int64())).take(pa.array(np.arange(n), mask=empty))
                one, two = _content(found, hashes), _content(found, tx.word_hashes(chunk, found, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.low, n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists],
                    ["doc", "one", "two", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(bl.lean_batches(run), f"doc {kind}, one long, two long, bands array<long>")


def probability_jaccard(doc, key, weight, side, n: int) -> np.ndarray:
    """Exact similarity of n pairs from the weighted shingles of both sides (0, 1)."""
    order = np.lexsort((side, key, doc))
    doc, key, weight, side = doc[order], key[order], weight[order].astype(float), side[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    group = np.cumsum(new) - 1
    pair = doc[new]
    a, b = (np.bincount(group, np.where(side == s, weight, 0), len(pair)) for s in (0, 1))
    ratio = np.divide(a, b, out=np.full(len(a), np.inf), where=b > 0)
    order = np.lexsort((ratio, pair))
    pair, a, b, ratio = pair[order], a[order], b[order], ratio[order]
    # A shingle i of both counts 1 / sum_j max(a_j / a_i, b_j / b_i); the ratio says which term is larger.
    edge = np.searchsorted(pair, np.arange(n + 1))
    up = np.concatenate([[0], np.cumsum(a)])
    down = np.concatenate([[0], np.cumsum(b)])
    place = np.arange(len(pair))
    high = up[edge[pair + 1]] - up[place + 1]
    low = down[place + 1] - down[edge[pair]]
    shared = (a > 0) & (b > 0)
    score = 1 / (high[shared] / a[shared] + low[shared] / b[shared])
    return np.bincount(pair[shared], score, n)


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        body = pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), body, pa.array(list(map(len, raw)), pa.int64())], ["doc", "body", "size"]
        )


def _expanded(bodies: pa.Array, sizes: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", 1)
    raw = [codec.decompress(b, n, asbytes=True) for b, n in zip(bodies.to_pylist(), sizes.to_pylist())]
    return pa.array(raw, pa.binary()).cast(pa.string())


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of each row's two texts, for a few megabytes of rows at a time."""
    for batch in batches:
        size = pc.add(batch.column(4), batch.column(5)).to_numpy()
        step = np.cumsum(size) // (4 * tx.CHUNK_BYTES)
        cut = np.concatenate([np.flatnonzero(np.diff(step, prepend=-1)), [batch.num_rows]])
        for low, high in zip(cut[:-1], cut[1:]):
            rows = batch.slice(low, high - low)
            parts = []
            for side in (0, 1):
                for chunk in tx.chunks(_expanded(rows.column(2 + side), rows.column(4 + side))):
                    found = tx.words(chunk)
                    doc, key, weight = shingles(chunk, found, tx.word_hashes(chunk, found))
                    parts.append((doc + chunk.low, key, weight, np.full(len(doc), side)))
            similar = probability_jaccard(*(np.concatenate(x) for x in zip(*parts)), rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(similar)], ["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose texts (doc, body, size: compressed) are at least so similar."""
    kind = pairs.schema["a"].dataType.simpleString()
    left = texts.toDF("a", "body_a", "size_a")
    right = texts.toDF("b", "body_b", "size_b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "body_a", "body_b", "size_a", "size_b")
    return both.mapInArrow(bl.lean_batches(_similarity), f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= similar)


def _block_links(similar: float, columns: list[str]):
    """Links between the documents of two blocks, at most one for each document and component."""

    def weights(rows: list[dict]):
        texts = _expanded(pa.array([x["body"] for x in rows]), pa.array([x["size"] for x in rows]))
        found = [(c, tx.words(c)) for c in tx.chunks(texts)]
        sets = [(c.low, *shingles(c, w, tx.word_hashes(c, w))) for c, w in found]
        return tuple(np.concatenate(x) for x in zip(*((doc + low, key, weight) for low, doc, key, weight in sets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["x"], row["y"]
                (d1, k1, w1), (d2, k2, w2) = weights(left), weights(right)
                keys, place = np.unique(np.concatenate([k1, k2]), return_inverse=True)
                both = []
                for doc, at, weight, n in ((d1, place[: len(k1)], w1, len(left)), (d2, place[len(k1) :], w2, len(right))):
                    share = np.zeros((n, len(keys)), np.float32)
                    share[doc, at] = weight / np.bincount(doc, weight, n)[doc]
                    both.append(share)
                # With shares a and b of the two weights on common shingles, the similarity is at
                # most 1 / (1 / a + 1 / b - 1), and just that where all shingles weigh the same.
                a, b = both[0] @ (both[1] > 0).T, (both[0] > 0).astype(np.float32) @ both[1].T
                possible = a * b >= (similar - 1e-4) * (a + b - a * b)
                done, out = set(), []
                for i, j in zip(*np.nonzero(possible)):
                    p, q = left[i], right[j]
                    if p["component"] == q["component"] or (i, q["component"]) in done:
                        continue
                    m1, m2 = d1 == i, d2 == j
                    one = probability_jaccard(
                        np.zeros(m1.sum() + m2.sum(), np.int64), np.concatenate([k1[m1], k2[m2]]),
                        np.concatenate([w1[m1], w2[m2]]), np.repeat([0, 1], [m1.sum(), m2.sum()]), 1,
                    )[0]
                    if one >= similar:
                        done.add((i, q["component"]))
                        out.append((min(p["rep"], q["rep"]), max(p["rep"], q["rep"]), float(one)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], columns)

    return run


def _outside(large: DataFrame, named: DataFrame, texts: DataFrame, similar: float, kind: str) -> DataFrame:
    """Links of documents that share large buckets (key, rep, component) with another component."""
    size = large.groupBy("key", "component").agg(F.count("*").alias("members"))
    main = size.groupBy("key").agg(F.max_by("component", F.struct("members", "component")).alias("main"))
    outside = large.join(main, "key").where("component <> main").select("main", "rep", "component").distinct()
    inside = named.select(F.col("component").alias("main"), F.col("node").alias("rep"), "component")
    single = outside.select("main", F.col("main").alias("rep"), F.col("main").alias("component"))
    every = inside.join(outside.select("main").distinct(), "main", "left_semi").unionByName(single).unionByName(outside)
    body = texts.withColumnRenamed("doc", "rep")
    sizes = body.select("rep", "size")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        # Hashed parts of a component first, so that numbering it is not one task's work.
        rows = rows.distinct().withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(PARTS)))
        order = Window.partitionBy("main", "part").orderBy("rep")
        before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        block = F.concat_ws("-", "part", F.floor((F.row_number().over(order) - 1) / LARGE), F.floor(before / BLOCK_BYTES))
        return (
            rows.join(sizes, "rep").withColumn("block", block).drop("size").join(body, "rep")
            .groupBy("main", "block").agg(F.collect_list(F.struct("rep", "component", "body", "size")).alias(name))
            .select("main", name)
        )

    both = blocks(outside, "x").join(blocks(every, "y"), "main").select("x", "y")
    return both.mapInArrow(bl.lean_batches(_block_links(similar, ["a", "b", "similarity"])), f"a {kind}, b {kind}, similarity double")


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR
) -> DataFrame:
    """(id, class_id): the least id of each document's class."""
    kind = docs.schema[id_col].dataType.simpleString()
    marks = stored(signed(docs, id_col, text_col))
    lone = F.col("doc").isNull() | F.col("bands").isNull()
    classes = stored(
        marks.where(~lone).groupBy("one", "two").agg(F.min("doc").alias("rep"), F.first("bands").alias("bands"))
    )
    buckets = classes.select(F.explode("bands").alias("key"), "rep")
    # One centre for each bucket, drawn the same way in a quarter of all buckets.
    draw = F.xxhash64("rep", F.pmod("key", F.lit(CENTRES)))
    drawn = buckets.groupBy("key").agg(F.min_by("rep", F.struct(draw, "rep")).alias("centre"), F.count("*").alias("n"))
    shared = stored(buckets.join(drawn.where("n > 1"), "key"))
    reach = shared.groupBy("rep").agg(F.sum("n").alias("reach"))
    middle = shared.join(reach, "rep").groupBy("key").agg(F.max_by("rep", F.struct("reach", "rep")).alias("middle"))
    tried = shared.select("rep", "centre").unionByName(shared.join(middle, "key").select("rep", F.col("middle").alias("centre")))
    pairs = stored(tried.where("rep <> centre").select(*_pair("rep", "centre")).distinct())
    needed = shared.select(F.col("rep").alias("doc")).distinct()
    packed = docs.select(id_col, text_col).mapInArrow(bl.lean_batches(_compressed), f"doc {kind}, body binary, size long")
    texts = stored(packed.join(needed, "doc"))
    links = stored(verified(pairs, texts, similar))
    named = components(links)

    member = shared.join(named, shared.rep == named.node, "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    open_keys = member.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_ = stored(member.join(open_keys.select("key"), "key"))
    more_links = stored(_outside(open_.where(F.col("n") > LARGE), named, texts, similar, kind))
    rest = open_.where(F.col("n") <= LARGE).select("key", "rep", "component")
    left = rest.select("key", F.col("rep").alias("p"), F.col("component").alias("x"))
    right = rest.select("key", F.col("rep").alias("q"), F.col("component").alias("y"))
    others = left.join(right, "key").where("x < y").select(*_pair("p", "q")).distinct()
    more = stored(verified(others.join(pairs, ["a", "b"], "left_anti"), texts, similar))
    links = links.unionByName(more).unionByName(more_links)
    named = components(links)

    of_rep = classes.join(named, classes.rep == named.node, "left").select(
        "one", "two", F.coalesce("component", "rep").alias("class_id")
    )
    joined = marks.where(~lone).join(of_rep, ["one", "two"]).select("doc", "class_id")
    alone = marks.where(lone).select("doc", F.col("doc").alias("class_id"))
    return joined.unionByName(alone).withColumnRenamed("doc", id_col)
