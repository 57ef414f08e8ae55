"""Language-model scoring with stupid backoff.

``model_table`` and ``scores_by_model`` are the relational form, a row for each
n-gram: count tables, joined with themselves on the context to give each
n-gram its factor, joined to the exploded n-grams of any documents, and summed
for each.  It shuffles about forty times the bytes of the texts.
``scores_by_own_grams`` is that form for documents that are their own model: a
row for each bigram and trigram too, but shuffled once, by hash.

``lm_scores`` computes the same aggregate and join for documents that are their
own model, with packed rows: the n-gram counts of the whole corpus lie
partitioned by hash; each block of documents sends its distinct n-grams with
their counts to the partitions, which add them up, and the joined counts come
back to the block, where they are matched to the n-grams of each text by
position and summed for each document.  Every n-gram counts, those that occur
once too.  A trigram with a bigram that occurs once occurs once itself, so only
the others are asked for.

Score of a word: c(u v w) / c(u v) if the trigram is in the model, else 0.4
times c(v w) / c(v) if the bigram is, else 0.4 times again c(w) / N.  At the
start of a text the shorter n-grams are all there is, without a penalty.  A
model of the texts scored holds all their n-grams, so no word of theirs is
backed off; one of other texts may not even hold the word, which then scores
the last penalty times 1 / N.  ``lm_scores`` and ``scores_by_own_grams`` tell
n-grams apart by 64-bit hashes, ``scores_by_model`` by their words.

Defined cases: null and empty texts have no words and score 0 (mean null);
repeated rows count each time and score alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskline.llm import blocks as bl
from maskline.llm import text as tx
from maskline.llm.store import stored

BACKOFF = 0.4
_SALT = [np.uint64(x) for x in (0, 0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)]

SCHEMA = (
    "n_words long, n_trigrams long, n_bigrams long, n_unigrams long, log_score double, mean_log_score double"
)


_WORD = r"([^\x20\x09-\x0D]+)"


def _places(docs: DataFrame, text_col: str, *kept: str) -> DataFrame:
    """A row for each word: ``grams`` that end there, shortest first."""
    found = docs.select(*kept, F.regexp_extract_all(text_col, F.lit(_WORD), F.lit(1)).alias("_w"))
    none = F.lit(None).cast("string")
    # The words beside those one and two places before them; the array itself stays out of the rows.
    zipped = F.arrays_zip(F.col("_w").alias("c"), F.concat(F.array(none), "_w").alias("b"), F.concat(F.array(none, none), "_w").alias("a"))
    rows = found.select(*kept, F.explode(zipped).alias("z")).where("z.c is not null")
    two, three = F.concat("z.b", F.lit(" "), "z.c"), F.concat("z.a", F.lit(" "), "z.b", F.lit(" "), "z.c")
    return rows.select(*kept, F.array_compact(F.array("z.c", two, three)).alias("grams"))


def count_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, n): how often each run of one to three words occurs in the texts."""
    return _places(docs, text_col).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def model_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, factor): each n-gram's count by that of its context, or by all words for one word."""
    counts = stored(count_table(docs, text_col))
    total = counts.where(~F.col("gram").contains(" ")).agg(F.sum("n")).first()[0] or 0
    longer = counts.where(F.col("gram").contains(" ")).withColumn("context", F.regexp_replace("gram", " [^ ]+$", ""))
    with_context = longer.join(counts.select(F.col("gram").alias("context"), F.col("n").alias("base")), "context")
    one = counts.where(~F.col("gram").contains(" ")).select("gram", (F.col("n") / F.lit(max(total, 1))).alias("factor"))
    return stored(with_context.select("gram", (F.col("n") / F.col("base")).alias("factor")).unionByName(one))


def scores_by_model(docs: DataFrame, model: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, words scored by each order, log_score) by a model of ``words`` words, of whatever texts.

    A row that is repeated scores once and is given out as often as it occurs.
    """
    key = [F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_text")]
    rows = docs.select(*key, F.col(text_col).alias("text")).dropDuplicates(["_id", "_text"])
    left = _places(rows, "text", "_id", "_text").select("_id", "_text", F.element_at("grams", -1).alias("gram"))
    left = left.groupBy("_id", "_text", "gram").agg(F.count("*").alias("times")).withColumn("penalty", F.lit(0.0))
    order = F.size(F.split("gram", " "))
    found = []
    for _ in range(3):
        met = left.join(model, "gram", "left")
        found.append(met.where("factor is not null").select("_id", "_text", "times", order.alias("order"), (F.log("factor") + F.col("penalty")).alias("log")))
        left = met.where("factor is null").select("_id", "_text", "times", F.when(F.col("gram").contains(" "), F.regexp_replace("gram", "^[^ ]+ ", "")).alias("gram"), F.when(F.col("gram").isNull(), F.col("penalty")).otherwise(F.col("penalty") + math.log(BACKOFF)).alias("penalty"))
    unseen = left.select("_id", "_text", "times", F.lit(0).alias("order"), (F.col("penalty") - math.log(max(words, 1))).alias("log"))
    scored = reduce(DataFrame.unionByName, [*found, unseen])
    by_order = [F.sum(F.when(F.col("order") == n, F.col("times")).otherwise(0)).alias(name) for n, name in ((3, "n_trigrams"), (2, "n_bigrams"), (1, "n_unigrams"))]
    sums = scored.groupBy("_id", "_text").agg(F.sum("times").alias("n_words"), *by_order, F.sum(F.col("times") * F.col("log")).alias("log_score"))
    every = docs.select(*key).alias("d").join(sums.alias("s"), F.expr("d._id <=> s._id and d._text = s._text"), "left")
    numbers = [F.coalesce(f"s.{x}", F.lit(0)).cast("long").alias(x) for x in ("n_words", "n_trigrams", "n_bigrams", "n_unigrams")]
    return every.select(F.col("d._id").alias(id_col), *numbers, F.coalesce("s.log_score", F.lit(0.0)).alias("log_score"))


def scores_by_own_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, words scored by each order, log_score) of documents by the n-grams of them all, a row for each n-gram.

    Nothing is backed off, so the factors of a text telescope: each trigram's count counts for it, that of each bigram
    between its first and its last against it, and N once.  A text of two words has its bigram's count, one of one
    word that word's.  So each bigram and trigram goes by hash to where it is counted, with the key of its text, and only
    sums come back; those that occur once add nothing.
    """
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_WORD), F.lit(1))
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_key"), words.alias("_w"))
    n = F.size("_w")
    sizes = found.select("_id", "_key", n.cast("long").alias("n_words"), F.when(n == 1, F.get("_w", 0)).otherwise(F.concat(F.lit(" "), F.col("_key").cast("string"))).alias("word"))
    # The words one and two places behind each; the array itself stays out of the rows.
    zipped = F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), n + 1).alias("b"), F.slice("_w", F.lit(3), n + 1).alias("c"))
    places = found.where(n > 1).select("_key", n.alias("n"), F.posexplode(zipped).alias("at", "z")).where("z.b is not null")
    two, three = F.xxhash64(F.lit(2), "z.a", "z.b"), F.xxhash64(F.lit(3), "z.a", "z.b", "z.c")
    weight = F.when(F.col("n") == 2, 1).when((F.col("at") == 0) | (F.col("at") == F.col("n") - 2), 0).otherwise(-1)
    long = F.struct(three.alias("gram"), F.lit(1).alias("weight"))
    each = F.array_compact(F.array(F.struct(two.alias("gram"), weight.alias("weight")), F.when(F.col("z.c").isNotNull(), long)))
    grams = places.select("_key", F.inline(each))
    counted = grams.withColumn("times", F.count("*").over(Window.partitionBy("gram"))).where("times > 1 and weight <> 0")
    sums = counted.groupBy("_key").agg(F.sum(F.col("weight") * F.log("times")).alias("log"))
    # Words that are a whole text's, and what shares one of 1,024 slots with them: none where no text is one word.
    slot = F.pmod(F.xxhash64("word"), F.lit(1024))
    sought = sizes.where("n_words = 1").agg(F.collect_set(slot).alias("slots"))
    met = found.select(F.explode("_w").alias("word")).join(F.broadcast(sought), F.array_contains("slots", slot))
    single = met.groupBy("word").agg(F.count("*").alias("times"))
    total = found.agg(F.greatest(F.sum(n), F.lit(1)).alias("total"))
    # Longer texts join under a word that is none, each its own, so that they don't meet in one task.
    # A repeated row sends its n-grams as often as it occurs, under one key.
    copies = sizes.withColumn("copies", F.count("*").over(Window.partitionBy("_key")))
    rows = copies.join(sums, "_key", "left").join(single, "word", "left").join(F.broadcast(total))
    number = F.col("n_words")
    log = F.coalesce(F.col("log") / F.col("copies"), F.lit(0.0)) + F.coalesce(F.log("times"), F.lit(0.0)) - F.log("total")
    by_order = [F.greatest(number - 2, F.lit(0)).alias("n_trigrams"), (number > 1).cast("long").alias("n_bigrams"), (number > 0).cast("long").alias("n_unigrams")]
    return rows.select(F.col("_id").alias(id_col), number, *by_order, F.when(number > 0, log).otherwise(0.0).alias("log_score"))


def corpus_size(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = words = 0
            for chunk in tx.chunks(batch.column(0)):
                size += len(chunk.data)
                words += len(tx.words(chunk).start)
            yield pa.RecordBatch.from_pydict({"size": [size], "words": [words]})

    got = docs.select(text_col).mapInArrow(run, "size long, words long").agg(F.sum("size"), F.sum("words")).first()
    return got[0] or 0, got[1] or 0


class _Grams:
    """The words of a block with the hashes of the n-grams that end at each."""

    def __init__(self, texts: pa.ChunkedArray):
        doc, place, words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for chunk in tx.chunks(texts):
            found = tx.words(chunk)
            doc.append(found.doc + chunk.low)
            place.append(np.arange(len(found.doc)) - found.first[found.doc])
            words.append(tx.word_hashes(chunk, found))
        self.doc, self.place = np.concatenate(doc), np.concatenate(place)
        self.words = np.concatenate(words)

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, hash) of each n-gram."""
        at = np.flatnonzero(self.place >= n - 1)
        if not len(at):
            return at, np.zeros(0, np.uint64)
        # The table of each order has its own share of the hash space.
        return at, tx.mix(tx.runs(self.words, n)[at - (n - 1)] ^ _SALT[n])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, words scored by each order, log_score, mean_log_score)."""
    size, total = corpus_size(docs, text_col)
    n_blocks = bl.block_count(size)
    n_buckets = bl.power_of_two(n_blocks)
    by_block = bl.in_blocks(docs.select(id_col, text_col), id_col, text_col, n_blocks).groupBy("_block")

    def asked(block: int, order: int, keys: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        keys, times = np.unique(keys, return_counts=True)
        at = bl.cuts(keys, 64, n_buckets)
        out = []
        for k in np.flatnonzero(np.diff(at)):
            own = slice(at[k], at[k + 1])
            body = bl.frames(bl.pack_sorted(keys[own]), bl.pack(times[own].astype(np.uint32)))
            out.append((order * n_buckets + int(k), block, int(at[k + 1] - at[k]), body))
        return out

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sent = []
        for block, n, body in zip(*(table[x].to_pylist() for x in ("_block", "_n", "_body"))):
            keys, times = bl.unframe(body)
            sent.append((block, bl.unpack_sorted(keys, n, np.uint64), bl.unpack(times, n, np.uint32)))
        distinct, inverse = np.unique(np.concatenate([x[1] for x in sent]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([x[2] for x in sent]), len(distinct)).astype(np.uint64)[inverse]
        ends = np.cumsum([0, *(len(x[1]) for x in sent)])
        return bl.rows(
            [(key[0].as_py(), b, len(k), bl.pack(count[i : i + len(k)])) for (b, k, _), i in zip(sent, ends)]
        )

    def counts(order: int, keys: np.ndarray, replies: pa.Table) -> np.ndarray:
        """The corpus count of each key, in the order given."""
        _, inverse = np.unique(keys, return_inverse=True)
        own = sorted(
            (bucket, n, body)
            for bucket, n, body in zip(*(replies[x].to_pylist() for x in ("_bucket", "_n", "_body")))
            if bucket // n_buckets == order
        )
        if not own:
            return np.zeros(0, np.int64)
        return np.concatenate([bl.unpack(body, n, np.uint64) for _, n, body in own]).astype(np.int64)[inverse]

    def short(key: tuple[pa.Scalar, ...], bundles: pa.Table) -> pa.Table:
        grams, block = _Grams(bl.unbundled(bundles)[text_col]), key[0].as_py()
        return bl.rows([x for order in (1, 2) for x in asked(block, order, grams.keys(order)[1])])

    def pairs(grams: _Grams, replies: pa.Table) -> np.ndarray:
        """For each word, the count of the bigram that ends there; 0 where none does."""
        out = np.zeros(len(grams.words), np.int64)
        at, keys = grams.keys(2)
        out[at] = counts(2, keys, replies)
        return out

    def unknown(grams: _Grams, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams whose counts do not follow from their bigrams: neither of these occurs once."""
        at, keys = grams.keys(3)
        both = (bigram[at] > 1) & (bigram[at - 1] > 1)
        return at[both], keys[both]

    def long(key: tuple[pa.Scalar, ...], bundles: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(bundles):
            return bl.rows([])
        grams = _Grams(bl.unbundled(bundles)[text_col])
        return bl.rows(asked(key[0].as_py(), 3, unknown(grams, pairs(grams, replies))[1]))

    def score(key: tuple[pa.Scalar, ...], bundles: pa.Table, replies: pa.Table) -> pa.Table:
        table = bl.unbundled(bundles)
        grams, n = _Grams(table[text_col]), len(table)
        one = counts(1, grams.keys(1)[1], replies).astype(float)
        bigram = pairs(grams, replies)
        at, keys = unknown(grams, bigram)
        trigram = (grams.place >= 2).astype(np.int64)
        trigram[at] = counts(3, keys, replies)
        steps = np.minimum(grams.place, 2)
        order = np.where(trigram > 0, 3, np.where(bigram > 0, 2, 1))
        before = np.concatenate([[1.0], one[:-1]])
        before2 = np.concatenate([[1], bigram[:-1]])
        value = np.select(
            [order == 3, order == 2],
            [trigram / np.maximum(before2, 1), bigram / np.maximum(before, 1)],
            one / max(total, 1),
        )
        logs = np.log(value) + (steps + 1 - order) * np.log(BACKOFF)
        n_words = np.bincount(grams.doc, minlength=n)
        sums = np.bincount(grams.doc, logs, n).astype(float)  # of nothing it counts in whole numbers
        by_order = [pa.array(np.bincount(grams.doc[order == k], minlength=n)) for k in (3, 2, 1)]
        mean = pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0)
        return pa.table([table[id_col], pa.array(n_words), *by_order, pa.array(sums), mean], names=names)

    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]
    kind = docs.schema[id_col].dataType.simpleString()
    first = by_block.applyInArrow(bl.lean(short), bl.ROWS).groupBy("_bucket").applyInArrow(bl.lean(add), bl.ROWS)
    third = by_block.cogroup(first.groupBy("_block")).applyInArrow(bl.lean_pair(long), bl.ROWS)
    third = third.groupBy("_bucket").applyInArrow(bl.lean(add), bl.ROWS)
    replies = first.unionByName(third)
    return by_block.cogroup(replies.groupBy("_block")).applyInArrow(bl.lean_pair(score), f"`{id_col}` {kind}, {SCHEMA}")
