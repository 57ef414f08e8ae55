"""Spelling variants: words one edit apart, by a positional q-gram index.

Counts.  Texts are cut into words in numpy, a chunk of whole documents at a time;
each chunk gives its distinct words with their counts, which are summed by Spark.

Pairs.  A word of n code points has n + Q - 1 padded q-grams, and one edit spoils
Q of them at most, so two words one edit apart share max(n, m) - 1 q-grams whose
places differ by one at most.  A word is therefore posted under its Q + 1 rarest
q-grams: of any such pair both words are posted under one they share.  Rarity is
a count in a table of hashed q-grams of fixed size (SLOTS), the only thing that is
broadcast; any order of q-grams that all words keep would do.

Postings of a q-gram meet in one bucket.  In it the postings of the rarest
*further* q-grams are merged, list by list in ascending order, under the limits of
length and position; pairs that share enough q-grams are verified.  A pair is
counted under the first q-gram under which it meets, and only there, so that each
bucket gives sums by word and no pair leaves it.  A q-gram with more than HOT
postings is split: its words are posted under it and a further q-gram of theirs,
by the same bound with one q-gram fewer.

Forms.  A word's form is its near word of the largest count; roots follow forms by
doubling the links in joins, as counts at least double from form to form.

Defined cases: null text has no words; a null id is empty in what is hashed;
repeated rows count again; ties of counts go to the smallest word in code-point
order; an empty table gives no words; further columns are not read.  Words of any
length are compared whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm import text as tx
from maskline.llm.store import stored

Q = 4
SLOTS = 1 << 18
#: Postings of one q-gram that a bucket takes before they are split by a further one.
HOT = 20_000
#: Postings that a bucket has about.
BUCKET = 200_000
#: Lists up to this length are compared as they are, longer ones by a further q-gram.
SHORT = 24
#: Pairs compared at a time.
PAIRS = 1 << 18
_U = np.uint64
_CHUNK = 4 << 20

# ----------------------------------------------------------------- words and counts

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def _runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs of letters in a chunk of UTF-8."""
    inside = _LETTER[data] | (data == _LEAD)
    inside[1:] |= data[:-1] == _LEAD
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    opens[edge] = inside[edge]
    edge = bounds[1:][bounds[1:] > 0] - 1
    closes[edge] = inside[edge]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def _crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each run: a byte of all runs at a time, of long ones alone."""
    length = end - start
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(length, 64), kind="stable")
    left = np.searchsorted(-np.minimum(length, 64)[order], -np.arange(64), "left")
    for k in range(int(min(64, length.max(initial=0)))):
        at = order[: left[k]]
        out[at] = _CRC[(out[at] ^ data[start[at] + k]) & 0xFF] ^ (out[at] >> 8)
    for k in np.flatnonzero(length > 64):
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes()) ^ 0xFFFFFFFF
    return out ^ np.uint32(0xFFFFFFFF)


def _after(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What CRC-32 values of prefixes become when so many zero bytes follow: crc(a + b) = this xor crc(b)."""
    out, left = crc.astype(np.uint32), length.copy()
    while (some := left > 0).any():
        out[some] = _CRC[out[some] & 0xFF] ^ (out[some] >> 8)
        left[some] -= 1
    return out


def _shifted(bases: np.ndarray, doc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``_after`` of each run's document and length, computed once for each pair of both."""
    pair = doc.astype(np.int64) << 32 | length
    pairs, where = np.unique(pair, return_inverse=True)
    long = (pairs & 0xFFFFFFFF) > 64
    out = np.zeros(len(pairs), np.uint32)
    out[~long] = _after(bases[pairs[~long] >> 32], pairs[~long] & 0xFFFFFFFF)
    for k in np.flatnonzero(long):
        zeros = bytes(int(pairs[k] & 0xFFFFFFFF))
        out[k] = zlib.crc32(zeros, int(bases[pairs[k] >> 32])) ^ zlib.crc32(zeros)
    return out[where]


def _gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The runs as an Arrow array of strings."""
    length = end - start
    stop = np.cumsum(length)
    take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - length), length)
    offsets = np.concatenate([[0], stop]).astype(np.int64)
    body = pa.py_buffer(np.ascontiguousarray(data[take]))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), body).cast(pa.string())


def _counted(chunk: tx.Chunk, ids: list[str], every: int) -> pa.RecordBatch:
    """Distinct words of a chunk with their counts, some runs having lost a letter."""
    data = _LOWER[chunk.data]
    start, end, doc = _runs(data, chunk.bounds)
    key = tx.LANES[0].hashes(data, start, end)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    bases = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
    h = _shifted(bases, doc, end - start) ^ _crcs(data, start[first], end[first])[which]
    hit = h % every == 0 if len(h) else np.zeros(0, bool)
    times = np.bincount(which[~hit], minlength=len(first))
    some = times > 0
    words, counts = [_gathered(data, start[first[some]], end[first[some]])], [times[some]]
    odd = []
    for k in np.flatnonzero(hit):
        run = data[start[k] : end[k]].tobytes().decode()
        at = int(h[k]) % len(run)
        odd.append(run[:at] + run[at + 1 :])
    words.append(pa.array([x for x in odd if x], pa.string()))
    counts.append(np.ones(len(words[1]), np.int64))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(words), pa.array(np.concatenate(counts), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97) -> DataFrame:
    """(word, n) over all texts, in which one run in ``every`` has lost a letter."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in tx.chunks(batch.column(1), _CHUNK):
                yield _counted(chunk, ids[chunk.low : chunk.high], every)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------- q-grams


class _Grams:
    """Padded q-grams of words, flat: code, place and word of each, by word and place."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        at = np.concatenate([[0], np.cumsum(self.length + 2 * (Q - 1))])
        padded = np.zeros(at[-1], _U)
        inner = np.arange(len(flat)) + np.repeat(at[:-1] + (Q - 1) - np.concatenate([[0], np.cumsum(self.length)[:-1]]), self.length)
        padded[inner] = flat
        n = self.length + Q - 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.word = np.repeat(np.arange(len(words)), n)
        self.place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n)
        begin = self.place + np.repeat(at[:-1], n)
        code = np.zeros(len(begin), _U)
        for k in range(Q):
            code = tx.mix(code * _U(0x9E3779B97F4A7C15) + padded[begin + k] + _U(1))
        self.code = code

    def rarest(self, times: np.ndarray, n: int, but: np.ndarray | None = None) -> np.ndarray:
        """The n rarest q-grams of each word (places in the flat arrays), without one of them."""
        seen = times[self.code & _U(SLOTS - 1)].astype(np.int64)
        if but is not None:
            seen[but] = np.iinfo(np.int64).max
        order = np.lexsort((self.place, self.code, seen, self.word))
        rank = np.arange(len(order)) - np.repeat(self.first[:-1], np.diff(self.first))
        own = order[rank < n]
        return own if but is None else own[~np.isin(own, but)]


def _vocabulary_map(words: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 20_000):
                yield function(batch.slice(k, 20_000))

    return words.mapInArrow(run, schema)


def _slot_counts(words: DataFrame, codes) -> np.ndarray:
    """How many q-grams that ``codes(words)`` gives fall into each of SLOTS slots."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        times = np.bincount((codes(batch.column("word").to_pylist()) & _U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(times)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(times[some], pa.int64())], ["slot", "n"])

    rows = _vocabulary_map(words.select("word"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def _postings(words: list[str], times: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, word) of all postings: a rare q-gram's code, or that with a further one's where it is hot."""
    grams = _Grams(words)
    own = grams.rarest(times, Q + 1)
    code, word = grams.code[own], grams.word[own]
    split = hot[(code & _U(SLOTS - 1)).astype(np.int64)]
    keys, of = [code[~split]], [word[~split]]
    if split.any():
        # One more than the bound asks for: either word may lose another occurrence of the q-gram.
        few = [words[k] for k in word[split]]
        further = _Grams(few)
        but = further.first[:-1] + grams.place[own[split]]
        at = further.rarest(times, Q + 2, but)
        keys.append(_joined(code[split][further.word[at]], further.code[at]))
        of.append(word[split][further.word[at]])
    pairs = np.unique(np.stack([np.concatenate(keys), np.concatenate(of).astype(_U)]), axis=1)
    return pairs[0], pairs[1].astype(np.int64)


def _joined(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return tx.mix(one * _U(0xD6E8FEB86659FD93) + two)


# --------------------------------------------------------------------- near words


def _spans(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(k, x) for each x of low[k]:high[k], about PAIRS at a time."""
    n = np.maximum(high - low, 0)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        own = n[at:upto]
        which = np.repeat(np.arange(at, upto), own)
        yield which, np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + low[which]
        at = upto


class _Index:
    """The postings of a bucket: lists of words by key, and the words' q-grams."""

    def __init__(self, keys: np.ndarray, of: np.ndarray, words: list[str]):
        order = np.lexsort((of, keys))
        self.keys, self.of, self.words = keys[order], of[order], words
        self.grams = _Grams(words)
        self.length = self.grams.length
        new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])
        self.list = np.cumsum(new) - 1
        self.size = np.bincount(self.list)
        wide = int(min(40, self.length.max(initial=1)))
        self.wide, self.letters = wide, np.zeros((len(words), wide + 1), np.uint32)
        self.codes = np.zeros((len(words), wide + Q + 1), np.uint32)  # from column 1; zero on both sides
        fits = self.length <= wide
        rows = np.repeat(fits, self.length + Q - 1)
        self.codes[self.grams.word[rows], self.grams.place[rows] + 1] = (self.grams.code[rows] >> _U(32)).astype(np.uint32) | 1
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(words)), self.length)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        rows = fits[owner]
        self.letters[owner[rows], place[rows]] = flat[rows]

    def _tokens(self) -> tuple[np.ndarray, ...]:
        """(list, q-gram, place, word) to merge: of short lists each word once, of long ones its rarest q-grams there."""
        short = self.size[self.list] <= SHORT
        none = np.zeros(int(short.sum()), np.int64)
        at = np.flatnonzero(~short)
        word = self.of[at]
        n = self.length[word] + Q - 1
        which = np.repeat(np.arange(len(at)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        code = self.grams.code[self.grams.first[word][which] + place]
        here = _joined(self.keys[at][which], code)
        _, back, times = np.unique(here, return_inverse=True, return_counts=True)
        order = np.lexsort((place, code, times[back], which))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        own = order[rank <= Q]
        return (
            np.concatenate([self.list[short], self.list[at][which[own]]]), np.concatenate([none.astype(_U), code[own]]),
            np.concatenate([none, place[own]]), np.concatenate([self.of[short], word[which[own]]]),
        )

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, one, two): pairs one edit apart that share a list, ``one`` not longer, once a list."""
        lists, code, place, word = self._tokens()
        length = self.length[word]
        order = np.lexsort((word, length, code, lists))
        lists, code, place, word, length = (x[order] for x in (lists, code, place, word, length))
        group = np.cumsum(np.concatenate([[True], (lists[1:] != lists[:-1]) | (code[1:] != code[:-1])])) - 1 if len(word) else lists
        # Postings of a q-gram lie by length: partners are those that follow, up to one letter longer.
        place_of = group * (int(length.max(initial=0)) + 3) + length
        upto = np.searchsorted(place_of, place_of + 1, "right")
        found = []
        for one, two in _spans(np.arange(len(word)) + 1, upto):
            close = (np.abs(place[one] - place[two]) <= 1) & (word[one] != word[two])
            one, two = one[close], two[close]
            same = self._one_edit(word[one], word[two])
            found.append(np.stack([lists[one[same]], word[one[same]], word[two[same]]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        swap = (self.length[pairs[1]] == self.length[pairs[2]]) & (pairs[1] > pairs[2])
        pairs[1:, swap] = pairs[:0:-1, swap]
        return tuple(np.unique(pairs, axis=1))

    def _one_edit(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether two is one edit from one, which is as long or one letter shorter."""
        out = np.zeros(len(one), bool)
        fits = self.length[two] <= self.wide
        for k in np.flatnonzero(~fits):
            out[k] = edit_one(self.words[one[k]], self.words[two[k]])
        at = np.flatnonzero(fits)
        wide = int(self.length[two[at]].max(initial=0))
        a, b = self.codes[one[at]], self.codes[two[at], 1 : wide + Q]
        n = b.shape[1]
        a = np.pad(a, ((0, 0), (0, 2)))
        shared = ((a[:, :n] == b) | (a[:, 1 : n + 1] == b) | (a[:, 2 : n + 2] == b)) & (b != 0)
        enough = shared.sum(axis=1) >= self.length[two[at]] - 1
        at = at[enough]
        a, b = self.letters[one[at], : wide + 1], self.letters[two[at], : wide + 1]
        unlike = a != b
        equal = self.length[one[at]] == self.length[two[at]]
        first = unlike.argmax(axis=1)
        # The longer without its letter there goes on as the shorter does.
        rest = a[:, :-1] != b[:, 1:]
        rest &= np.arange(rest.shape[1]) >= first[:, None]
        out[at] = np.where(equal, unlike.sum(axis=1) == 1, ~rest.any(axis=1))
        return out


def edit_one(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _first_lists(index: _Index, lists: np.ndarray, one: np.ndarray, two: np.ndarray, keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether a pair's list is that of the least key under which both words are posted anywhere."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    at = np.searchsorted(of, np.arange(len(index.words) + 1))
    posted = np.sort(_joined(of.astype(_U), keys))
    key = index.keys[np.searchsorted(index.list, lists)]
    first = np.ones(len(one), bool)
    for which, x in _spans(at[one], at[one + 1]):
        less = keys[x] < key[which]
        which, x = which[less], x[less]
        look = _joined(two[which].astype(_U), keys[x])
        place = np.minimum(np.searchsorted(posted, look), len(posted) - 1)
        first[which[posted[place] == look]] = False
    return first


def near_words(words: DataFrame) -> DataFrame:
    """Words (word, n; all of at least two letters and distinct) that have near ones: (word, n_near, form_n, form) with the best of them."""
    size = words.count()
    times = _slot_counts(words, lambda x: _Grams(x).code)
    rare = lambda x: (g := _Grams(x)).code[g.rarest(times, Q + 1)]
    hot = _slot_counts(words, rare) > HOT
    n_buckets = max(1, -(-size * (Q + 1) // BUCKET))

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, of = _postings(batch.column("word").to_pylist(), times, hot)
        bucket = (tx.mix(keys) % _U(n_buckets)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket), pa.array(keys.view(np.int64)), *(batch.column(c).take(pa.array(of)) for c in ("word", "n"))], ["bucket", "key", "word", "n"]
        )

    def search(table: pa.Table) -> pa.Table:
        coded = table["word"].combine_chunks().dictionary_encode()
        words, of = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        n = np.zeros(len(words), np.int64)
        n[of] = table["n"].to_numpy()
        index = _Index(table["key"].to_numpy().view(_U), of, words)
        lists, one, two = index.near()
        mine = _first_lists(index, lists, one, two, *_postings(words, times, hot))
        one, two = np.concatenate([one[mine], two[mine]]), np.concatenate([two[mine], one[mine]])
        by_rank = np.array(sorted(range(len(words)), key=lambda k: (-n[k], words[k])), np.int64)
        rank = np.empty(len(words), np.int64)
        rank[by_rank] = np.arange(len(words))
        best = np.full(len(words), len(words), np.int64)
        np.minimum.at(best, one, rank[two])
        count = np.bincount(one, minlength=len(words))
        some = np.flatnonzero(count)
        form = by_rank[best[some]]
        take = lambda k: coded.dictionary.take(pa.array(k))
        return pa.table({"word": take(some), "n_near": pa.array(count[some], pa.int64()), "form_n": pa.array(n[form], pa.int64()), "form": take(form)})

    postings = _vocabulary_map(words.select("word", "n"), post, "bucket int, key long, word string, n long")
    parts = postings.groupBy("bucket").applyInArrow(search, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles: the last form that each word leads to."""
    links, left = stored(forms.select("word", F.col("form").alias("root"))), True
    while left:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        left = bool(links.where("moved").limit(1).count())
        links = links.drop("moved")
    return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 5, times: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words of so many letters that occur so often."""
    counted = word_counts(docs, id_col, text_col)
    words = stored(counted.where((F.char_length("word") >= letters) & (F.col("n") >= times)))
    found = stored(words.join(near_words(words), "word", "left"))
    strong = F.col("form_n") >= 2 * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    led = found.join(roots(found.where("form is not null")), "word", "left")
    return led.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
