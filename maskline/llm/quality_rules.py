"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are compared inside each document,
and the characters inside duplicated n-grams and duplicated lines are
measured.  The operator is a map over Arrow batches: no shuffle, no state
between documents, so it scales with the input and a lost task is only rerun.

Defined cases: a null or empty text has no words and fails the base rule;
repeated rows are judged each on its own; an empty table gives an empty
result; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskline.llm import blocks as bl
from maskline.llm import text as tx

#: n-gram length -> largest fraction of word characters inside n-grams that occur twice or more.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.25}
#: Largest fraction of word characters in lines equal to an earlier line.
LINE_LIMIT = 0.30
#: Largest number of symbols (one of #*$%&|<>) for each word.
SYMBOL_LIMIT = 1.0
MIN_WORDS = 10
REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in NGRAM_LIMITS)
    + ", kept boolean"
)


def _lines(chunk: tx.Chunk, found: tx.Words, hashes: np.ndarray, lead: np.ndarray):
    """Duplicate lines of each document and the word characters in them.

    Lines are equal as texts, so the line hash covers every byte between line
    feeds.
    """
    data, bounds = chunk.data, chunk.bounds
    feeds = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([bounds[:-1], feeds + 1]))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1, np.int64)
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 0x0A)
    doc = np.searchsorted(bounds, start, "right") - 1
    has_word = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    key = tx.LANES[1].hashes(data, start, end)
    order = np.lexsort((np.arange(len(key)), key, doc))
    later = np.zeros(len(key), bool)
    later[order[1:]] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    chars = lead[end] - lead[start]
    n = len(bounds) - 1
    return np.bincount(doc[later], minlength=n), np.bincount(doc[later], chars[later], n).astype(np.int64)


def measure(chunk: tx.Chunk) -> dict[str, np.ndarray]:
    """The rule's columns, one value for each document of the chunk."""
    found = tx.words(chunk)
    data, bounds = chunk.data, chunk.bounds
    n_words = np.diff(found.first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[found.start] += 1
    inside[found.end] -= 1
    points = (np.cumsum(inside[:-1]) > 0) & ((data & 0xC0) != 0x80)
    lead = np.concatenate([[0], np.cumsum(points)])
    hashes = tx.word_hashes(chunk, found)
    width = lead[found.end] - lead[found.start]
    out = {"n_words": n_words, "word_chars": lead[bounds[1:]] - lead[bounds[:-1]]}
    out["n_symbols"] = tx.sums(_SYMBOL[data], bounds)
    out["n_dup_lines"], out["dup_line_chars"] = _lines(chunk, found, hashes, lead)
    alive = None
    for n in sorted({5, *NGRAM_LIMITS}):
        at, key = tx.windows(found, hashes, n)
        if alive is not None:  # a repeated n-gram begins with a repeated shorter one
            near = alive[at]
            at, key = at[near], key[near]
        at = at[tx.repeated(key + tx.mix(found.doc[at].astype(np.uint64) + np.uint64(1)))]
        alive = np.zeros(len(hashes) + 1, bool)
        alive[at] = True
        cover = tx.covered(at, n, len(hashes))
        if n == 5:
            out["n_repeat_words"] = tx.sums(cover, found.first)
        inner = np.concatenate([[0], np.cumsum(np.where(cover, width, 0))])
        out[f"dup_{n}gram_chars"] = inner[found.first[1:]] - inner[found.first[:-1]]
    base = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * n_words)
    chars = np.maximum(out["word_chars"], 1)
    bad = (out["dup_line_chars"] > LINE_LIMIT * chars) | (out["n_symbols"] > SYMBOL_LIMIT * n_words)
    for n, most in NGRAM_LIMITS.items():
        bad |= out[f"dup_{n}gram_chars"] > most * chars
    return out | {"base_failed": base, "kept": ~base & ~bad}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with the measures and the verdict ``kept``."""
    names = [id_col, *(x.split()[0] for x in SCHEMA.split(", "))]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in tx.chunks(batch.column(1)):
                got = measure(chunk)
                ids = batch.column(0).slice(chunk.low, chunk.high - chunk.low)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(got[x]) for x in names[1:])], names)

    return docs.select(id_col, text_col).mapInArrow(bl.lean_batches(run), schema)


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that the rules keep; one map, no join."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            keep += [measure(x)["kept"] for x in tx.chunks(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(bl.lean_batches(run), docs.schema)
