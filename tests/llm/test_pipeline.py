"""The pipeline against plain Python, stage by stage and as a whole."""

import collections
import hashlib
import itertools
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from maskline.llm import quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def quality(text):
    """The measures of a text and whether it is kept."""
    words = WORD.findall(text or "")
    chars = sum(map(len, words))
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum((text or "").count(x) for x in "#*$%&|<>")}
    seen, later = set(), []
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in seen:
                later.append(line)
            seen.add(line)
    out |= {"n_dup_lines": len(later), "dup_line_chars": sum(len("".join(WORD.findall(x))) for x in later)}
    good = out["dup_line_chars"] <= 0.3 * max(chars, 1) and out["n_symbols"] <= len(words)
    for n, most in ((5, 0.30), (7, 0.28), (10, 0.25)):
        grams = collections.Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        inside = {p for k in range(len(words) - n + 1) if grams[tuple(words[k : k + n])] > 1 for p in range(k, k + n)}
        out[f"dup_{n}gram_chars"] = sum(len(words[p]) for p in inside)
        good &= out[f"dup_{n}gram_chars"] <= most * max(chars, 1)
        if n == 5:
            out["n_repeat_words"] = len(inside)
    out["base_failed"] = len(words) < 10 or 100 * out["n_repeat_words"] > 20 * len(words)
    return out | {"kept": good and not out["base_failed"]}


def shingles(words):
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else collections.Counter()


def probability_jaccard(a, b):
    both = a.keys() & b.keys()
    share = min(sum(a[x] for x in both) / a.total(), sum(b[x] for x in both) / b.total())
    if share < 0.8:  # it can't be larger than this
        return 0.0
    every = list(a.keys() | b.keys())
    x, y = (np.array([bag[k] for k in every], float) for bag in (a, b))
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero((x > 0) & (y > 0)))


def near(texts):
    """The ids that stay: the least of each class."""
    bags = {d: shingles(WORD.findall(t)) for d, t in texts.items()}
    root = {d: d for d in bags}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(x for x in bags if bags[x]), 2):
        if find(a) != find(b) and probability_jaccard(bags[a], bags[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d for d in bags if find(d) == d}


def without_repeats(texts):
    first, out = {}, {}
    for d in sorted(texts):
        w = WORD.findall(texts[d])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    for d, t in texts.items():
        w = WORD.findall(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for p in range(k, k + 50)}
        left = [x for p, x in enumerate(w) if p not in gone]
        if left or not w:
            out[d] = " ".join(left) if gone else t
    return out


def leaks(text, items):
    """Whether some window of an item's number of words is like it."""
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = WORD.findall(plain(text))
    for item in items:
        own = WORD.findall(plain(item))
        if not own or not words:
            continue
        size = min(5, len(own))
        if len(words) < size:
            continue
        bag = collections.Counter(tuple(own[k : k + size]) for k in range(len(own) - size + 1))
        keys = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        hits = np.concatenate([[0], np.cumsum([k in bag for k in keys])])
        m = min(len(own) - size + 1, len(keys))
        for k in range(len(keys) - m + 1):
            if 2 * (hits[k + m] - hits[k]) >= 0.8 * m:
                window = collections.Counter(keys[k : k + m])
                if (bag & window).total() >= 0.8 * (bag | window).total():
                    return True
    return False


def test_quality_rules_by_hand(spark):
    texts = [r.text for r in queries.table(spark, SF, "documents").collect()]
    texts += [None, "", "\n\n", "# $ % & a b c d e f", "same line of words\n" * 9, "a b c d e f g h i j\n a b c d e f g h i j\n" * 2, "\u00e9 \u4e2d\u6587 x\u00a0y " * 30]
    rows = spark.createDataFrame([(f"d{i}", t, "clash") for i, t in enumerate(texts)], "doc_id string, text string, n_words string")
    got = {r.doc_id: r.asDict() for r in quality_rules.quality_rules(rows).collect()}
    for i, t in enumerate(texts):
        assert got[f"d{i}"] == {"doc_id": f"d{i}", **quality(t)}


def test_pipeline_is_that_of_plain_python(spark):
    docs = queries.table(spark, SF, "documents")
    items = [r.text for r in queries.table(spark, SF, "benchmark").collect()]
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {d: t for d, t in texts.items() if quality(t)["kept"]}
    one = corpus_pipeline.quality(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == set(want) and one.columns == docs.columns
    stay = near(want)
    want = {d: want[d] for d in stay}
    two = corpus_pipeline.near_dedup(spark, one, SF)
    assert {r.doc_id for r in two.collect()} == stay and two.columns == docs.columns
    want = without_repeats(want)
    three = corpus_pipeline.repeated_passages(spark, two, SF)
    assert {r.doc_id: r.text for r in three.collect()} == want and three.columns == docs.columns
    want = {d: t for d, t in want.items() if not leaks(t, items)}
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_stages_keep_other_columns_and_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(1, passage, 5, "a", 1), (1, passage, 5, "a", 1), (2, passage + " more", 7, "b", 2), (None, "no id at all", 3, None, None), (3, None, None, "c", 3), (4, "", 0, "d", 4), (None, passage, 1, "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, leaks string, n_removed int")
    near_ = corpus_pipeline.near_dedup(spark, docs, SF)
    assert near_.columns == docs.columns and near_.schema == docs.schema
    assert sorted((str(r.doc_id), r.n_words) for r in near_.collect()) == [("1", 5), ("3", None), ("4", 0), ("None", 1), ("None", 3)]
    cut = corpus_pipeline.repeated_passages(spark, docs.where("doc_id is not null"), SF)
    assert cut.columns == docs.columns
    assert sorted((r.doc_id, r.n_words, r.leaks, r.n_removed) for r in cut.collect() if r.n_words is not None) == [(1, 5, "a", 1), (1, 5, "a", 1), (2, 7, "b", 2), (4, 0, "d", 4)]
    clean = corpus_pipeline.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(rows) and clean.where("leaks = 'a'").count() == 2
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.tokens(spark, docs, SF).where(F.col("n_tokens") == 0).count() == 2


def test_an_id_of_two_texts_loses_none(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    for kind in ("long", "string"):
        rows = spark.createDataFrame([(3, one), (5, one), (5, two), (5, two), (-7, two + " more"), (None, one)], "doc_id long, text string")
        docs = rows.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
        got = sorted((str(r.doc_id), r.text[:2]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
        assert got == [("-7", "b0"), ("3", "a0"), ("None", "a0")]
    rows = spark.createDataFrame([(3, one), (5, one), (5, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, rows, SF).collect()) == [(3, one), (5, two)]
