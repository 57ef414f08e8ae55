import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from maskline.llm import spelling
from maskline.llm import text as tx

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    out.pop("", None)
    return out


def brute(words):
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), group in holes.items():
        for w in group:
            near[w] |= group - {w}
        if a + b in words:
            for w in group:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def documents(seed):
    draw = random.Random(seed)
    base = ["".join(draw.choices("abcdeéß", k=draw.randint(3, 12))) for _ in range(120)] + ["x" * 60, "y" * 200, "straße", "Ünïcode"]
    rows = []
    for i in range(150):
        out = []
        for _ in range(60):
            w = draw.choice(base)
            if draw.random() < 0.3:
                k = draw.randrange(len(w))
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + draw.choice("abé") + w[k:], w[:k] + draw.choice("abé") + w[k + 1 :]])
            out.append(draw.choice([w, w.upper(), w.title()]))
        rows.append((i, draw.choice([" ", ", ", "中", "Ā", "1", "× "]).join(out)))
    return rows + [(None, "null id here here"), (3, None), (4, ""), (5, "a " * 3000), (5, "a " * 3000), (6, "ab×cd÷ef ¿ÀŸ \U0001f600zzzzz")]


def test_counts(spark):
    rows = documents(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == counted(rows)
    chunk = next(tx.chunks(pa.array(["é" * 100_000 + " " + "b" * 70])))
    batch = spelling._counted(chunk, ["7"], 97)
    assert dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) == counted([(7, "é" * 100_000 + " " + "b" * 70)])


@pytest.mark.parametrize("limits", [{}, {"HOT": 3, "SHORT": 2, "BUCKET": 100, "PAIRS": 64}, {"HOT": 0, "SHORT": 0}])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    rows = documents(len(limits))
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    words = {w: n for w, n in counted(rows).items() if len(w) >= 5 and n >= 3}
    want = brute(words)
    assert sum(r[4] for r in want) > 300 and any(r[2] != r[1] for r in want if r[1])
    assert found(spelling.variants(docs)) == want


def test_repetitive_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHORT", 0)
    monkeypatch.setattr(spelling, "HOT", 2)
    words = {w: len(w) for w in ["aaaaa", "aaaaaa", "aaaaab", "ababab", "babab", "bababa", "ababa", "abcabcabc", "abcabc", "abcabcab", "bcabcabc", "aabaab", "abaab"]}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r.n_near for r in spelling.near_words(rows).collect()}
    assert got == {w: sum(spelling.edit_one(w, x) for x in words) for w in words if any(spelling.edit_one(w, x) for x in words)}


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
