import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from maskline.llm import (
    byte_bpe, decontamination, html_extraction, language_id, lm_scoring, minhash_dedup, quality_rules, substring_dedup,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [None, "", "one", "a b c d e f g h i j k", LONG, LONG, LONG.replace("w7 ", "x7 "), f"start {PASSAGE} end", f"other {PASSAGE} tail", "a  b\n\nc 　é ", " ".join(["rep eat"] * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(TEXTS)] + [(None, "null id here", None, None, "clash"), (3, TEXTS[3], "en", "s", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality(docs, empty):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        assert (got[i].n_words, got[i].n_repeat_words, got[i].word_chars) == (len(w), len(repeat), sum(map(len, w)))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
    assert got[4].kept and not got[10].kept
    assert quality_rules.quality_rules(empty).count() == 0 and quality_rules.kept_rows(empty).count() == 0


def test_substring(docs, empty):
    rows = docs.where("doc_id is not null")
    got = {r.doc_id: r for r in substring_dedup.digest(substring_dedup.substring_dedup(rows)).collect()}
    words = {i: WORD.findall(t or "") for i, t in enumerate(TEXTS)}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert got[5].n_removed == 3000 and got[8].n_removed == 60
    assert substring_dedup.substring_dedup(docs).count() == docs.count()
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_bpe_round_trip(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert len(got) == docs.count()
    texts = dict(enumerate(TEXTS)) | {None: "null id here"}
    for r in got:
        assert r.ids == exact.encode_ordinary(texts[r.doc_id] or "") and bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    assert byte_bpe.decode(byte_bpe.encode(empty, path, public_tokenizers.PATTERN), path).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, [60_000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(odd, path).collect()} == {1: None, 2: None, 3: bytearray()}


def test_merges_are_those_of_the_library():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = byte_bpe.ranks(path)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    draw = random.Random(6)
    texts = ["", " ", "a" * 50_000, "ab" * 9_000, "don't  stop\n\n now", "\u0000\U0010ffff", "<|endoftext|>", "12345678 9"]
    texts += ["".join(draw.choices("aeinrst \n'.,0189-\u00e9\u4e2d\u0645\U0001f600", k=draw.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        assert byte_bpe.encoded(text, table, public_tokenizers.PATTERN) == exact.encode_ordinary(text), text[:50]


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got[4] == got[5] == got[6] == 4
    assert got[7] == got[8] == 7  # 56 of 60 shingles in common
    assert all(got[i] == i for i in (0, 1, 2, 3, 9, 10)) and got[None] is None
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch):
    draw = random.Random(9)
    texts = []
    for group in range(40):
        base = [f"g{group}w{draw.randrange(60)}" for _ in range(draw.choice([3, 8, 40, 120]))]
        for _ in range(draw.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 6])):
                copy[draw.randrange(len(copy))] = f"new{draw.randrange(10**6)}"
            texts.append(draw.choice([" ", "\n"]).join(copy))
    chain = [f"c{x}" for x in range(300)]
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 90, 3)] + [texts[0]]
    bags = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in map(str.split, texts)]

    def similarity(a, b):
        return sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a | b) for i in a.keys() & b.keys())

    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in itertools.combinations(range(len(texts)), 2):
        if find(i) != find(j) and similarity(bags[i], bags[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(rows).collect()} == want
    # The same when every bucket counts as large and a block holds a text or two.
    monkeypatch.setattr(minhash_dedup, "LARGE", 1)
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 1000)
    assert {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(rows).collect()} == want


def test_probability_jaccard_is_exact():
    import numpy as np

    a, b = {1: 3, 2: 1, 5: 2}, {1: 1, 2: 1, 7: 4}
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a | b) for i in a.keys() & b.keys())
    keys, weights, side = [*a, *b], [*a.values(), *b.values()], [0] * 3 + [1] * 3
    got = minhash_dedup.probability_jaccard(np.zeros(6, int), np.array(keys), np.array(weights), np.array(side), 1)
    assert abs(got[0] - want) < 1e-12


def test_decontamination(spark, docs, empty):
    item = " ".join(f"q{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "x y"), (5, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"lead {item.upper()}, end"), (2, item.replace(" q29", "")), (3, "clean text of no item"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leak_pairs(rows, items).collect()}
    assert got == {(1, 1), (1, 5), (2, 1), (2, 5)}
    small = decontamination.with_leaks(rows, items, item_block=1).where("doc_id = 1").first().leaks
    assert [x.item_id for x in small] == [1, 5]
    assert decontamination.leak_pairs(empty, items).count() == 0 and decontamination.leak_pairs(docs, items.limit(0)).count() == 0


def test_decontamination_of_a_long_item(spark):
    item = " ".join(f"l{i % 7000}" for i in range(9_000))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = spark.createDataFrame([(1, f"{LONG} {item} {LONG}"), (2, LONG), (1, item)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leak_pairs(rows, items).collect()] == [(1, 7), (1, 7)]


def test_decontamination_finds_all_similar_windows(spark):
    draw = random.Random(3)
    items, rows = [], []
    for i, (n, k) in enumerate([(104, 7), (54, 1), (104, 6), (79, 3), (54, 2)] * 130):
        item = [f"v{draw.randrange(400)}" for _ in range(n)]
        at = draw.randrange(4, n - 4 - k)
        copy = ["lead"] * 3 + item[:at] + [f"new{i}x{x}" for x in range(k)] + item[at + k :] + ["tail"] * 3
        items.append((i, item))
        rows.append((i, copy))

    def bag(w):
        return collections.Counter(tuple(w[x : x + 5]) for x in range(len(w) - 4))

    def best(item, text):
        a, out = bag(item), 0.0
        for x in range(len(text) - len(item) + 1):
            b = bag(text[x : x + len(item)])
            out = max(out, (a & b).total() / (a | b).total())
        return out

    want = {i: best(item, text) for (i, item), (_, text) in zip(items, rows)}
    want = {i: x for i, x in want.items() if x >= 0.8}
    assert len(want) > 500 and min(want.values()) < 0.805
    frame = lambda x, name: spark.createDataFrame([(i, " ".join(w)) for i, w in x], f"{name} long, text string")
    got = decontamination.leak_pairs(frame(rows, "doc_id"), frame(items, "item_id")).collect()
    assert {r.doc_id: round(r.similarity, 9) for r in got if r.doc_id == r.item_id} == {i: round(x, 9) for i, x in want.items()}
    assert all(r.doc_id == r.item_id for r in got)


def test_lm_scores(docs, empty):
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    assert got[0].n_words == 0 and got[0].mean_log_score is None and got[4].n_trigrams > 2000
    assert abs(got[4].log_score - got[5].log_score) < 1e-9 and lm_scoring.lm_scores(empty).count() == 0


def test_lm_scores_are_stupid_backoff(spark, docs):
    texts = [r.text or "" for r in docs.collect()] + ["a b c d x", "b c d e b c d", "u v", "v u v w", "only once here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = {i: WORD.findall(t) for i, t in enumerate(texts)}
    count = collections.Counter(tuple(w[k : k + n]) for w in words.values() for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, words.values()))

    def score(gram):
        if len(gram) == 1:
            return count[gram] / total
        return count[gram] / count[gram[:-1]] if count[gram] else 0.4 * score(gram[1:])

    for r in lm_scoring.lm_scores(rows).collect():
        w = words[r.doc_id]
        want = sum(math.log(score(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert abs(r.log_score - want) < 1e-6, r.doc_id
        assert (r.n_words, r.n_trigrams, r.n_bigrams, r.n_unigrams) == (len(w), max(len(w) - 2, 0), int(len(w) > 1), int(len(w) > 0))


def test_html():
    model = html_extraction.trained()
    wrong = 0
    for plain, marked in html_extraction.labelled_pages(150, seed=5):
        want = " ".join(x[1:] for x in re.sub(r"<[^>]+>", " ", marked).split() if x.startswith("¤"))
        wrong += html_extraction.main_text(plain, model) != want
    assert wrong <= 3
    page = "<nav><a href=/>x</a></nav><article><h1>T &amp; U</h1><p>One  two<br>three<p>Four &am</article><footer>f</footer>"
    assert html_extraction.main_text(page, model) == "T & U One two three Four &am"
    assert html_extraction.main_text(None, model) == ""


def test_lm_scores_by_rows_back_off(spark, docs, empty):
    model_texts = ["a b c d", "b c e", None, "x y"]
    texts = ["a b c e q", "c d", "zz", "", None, "x y a b c d", "x y a b c d"]
    count = collections.Counter(tuple(w[k : k + n]) for w in ((t or "").split() for t in model_texts) for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = 9

    def score(gram):
        if not count[gram]:
            return 0.4 * (score(gram[1:]) if len(gram) > 1 else 1 / total)
        return count[gram] / (count[gram[:-1]] if len(gram) > 1 else total)

    frame = lambda x: spark.createDataFrame([(min(i, 5), t, "clash") for i, t in enumerate(x)], "doc_id long, text string, n_words string")
    got = lm_scoring.scores_by_model(frame(texts), lm_scoring.model_table(frame(model_texts)), total).collect()
    assert len(got) == len(texts)
    for r in got:
        w = (texts[r.doc_id] or "").split()
        want = sum(math.log(score(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert r.n_words == len(w) and abs(r.log_score - want) < 1e-9, r
    packed = {(r.doc_id, r.n_words, r.n_trigrams, r.n_bigrams, round(r.log_score, 6)) for r in lm_scoring.lm_scores(docs).collect()}
    words = lm_scoring.corpus_size(docs, "text")[1]
    rows = lm_scoring.scores_by_model(docs, lm_scoring.model_table(docs), words).collect()
    assert {(r.doc_id, r.n_words, r.n_trigrams, r.n_bigrams, round(r.log_score, 6)) for r in rows} == packed
    assert lm_scoring.scores_by_model(empty, lm_scoring.model_table(empty), 0).count() == 0


def test_lm_scores_by_own_grams(spark, docs, empty):
    """each n-gram crosses one shuffle and only sums come back; the scores are those by the model's rows."""
    texts = ["a b c a b c a", "a b c", "a b", "a", "zz", "", None, "x y a b", "x y a b"]
    odd = spark.createDataFrame([(None if i == 2 else min(i, 7), t) for i, t in enumerate(texts)], "doc_id long, text string")
    rounded = lambda x: sorted(((*r[:5], round(r.log_score, 6)) for r in x.collect()), key=str)
    for frame in (odd, docs.select("doc_id", "text"), empty.select("doc_id", "text")):
        total = lm_scoring.corpus_size(frame, "text")[1]
        assert rounded(lm_scoring.scores_by_own_grams(frame)) == rounded(lm_scoring.scores_by_model(frame, lm_scoring.model_table(frame), total))
    plan = lm_scoring.scores_by_own_grams(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(gram") == 1 and "Window" in plan


# Pages written by hand, apart from the training pages, with the text that a reader would call the article.
SENTENCE = "The council met on Monday and agreed to mend the bridge before winter, as the engineer had asked. "
BY_HAND = [
    (None, ""),
    ("", ""),
    ("<p>", ""),
    (f"<html><body><h1>Bridge</h1><p>{SENTENCE * 3}</p><p>{SENTENCE * 2}</p></body></html>", f"Bridge {SENTENCE * 3}{SENTENCE * 2}".strip()),
    (f"<datalist id=d><option value=a><option value=b></datalist><article><h2>Two</h2><p>{SENTENCE * 4}</article>", f"Two {SENTENCE * 4}".strip()),
    (f"<article><p>Watch <video src=x> this clip. {SENTENCE * 3}</p><p>{SENTENCE}</p></article>", f"Watch this clip. {SENTENCE * 4}".strip()),
    (f"<article><p>Let <math><mi>x</mi></math> be so. {SENTENCE * 3}</p></article>", f"Let x be so. {SENTENCE * 3}".strip()),
    (f"<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><main><article><h1>Caf&eacute; &amp; bar</h1><p>{SENTENCE}<p>{SENTENCE}<ul><li>one<li>two</ul><script>if (a < b) {{}}</script></article></main><footer>Legal</footer>", f"Café & bar {SENTENCE}{SENTENCE}one two"),
    (f"<body><div class='post-body'><p>{SENTENCE * 2}</p><select><option>a<option>b</select><form><input><button>Send</button> us a word</form><p>{SENTENCE}</p></div><section id=comments><p>First! {SENTENCE}</p></section></body>", f"{SENTENCE * 3}".strip()),
    (f"<body><div class=cookie-banner><p>We use cookies.</p></div><table class=nav><tr><td><a href=/x>x</a></table><article><table><tr><td>Year<td>Sum<tr><td>1990<td>12</table><p>{SENTENCE * 2}</p></article><aside><p>{SENTENCE}</p></aside>", f"Year Sum 1990 12 {SENTENCE * 2}".strip()),
    (f"<article><p>{SENTENCE}<a <a <a", f"{SENTENCE}<a <a <a"),
]


def test_html_pages_written_by_hand(spark):
    rows = [(i, f"http://h/{i}", h, "clash") for i, (h, _) in enumerate(BY_HAND)]
    pages = spark.createDataFrame([*rows, rows[3], (None, None, BY_HAND[3][0], None)], "page_id long, url string, html string, text string")
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(BY_HAND) + 2
    for r in got:
        want = BY_HAND[3 if r.page_id is None else r.page_id][1]
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_html_holders_of_many_kinds():
    model = html_extraction.trained()
    line = "A long enough paragraph of the article about rivers and bridges, with several words."
    menu = "<nav><ul><li><a href=/>Home</a><li><a href=/b>Bridge</a></ul></nav>"
    foot = "<footer>Copyright us</footer>"
    pages = {
        f"{menu}<div class='elementor-widget-container'><h1>Title</h1><p>{line}</p><p>{line}</p></div>{foot}": f"Title {line} {line}",
        f"<div>{line}<br><br>{line}</div><div>{line}</div>": f"{line} {line} {line}",
        f"{menu}<div>{line}<br><br>{line}</div><div>{line}</div>{foot}": f"{line} {line} {line}",
        f"<header><a href=/>Site</a></header><article><header class='entry-header'><h1>Title</h1></header><p>{line}</p></article>{foot}": f"Title {line}",
        f"<body class='page has-sidebar'><div class='content with-sidebar'><p>{line}</p></div><div class=sidebar><p>Side</p></div></body>": line,
        f"{menu}<div class=widget><h3>Links</h3><ul><li><a href=/1>One</a></ul></div><article><p>{line}</p></article>": line,
        f"{menu}{foot}": "",
        f"{menu}<section class=comments><h2>Comments</h2><div class=comment><p>{line}</p></div></section>{foot}": "",
        f"{menu}<div class=cookie-notice><p>{line}</p></div>{foot}": "",
        "<form><p>Sign in</p><input></form>": "",
    }
    for page, want in pages.items():
        assert html_extraction.main_text(f"<html>{page if '<body' in page else f'<body>{page}</body>'}</html>", model) == want, page
    wrong = {}
    for shape in ("header", "builder"):
        found = html_extraction.labelled_pages(100, seed=11, bare=1e-9, shapes=(shape,))
        wrong[shape] = 0
        for plain, marked in found:
            want = " ".join(x[1:] for x in re.sub(r"<[^>]+>", " ", marked).split() if x.startswith("¤"))
            wrong[shape] += html_extraction.main_text(plain, model) != want
    assert wrong["header"] <= 25 and wrong["builder"] <= 50, wrong


def test_html_time_follows_the_length():
    model = html_extraction.trained()
    for page in ("<a " * 300_000, "<div>" * 30_000 + "</p>" * 100_000, "<video>" * 50_000, "<!-- " * 100_000, "<p class='" * 100_000):
        began = time.time()
        html_extraction.main_text(page, model)
        assert time.time() - began < 20


def test_language_is_the_product_of_its_evidence(spark):
    draw = random.Random(4)
    stock = {"en": "the and of river bridge", "de": "und der die fluss bruecke", "fr": "et le la pont riviere"}
    langs = sorted(stock)
    text = lambda lang, n: " ".join(draw.choices(stock[lang].split(), k=n))
    labelled = spark.createDataFrame([(i, text(langs[i % 3], 30), langs[i % 3]) for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.train(labelled)
    hosts = ["www.a.example.de", "b.example.de", "example.de", "x.fr", "y.fr", "local", "WWW.c.co.uk"]
    rows = []
    for i in range(80):
        lang = draw.choice(langs)
        mark = draw.choice(["", f" lang={draw.choice(langs)}", ' LANG="de-AT"', " lang=xx"])
        body = draw.choice([text(lang, 6), text(lang, 1), "", "<script>the the the</script>" + text(lang, 4)])
        rows.append((i, draw.choice([f"http://u@{draw.choice(hosts)}:80/p", f"https://{draw.choice(hosts)}", None]), f"<html{mark}><p>{body}</p></html>"))
    rows += [(100, None, None), rows[0]]
    got = language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), model, "page_id", "html", url_col="url", markup=True).collect()

    def mixed(a, b, c):
        x = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        return (x ^ x >> 15) % language_id.BUCKETS

    facts = []
    for i, url, page in rows:
        data = re.sub(rb"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", b" ", (page or "").encode()).lower()
        score = [sum(model[1][k][mixed(*data[x : x + 3])] for x in range(len(data) - 2)) * language_id.TEXT_WEIGHT for k in range(3)]
        top = [math.exp(x - max(score)) for x in score]
        host = re.sub(r":\d+$", "", (url or "").split("://")[-1].split("@")[-1].split("/")[0]).lower()
        declared = re.search(r"(?i)<html lang=\W?([a-z]{2})", page or "")
        declared = declared[1] if declared and declared[1] in langs else None
        labels = host.split(".")
        keys = {"host": host, "domain": ".".join(labels[-2:]) if len(labels) > 2 else None, "suffix": labels[-1] if len(labels) > 1 else None}
        facts.append((i, score, [x / sum(top) for x in top], declared, keys))
    whole = [1 + sum(f[2][k] for f in facts) for k in range(3)]
    said = [f for f in facts if f[3]]
    trust = (sum(f[2][langs.index(f[3])] for f in said) + 1) / (len(said) + 2)
    want = collections.Counter()
    for i, score, alone, declared, keys in facts:
        prior = [x / sum(whole) for x in whole]
        for level in ("suffix", "domain", "host"):
            if keys[level] is not None:
                same = [f for f in facts if f[4][level] == keys[level]]
                prior = [(sum(f[2][k] for f in same) - alone[k] + 8 * prior[k]) / (len(same) - 1 + 8) for k in range(3)]
        product = [score[k] + math.log(prior[k] + 1e-12) + (math.log(trust if langs[k] == declared else (1 - trust) / 2) if declared else 0) for k in range(3)]
        best = max(product)
        want[i, keys["host"], declared, langs[product.index(best)], round(1 / sum(math.exp(x - best) for x in product), 9)] += 1
    assert collections.Counter((r.page_id, r.host, r.declared_lang, r.lang, round(r.posterior, 9)) for r in got) == want


def test_language(spark, docs, empty):
    rows = spark.createDataFrame([(i, f"the and of {i} " * 9, "en") for i in range(9)] + [(20 + i, f"und der die {i} " * 9, "de") for i in range(9)], "doc_id long, text string, lang string")
    model = language_id.train(rows)
    got = language_id.identify(rows, model, "doc_id", "text").join(rows.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert got.where("lang <> truth").count() == 0
    assert language_id.identify(docs, model, "doc_id", "text", host_col="source").count() == docs.count()
    assert language_id.identify(empty, model, "doc_id", "text").count() == 0


def test_markup_is_taken_off_in_linear_time():
    plain = re.compile(rb"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    draw = random.Random(2)
    parts = [b"<script>", b"</script>", b"<style x>", b"</STYLE >", b"<p>", b"<", b">", b"a", b" b ", b"<a href='x'>", b"</script", b"<scripty>"]
    for _ in range(3000):
        page = b"".join(draw.choices(parts, k=draw.randrange(12)))
        assert language_id.without_markup(page) == plain.sub(b" ", page), page
    began = time.time()
    for page in (b"<script>" * 200_000, b"<a " * 500_000, b"<style>" * 100_000 + b"<script></script>" * 100_000):
        language_id.without_markup(page)
    assert time.time() - began < 20


@pytest.mark.parametrize("kind", ["string", "decimal(10,2)", "int"])
def test_substring_ids_of_any_type(spark, kind):
    draw = random.Random(4)
    shared = [f"s{i}" for i in range(70)]
    rows = [(i, " ".join([f"d{i}w{k}" for k in range(draw.randrange(30))] + (shared if i % 3 else []) + [f"e{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "n int, text string").select(F.col("n").cast(kind).alias("doc_id"), "text", F.col("n").alias("n_words"))
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    first = min((r.doc_id for r in docs.collect() if " s0 " in f" {r.text} "))
    assert got == {r.doc_id: 70 if " s0 " in f" {r.text} " and r.doc_id != first else 0 for r in docs.collect()}
