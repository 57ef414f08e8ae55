import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from maskline.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, n_convs string"


def sequences(rows):
    convs = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            convs[c].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = []
    for node in members:
        below = [x for x in members if x[: len(node)] == node]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        leaves = sum(not children[x] for x in below)
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, sha))
    return sorted(out, key=str)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def conversations(seed, n, width, longest):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        start = draw.choice([[], ["hot"], ["hot", "hotter"]])
        turns = start + [f"t{draw.randrange(width)}" * draw.randrange(3) for _ in range(draw.randrange(longest))]
        rows += [(c * draw.choice([1, 1, 7]), k, draw.choice(["user", None]) if k > 3 else "user", t or None, "clash") for k, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("part", [2, 25, 10**6])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, part):
    monkeypatch.setattr(prefix_trie, "PART_TURNS", part)
    monkeypatch.setattr(prefix_trie, "RUN", 8)
    rows = conversations(part, 150, 3, 7)
    rows += [(5000 + k, j, "user", x, None) for k in range(40) for j, x in enumerate(["hot", "hotter", "é\U0001f600", "d"])]
    rows += [(9000, k, "user", f"long {k}", None) for k in range(60)] + [(9001, k, "user", f"long {k}", None) for k in range(45)]
    rows += [(7777, None, "user", "first", None), (7777, 3, None, None, None), (None, 1, "user", "nobody", None), (-5, 0, "user", "hot", None)]
    draw = spark.createDataFrame(rows, COLUMNS).repartition(3)
    turns = prefix_trie.sequences(draw)
    convs = {r.conv_id: len(r.turns) for r in turns.collect()}
    want = sequences(rows)
    assert convs == {c: len(t) for c, t in want.items()}
    # Turns that share their number are ordered by digests; take the order found.
    assert found(prefix_trie.trie(prefix_trie.shared_starts(turns))) == brute(rebuilt(ordered(want, rows)))


def ordered(convs, rows):
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    out = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            out[c].append((-1 if turn is None else turn, digest(role or "", text or "")[:32], role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in out.items()}


def test_plain_tries(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PART_TURNS", 1)
    for texts in ([[]], [["a"]], [[], ["a"], ["a"], ["a", "b"]], [["a", "b", "c"], ["a", "b", "d"], ["x"]], [["a"] * 30, ["a"] * 20, ["a"] * 20 + ["b"]]):
        convs = {i: [("", t) for t in x] for i, x in enumerate(texts)}
        data = [(i, [(hashlib.sha256(t.encode()).hexdigest()[:32], len(t)) for _, t in x]) for i, x in convs.items()]
        rows = spark.createDataFrame(data, "conv_id long, turns array<struct<digest string, size int>>")
        assert found(prefix_trie.trie(rows)) == brute(convs)


def test_empty(spark):
    rows = spark.createDataFrame([], COLUMNS)
    assert prefix_trie.trie(prefix_trie.shared_starts(prefix_trie.sequences(rows))).count() == 0
