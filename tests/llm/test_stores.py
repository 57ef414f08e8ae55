import base64
import collections
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

from maskline.llm import sharding, store, token_counts

CHANGES = "source string, lang string, tokenizer string, before long, after long"


def test_a_file_is_put_once(spark, tmp_path):
    path = f"file://{tmp_path}/x y/one"
    assert store.put_once(spark, path, "first") and not store.put_once(spark, path, "second")
    assert store.get_text(spark, path) == "first" and len(list(Path(tmp_path, "x y").glob("[!.]*"))) == 1


def test_rollup_is_idempotent(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    new = spark.createDataFrame([("a", "en", "t", None, 5), ("a", "en", "t", None, 7), (None, "en", "t", None, 1)], CHANGES)
    assert rollup.commit("1/x y", new) and not rollup.commit("1/x y", new)
    change = spark.createDataFrame([("a", "en", "t", 5, 6), ("a", "en", "t", 7, None)], CHANGES)
    want = {("a", 1, 6), (None, 1, 1)}
    rows = lambda: {(r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert rollup.commit("2", change) and rollup.commit("3", change.limit(0)) and rows() == want
    assert rollup.compact() and rows() == want and rollup.compact() and rows() == want
    assert not rollup.commit("2", change) and rollup.commit("4", new.limit(1)) and rows() == {("a", 2, 11), (None, 1, 1)}


def test_two_writers_of_one_batch(spark, tmp_path):
    one, two = (token_counts.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    new = spark.createDataFrame([("a", "en", "t", None, 5)], CHANGES)
    two.committed = lambda batch: False  # as seen just before the other commits
    assert one.commit("1", new) and not two.commit("1", new)
    assert one.totals().first().n_tokens == 5


def test_token_feed_counts_as_the_vocabularies_do(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "one two\none two\nthree é", "x" * 20_000, "a\na"]
    docs = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, one_first string")
    got = {r.doc_id: r for r in token_counts.token_feed(docs, {"one": path}, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        lines = "\n".join(dict.fromkeys((t or "").split("\n")))
        assert (got[i].one_first, got[i].one_revised) == (len(exact.encode_ordinary(t or "")), len(exact.encode_ordinary(lines)))
    assert token_counts.token_feed(docs.limit(0), {"one": path}, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("schema", ["doc_id long, text string", "path string, run long, shard string, _shard string, _run string, _path string, _key int"])
def test_sharding_keeps_rows(spark, tmp_path, schema):
    rows = [(i, None) if schema.startswith("doc_id") else (f"p{i}", i % 3, None, "s", "r", "", i) for i in [*range(40), 0, 0]]
    docs = spark.createDataFrame(rows, schema)
    shards = sharding.ShardStore(spark, f"file://{tmp_path}/s t+%41", docs.schema)
    name = sharding.free_name("shard", docs.columns)
    assert shards.read().count() == 0 and shards.compact() == 0
    for _ in range(3):
        shards.append(docs.repartition(4))
    assert shards.append(docs.limit(0)) == 4
    assert shards.compact() == 5 and shards.manifest().count() < shards.manifest(3).count()
    count = lambda df: collections.Counter(map(tuple, df.drop(name).collect()))
    assert count(shards.read()) == count(shards.read(3)) == count(docs.unionAll(docs).unionAll(docs))
    assert shards.vacuum() > 0 and count(shards.read()) == count(docs.unionAll(docs).unionAll(docs))
    with pytest.raises(RuntimeError):
        shards._commit(5, shards.manifest())


def test_each_run_is_one_file(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id", "sha2(cast(id as string), 512) as text")
    shards = sharding.ShardStore(spark, f"file://{tmp_path}/s", docs.schema, target=60_000)
    shards.append(docs.repartition(24))
    runs = shards.plan().where("run is not null").select("run").distinct().count()
    shards.compact()
    assert runs > 2 and shards.manifest().where("level = 1").count() == runs
    assert shards.read().distinct().count() == 4000
