"""Token counts kept as delta-maintained rollups.

A change says what a document counted before and what it counts now under one
tokenizer version: nothing before is an insert, nothing now a delete, both a
revision.  A batch of changes becomes signed sums by source, language and
tokenizer version, written aside; the batch is in once a small file under its
id names them, and that file can be put in place once only.  So a replayed or
retried batch, or one that two writers commit at once, counts once.  ``compact``
folds committed batches into one base with the list of their ids; totals are
the base and the batches it doesn't list.  Deltas are additive, so Spark adds
them up before the shuffle and a hot source costs one row a task.

Tokens are counted by byte-level BPE vocabularies (their name is the tokenizer
version) in one map over the texts, or by any count the caller has.

Defined cases: a null source or language is a group of its own; null counts
on both sides change nothing; a null text has no tokens; repeated rows count
each time; an empty batch commits and adds nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.llm import blocks as bl
from maskline.llm.store import get_text, put_once

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Words as the corpus defines them, and words and marks by Unicode class.
WORDS_1 = r"[^\x20\x09-\x0D]+"
WORDS_2 = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def count_of(text, pattern: str):
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class TokenRollup:
    """Committed deltas in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, batch: str) -> str:
        return f"{self.folder}/batches/{quote(batch, safe='')}.id"

    def _names(self, folder: str) -> list[str]:
        top = self._path(f"{self.folder}/{folder}")
        if not self._files.exists(top):
            return []
        return sorted(n for x in self._files.listStatus(top) if (n := x.getPath().getName()).endswith(".id"))

    def committed(self, batch: str) -> bool:
        return self._files.exists(self._path(self._place(batch)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add changes (source, lang, tokenizer, before, after); False if that batch is in already."""
        if self.committed(batch):
            return False
        before, after = F.col("before"), F.col("after")
        deltas = changes.groupBy(*KEYS).agg(
            F.sum(after.isNotNull().cast("long") - before.isNotNull().cast("long")).alias("n_docs"),
            F.sum(F.coalesce(after, F.lit(0)) - F.coalesce(before, F.lit(0))).cast("long").alias("n_tokens"),
        )
        rows = uuid.uuid4().hex
        deltas.write.parquet(f"{self.folder}/deltas/{rows}")
        return put_once(self.spark, self._place(batch), rows)

    def batches(self) -> list[str]:
        """The committed batches, as the names of their files."""
        return self._names("batches")

    def _base(self) -> tuple[int, str | None, set[str]]:
        """The number of the base in force, its folder, and the batches in it."""
        bases = self._names("bases")
        if not bases:
            return 0, None, set()
        rows = get_text(self.spark, f"{self.folder}/bases/{bases[-1]}")
        folded = self.spark.read.text(f"{self.folder}/folded/{rows}").toLocalIterator()
        return len(bases), f"{self.folder}/totals/{rows}", {r.value for r in folded}

    def _sums(self, base: str | None, names: list[str]) -> DataFrame:
        folders = [base] if base else []
        if names:
            ids = self.spark.read.text([f"{self.folder}/batches/{x}" for x in names], wholetext=True)
            folders += [f"{self.folder}/deltas/{r.value}" for r in ids.toLocalIterator()]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        deltas = self.spark.read.schema(SCHEMA).parquet(*folders)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        _, base, folded = self._base()
        return self._sums(base, [x for x in self.batches() if x not in folded])

    def compact(self) -> bool:
        """Fold the committed batches into a new base; False if another writer did so first."""
        number, base, folded = self._base()
        names = self.batches()
        rows = uuid.uuid4().hex
        self._sums(base, [x for x in names if x not in folded]).write.parquet(f"{self.folder}/totals/{rows}")
        self.spark.createDataFrame([(x,) for x in names], "value string").coalesce(1).write.text(f"{self.folder}/folded/{rows}")
        return put_once(self.spark, f"{self.folder}/bases/{number + 1:08d}.id", rows)


@lru_cache(maxsize=4)
def _vocabulary(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_feed(docs: DataFrame, versions: dict[str, str], pattern: str) -> DataFrame:
    """(doc_id, source, lang, content, then for each version its count and that of the revised text).

    ``versions`` names vocabulary files; a revision keeps each different line of
    a text once; ``content`` tells texts apart.  One map over the texts.
    """
    lines = F.array_join(F.array_distinct(F.split(F.col("text"), "\n")), "\n")
    rows = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"), "text", F.when(lines != F.col("text"), lines).alias("lines"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [f"{n}_{x}" for n in versions for x in ("first", "revised")]
    schema = f"doc_id {kind}, source string, lang string, content string, " + ", ".join(f"`{n}` long" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_vocabulary(path, pattern) for path in versions.values()]
        for batch in batches:
            texts, revised = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            columns = []
            for own in found:
                first = [len(own.encode_ordinary(x or "")) for x in texts]
                columns += [first, [n if x is None else len(own.encode_ordinary(x)) for n, x in zip(first, revised)]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(x, pa.int64()) for x in columns)], [*batch.schema.names[:4], *names]
            )

    return rows.mapInArrow(bl.lean_batches(run), schema)


def documents_feed(docs: DataFrame) -> DataFrame:
    """What the change feed needs of each document, in one pass over the texts, without Python.

    The first version counts words, the second words and marks; a revision of
    the first counts each different line once; a document equal to one with a
    smaller id is a copy.
    """
    lines = F.array_join(F.array_distinct(F.split(F.col("text"), "\n")), "\n")
    return docs.select(
        "doc_id",
        "source",
        "lang",
        count_of(F.col("text"), WORDS_1).alias("first"),
        count_of(F.col("text"), WORDS_2).alias("second"),
        count_of(lines, WORDS_1).alias("revised"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("content"),
    )
