"""Quality rules, near-dedup, substring dedup, decontamination, then byte-level BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next one's documents.  The tables of a run stay
in the shared folder under pipeline-<id> until the caller deletes them.

All stages take any columns beside doc_id and text and give them back as they
were, whatever their names; a null text counts as empty; texts are read whole,
of any length; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskline.llm import byte_bpe, decontamination, minhash_dedup, quality_rules, queries, store, substring_dedup


def _shielded(docs: DataFrame) -> DataFrame:
    """The documents with names for their other columns that no operator uses."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_kept_{i}" for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail the rules and go; a null id changes nothing;
    repeated rows are each judged, alike.
    """
    store.small_batches(spark)
    return quality_rules.kept_rows(docs)


def _named(docs: DataFrame) -> DataFrame:
    """The documents with ``_key``, a text in the order of the ids that tells rows of one id and unlike texts apart; null without an id."""
    kind = docs.schema["doc_id"].dataType
    number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    name = number if isinstance(kind, T.IntegralType) else F.concat(F.col("doc_id").cast("string"), F.lit("\x00"))
    return docs.withColumn("_key", F.concat(name, F.sha2(F.coalesce("text", F.lit("")), 256)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates.

    Rows with equal id and text are one document; rows that share an id and not
    their text are documents of their own, and each goes or stays by its own
    class.  Rows without words or without an id are classes of their own and
    stay; a text of fewer than five words is like its equals only; the least id
    settles ties.
    """
    store.small_batches(spark)
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():  # ids name rows, as they should
        classes = minhash_dedup.near_duplicates(docs)
        out = classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id")
        return docs.join(out, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])
    keyed = _named(_shielded(docs))
    classes = minhash_dedup.near_duplicates(keyed.select("_key", "text"), "_key")
    out = classes.where(~F.col("_key").eqNullSafe(F.col("class_id"))).select("_key").distinct()
    kept = keyed.join(out, "_key", "left_anti")
    one = kept.where("_key is not null").dropDuplicates(["_key"]).unionByName(kept.where("_key is null"))
    return one.drop("_key").toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go; documents left without words go too.

    ``n_chars``, where there is such a column, follows the text.  Texts without
    words, or of fewer than fifty, stay as they are; a row with a null id comes
    after all others; rows of one id keep what they share.
    """
    store.small_batches(spark)
    left = substring_dedup.substring_dedup(_shielded(docs), join_all=False)
    left = left.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed, size = F.col("n_removed") > 0, F.char_length("text").cast("long")
    columns = {c: F.col(c if c in ("doc_id", "text") else f"_kept_{i}") for i, c in enumerate(docs.columns)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, size).otherwise(columns["n_chars"])
    return left.select([x.alias(c) for c, x in columns.items()])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts hold no item and stay; so do rows with a null id that
    hold none; null and empty items match nothing; repeated rows are each judged.
    """
    found = decontamination.with_leaks(_shielded(docs), queries.table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).drop("leaks").toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to.

    Null and empty texts have no tokens; repeated rows and null ids are rows of
    the result like others; no other column is carried.
    """
    store.small_batches(spark)
    # Written, so that no task runs the Python workers of both encoding and decoding.
    ids = store.stored(byte_bpe.encode(docs, queries.RANKS, queries.PATTERN))
    return byte_bpe.digest(byte_bpe.decode(ids, queries.RANKS))


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("substring dedup", repeated_passages),
    ("decontamination", decontaminate),
    ("byte-level BPE", tokens),
]

#: SQL cannot run near-dedup or BPE; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    folder = f"{store.shared_folder(spark)}/maskline/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
