"""Language ID by Bayesian evidence fusion.

The likelihood of a text comes from byte trigrams, trained on a sample of
labelled documents of bounded size.  Language posteriors from text alone are
added up by host, registered domain, address suffix and overall; the prior of
a host is smoothed towards that of its domain, its domain's towards its
suffix's, and that towards the overall one, each leaving out the page in
question.  A host of one label has no suffix, and one of two is its own
domain; a level that says nothing of its own is passed over.  The declared markup language is a further witness, as reliable as
its agreement with the texts shows.  The posterior is the normalised product.

The texts are read once in a map over Arrow batches; what is grouped are a few
numbers for each row, partially added before the shuffle.  Domains and suffixes
are sums over hosts and are joined to hosts; rows meet their host in one join,
whose hot keys adaptive execution splits.

Defined cases: null or empty text leaves the prior and the declaration; null
address or host shares the prior of the rows without one; an undeclared or unknown markup
language says nothing; ties go to the language first in order; repeated rows
count each time; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskline.llm import text as tx
from maskline.llm.store import stored

BUCKETS = 1 << 15
#: About so many labelled documents of each language train the text model.
SAMPLE = 2_000
#: Trigrams overlap and repeat, so their evidence counts for less than if independent.
TEXT_WEIGHT = 0.1
#: Rows' worth of trust in the level above.
SMOOTHING = 8.0
LEVELS = ["host", "domain", "suffix"]

_OPENS = re.compile(rb"<(script|style)\b", re.I)
_CLOSES = {x: re.compile(rb"</" + x + rb"\s*>", re.I) for x in (b"script", b"style")}


def without_markup(page: bytes) -> bytes:
    """The page with a blank for each tag, and for each script or style with what it holds.

    Linear: what has no end is looked for once, and each end is found from its beginning.
    """
    out, at, never = [], 0, set()
    while (low := page.find(b"<", at)) >= 0:
        name = (m := _OPENS.match(page, low)) and m[1].lower()
        close = _CLOSES[name].search(page, low) if name and name not in never else None
        if name and not close:
            never.add(name)
        high = close.end() if close else page.find(b">", low) + 1
        if not high:
            break
        out += [page[at:low], b" "]
        at = high
    return b"".join([*out, page[at:]])


def _trigrams(data: np.ndarray) -> np.ndarray:
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint32)
    mixed = lower[:-2] * np.uint32(0x9E3779B1) ^ lower[1:-1] * np.uint32(0x85EBCA77) ^ lower[2:] * np.uint32(0xC2B2AE3D)
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities of each trigram bucket.

    labelled: doc_id, text, lang.  Of a language with more than ``sample``
    documents a hashed share of about that many is used.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return ["und"], np.full((1, BUCKETS), -math.log(BUCKETS))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    part = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) > 2:
                    own = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(_trigrams(data), minlength=BUCKETS)
        for lang, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at, "n": own[at]})

    counted = part.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    langs = sorted(sizes)
    table = np.full((len(langs), BUCKETS), 0.5)
    for row in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        table[langs.index(row.lang), row.bucket] += row.n
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _scores(column, model: np.ndarray, markup: bool) -> np.ndarray:
    """Log likelihoods, a row for each text."""
    if markup:
        texts = [without_markup((x or "").encode()).decode(errors="ignore") for x in column.to_pylist()]
        column = pa.array(texts, pa.string())
    out = np.zeros((len(column), len(model)))
    for chunk in tx.chunks(column):
        if len(chunk.data) < 3:
            continue
        grams = _trigrams(chunk.data)
        low = np.minimum(chunk.bounds[:-1], len(grams))
        high = np.maximum(np.minimum(chunk.bounds[1:] - 2, len(grams)), low)
        for k, logs in enumerate(model):
            total = np.concatenate([[0.0], np.cumsum(logs[grams], dtype=np.float64)])
            out[chunk.low : chunk.high, k] = total[high] - total[low]
    return out


def identify(
    rows: DataFrame, model: tuple[list[str], np.ndarray], id_col: str, text_col: str, url_col: str | None = None,
    host_col: str | None = None, markup: bool = False, weight: float = TEXT_WEIGHT,
) -> DataFrame:
    """(id, host, text_lang, declared_lang, lang, posterior) for each row."""
    langs, logs = model
    if url_col:
        host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    else:
        host = F.coalesce(F.col(host_col), F.lit("")) if host_col else F.lit("")
    declared = F.lit(None).cast("string")
    if markup:
        declared = F.lower(F.regexp_extract(F.col(text_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    base = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.alias("host"), declared.alias("declared"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch.column(1), logs, markup) * weight
            text = np.exp(score - score.max(axis=1, keepdims=True))
            text /= text.sum(axis=1, keepdims=True)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(langs)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), lists(score), lists(text)],
                ["id", "host", "declared", "score", "alone"],
            )

    schema = f"id {kind}, host string, declared string, score array<double>, alone array<double>"
    seen = base.mapInArrow(run, schema)
    seen = stored(seen.withColumn("declared", F.when(F.col("declared").isin(langs), F.col("declared"))))
    each = range(len(langs))
    sums = lambda tag: [F.sum(F.element_at("alone", k + 1)).alias(f"{tag}_{k}") for k in each]
    whole = seen.agg(*sums("all")).first()
    overall = [(whole[k] or 0.0) + 1.0 for k in each]
    overall = [x / sum(overall) for x in overall]
    # How often a language is declared where the texts say it is spoken: agreement, smoothed.
    agree = seen.where("declared is not null").agg(
        F.count("*").alias("n"),
        F.sum(sum(F.when(F.col("declared") == x, F.element_at("alone", k + 1)).otherwise(0.0) for k, x in enumerate(langs))).alias("s"),
    ).first()
    trust = ((agree["s"] or 0.0) + 1.0) / (agree["n"] + 2.0)
    doubt = (1 - trust) / max(1, len(langs) - 1)

    parts = F.split(F.col("host"), r"\.")
    hosts = seen.groupBy("host").agg(*sums("host"), F.count("*").alias("host_n"))
    hosts = hosts.withColumn("domain", F.when(F.size(parts) > 2, F.concat_ws(".", F.slice(parts, -2, 2))))
    hosts = hosts.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1)))
    for level in LEVELS[1:]:
        columns = [F.sum(f"host_{k}").alias(f"{level}_{k}") for k in (*each, "n")]
        hosts = hosts.join(hosts.where(F.col(level).isNotNull()).groupBy(level).agg(*columns), level, "left")
    joined = seen.join(hosts, "host")
    prior = [F.lit(x) for x in overall]
    for level in reversed(LEVELS):
        rows_here = F.col(f"{level}_n") - 1
        prior = [
            F.when(F.col(f"{level}_n").isNull(), prior[k]).otherwise(
                (F.greatest(F.col(f"{level}_{k}") - F.element_at("alone", k + 1), F.lit(0.0)) + SMOOTHING * prior[k]) / (rows_here + SMOOTHING)
            )
            for k in each
        ]
    evidence = [
        F.element_at("score", k + 1)
        + F.log(prior[k] + 1e-12)
        + F.when(F.col("declared").isNull(), F.lit(0.0)).otherwise(F.when(F.col("declared") == x, math.log(trust)).otherwise(math.log(max(doubt, 1e-9))))
        for k, x in enumerate(langs)
    ]
    fused = joined.select("id", "host", "declared", "alone", F.array(*evidence).alias("evidence"))
    best = F.array_max("evidence")
    name = lambda array, top: F.element_at(F.array(*map(F.lit, langs)), F.array_position(array, top).cast("int"))
    norm = F.aggregate("evidence", F.lit(0.0), lambda total, x: total + F.exp(x - F.array_max(F.col("evidence"))))
    return fused.select(
        F.col("id").alias(id_col),
        "host",
        name(F.col("alone"), F.array_max("alone")).alias("text_lang"),
        F.col("declared").alias("declared_lang"),
        name(F.col("evidence"), best).alias("lang"),
        (1.0 / norm).alias("posterior"),
    )
