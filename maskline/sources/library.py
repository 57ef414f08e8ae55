"""Tables of published samples: catalogue, overlay, availability, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskline.functions.values import canonical_sourcetype, fingerprint
from maskline.operators.parsers import let


def catalogue(system: DataFrame, packs: DataFrame) -> DataFrame:
    """System samples, and pack samples whose name no system sample has."""
    return system.unionByName(packs.join(system.select("name"), "name", "left_anti"))


def merge_overlay(base: DataFrame, removed: DataFrame, overlay: DataFrame, key: str = "key") -> DataFrame:
    """(base without removed) and overlay; the overlay wins."""
    left = base.join(removed.select(key).unionByName(overlay.select(key)), key, "left_anti")
    return left.unionByName(overlay)


def diff_overlay(base: DataFrame, now: DataFrame, key: str = "key", doc: str = "doc") -> DataFrame:
    """Keys that are new, changed or removed."""
    b, n = base.select(key, F.col(doc).alias("was")), now.select(key, F.col(doc).alias("is"))
    both = b.withColumn("b", F.lit(1)).join(n.withColumn("n", F.lit(1)), key, "full_outer")
    change = F.when(F.col("b").isNull(), "new").when(F.col("n").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def availability(indexes: DataFrame) -> DataFrame:
    """The index with most events of each sourcetype; the first in rank wins ties."""
    best = F.max_by(F.struct("index_name", "events"), F.struct(F.col("events"), -F.col("rank")))
    return indexes.groupBy("sourcetype").agg(best.alias("b")).select("sourcetype", "b.index_name", "b.events")


def documents(lines: DataFrame, sourcetype: str, most_bytes: int = 1_000_000) -> DataFrame:
    """One validated document a sample: key, events in order, fingerprint; larger ones are left out."""
    events = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw"))), lambda x: x.raw)
    small = lines.groupBy("sample_id").agg(F.sum(F.length("raw")).alias("size")).where(F.col("size") <= most_bytes)
    rows = lines.join(small.select("sample_id"), "sample_id", "left_semi").groupBy("sample_id").agg(events.alias("events"))
    key = F.concat(F.lit(f"{sourcetype}::"), F.col("sample_id"))
    return rows.where(~key.rlike(r"[/\\\x00\r\n]|\.\.")).select(
        key.alias("key"), "events", fingerprint(F.array_join("events", "\n")).alias("fingerprint"), F.lit(True).alias("sanitised")
    )


def refused(lines: DataFrame, most_bytes: int = 1_000_000) -> DataFrame:
    """(sample_id, size) of the samples that ``documents`` leaves out as too large."""
    return lines.groupBy("sample_id").agg(F.sum(F.length("raw")).alias("size")).where(F.col("size") > most_bytes)


def intact(docs: DataFrame) -> DataFrame:
    """Documents whose fingerprint is that of their events."""
    return docs.where(F.col("fingerprint") == fingerprint(F.array_join("events", "\n")))


def _unwrapped(text: Column) -> Column:
    """The JSON text inside up to three layers of JSON strings."""
    inner = lambda t: F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0)
    for _ in range(3):
        text = let(text, lambda t: F.when(F.trim(t).startswith('"'), inner(t)).otherwise(t))  # each layer is read once
    return text


def longer(text: Column, most: int) -> Column:
    """length(text) > most, characters counted only where bytes don't tell: a byte beyond ASCII, read as a Latin-1 letter, becomes two."""
    size = F.octet_length(text)
    ascii_ = F.octet_length(F.decode(text.cast("binary"), "ISO-8859-1")) == size
    return F.when(size <= most, False).when(size > 4 * most, True).when(ascii_, True).otherwise(F.length(text) > most)


#: Fields of a stored document; others are not let through.
DOCUMENT = "version int, key string, sourcetype string, format string, events array<string>, fingerprint string, sanitised boolean, provenance struct<sourceMode: string, sourceLabel: string, replacementsApplied: bigint, structurePreserved: boolean, coverage: struct<total: bigint, replaced: bigint, ok: boolean, blind: boolean>, sanitisedAt: string>"
MODES = ["upload", "paste", "group", "live-capture"]
LONGEST_DOCUMENT = 1_000_000


def document_key(sourcetype: Column, form: Column) -> Column:
    return F.concat_ws("::", canonical_sourcetype(sourcetype), F.nullif(F.lower(form), F.lit("")))


def parsed_documents(texts: DataFrame, key_col: str = "key", text_col: str = "text", most_bytes: int = LONGEST_DOCUMENT) -> DataFrame:
    """The rows with ``doc``, each stored text as a document of DOCUMENT's fields, or null with the ``reason`` for its rejection.

    Keys other than those of the allow-list are dropped; nothing is corrected: a
    fingerprint that isn't that of the events, or a key that isn't that of the
    source and format, rejects the document.
    """
    body = _unwrapped(F.col(text_col))
    rows = texts.withColumn("body", body).withColumn("d", F.from_json("body", DOCUMENT))
    d = lambda name: F.col(f"d.{name}")
    lines = F.filter("d.events", lambda e: F.trim(e) != "")
    p = F.col("d.provenance")
    counts = p["replacementsApplied"].isNotNull() & p["coverage"]["total"].isNotNull() & p["coverage"]["replaced"].isNotNull()
    reason = (
        F.when(F.col("body").isNull() | F.col("d").isNull() | F.try_parse_json("body").isNull(), "not JSON")
        .when(~d("version").eqNullSafe(1) | ~d("sanitised").eqNullSafe(True), "not a sanitised document of this version")
        .when(d("key").isNull() | d("sourcetype").isNull() | ~d("key").eqNullSafe(document_key(d("sourcetype"), d("format"))) | d("key").rlike(r"[/\\\x00\r\n]|\.\."), "key")
        .when(F.col(key_col).isNotNull() & ~d("key").eqNullSafe(F.col(key_col)), "stored under another key")
        .when(F.coalesce(F.size(lines), F.lit(0)) <= 0, "no events").when(F.exists("d.events", lambda e: e.isNull()), "events")
        .when(p.isNull() | ~F.coalesce(p["sourceMode"].isin(MODES), F.lit(False)) | ~counts | (F.coalesce(p["sanitisedAt"], F.lit("")) == ""), "provenance")
        .when(longer(F.col("body"), most_bytes), "too large").when(~d("fingerprint").eqNullSafe(fingerprint(F.array_join(lines, "\n"))), "fingerprint")
    )
    clean = F.col("d").withField("events", lines).withField("provenance.sourceLabel", F.left(F.coalesce(p["sourceLabel"], F.lit("")), F.lit(200)))
    # The reason first, so that it is worked out once.
    return rows.withColumn("reason", reason).withColumn("doc", F.when(F.col("reason").isNull(), clean)).drop("body", "d")


def parsed_overlay(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, key, doc, removed, reason): the samples and the removed keys of each overlay; one bad sample rejects its overlay whole."""
    layout = "samples map<string,string>, removed array<string>, updatedAt string"
    rows = texts.select(F.col(id_col).alias("id"), F.from_json(_unwrapped(F.col(text_col)), layout).alias("o"))
    checked = parsed_documents(rows.select("id", F.explode("o.samples").alias("key", "text"))).select("id", "key", "doc", F.lit(False).alias("removed"), "reason")
    gone = rows.select("id", F.explode(F.array_distinct("o.removed")).alias("key")).where("key <> ''")
    every = checked.unionByName(gone.select("id", "key", F.lit(None).cast(checked.schema["doc"].dataType).alias("doc"), F.lit(True).alias("removed"), F.lit(None).cast("string").alias("reason")))
    bad = every.groupBy("id").agg(F.min("reason").alias("why"))
    rejected = F.col("why").isNotNull()
    whole = every.join(bad, "id")
    none = rows.join(every.select("id").distinct(), "id", "left_anti").select("id", F.lit(None).cast("string").alias("key"), F.lit("no samples and nothing removed").alias("reason"))
    out = whole.select("id", "key", F.when(~rejected, F.col("doc")).alias("doc"), "removed", F.when(rejected, F.coalesce("reason", F.lit("another sample of its overlay"))).alias("reason"))
    return out.unionByName(none, allowMissingColumns=True)


def save(docs: DataFrame, path: str, replace: bool = False) -> None:
    docs.write.mode("overwrite" if replace else "errorifexists").parquet(path)
