"""Live capture: distinct lines as they come, de-identified batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.operators import apply, detect, mint, plan
from maskline.sources.store import kept


def source(spark: SparkSession, path: str, files_a_trigger: int = 25) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_trigger).text(path).select(F.col("value").alias("raw"))


def distinct_lines(stream: DataFrame, delay: str | None = None, time: str = "ts") -> DataFrame:
    """Each text once; with a delay, state older than the watermark goes.  Without one the state keeps every text there was."""
    if delay:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["raw"])
    return stream.dropDuplicates(["raw"])


#: Lines that a task holds before it passes on what it has.
HELD = 20_000


def _first(rows: dict[str, object], lines: int) -> list[tuple[object, str]]:
    """The first distinct texts (time, text), by time and then by text."""
    return sorted((t, raw) for raw, t in rows.items())[:lines]


def bounded(stream: DataFrame, lines: int, seconds: float, keep: Column | None = None, time: str = "ts") -> DataFrame:
    """(sample_id, line_no, raw): of each sample the first distinct lines, until there are so many or so much time has passed.

    The clock of a sample starts with its first line that ``keep`` lets through
    and runs by the lines' own times, so a restart changes nothing; a line
    exactly at its end still counts.  Lines are numbered from 1 in the order
    seen, within a batch by time and then by text.  Null texts, times and samples
    are left out.  The state is a sample's lines, so at most ``lines`` texts; it
    stays, so that a full sample takes no more.  Each task passes on only the
    first lines of what it has read of a sample, so a hot sample moves little.
    """
    rows = (stream if keep is None else stream.where(keep)).select("sample_id", "raw", F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    rows = rows.where("sample_id IS NOT NULL AND raw IS NOT NULL AND us IS NOT NULL")
    limit = int(seconds * 1_000_000)

    def fewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[str, int]] = {}
        n = 0

        def out() -> pd.DataFrame:
            found = [(s, raw, t) for s, texts in held.items() for t, raw in _first(texts, lines)]
            return pd.DataFrame(found, columns=["sample_id", "raw", "us"])

        for batch in batches:
            for sample, raw, us in batch.itertuples(index=False):
                texts = held.setdefault(sample, {})
                if raw not in texts:
                    n += 1
                texts[raw] = min(us, texts.get(raw, us))
                if len(texts) > 2 * lines + 1000:
                    n -= len(texts) - lines
                    held[sample] = {raw: t for t, raw in _first(texts, lines)}
            if n > HELD:
                yield out()
                held, n = {}, 0
        yield out()

    def take(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, seen = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        before, known = len(seen), set(seen)
        if before < lines:
            new: dict[str, int] = {}
            for batch in batches:
                for _, raw, us in batch.itertuples(index=False):
                    new[raw] = min(us, new.get(raw, us))
                if len(new) > 2 * lines + 1000:
                    # Known texts don't count, but the first time may be theirs.
                    new = {raw: t for t, raw in _first(new, lines + len(known))}
            if start is None and new:
                start = min(new.values())
            for us, raw in _first(new, lines + len(known)):
                if raw not in known and us <= start + limit and len(seen) < lines:
                    seen.append(raw)
            if start is not None:
                state.update((start, seen))
        yield pd.DataFrame({"sample_id": key[0], "line_no": range(before + 1, len(seen) + 1), "raw": seen[before:]})

    fewest = rows.mapInPandas(fewer, "sample_id string, raw string, us long")
    return fewest.groupBy("sample_id").applyInPandasWithState(take, "sample_id string, line_no long, raw string", "start long, seen array<string>", "append", "NoTimeout")


class Mapping:
    """The aliases of a stream: a table in a folder, to which each batch adds those of its new values once.

    A batch's rows count once its folder is committed, so a batch that is run
    again reads what was there before it, never what a failed attempt left.
    After FOLDED batches all of them are folded into one base.
    """

    FOLDED = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _committed(self) -> dict[str, int]:
        """Committed folders that count, with their numbers: the last base, and batches after it."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        path = place(self.folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return {}
        names = [x.getPath().getName() for x in files.listStatus(path)]
        whole = {n: int(n.partition("=")[2]) for n in names if n.startswith(("base=", "batch=")) and files.exists(place(f"{self.folder}/{n}/_SUCCESS"))}
        base = max((k for n, k in whole.items() if n.startswith("base=")), default=-1)
        return {n: k for n, k in whole.items() if n == f"base={base}" or (n.startswith("batch=") and k > base)}

    def read(self) -> DataFrame:
        """All rows (kind, key, alias) so far."""
        found = self._committed()
        if not found:
            return self.spark.createDataFrame([], mint.MAPPING)
        return self.spark.read.schema(mint.MAPPING).parquet(*[f"{self.folder}/{n}" for n in sorted(found)])

    def aliased(self, entries: DataFrame, salt: str, batch: int) -> DataFrame:
        """The entries with their aliases; a batch that is run again adds nothing again."""
        found = self._committed()
        if f"batch={batch}" not in found and batch > max((k for n, k in found.items() if n.startswith("base=")), default=-1):
            mint.extend(self.read(), entries, salt).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        if len(found) >= self.FOLDED:
            self.read().write.mode("overwrite").parquet(f"{self.folder}/base={max(found.values())}")
        return mint.aliased(entries, self.read(), salt)


def deidentified(stream: DataFrame, out: str, checkpoint: str, salt: str, seconds: int | None = 4, mapping: str | None = None):
    """Write each batch with its identifiers replaced.

    Aliases come from the mapping table (beside the output unless named), so a
    value has one alias in all batches, and an alias stands for one value.
    """

    def batch(rows: DataFrame, number: int) -> None:
        aliases = Mapping(rows.sparkSession, mapping or f"{out.rstrip('/')}-mapping")
        lines = kept(rows.select(F.lit(str(number)).alias("sample_id"), F.xxhash64("raw").alias("line_no"), "raw"))
        found = kept(plan.collapse_composites(kept(plan.entries(detect.identities(lines)))))
        changed = apply.applied(lines, kept(aliases.aliased(found, salt, number)))
        changed.select("after").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
