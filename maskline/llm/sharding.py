"""Sharding by size-tiered compaction, with DataFrame and SQL functions only.

Arrivals are appended as they are partitioned, as small immutable Parquet
shards, without a shuffle.  Compaction puts shards whose sizes have the same
number of bits pairwise (factors of four) into one tier, fills runs up to the
target size within each tier, and rewrites each run of two or more shards as
one file; other shards stay.  A manifest lists the shards in force; its rows
are written aside, and the version is one small file that names them and can
be put in place once only, so readers see the old or the new list and the
second of two writers fails.  Old shards stay for readers of old versions
until ``vacuum``.

Only rewritten runs are shuffled, once, each run to a partition of its own; a
run never exceeds the target by more than one shard, whatever keys the rows
have.  The plan is made from the list of shards, not from rows, and rows meet
it in a join on the shard's path, at any number of shards.  The driver holds
the paths that a read names, about 200 bytes for each shard of TARGET_BYTES.

Defined cases: rows pass through unchanged, nulls and repeats too; an empty
arrival adds a version without new shards; all columns are kept, whatever
their names (``read`` names the shard's column so that it clashes with none).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskline.llm.store import get_text, put_once

TARGET_BYTES = 32 << 20
MANIFEST = "path string, bytes long, rows long, level int"


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, target: int = TARGET_BYTES):
        self.spark, self.folder, self.schema, self.target = spark, folder.rstrip("/"), schema, target
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The version in force; 0 before the first append."""
        top = self._path(f"{self.folder}/versions")
        if not self._files.exists(top):
            return 0
        names = [x.getPath().getName() for x in self._files.listStatus(top)]
        return max([0, *(int(x[1:]) for x in names if x[1:].isdigit())])

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        rows = get_text(self.spark, f"{self.folder}/versions/v{version:08d}")
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/{rows}")

    def _commit(self, version: int, shards: DataFrame) -> None:
        rows = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.folder}/manifests/{rows}")
        if not put_once(self.spark, f"{self.folder}/versions/v{version:08d}", rows):
            raise RuntimeError(f"version {version} was committed by another writer")

    @staticmethod
    def _file() -> Column:
        """The path of a row's file, decoded (the metadata column holds it as a URL)."""
        return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))

    def _shards(self, folder: str, level: int) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(folder)
        return rows.groupBy(self._file().alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(
            F.count("*").alias("rows")
        ).withColumn("level", F.lit(level))

    def append(self, rows: DataFrame) -> int:
        """Add an arrival, one small shard for each task; the version in force afterwards."""
        base, folder = self.version(), f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f"`{c}`") for c in self.schema.names]).write.option("compression", "zstd").parquet(folder)
        self._commit(base + 1, self.manifest(base).unionByName(self._shards(folder, 0)))
        return base + 1

    def plan(self) -> DataFrame:
        """The shards with their run, numbered from 0; null where a shard stays as it is."""
        tier = F.floor(F.length(F.bin("bytes")) / 2)
        order = Window.partitionBy("tier").orderBy("path")
        filled = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
        shards = self.manifest().withColumn("tier", tier)
        shards = shards.withColumn("slot", F.floor(F.coalesce(filled, F.lit(0)) / F.lit(self.target)))
        members = F.count("*").over(Window.partitionBy("tier", "slot"))
        merge = (members > 1) & (F.col("bytes") < self.target)
        shards = shards.withColumn("merge", merge)
        number = F.dense_rank().over(Window.orderBy("tier", "slot")) - 1
        runs = shards.where("merge").select("tier", "slot").distinct().withColumn("run", number)
        return shards.join(runs, ["tier", "slot"], "left").select(
            *self.manifest().columns, F.when(F.col("merge"), F.col("run")).alias("run")
        )

    def compact(self) -> int:
        """Merge similar shards and commit the new list; the version in force afterwards."""
        base, folder = self.version(), f"{self.folder}/data/{uuid.uuid4().hex}"
        planned = f"{self.folder}/plans/{uuid.uuid4().hex}"
        schema = self.plan().schema
        self.plan().coalesce(1).write.parquet(planned)
        plan = self.spark.read.schema(schema).parquet(planned)
        merged = plan.where("run is not null").select("path", "run")
        runs = merged.agg(F.max("run")).first()[0]
        if runs is None:
            return base
        path, run, key = (free_name(x, self.schema.names) for x in ("_path", "_run", "_key"))
        rows = self._rows([r.path for r in merged.select("path").toLocalIterator()])
        rows = rows.withColumn(path, self._file()).join(merged.toDF(path, run), path).drop(path)
        # A key for each run that the exchange sends to a partition of its own.
        n = runs + 1
        keys = self.spark.range(40 * n + 40).select(F.col("id").cast("int").alias(key))
        keys = keys.groupBy(F.pmod(F.hash(key), F.lit(n)).alias(run)).agg(F.min(key).alias(key))
        dealt = rows.join(keys, run).repartition(n, key)
        dealt.select(*[F.col(f"`{c}`") for c in self.schema.names]).write.option("compression", "zstd").parquet(folder)
        stay = plan.where("run is null").drop("run")
        self._commit(base + 1, stay.unionByName(self._shards(folder, 1)))
        return base + 1

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the ``shard`` each lies in (``_shard`` if there is such a column)."""
        shard = free_name("shard", self.schema.names)
        paths = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], self.schema).withColumn(shard, F.lit(None).cast("string"))
        return self._rows(paths).select(*[F.col(f"`{c}`") for c in self.schema.names], self._file().alias(shard))

    def vacuum(self) -> int:
        """Delete shards that the version in force doesn't list; how many."""
        live = {r.path.rsplit("/data/")[-1] for r in self.manifest().select("path").toLocalIterator()}
        gone = 0
        found = self._files.listFiles(self._path(f"{self.folder}/data"), True)
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().endswith(".parquet") and path.toUri().getPath().rsplit("/data/")[-1] not in live:
                gone += bool(self._files.delete(path, False))
        return gone
