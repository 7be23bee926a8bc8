"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet files and of versions. Arrivals are appended as small files; compaction takes runs
of files of similar size (a tier holds files up to FANOUT times as large as the smallest it may hold), and writes each run
as one file of about the target size. A version lists the live files in a manifest of its own; it is committed by creating
the file that names the manifest, which fails if that version is there already, so that readers see one version or the next
and never a mixture. Tasks write through Spark's committer: a lost executor's files are written again or not at all.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

TARGET_BYTES = 64 << 20
#: Rows of an arriving file at most; files of a run at least, unless they fill a target-sized file; smallest tier's size.
ARRIVAL_ROWS, FANOUT, SMALLEST = 2048, 4, 64 << 10
COMPRESSION = "zstd"
#: Files of one tier that are put in order in one place when runs are formed, and files that are merged in one commit, about.
PLAN_ROWS, ROUND_FILES = 100_000, 50_000
#: A claim on a version is void after so many seconds; folders that no version names are removed after so many.
CLAIM_SECONDS, ORPHAN_SECONDS = 600, 24 * 3600


class CommitConflict(RuntimeError):
    """Another writer committed that version first; its files are there, ours are not."""


def added(names: list[str]) -> list[str]:
    """What the columns are called that read() adds to columns of these names."""
    taken, out = {n.lower() for n in names}, []
    for name in ("_shard", "_shard_bytes", "_shard_rows"):
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


class Store:
    """Rows in files below root (any file system that Spark writes). Columns are stored by place: names may be anything."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _entry(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:08d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, entry: dict) -> None:
        """Write the version's entry beside its place, then move it there: it is whole or not there."""
        final, draft = self._path(f"{self.root}/versions/{version:08d}"), self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        claim = self._path(f"{self.root}/versions/.claim-{version:08d}")
        try:
            # a writer that died before its entry was moved must not block the version for ever
            if self._fs.exists(claim) and not self._fs.exists(final) and self._age(claim) > CLAIM_SECONDS:
                self._fs.delete(claim, False)
            self._fs.create(claim, False).close()  # only one writer gets it
        except Exception as e:
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version} is being committed by another writer") from e
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version} is there already")

    def _age(self, path) -> float:
        """Seconds since a file or folder was written."""
        return time.time() - self._fs.getFileStatus(path).getModificationTime() / 1000

    # files

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, job, shard, bytes, rows of the live files of a version (the last one)."""
        version = self.version() if version is None else version
        schema = StructType.fromDDL("path string, job string, shard string, bytes long, rows long")
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._entry(version)["manifest"])

    def _listed(self, job: str, version: int, schema: StructType) -> DataFrame:
        files = self.spark.read.schema(schema).parquet(job).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
        files = files.groupBy("file_path", "file_name", "file_size").agg(F.count(F.lit(1)).alias("rows"))
        name = F.concat(F.lit(f"{version:08d}-"), F.regexp_replace("file_name", r"^part-(\d+)-.*?(?:c(\d+))?\.[a-z.]*parquet$", "$1-$2"))
        return files.select(F.col("file_path").alias("path"), F.lit(job).alias("job"), name.alias("shard"), F.col("file_size").alias("bytes"), "rows")

    def _publish(self, version: int, manifest: DataFrame, schema: StructType, names: list[str]) -> int:
        path = f"{self.root}/manifests/{version:08d}-{uuid.uuid4().hex}"
        manifest.write.parquet(path)
        jobs = [r[0] for r in self.spark.read.parquet(path).select("job").distinct().collect()]  # one a commit that still has live files
        self._commit(version, {"manifest": path, "jobs": sorted(jobs), "schema": schema.jsonValue(), "names": names})
        return version

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Write rows as small files, as they lie, and commit them with what there is; returns the version."""
        version = self.version() + 1
        job = f"{self.root}/data/{version:08d}-{uuid.uuid4().hex}"
        plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
        if version > 1 and (stored := StructType.fromJson(self._entry(version - 1)["schema"])).simpleString() != plain.schema.simpleString():
            raise ValueError(f"the store holds {stored.simpleString()}, not {plain.schema.simpleString()}")
        plain.write.option("maxRecordsPerFile", arrival_rows).option("compression", COMPRESSION).parquet(job)
        manifest = self.manifest(version - 1).unionByName(self._listed(job, version, plain.schema))
        return self._publish(version, manifest, plain.schema, rows.columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one) with _shard, _shard_bytes and _shard_rows of the file that holds them; a name
        that is taken gets more underscores in front."""
        version = self.version() if version is None else version
        entry = self._entry(version)
        schema, live = StructType.fromJson(entry["schema"]), self.manifest(version)
        if not entry["jobs"]:
            rows = self.spark.createDataFrame([], StructType([*schema.fields, *StructType.fromDDL("path string")]))
        else:
            rows = self.spark.read.schema(schema).parquet(*entry["jobs"]).select("*", F.col("_metadata.file_path").alias("path"))
        rows = rows.join(live.select("path", F.col("shard").alias("_shard"), F.col("bytes").alias("_shard_bytes"), F.col("rows").alias("_shard_rows")), "path").drop("path")
        return rows.toDF(*entry["names"], *added(entry["names"]))

    # compaction

    def plan(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """path, run for the files to be merged: neighbours of a tier up to the target size, fanout of them or a full file."""
        small = self.manifest().where(F.col("bytes") < target // 2)
        tier = F.greatest(F.lit(0), F.floor(F.log(float(fanout), F.col("bytes") / SMALLEST))).cast("int")
        parts = max(1, math.ceil(small.count() / PLAN_ROWS))
        small = small.select("path", "shard", "bytes", tier.alias("tier"), F.pmod(F.xxhash64("shard"), F.lit(parts)).alias("part"))
        before = F.coalesce(F.sum("bytes").over(Window.partitionBy("tier", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        small = small.withColumn("nth", F.floor(before / target))
        runs = small.groupBy("tier", "part", "nth").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("run_bytes"))
        runs = runs.where((F.col("n") >= fanout) | (F.col("n") > 1) & (F.col("run_bytes") >= target))
        runs = runs.withColumn("run", (F.row_number().over(Window.orderBy("tier", "part", "nth")) - 1).cast("int"))
        return small.join(runs.select("tier", "part", "nth", "run"), ["tier", "part", "nth"]).select("path", "run")

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, keep_old: bool = False) -> int:
        """Merge runs of similar files until no tier has one; returns the version. Without keep_old, files go that
        neither the last version nor the one before it names."""
        while True:
            version = self.version()
            if not version:
                return 0
            plan = common.store(self.plan(target, fanout), "plan")
            runs = (plan.agg(F.max("run")).first()[0] or 0) + 1 if plan.limit(1).count() else 0
            if not runs:
                return version
            entry = self._entry(version)
            schema = StructType.fromJson(entry["schema"])
            job = f"{self.root}/data/{version + 1:08d}-{uuid.uuid4().hex}"
            # the first runs of about ROUND_FILES files; the others are for the next rounds
            sizes = plan.groupBy("run").agg(F.count(F.lit(1)).alias("n")).groupBy(F.floor(F.col("run") / 1024).alias("part")).agg(F.sum("n").alias("n")).orderBy("part").collect()
            last, files = 1024, 0
            for r in sizes:
                if files and files + r.n > ROUND_FILES:
                    break
                last, files = 1024 * (r.part + 1), files + r.n
            plan, runs = plan.where(F.col("run") < last), min(runs, last)
            rows = self.spark.read.schema(schema).parquet(*(r.path for r in plan.select("path").collect())).select("*", F.col("_metadata.file_path").alias("path"))
            rows.join(plan, "path").repartitionById(runs, F.col("run")).drop("path", "run").write.option("compression", COMPRESSION).parquet(job)
            live = self.manifest(version).join(plan, "path", "left_anti").unionByName(self._listed(job, version + 1, schema))
            self._publish(version + 1, live, schema, entry["names"])
            if not keep_old:
                self.vacuum()

    def vacuum(self, keep: int = 2) -> None:
        """Remove the data that none of the last versions names: readers of the one before the last aren't disturbed. What no
        version ever named is a job that failed or still runs; it goes when it is old."""
        versions = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName().isdigit())
        entries = {v: {j.rsplit("/", 1)[1] for j in self._entry(v)["jobs"]} for v in versions}
        live = set().union(*(entries[v] for v in versions[-keep:]))
        for status in self._fs.listStatus(self._path(f"{self.root}/data")):
            job = status.getPath()
            named = any(job.getName() in jobs for jobs in entries.values())
            if job.getName() not in live and (named or self._age(job) > ORPHAN_SECONDS):
                self._fs.delete(job, True)


def sharded(docs: DataFrame, target: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """docs after appending them to a new store and compacting it: its columns, _shard, _shard_bytes and _shard_rows.

    Every row is kept as it is (nulls, repeated rows, empty and long texts); an empty table is a version without files.
    """
    store = Store(docs.sparkSession, common.scratch(docs.sparkSession, "shards"))
    store.append(docs, arrival_rows)
    store.compact(target)
    return store.read()


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file of each document after arrival and compaction, with its bytes and rows. Nulls, repeated rows, empty and long texts
    are kept as they are; files of equal size are taken in the order of their names."""
    docs = common.table(spark, sf_dir, "documents")
    return common.pick(sharded(docs), "doc_id", *added(docs.columns)).toDF("doc_id", "shard", "shard_bytes", "shard_rows")


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as they are read from a compacted store, with the file that holds each."""
    return sharded(docs)
