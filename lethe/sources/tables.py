"""Sinks: idempotent append, upsert, expiry, and versioned tables that are changed file
by file, with one manifest that is switched last."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def append_once(target: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The rows to append: first of each key, and only where the target has none."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return first.join(target.select(*key), key, "left_anti")


def upsert_latest(target: DataFrame, rows: DataFrame, key: list[str], version: Column, guard: Column | None = None) -> DataFrame:
    """The table after an upsert: the latest row of each key. Stored rows for which
    ``guard`` holds are never replaced."""
    held = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(False)
    both = target.withColumn("_held", held.cast("int")).unionByName(rows.withColumn("_held", F.lit(0)))
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_held"), version.desc()))
    return both.withColumn("_n", newest).where("_n = 1").drop("_n", "_held")


def purge_expired(rows: DataFrame, expiry: str, now: Column) -> DataFrame:
    """Rows that are not past their expiry."""
    return rows.where(F.col(expiry) >= now)


def dedupe_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where
    it is unset, one of this machine serves only if all executors are its threads."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lethe-stored-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_stored: list[str] = []


def stored(df: DataFrame, what: str = "stored") -> DataFrame:
    """``df`` written once under the shared folder and read back: for frames that several
    others are made from. ``sweep`` deletes what was written."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    _stored.append(at)
    return spark.read.schema(df.schema).parquet(at)


def sweep(spark: SparkSession) -> None:
    """Delete all that ``stored`` has written in this process. Results that were made
    from it and not written themselves can't be read any more."""
    while _stored:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stored.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Change(NamedTuple):
    """The rows that take the place of some files of a table."""

    rows: DataFrame
    files: list[str]


class Versions:
    """Versioned Parquet tables under one folder, changed file by file.

    A manifest lists each table's files and its schema. A run writes new files under an
    id of its own and then adds a numbered manifest, of which the highest counts: either all
    of a run is seen or nothing, and no reader finds a moment without a manifest. A
    manifest is complete before its name appears (a rename that never overwrites); who
    comes second to a number fails. One writer at a time.

    A ``Change`` replaces only the files it names: an erasure reads a table's keys, and
    reads and writes whole rows only of files that hold a hit. Tables written in the order of the
    subjects' keys (``cluster``) have a subject's rows in few files. The driver holds
    the names of files, as Spark's own listing of a table does, never rows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, at: str) -> list[str]:
        path = self._path(f"{self.root}/{at}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _latest(self) -> int:
        """The number of the manifest that counts, 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")), default=0)

    def manifest(self) -> dict[str, dict]:
        """By table: files (below the root) and schema (as JSON text)."""
        number = self._latest()
        if not number:
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/manifests/{number:012d}.json").collect()))

    def files(self, name: str) -> list[str]:
        return self.manifest()[name]["files"]

    def read(self, name: str, files: list[str] | None = None) -> DataFrame:
        """A table, or the rows of some of its files."""
        own = self.manifest()[name]
        schema = StructType.fromJson(json.loads(own["schema"]))
        files = own["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])

    def rows(self, name: str) -> DataFrame:
        """A table with ``_file``, each row's file as the manifest names it. Other columns
        are not read for it."""
        df = self.read(name)
        at = F.substring_index(F.col("_metadata.file_path"), "/", -3) if self.files(name) else F.lit(None).cast("string")
        return df.withColumn("_file", at)

    def commit(self, tables: dict[str, DataFrame] | None = None, changes: dict[str, Change] | None = None, cluster: dict[str, list[str]] | None = None) -> str:
        """Write whole tables and changes of tables, then switch to them all at once.
        Tables named in ``cluster`` are written in ranges of these columns. Returns the
        run id."""
        tables, changes = tables or {}, changes or {}
        run = uuid.uuid4().hex
        number = self._latest() + 1
        now = self.manifest()
        for name, df in [*tables.items(), *((n, c.rows) for n, c in changes.items())]:
            if name in (cluster or {}) and name in tables:
                df = df.repartitionByRange(*cluster[name]).sortWithinPartitions(*cluster[name])
            df.write.parquet(f"{self.root}/{name}/{run}")
            new = [f"{name}/{run}/{n}" for n in self._names(f"{name}/{run}") if n.startswith("part-")]
            if name in tables:
                now[name] = {"files": sorted(new), "schema": df.schema.json()}
            else:
                if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in self.read(name).schema]:
                    raise ValueError(f"a change of {name} must keep its columns and types")
                gone = set(changes[name].files)
                if not gone <= set(now[name]["files"]):
                    raise RuntimeError(f"another run has replaced files of {name} in the meantime")
                now[name] = now[name] | {"files": sorted([f for f in now[name]["files"] if f not in gone] + new)}
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        staged, final = self._path(f"{self.root}/manifests/{run}.staged"), self._path(f"{self.root}/manifests/{number:012d}.json")
        out = self._fs.create(staged, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            self._fs.delete(staged, False)
            raise RuntimeError("another run has committed in the meantime")
        return run

    def forget(self, name: str) -> None:
        """Delete all files of a table that the manifest does not list, for good:
        superseded ones (destroyed keys) and those of runs that never finished. Older
        manifests go with them."""
        live, number = set(self.manifest().get(name, {}).get("files", [])), self._latest()
        for n in self._names("manifests"):
            if n != f"{number:012d}.json":
                self._fs.delete(self._path(f"{self.root}/manifests/{n}"), False)
        for run in self._names(name):
            kept = False
            for n in self._names(f"{name}/{run}"):
                if f"{name}/{run}/{n}" in live:
                    kept = True
                else:
                    self._fs.delete(self._path(f"{self.root}/{name}/{run}/{n}"), True)
            if not kept:
                self._fs.delete(self._path(f"{self.root}/{name}/{run}"), True)
