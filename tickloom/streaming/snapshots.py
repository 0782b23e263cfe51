"""Versions of keyed state in a shared folder: each is a table of its own, and a pointer, replaced in one step, names the current one."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.streaming.keyed import STATES

POINTER = "current"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; one machine alone makes a temporary one where the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tickloom-state-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table of the shared folder, for what a plan would else derive more than once."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Snapshots:
    """States (key, payload, rows, at) saved under numbers from 1 on.

    A version is written whole before the pointer names it, so that a reader sees the version before or the new one and nothing between,
    and a job that dies while writing leaves the pointer as it was. The next version takes a number that no folder has.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were written whole."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = [str(s.getPath().getName()) for s in self._files.listStatus(self._path(self.path))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and self._files.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def current(self) -> int | None:
        """The version that the pointer names; None before the first."""
        at = self._path(f"{self.path}/{POINTER}")
        if not self._files.exists(at):
            return None
        return int(self.spark.read.text(f"{self.path}/{POINTER}").first()[0])

    def save(self, states: DataFrame) -> int:
        """Write a new version and make it the current one."""
        taken = [0]
        if self._files.exists(self._path(self.path)):
            names = [str(s.getPath().getName()) for s in self._files.listStatus(self._path(self.path))]
            taken += [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        version = max(taken) + 1
        states.select("key", *[f.split()[0] for f in STATES.split(", ")]).write.parquet(f"{self.path}/version={version}")
        self.point(version)
        return version

    def point(self, version: int) -> None:
        """Make a version the current one, also an earlier one."""
        if version not in self.versions():
            raise ValueError(f"no version {version} in {self.path}")
        jvm = self.spark.sparkContext._jvm
        new = self._path(f"{self.path}/_new-{uuid.uuid4().hex}")
        out = self._files.create(new)
        out.write(bytearray(f"{version}\n".encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, self._path(f"{self.path}/{POINTER}"), options)

    def restore(self, version: int | None = None) -> DataFrame:
        """The states of a version, of the current one by default; without any, none."""
        version = self.current() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], f"key string, {STATES}")
        if version not in self.versions():
            raise ValueError(f"no version {version} in {self.path}")
        return self.spark.read.schema(f"key string, {STATES}").parquet(f"{self.path}/version={version}")

    def forget(self, keep: int = 5) -> list[int]:
        """Delete all but the last `keep` versions and the current one; those deleted."""
        gone = [v for v in self.versions()[:-keep] if v != self.current()]
        for version in gone:
            self._files.delete(self._path(f"{self.path}/version={version}"), True)
        return gone


def newer(rows: DataFrame, states: DataFrame, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Rows after the last one that their key's saved state has taken, for a replay from a version: later times; rows of new keys all."""
    seen = states.select(F.col("key").alias("_key"), "at")
    kind = rows.schema[order].dataType.simpleString()
    last = F.to_timestamp_ntz(F.substring("at", 1, 26)) if kind.startswith("timestamp") else (F.col("at").cast("decimal(38,0)") - F.lit(1 << 63).cast("decimal(38,0)")).cast("long")
    joined = rows.join(seen, F.col(key).cast("string").eqNullSafe(F.col("_key")), "left")
    return joined.where(F.col("at").isNull() | (F.col(order) > last.cast(kind))).select(*rows.columns)
