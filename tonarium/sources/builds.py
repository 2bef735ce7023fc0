"""Products that are rebuilt when their sources change, and counts that a write
takes on its way."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import readers

MANIFEST = "path string, sha256 string"


def write_counted(df: DataFrame, path: str, counts: dict[str, Column], facts: dict[str, str] | None = None) -> DataFrame:
    """Write df, and beside it (path.about) what is known of it: kind, name and
    value of the counts, observed while the rows pass, and of the facts.  The
    rows are read once."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.mode("overwrite").parquet(path)
    found = seen.get
    rows = [("count", k, str(found[k] if found.get(k) is not None else 0)) for k in counts] + [("fact", k, v) for k, v in (facts or {}).items()]
    rows.append(("fact", "columns", json.dumps(df.columns)))
    df.sparkSession.createDataFrame(rows, "kind string, name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}.about")
    return df.sparkSession.read.parquet(f"{path}.about")


def about(spark: SparkSession, path: str) -> DataFrame:
    """What write_counted() noted of a table."""
    return spark.read.parquet(f"{path}.about")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, changed, same): two manifests compared by
    one full outer join."""
    met = new.select("path", F.col("sha256").alias("_new")).join(old.select("path", F.col("sha256").alias("_old")), "path", "full")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return met.select("path", kind.alias("change"))


class Build:
    """Versions of a product under one folder, and a pointer to the one in use.

    A version is written beside the others with the manifest of the sources it
    was made from; only then the pointer, a file of one line, is replaced by a
    rename.  A run that is cut off leaves the pointer at the old version.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def current(self) -> str | None:
        """The path of the version in use."""
        pointer = self._path("CURRENT")
        if not pointer.getFileSystem(self.conf).exists(pointer):
            return None
        name = self.spark.read.text(f"{self.folder}/CURRENT").first()[0]
        return f"{self.folder}/{name}"

    def manifest(self) -> DataFrame:
        """The sources of the version in use; empty without one."""
        at = self.current()
        return self.spark.read.schema(MANIFEST).parquet(f"{at}/manifest") if at else self.spark.createDataFrame([], MANIFEST)

    def publish(self, name: str) -> None:
        new, pointer = self._path(f"CURRENT.{uuid.uuid4().hex}"), self._path("CURRENT")
        system = pointer.getFileSystem(self.conf)
        stream = system.create(new, True)
        stream.write(bytearray(f"{name}\n".encode()))
        stream.close()
        system.delete(pointer, False)
        system.rename(new, pointer)

    def refresh(self, sources: str, make: Callable[[], dict[str, DataFrame]]) -> DataFrame:
        """Compare the files of sources (a pattern) with the version in use; if
        any was added, removed or changed, make all tables anew.  Returns the
        changes; without any nothing is written."""
        new = readers.file_hashes(self.spark, sources)
        found = [(r["path"], r["change"]) for r in changes(self.manifest(), new).collect()]  # one row a source file
        report = self.spark.createDataFrame(found, "path string, change string")
        if all(change == "same" for _, change in found) and self.current():
            return report
        name = f"version-{uuid.uuid4().hex}"
        for table, df in make().items():
            df.write.parquet(f"{self.folder}/{name}/{table}")
        new.coalesce(1).write.parquet(f"{self.folder}/{name}/manifest")
        self.publish(name)
        return report

    def table(self, name: str) -> DataFrame:
        at = self.current()
        if at is None:
            raise FileNotFoundError(f"nothing is built in {self.folder}")
        return self.spark.read.parquet(f"{at}/{name}")
