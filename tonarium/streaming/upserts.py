"""A key-value table that follows a stream.

Each batch is merged by key and written as the next version of the table; a
batch that comes again, after a restart, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Upserts:
    """key, values and order columns under a folder: version=N holds the table
    after batch N.  Of a key's rows the one of the greatest order wins; of equal
    orders the one with the greatest values, so that reruns agree."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str]):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order

    def version(self) -> int:
        """The last whole version; -1 without one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        done = found.getFileSystem(conf).globStatus(found)
        return max((int(x.getPath().getParent().getName().split("=")[1]) for x in done or ()), default=-1)

    def table(self, version: int | None = None) -> DataFrame | None:
        at = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/version={at}") if at >= 0 else None

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: partial maxima on the map side, so a common key hardly
        travels."""
        values = [c for c in rows.columns if c not in (self.key, *self.order)]
        best = F.max(F.struct(*self.order, *values)).alias("_r")
        return rows.groupBy(self.key).agg(best).select(*[F.col("_r")[c].alias(c) if c != self.key else F.col(c) for c in rows.columns])

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the table after this batch.  A batch that is known
        is left out; a version that was cut off is written again."""
        if batch_id <= self.version():
            return
        old = self.table()
        rows = batch if old is None else old.select(*batch.columns).unionByName(batch)
        self.latest(rows).repartitionByRange(self.key).sortWithinPartitions(self.key).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")

    def prune(self, keep: int = 2) -> None:
        """Delete all but the last versions."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*")
        system = found.getFileSystem(conf)
        for x in system.globStatus(found) or ():
            if int(x.getPath().getName().split("=")[1]) <= self.version() - keep:
                system.delete(x.getPath(), True)


def follow(stream: DataFrame, target: Upserts, checkpoint: str, also: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Merge all that has arrived into the target, batch by batch, and stop."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        target.merge(rows, batch_id)
        if also:
            also(rows, batch_id)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
