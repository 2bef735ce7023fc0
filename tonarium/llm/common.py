"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def steady_reads(spark: SparkSession) -> None:
    """Read Parquet in order, not in parallel ranges: those keep a direct
    buffer as large as a column chunk for each thread, outside the heap."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    steady_reads(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent and the master is local (tests) a temporary
    folder is made once per session and remembered in the session's settings.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tonarium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders that this process wrote, for clean().
_made: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and reread it.

    Survives lost executors, and joins on the reread table have an exchange on
    either side, so that adaptive execution can split skewed partitions.
    """
    spark = df.sparkSession
    steady_reads(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by key: joins on
    the key don't shuffle it again."""
    spark = df.sparkSession
    steady_reads(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"{name}_{uuid.uuid4().hex}"
    _made.append(f"{shared_dir(spark)}/{label}")
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", _made[-1]).saveAsTable(label)
    return spark.table(label)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _made.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete what written() returned, once all that needs it is written."""
    for df in frames:
        _delete(df.sparkSession, [p for p in (getattr(df, "written_to", None),) if p in _made])


def made() -> int:
    """How many tables written() and bucketed() have left."""
    return len(_made)


def clean(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> None:
    """Delete what written() and bucketed() have left since made() returned that
    number, but one table; results that were not stored can't be read afterwards."""
    paths = [p for p in _made[since:] if p != getattr(but, "written_to", None)]
    for table_ in [t.name for t in spark.catalog.listTables() if any(p.endswith(f"/{t.name}") for p in paths)]:
        spark.sql(f"DROP TABLE IF EXISTS {table_}")
    _delete(spark, paths)


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
