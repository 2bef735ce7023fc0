"""Tables and files that a job keeps on the way, in the shared folder."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); under
    a local master a temporary one if it isn't set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tonarium-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: What this process made, for clean().
_made: list[str] = []


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and reread: its lineage is cut, and a join with it has a plain
    exchange on this side, so that adaptive execution can split a common key."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size(df: DataFrame) -> int:
    """Bytes of a table that stored() returned."""
    conf, jvm = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    return sum(where.getFileSystem(conf).getContentSummary(where).getLength() for where in map(jvm.org.apache.hadoop.fs.Path, folders))


@contextlib.contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """What is stored in here is shuffled to n partitions at least."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", max(n, int(before)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@contextlib.contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of spark.sql (with _ for .) that hold in here."""
    names = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def one_file_each(df: DataFrame) -> bool:
    """Has each bucket of a table that bucketed() returned one file at most?"""
    numbers = [re.search(r"_(\d+)(?:\.[^/]*)?$", f) for f in df.inputFiles()]
    return all(numbers) and len({m[1] for m in numbers}) == len(numbers)


def bucketed(df: DataFrame, key: str, order: str, name: str, n: int, *, source: DataFrame | None = None) -> DataFrame:
    """df as a table of n buckets by key, each in the order of key and a number:
    joins on both columns shuffle and sort nothing, and what a bucket's rows give
    stays in its bucket.  Numbers are kept as differences, next to nothing in a row.

    source: the table of n buckets by key and number whose rows df makes others
    from, each in its place.  If its buckets have one file each, a task reads one
    bucket in order, and what it writes isn't sorted again.
    """
    spark, path = df.sparkSession, place(df.sparkSession, name)
    label = path.rsplit("/", 1)[1].replace("-", "_")
    # buckets by one of a join's two columns are enough; their order counts where a bucket is one file
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    rows = df.write.format("parquet").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").option(f"parquet.enable.dictionary#{order}", "false").option("parquet.enable.dictionary#form_ord", "false")
    rows = rows.bucketBy(n, key).option("path", path)
    if source is None or not one_file_each(source):
        rows.sortBy(key, order).saveAsTable(label)
        return spark.table(label)
    # a bucket a task, so one writer is enough; with writers allowed Spark doesn't sort
    with _set(spark, sources_bucketing_autoBucketedScan_enabled="false", maxConcurrentOutputFileWriters="2"):
        rows.saveAsTable(label)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(label).schema)
    spark.sql(f"DROP TABLE {label}")  # its files stay; the same table again, with the order that they have
    spark.sql(f"CREATE TABLE {label} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}, {order}) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(label)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cache_path(spark: SparkSession, key: str) -> str:
    """Where a cached table of this key is: its digest, so any text is a key."""
    return f"{shared_dir(spark)}/cache-{hashlib.sha256(key.encode()).hexdigest()[:32]}"


def cached(spark: SparkSession, key: str, make) -> DataFrame:
    """The table of this key: read if a whole one is there, else made, written
    and reread.  A cut-off write has no _SUCCESS file and is made again."""
    path = cache_path(spark, key)
    if not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what place(), stored() and bucketed() have made."""
    for label in {t.name for t in spark.catalog.listTables()} & {p.rsplit("/", 1)[1].replace("-", "_") for p in _made}:
        spark.sql(f"DROP TABLE IF EXISTS {label}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _made.clear()
