"""Importance resampling towards a target distribution of hashed n-grams.

Each partition is worked off by a DuckDB connection of its own: SQL unnests the
words of a batch of texts, windows over them make the n-grams, and zlib's CRC,
registered as a function, gives each its bucket.  A task's bucket counts and
each document's buckets (two bytes a feature) are spilled to Parquet in the
shared folder.  Spark merges the counts of all tasks, for the documents and for
the target texts; the two distributions give each bucket a gain (at most
``buckets`` numbers, which go to all executors), and documents are scored from
what was spilled, so that no n-gram is made twice or shuffled.

Scores have Gumbel noise from a digest of the id, so the highest are a sample
without replacement with weights exp(weight / 1000).  Ranks come from a range
partitioning by score, the places in its partitions and the partitions' sizes.

Cases: null and empty texts have no words, no features and weight 0; without
target texts the gains only favour rare buckets; rows that repeat an id or lack
one (digest of the empty string) are rows like others, tied rows of one id in
any order; an empty table gives an empty result; other columns than id and text
are not read, so their names can't clash.  Long texts are cut into parts that
overlap by two words; a text's buckets are held by one task.
"""

from __future__ import annotations

import math
import shutil
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of, written

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 5, 20, 42
#: Bytes of text that a connection looks at at once; longer texts are cut.
BATCH = 4 << 20
MEMORY = "300MB"
#: A-Z to lower case; ASCII that is neither letter nor digit separates words.
CLEAN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))

GRAMS = """
CREATE OR REPLACE TEMP TABLE features AS
WITH words AS (
  SELECT part, id, skip, i, w FROM (
    SELECT part, id, skip, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT part, id, skip, string_split(text, ' ') AS ws FROM texts)) WHERE w <> ''),
grams AS MATERIALIZED (
  SELECT id, i > skip AS own, w AS one, lag(w) OVER t || ' ' || w AS two, lag(w, 2) OVER t || ' ' || lag(w) OVER t || ' ' || w AS three
  FROM words WINDOW t AS (PARTITION BY part ORDER BY i)),
hashes AS (SELECT id, unnest([crc(one), crc(two), crc(three)]) AS h FROM grams WHERE own)
SELECT id, (h % {buckets})::USMALLINT AS bucket FROM hashes WHERE h IS NOT NULL
"""


def crc(texts: pa.Array) -> pa.Array:
    """zlib's CRC of each text's UTF-8, null for null."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.binary())
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    begin, end = int(at[0]), int(at[-1])
    data = texts.buffers()[2].slice(begin, end - begin).to_pybytes() if end > begin else b""
    at = (at - begin).tolist()
    found = np.fromiter(map(zlib.crc32, map(data.__getitem__, map(slice, at, at[1:]))), np.uint32, len(texts))
    return pa.array(found, pa.uint32(), mask=texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None)


def parts(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
    """A clean text in parts of about size bytes: how many words of the part
    before it each begins with (two at most), and the part."""
    at, before = 0, []
    while at < len(text) or not at:
        stop = len(text) if len(text) - at <= size else text.find(b" ", at + size)
        stop = len(text) if stop < 0 else stop
        own = text[at:stop]
        yield len(before), b" ".join([*before, own])
        before = [*before, *own.rsplit(None, 2)[-2:]][-2:] if stop < len(text) else []
        at = stop + 1


class Hasher:
    """A DuckDB connection that turns texts into buckets and counts them."""

    def __init__(self, buckets: int):
        import duckdb

        self.folder = tempfile.mkdtemp(prefix="resample-")
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder})
        self.db.create_function("crc", crc, ["VARCHAR"], "UINTEGER", type="arrow", null_handling="special")
        self.db.execute("CREATE TEMP TABLE counts (bucket USMALLINT, n BIGINT)")
        self.sql = GRAMS.format(buckets=buckets)

    def close(self) -> None:
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)

    def rows(self, sql: str) -> pa.Table:
        return self.db.sql(sql).to_arrow_table()

    def buckets(self, texts: list[tuple[int, int, bytes]], found: dict[int, list[bytes]]) -> None:
        """Add the buckets of (id, skip, part) to found, by id, and count them."""
        ids, skips, raw = zip(*texts, strict=True)
        batch = pa.table({"part": pa.array(range(len(ids)), pa.int32()), "id": pa.array(ids, pa.int32()), "skip": pa.array(skips, pa.int32()), "text": pa.array(raw, pa.binary()).cast(pa.string())})
        self.db.register("texts", batch)
        self.db.execute(self.sql)
        self.db.unregister("texts")
        self.db.execute("INSERT INTO counts SELECT bucket, count(*) FROM features GROUP BY bucket")
        lists = self.rows("SELECT id, list(bucket) AS buckets FROM features GROUP BY id").combine_chunks()
        for chunk in lists.to_batches():
            column = chunk.column(1)
            at = (column.offsets.to_numpy() * 2).tolist()
            data = column.values.to_numpy(zero_copy_only=False).astype("<u2").tobytes()
            for i, a, b in zip(chunk.column(0).to_pylist(), at, at[1:], strict=False):
                found.setdefault(i, []).append(data[a:b])

    def counts(self, buckets: int) -> np.ndarray:
        found = self.rows("SELECT bucket, sum(n)::BIGINT AS n FROM counts GROUP BY bucket")
        out = np.zeros(buckets, np.int64)
        out[found["bucket"].to_numpy()] = found["n"].to_numpy()
        return out


def _hash(buckets: int, batch_bytes: int, kind: pa.DataType):
    """The function of one task: ids and texts to ids and buckets, and a last
    row with the task's counts."""
    names = ["doc_id", "n_features", "buckets", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(buckets)
        try:
            for batch in batches:
                found: dict[int, list[bytes]] = {}
                pending, size = [], 0
                for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    for skip, part in parts(text.translate(CLEAN), batch_bytes):
                        pending.append((i, skip, part))
                        size += len(part)
                        if size >= batch_bytes:
                            hasher.buckets(pending, found)
                            pending, size = [], 0
                if pending:
                    hasher.buckets(pending, found)
                lists = [b"".join(found.pop(i, ())) for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in lists], pa.int64()), pa.array(lists, pa.binary()), pa.nulls(len(lists), pa.list_(pa.int64()))], names)
            counts = pa.array([hasher.counts(buckets).tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), counts], names)
        finally:
            hasher.close()

    return run


def hashed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, batch_bytes: int = BATCH) -> DataFrame:
    """Spilled rows: doc_id, n_features and buckets (binary, unsigned 16-bit) of
    each document; of each task one row with counts alone."""
    from pyspark.sql.pandas.types import to_arrow_type

    if not 0 < buckets <= 65536:
        raise ValueError("buckets must fit 16 bits")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return written(rows.mapInArrow(_hash(buckets, batch_bytes, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, n_features long, buckets binary, counts array<long>"), "ngrams")


def merged(spilled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts of all tasks together: one number a bucket."""
    sums = spilled.where("counts IS NOT NULL").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most as many rows as buckets
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """By bucket, a thousand times the log of how much likelier the target is."""
    k, s, t = float(len(source)), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(source.astype(float).tolist(), target.astype(float).tolist(), strict=True)]


def _weigh(gain: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.array(gain, np.int64)
        for batch in batches:
            weights = [int(values[np.frombuffer(x, "<u2")].sum()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weights, pa.int64())], ["doc_id", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, batch_bytes: int = BATCH) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank: the highest
    scores of ``percent`` per cent of the documents with at least ``min_words``
    words have ranks from 1, the others null."""
    spilled = hashed(docs, id_col=id_col, text_col=text_col, buckets=buckets, batch_bytes=batch_bytes)
    wanted = hashed(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), buckets=buckets, batch_bytes=batch_bytes)
    gain = gains(merged(spilled, buckets), merged(wanted, buckets))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spilled.where("counts IS NULL").select("doc_id", "n_features", "buckets").mapInArrow(_weigh(gain), f"doc_id {kind}, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.floor(F.log(-F.log(share)) * -1000.0).cast("long")
    # n words have n, n - 1 and n - 2 features
    n_words = F.when(F.col("n_features") < 3, F.col("n_features")).otherwise(F.expr("n_features div 3 + 1"))
    rows = written(rows.select("*", (F.col("weight") + noise).alias("score"), (n_words >= min_words).alias("_takes_part"), F.monotonically_increasing_id().alias("_row")), "weights")
    part = rows.where("_takes_part")
    drawn = part.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    placed = written(part.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("_at")), "ranks")
    # the id's upper bits are the partition, the lower 33 the place in it
    placed = placed.select("*", F.shiftright("_at", 33).alias("_part"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    rank = F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    placed = placed.join(F.broadcast(sizes), "_part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return placed.union(rows.where("NOT _takes_part").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their likeness to the benchmark, and a draw of 5 %."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
