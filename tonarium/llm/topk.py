"""Exact top-k inner products with block-at-a-time pruning.

Vectors are turned into integers.  The index holds chunks of vectors: a block
forward index (the vectors, block after block) and each block's term maxima,
for every dimension the largest and the smallest value.  A query's bound for a
block is the sum over dimensions of its value times the block's maximum (or
minimum, where the query is negative).  A query visits blocks in the order of
their bounds, scores each through the forward index, and stops when the next
bound is below its k-th score; equal bounds are visited, since ties go to the
smaller id.

Queries travel in chunks too.  Index chunks are dealt into tiles, every query
chunk goes to each tile, and a task carries a query's k best from chunk to
chunk, so its threshold rises; a task returns k rows a query, whatever the
tile holds.  This is the stated query set against all rows, in blocks.

Cases: vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; each query row has a search of its own, also
where rows repeat an id; rows that repeat the query's id are the query's own
and no candidates; other repeated rows are candidates each;
missing trailing components count as zero; scores beyond 64 bits are clamped;
without queries or candidates the result is empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

K, EVERY = 5, 50
BLOCK, CHUNK, QUERIES = 64, 4096, 512
#: Index chunks of one tile; tiles, at least (as far as there are chunks).
TILE_CHUNKS, TILES = 64, 16
#: Query chunks whose best rows a task holds.
HELD = 500
LONG = 2**63


def quantised(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, values (array of long) of the vectors that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("values"))


CHUNKS = "uid long, n int, d int, ids binary, vectors binary, high binary, low binary"


def chunked(rows: DataFrame, size: int, block: int) -> DataFrame:
    """Chunks of a partition's vectors; inside one, vectors with the same
    largest dimension stand together, so that blocks have tight maxima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 32
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal uid, ids, vectors
            if not ids:
                return
            d = max(1, max(map(len, vectors)))
            x = np.zeros((len(ids), d), np.int64)
            for i, v in enumerate(vectors):
                x[i, : len(v)] = v
            order = np.lexsort((x.max(axis=1), x.argmax(axis=1)))
            x, own = x[order], np.array(ids, np.int64)[order]
            starts = np.arange(0, len(x), block)
            high, low = np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts)
            yield pa.RecordBatch.from_pylist([{"uid": uid, "n": len(x), "d": d, "ids": own.tobytes(), "vectors": x.tobytes(), "high": high.tobytes(), "low": low.tobytes()}], schema=pa.schema([("uid", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), *((c, pa.binary()) for c in ("ids", "vectors", "high", "low"))]))
            uid, ids, vectors = uid + 1, [], []

        for batch in batches:
            column = batch.column(1)
            flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                ids.append(vec_id)
                vectors.append(flat[cuts[i] : cuts[i + 1]].copy())
                if len(ids) == size:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, CHUNKS)


class Best:
    """The k best candidates of each query of a chunk."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids = ids
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids == self.ids[rows][:, None], -np.inf, scores)
        better = scores.max(axis=1) >= self.scores[rows, -1]
        rows, scores, ids = rows[better], scores[better], ids[better]
        scores = np.concatenate([self.scores[rows], scores], axis=1)
        ids = np.concatenate([self.found[rows], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=-1)[:, : self.scores.shape[1]]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.found[rows] = np.take_along_axis(ids, order, 1)


def prune_and_score(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, block: int) -> int:
    """Visit blocks query by query, wave by wave; returns the blocks scored."""
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive, scored = np.arange(len(q)), 0
    for wave in range(len(high)):
        alive = alive[bounds[alive, order[alive, wave]] >= best.scores[alive, -1]]
        if not len(alive):
            break
        mine = order[alive, wave]
        by_block = np.argsort(mine, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(mine[by_block]) > 0, True])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = alive[by_block[i:j]]
            at = int(mine[by_block[i]]) * block
            best.take(rows, q[rows] @ x[at : at + block].T, np.broadcast_to(ids[at : at + block], (len(rows), len(ids[at : at + block]))))
        scored += len(alive)
    return scored


def exact(best: Best, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> list[list[tuple[int, int]]]:
    """Scores that don't fit a double's 53 bits, by Python's integers."""
    k = best.scores.shape[1]
    out = []
    for own, row in zip(best.ids.tolist(), q.tolist(), strict=True):
        scores = [(-max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(row, v, strict=True)))), i) for i, v in zip(ids.tolist(), x.tolist(), strict=True) if i != own]
        out.append(sorted(scores)[:k])
    return out


def _search(k: int, block: int):
    """Task: rows (query chunk, index chunk) to query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}

        def rows(uid: int, at: np.ndarray, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            columns = (np.full(len(at), uid), at, queries, ids, scores)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_uid", "_at", "query_id", "vec_id", "score"])

        def out() -> Iterator[pa.RecordBatch]:
            for uid, b in held.items():
                i, j = np.nonzero(b.scores > -np.inf)
                yield rows(uid, i, b.ids[i], b.found[i, j], b.scores[i, j].astype(np.int64))
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                q = np.frombuffer(r["q_vectors"], np.int64).reshape(r["q_n"], r["q_d"])
                x = np.frombuffer(r["vectors"], np.int64).reshape(r["n"], r["d"])
                d = min(r["q_d"], r["d"])
                ids = np.frombuffer(r["ids"], np.int64)
                top = Best(np.frombuffer(r["q_ids"], np.int64), k)
                if d * float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) >= 2.0**53:
                    for at, found in enumerate(exact(top, q[:, :d], x[:, :d], ids)):
                        if found:
                            yield rows(r["q_uid"], np.full(len(found), at), np.full(len(found), top.ids[at]), np.array([f for _, f in found]), np.array([-s for s, _ in found]))
                    continue
                if len(held) > HELD:
                    yield from out()
                best = held.setdefault(r["q_uid"], top)
                high, low = (np.frombuffer(r[c], np.int64).reshape(-1, r["d"])[:, :d].astype(float) for c in ("high", "low"))
                prune_and_score(best, q[:, :d].astype(float), x[:, :d].astype(float), ids, high, low, block)
        yield from out()

    return run


def top_k(queries: DataFrame, index: DataFrame, *, k: int = K, block: int = BLOCK, chunk: int = CHUNK, query_chunk: int = QUERIES) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: each query's k best rows
    of the index but its own.  Both inputs as quantised() returns them."""
    if min(k, block, chunk, query_chunk) < 1:
        raise ValueError("sizes must be positive")
    chunks = written(chunked(index, chunk, block), "topk-index")
    queries = written(queries, "topk-queries")  # by as many tasks as read the table
    asked = chunked(queries.coalesce(max(1, -(-queries.count() // query_chunk))), query_chunk, query_chunk)
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("uid", "n", "d", "ids", "vectors")])
    n = chunks.count()
    tiles = max(1, min(n, max(TILES, -(-n // TILE_CHUNKS))))
    pairs = chunks.withColumn("tile", F.pmod(F.xxhash64("uid"), F.lit(tiles)).cast("int")).join(asked.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).hint("shuffle_merge"), "tile")
    names = ["q_uid", "q_n", "q_d", "q_ids", "q_vectors", "n", "d", "ids", "vectors", "high", "low"]
    found = pairs.select(*names).mapInArrow(_search(k, block), "_uid long, _at long, query_id long, vec_id long, score long")
    # a query row is its chunk and its place there
    rank = F.row_number().over(Window.partitionBy("_uid", "_at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every vector whose id is divisible by 50."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
