import math
import random

import numpy as np

from tonarium.llm import topk


def brute(rows, k=5):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in kept:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    return out


def run(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    vectors = topk.quantised(frame)
    return {tuple(r) for r in topk.top_k(vectors.where("vec_id % 50 = 0"), vectors, **sizes).collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)]  # a common vector: ties
    rows += [(1000, None), (1001, [None] * 8), (1002, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, [1.0] * 8), (1100, [0.25, 0.5]), (1101, [])]
    want = brute(rows)
    assert run(spark, rows, chunk=64, block=8, query_chunk=4) == want
    assert run(spark, rows) == want


def test_large_values_and_few_rows(spark):
    rows = [(0, [3e12, -1e12]), (1, [2e12, 1.0]), (2, [-1.0, 5e11])]
    assert run(spark, rows) == {(0, r, i, max(-(2**63), min(2**63 - 1, s))) for _, r, i, s in brute(rows)}
    assert run(spark, [(0, [1.0])]) == set() and run(spark, []) == set() and run(spark, [(3, [1.0]), (4, [1.0])]) == set()


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(512, 16)).round(2) * 100
    x = x[np.argsort(x[:, 0])]
    q = np.zeros((3, 16))
    q[:, 0] = 100
    best = topk.Best(np.array([-1, -2, -3]), 5)
    starts = np.arange(0, 512, 64)
    scored = topk.prune_and_score(best, q, x, np.arange(512), np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts), 64)
    assert scored == 3 and (best.scores[0] == np.sort(q[0] @ x.T)[::-1][:5]).all()


def test_each_query_row_has_its_own_search(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1, 40)] + [(50, [1.0, 0.0, 0.0, 0.0]), (50, [-1.0, 0.0, 0.5, 0.0]), (50, [-1.0, 0.0, 0.5, 0.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    got = sorted(tuple(r) for r in topk.top_k(vectors.where("vec_id = 50"), vectors, chunk=8, block=4, query_chunk=2).collect())
    want = []
    for q in range(39, 42):
        want += [t for t in brute([*rows[:39], rows[q]]) if t[0] == 50]
    assert got == sorted(want) and len(got) == 15
