"""Boosting against a plain version, and models as tables."""

import math

import numpy as np
import pyarrow as pa
import pytest

from tonarium.operators import boost

NAMES = ["a", "b", "c"]


def data(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.integers(0, 3, n)]).astype(float)
    x[rng.random(n) < 0.05, 1] = np.nan
    y = (x[:, 0] > 4).astype(int) + ((np.nan_to_num(x[:, 1]) > 0.5) & (x[:, 2] > 0))
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y)
    return x, y, rng.random(n) < 0.3


def frame(spark, x, y, held):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r], int(k), bool(h)) for i, (r, k, h) in enumerate(zip(x, y, held))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int, held boolean").repartition(3)


def losses(s, y):
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p, -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).mean()


def plain(x, y, held, edges, setting):
    """Every split is tried row by row; no bins, no sums by bin."""
    train, k = ~held, y.max() + 1
    prior = np.array([math.log((y[train] == c).sum() / train.sum()) for c in range(k)])
    s, best, curve, trees = np.tile(prior, (len(y), 1)), (math.inf, 0), [], []
    for r in range(setting.rounds + 1):
        p, _ = losses(s, y)
        held_loss = losses(s[held], y[held])[1]
        curve.append((losses(s[train], y[train])[1], held_loss))
        best = min(best, (held_loss, r))
        if r == setting.rounds or r - best[1] >= setting.patience:
            break
        step = np.zeros_like(s)
        for c in range(k):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def grow(here, depth):
                gs, hs = g[here & train].sum(), h[here & train].sum()
                found = (1e-9, None)
                if depth < setting.depth:
                    for f in range(x.shape[1]):
                        for t in edges[f]:
                            left = here & ~(x[:, f] > t)
                            a, b = left & train, here & ~left & train
                            if h[a].sum() >= setting.least and h[b].sum() >= setting.least:
                                gain = round(g[a].sum() ** 2 / (h[a].sum() + setting.l2) + g[b].sum() ** 2 / (h[b].sum() + setting.l2) - gs**2 / (hs + setting.l2), 9)
                                if gain > found[0]:
                                    found = (gain, left)
                if found[1] is None:
                    step[here, c] = -setting.rate * gs / (hs + setting.l2)
                else:
                    grow(found[1], depth + 1)
                    grow(here & ~found[1], depth + 1)

            grow(np.ones(len(y), bool), 0)
        s = s + step
        trees.append(step)
    return curve, best[1], prior + sum(trees[: best[1]])


@pytest.mark.parametrize("setting", [boost.Setting(rounds=6, depth=3, rate=0.3, refresh=2, least=2.0), boost.Setting(rounds=40, depth=2, rate=0.9, patience=2)])
def test_rounds_and_answers_equal_a_plain_version(spark, setting):
    x, y, held = data()
    rows = frame(spark, x, y, held)
    model = boost.fit(rows, NAMES, setting=setting)
    curve, best, scores = plain(x, y, held, model.edges, setting)
    assert [(round(a, 8), round(b, 8)) for _, a, b, _ in model.metrics] == [(round(a, 8), round(b, 8)) for a, b in curve]
    assert [r for r, _, _, last in model.metrics if last] == [best] and {t[0] for t in model.trees} == set(range(best))
    if setting.rounds == 40:
        assert best < len(model.metrics) - 1 < 40  # stopped early
    assert [r.round for r in model.rounds(spark).collect()] == list(range(len(curve)))
    model.table(spark).write.mode("overwrite").parquet(path := "/tmp/tonarium-model-test")
    stored = spark.read.parquet(path)
    found = {r.id: r for r in boost.walk(rows, stored).collect()}
    assert all(np.allclose(found[i].scores, scores[i]) and found[i].yhat == int(scores[i].argmax()) for i in range(len(y)))
    turns = {(r.id, r["class"]): r.score for r in boost.walk_recursive(rows, stored, "id").collect()}
    assert all(abs(turns[i, c] - scores[i, c]) < 1e-9 for i in range(len(y)) for c in range(3))


def test_cases(spark):
    x, y, held = data(40)
    rows = frame(spark, x, y, held)
    with pytest.raises(ValueError):
        boost.fit(rows.where("held"), NAMES)
    none = boost.fit(rows, NAMES, setting=boost.Setting(rounds=0))
    assert not none.trees and boost.walk(rows, none.table(spark)).select("yhat").distinct().count() == 1
    assert boost.fit(rows.where("NOT held"), NAMES, setting=boost.Setting(rounds=2, depth=1)).metrics[0][2] != 0
    sure = boost.walk(rows, none.table(spark)).select(boost.probabilities("scores").alias("p")).first().p
    assert abs(sum(sure) - 1) < 1e-9


def test_pruning_report_equals_the_rule_of_a_running_trial(spark):
    rng = np.random.default_rng(3)
    curves = [(t, r, float(round(rng.random(), 3))) for t in range(12) for r in range(8)]
    found = boost.prunes(spark.createDataFrame(curves, "trial int, round int, loss double"), 2, 4).collect()
    known: dict = {}
    want = {}
    for t, r, loss in curves:
        want[t, r] = boost.median_rule(known, t, 2, 4)(r, loss)
    assert {(x.trial, x.round): x.pruned for x in found} == want and any(want.values())


def test_a_pruned_trial_stops(spark):
    x, y, held = data(120)
    seen = []
    model = boost.fit(frame(spark, x, y, held), NAMES, setting=boost.Setting(rounds=9, depth=1), stop=lambda r, loss: seen.append(loss) or r == 3)
    assert len(seen) == 4 == len(model.metrics)


def test_running_medians_of_many_trials(spark):
    # a window over all earlier trials put each trial's losses in order anew
    rng = np.random.default_rng(5)
    losses = rng.random(20_000).round(6)
    rows = spark.createDataFrame(pa.table({"trial": pa.array(range(20_000)), "round": pa.array([k % 2 + 3 for k in range(20_000)]), "loss": losses}).to_pandas())
    found = boost.prunes(rows)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.trial: r.median for r in found.collect()}
    for t in (0, 1, 2, 9, 10, 4001, 19_999):
        before = losses[[k for k in range(t) if k % 2 == t % 2]]
        assert got[t] is None if not len(before) else abs(got[t] - np.median(before)) < 1e-12
