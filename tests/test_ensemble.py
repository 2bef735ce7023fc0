"""Trained members against a vote that numpy makes of the same tables."""

import math

import numpy as np
import pytest

from tests.test_boost import NAMES, data, frame
from tonarium.operators import boost, ensemble
from tonarium.sources import scratch

TRIALS = "trial int, fitness double, depth int, rate double"


def walked(nodes, x, classes):
    """The scores of each row, one tree and one node after the other."""
    out = np.zeros((len(x), classes))
    trees: dict = {}
    for n in nodes:
        trees.setdefault((n["tree"], n["class"]), {})[n["node"]] = n
    for (_, label), tree in trees.items():
        for i, row in enumerate(x):
            at = tree[0]
            while at["feature"] >= 0:
                v = row[NAMES.index(at["name"])]
                at = tree[at["left"] if math.isnan(v) or v <= at["threshold"] else at["right"]]
            out[i, label] += at["leaf"]
    return out


def test_best_trials_and_settings(spark):
    trials = spark.createDataFrame([(3, 0.5, 2, 0.1), (1, 0.9, 3, None), (2, 0.9, 4, 0.2), (4, None, 9, 0.9), (5, float("nan"), 9, 0.9)], TRIALS)
    best = ensemble.best_trials(trials, 2)
    assert [t["trial"] for t in best] == [1, 2]
    made = ensemble.settings(best, boost.Setting(rounds=7))
    assert [(s.rounds, s.depth, s.rate) for s in made] == [(7, 3, 0.1), (7, 4, 0.2)]
    assert ensemble.best_trials(trials.limit(0)) == [] and [t["trial"] for t in ensemble.best_trials(trials)] == [1, 2, 3]


def test_vote_of_trained_members_equals_a_plain_one(spark):
    x, y, held = data(200)
    rows = frame(spark, x, y, held)
    tried = [boost.Setting(rounds=2, depth=d, rate=r) for d, r in ((1, 0.3), (2, 0.5), (2, 0.9))]
    models = ensemble.train(rows, NAMES, tried, classes=3)
    fit = ensemble.fitness(rows, models)
    want = [float((walked([n.asDict() for n in m.table(spark).collect()], x[held], 3).argmax(1) == y[held]).mean()) for m in models]
    assert np.allclose(fit, want)
    members = ensemble.keep(spark, models, fit, scratch.place(spark, "members-test"), 2)
    kept = sorted(range(3), key=lambda i: (-fit[i], i))[:2]
    assert sorted(r["fitness"] for r in members.select("member", "fitness").distinct().collect()) == sorted(fit[i] for i in kept)
    weights = np.exp([fit[i] for i in kept])
    weights /= weights.sum()
    p = np.zeros((len(x), 3))
    for n, w in enumerate(weights):
        s = walked([r.asDict() for r in members.where(f"member = {n}").collect()], x, 3)
        e = np.exp(s - s.max(1, keepdims=True))
        p += w * e / e.sum(1, keepdims=True)
        if n == 0:
            first = s.argmax(1)
    found = {r["id"]: r for r in ensemble.vote(rows, members).collect()}
    assert len(found) == len(x)
    assert np.allclose([found[i]["p"] for i in range(len(x))], p)
    sure = np.sort(p, 1)[:, -1] - np.sort(p, 1)[:, -2] > 1e-9  # no tie that rounding decides
    assert all(found[i]["ensemble"] == p[i].argmax() for i in np.flatnonzero(sure)) and sure.mean() > 0.9
    assert [found[i]["base"] for i in range(len(x))] == list(first)


def test_ensemble_cases(spark):
    x, y, held = data(60)
    rows = frame(spark, x, y, held)
    models = ensemble.train(rows, NAMES, [boost.Setting(rounds=1, depth=1)], classes=4)
    assert ensemble.fitness(rows.where("NOT held"), models) == [0.0] and ensemble.fitness(rows, []) == []
    one = ensemble.keep(spark, models, [0.5], scratch.place(spark, "members-one"))
    got = ensemble.vote(rows, one)
    assert got.where("base <> ensemble").count() == 0 and len(got.first()["p"]) == 4
    assert ensemble.vote(rows.limit(0), one).count() == 0
    with pytest.raises(ValueError):
        ensemble.vote(rows, one.limit(0))


def test_members_grown_together_equal_those_grown_alone(spark):
    x, y, held = data(150)
    rows = frame(spark, x, y, held)
    tried = [boost.Setting(rounds=30, depth=2, rate=0.9, patience=2, refresh=3), boost.Setting(rounds=4, depth=3, rate=0.3, refresh=3)]
    together = ensemble.train(rows, NAMES, tried, classes=3)
    for setting, model in zip(tried, together):
        alone = boost.fit(rows, NAMES, classes=3, setting=setting)
        assert [m[0] for m in model.metrics] == [m[0] for m in alone.metrics] and [m[3] for m in model.metrics] == [m[3] for m in alone.metrics]
        assert np.allclose([m[1:3] for m in model.metrics], [m[1:3] for m in alone.metrics]) and [t[:2] for t in model.trees] == [t[:2] for t in alone.trees]
    assert len(together[0].metrics) != len(together[1].metrics) == 5
    named = {f"s{i}": m.table(spark) for i, m in enumerate(together)}
    said = {r.id: r for r in boost.walk_many(rows, named).collect()}
    for name, model in named.items():
        assert all(np.allclose(said[r.id][name], r.scores) for r in boost.walk(rows, model).collect())
    assert sorted(map(tuple, rows.select("id", "a", "y").collect()), key=str) == sorted(((r.id, r.a, r.y) for r in said.values()), key=str)


@pytest.fixture
def asked(spark, monkeypatch):
    """What the queries ask for and train, over rows at hand."""
    from tonarium.plans import models

    seen = {}
    x, y, held = data(300)

    def labelled(spark, sf_dir, groups):
        seen["groups"] = groups
        return frame(spark, x, y, held).selectExpr("concat('f', id) AS form", "3 AS syllables", "a", "b", "c", "y", "held"), NAMES

    real = ensemble.train
    monkeypatch.setattr(models, "labelled", labelled)
    monkeypatch.setattr(ensemble, "train", lambda *a, **k: seen.setdefault("models", real(*a, **k)))
    seen["held"] = int(held.sum())
    return seen


def test_only_the_held_out_loss_ends_a_member(spark, asked):
    from tonarium.plans import models

    assert models.QUERIES["trained_ensemble"](spark, "").count() == 300
    assert asked["groups"] == ["shape", "clusters", "contexts", "morphology"] and len(asked["models"]) == 6
    for model in asked["models"]:
        grown, best = len(model.metrics) - 1, next(r for r, _, _, last in model.metrics if last)
        assert 3 < grown == best + models.MEMBER.patience < models.MEMBER.rounds


def test_the_whole_members_are_what_is_accepted(spark, asked):
    from tonarium.plans import models

    report = models.QUERIES["trained_ensemble_accepted"](spark, "").first()
    assert asked["groups"] == models.GROUPS and max(len(m.metrics) for m in asked["models"]) > 4
    best = max(np.mean([r.yhat == r.y for r in boost.walk(models.labelled(spark, "", models.GROUPS)[0].where("held"), m.table(spark)).select("yhat", "y").collect()]) for m in asked["models"])
    assert abs(report["base"] - best) < 1e-5 and report["base_hand"] == round(report["base"] * asked["held"])
