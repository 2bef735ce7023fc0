"""Settings against a plain version, the evolution on known functions, trials
that run at once."""

import hashlib
import math
import threading
import time

import numpy as np

from tonarium.operators import optimize

BOUNDS = {"p": (0.0, 10.0), "q": (-1.0, 1.0)}


def plain(trials, n=24, share=0.25, seed=42):
    def u(*parts):
        return (int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16) + 0.5) / 4294967296

    ranked = sorted(trials, key=lambda t: (t[1] is None, -(t[1] or 0), t[0]))
    unit = [[min(1.0, max(0.0, (v - lo) / (hi - lo))) for v, (lo, hi) in zip(t[2:], BOUNDS.values())] for t in ranked]
    k = max(1, math.ceil(len(ranked) * share))
    width = lambda m: max(0.03, 0.5 * max(m, 1) ** -0.2)
    density = lambda x, rows, i: (1 + sum(math.exp(-0.5 * ((x - r[i]) / width(len(rows))) ** 2) / (width(len(rows)) * math.sqrt(2 * math.pi)) for r in rows)) / (len(rows) + 1)
    out = []
    for c in range(n):
        centre = unit[int(u(c, "centre") * k)]
        x = [min(1.0, max(0.0, centre[i] + width(k) * math.sqrt(-2 * math.log(u(c, f"a{i}"))) * math.cos(2 * math.pi * u(c, f"b{i}")))) for i in range(2)]
        ratio = sum(math.log(density(x[i], unit[:k], i)) - math.log(density(x[i], unit[k:], i)) for i in range(2))
        out.append((c, *(lo + v * (hi - lo) for v, (lo, hi) in zip(x, BOUNDS.values())), ratio))
    return out


def test_candidates_equal_a_plain_version(spark):
    rng = np.random.default_rng(1)
    for m in (1, 3, 40):
        trials = [(i, None if i == 2 else float(round(rng.random(), 2)), float(rng.uniform(-1, 11)), float(rng.uniform(-1, 1))) for i in range(m)]
        frame = spark.createDataFrame(trials, "trial int, fitness double, p double, q double")
        found, want = sorted(map(tuple, optimize.candidates(frame, BOUNDS).collect())), plain(trials)
        assert np.allclose(found, want)
        best = max(want, key=lambda c: (c[3], -c[0]))
        assert np.allclose(list(optimize.suggest(frame, BOUNDS).values()), best[1:3])
    assert optimize.suggest(frame.limit(0), BOUNDS) is None


def test_density_ratio_finds_the_top(spark):
    score = lambda p, q: -((p - 7) ** 2) / 100 - (q - 0.2) ** 2
    rng = np.random.default_rng(2)
    trials = [(i, 0.0, float(rng.uniform(0, 10)), float(rng.uniform(-1, 1))) for i in range(60)]
    trials = [(i, score(p, q), p, q) for i, _, p, q in trials]
    found = optimize.suggest(spark.createDataFrame(trials, "trial int, fitness double, p double, q double"), BOUNDS)
    assert score(**found) > np.median([t[1] for t in trials])


def test_evolution_beats_random_settings():
    bounds = {k: (-5.0, 5.0) for k in "abcd"}
    valley = lambda s: -sum(10**k * (v - 1) ** 2 for k, v in enumerate(s.values()))
    wins = 0
    for seed in range(5):
        evolution, best, asked = optimize.Evolution(bounds, seed=seed), -math.inf, 0
        for _ in range(90):
            settings = evolution.ask()
            fitness = [valley(s) for s in settings]
            evolution.tell(fitness)
            best, asked = max(best, *fitness), asked + len(settings)
        rng = np.random.default_rng(seed)
        random = max(valley(dict(zip("abcd", rng.uniform(-5, 5, 4)))) for _ in range(asked))
        wins += best > random and best > -0.05
    assert wins == 5
    # the covariance has learned that the last parameter is the steepest
    assert evolution.covariance[3, 3] < evolution.covariance[0, 0]


def test_evolution_cases():
    one = optimize.Evolution({"a": (0, 1)}, start={"a": 0.9}, size=2)
    assert all(0 <= s["a"] <= 1 for s in one.ask())
    one.tell([math.nan, 1.0])
    assert len(one.ask(1)) == 1
    one.tell([0.5])
    assert optimize.Evolution({"a": (3, 3)}, start={"a": 3}).ask()[0] == {"a": 3.0}


def test_trials_run_at_once(spark):
    both, times = threading.Barrier(2, timeout=30), {}

    def objective(setting):
        begin = time.time()
        both.wait()  # passes only if two trials run at once
        n = spark.range(1000).selectExpr("sum(id)").first()[0]
        pool = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        times[setting["i"]] = (begin, time.time(), pool)
        return n

    assert optimize.at_once(spark, objective, [{"i": 0}, {"i": 1}], 2) == [499500, 499500]
    assert max(t[0] for t in times.values()) < min(t[1] for t in times.values())
    assert {t[2] for t in times.values()} == {"trial-0", "trial-1"}
