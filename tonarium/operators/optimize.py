"""Choosing settings to try: an evolution that adapts a covariance, and a density
ratio over the trials so far.

Settings are dicts by parameter; bounds give each its least and greatest value.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

Bounds = dict[str, tuple[float, float]]


class Evolution:
    """Covariance-matrix adaptation: a generation is drawn around a mean, and
    its better half moves the mean, the step size and the covariance.

    In the unit cube of the bounds; settings beyond a bound are put on it.
    Greater fitness is better; a fitness of nan counts as the worst.
    """

    def __init__(self, bounds: Bounds, *, start: dict | None = None, step: float = 0.3, size: int | None = None, seed: int = 42):
        self.bounds, n = bounds, len(bounds)
        self.n, self.rng, self.step = n, np.random.default_rng(seed), step
        self.size = size or 4 + int(3 * math.log(n))
        half = max(1, self.size // 2)
        weights = math.log(half + 0.5) - np.log(np.arange(1, half + 1))
        self.weights = weights / weights.sum()
        mass = 1 / (self.weights**2).sum()
        # fixed values: the method's published default rates
        self.c_path, self.c_step = (4 + mass / n) / (n + 4 + 2 * mass / n), (mass + 2) / (n + mass + 5)
        self.c_one = 2 / ((n + 1.3) ** 2 + mass)
        self.c_many = min(1 - self.c_one, 2 * (mass - 2 + 1 / mass) / ((n + 2) ** 2 + mass)) if mass > 1 else 0.0
        self.damping = 1 + 2 * max(0.0, math.sqrt((mass - 1) / (n + 1)) - 1) + self.c_step
        self.mass, self.length = mass, math.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
        self.mean = np.array([(start[k] - lo) / ((hi - lo) or 1) for k, (lo, hi) in bounds.items()]) if start else np.full(n, 0.5)
        self.covariance, self.path, self.step_path, self.generation = np.eye(n), np.zeros(n), np.zeros(n), 0

    def setting(self, u: np.ndarray) -> dict:
        return {k: float(lo + min(1.0, max(0.0, v)) * (hi - lo)) for v, (k, (lo, hi)) in zip(u, self.bounds.items(), strict=True)}

    def ask(self, size: int | None = None) -> list[dict]:
        """The settings of the next generation."""
        values, axes = np.linalg.eigh(self.covariance)
        self.root = axes @ np.diag(np.sqrt(np.maximum(values, 1e-20))) @ axes.T
        self.drawn = self.mean + self.step * self.rng.normal(size=(size or self.size, self.n)) @ self.root
        self.drawn = np.clip(self.drawn, 0.0, 1.0)
        return [self.setting(u) for u in self.drawn]

    def tell(self, fitness: list[float]) -> None:
        """The fitness of each setting that ask() gave."""
        order = np.argsort([-math.inf if math.isnan(f) else f for f in fitness], kind="stable")[::-1]
        best = self.drawn[order[: len(self.weights)]]
        weights = self.weights[: len(best)] / self.weights[: len(best)].sum()
        steps = (best - self.mean) / self.step
        move = weights @ steps
        self.generation += 1
        self.mean = self.mean + self.step * move
        white = np.linalg.pinv(self.root) @ move
        self.step_path = (1 - self.c_step) * self.step_path + math.sqrt(self.c_step * (2 - self.c_step) * self.mass) * white
        size = float(np.linalg.norm(self.step_path))
        calm = size / math.sqrt(1 - (1 - self.c_step) ** (2 * self.generation)) < (1.4 + 2 / (self.n + 1)) * self.length
        self.path = (1 - self.c_path) * self.path + calm * math.sqrt(self.c_path * (2 - self.c_path) * self.mass) * move
        many = (weights[:, None, None] * steps[:, :, None] * steps[:, None, :]).sum(0)
        kept = 1 - self.c_one - self.c_many + (not calm) * self.c_one * self.c_path * (2 - self.c_path)
        self.covariance = kept * self.covariance + self.c_one * np.outer(self.path, self.path) + self.c_many * many
        self.step = min(1.0, self.step * math.exp(min(1.0, self.c_step / self.damping * (size / self.length - 1))))


def at_once(spark: SparkSession, objective: Callable[[dict], float], settings: list[dict], most: int = 4) -> list:
    """The objective of all settings, as many at once as most.  Each trial's jobs
    are in a scheduler pool of their own, so that under fair scheduling
    (spark.scheduler.mode) no trial waits for another's."""

    def run(i: int, setting: dict):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{i}")
        try:
            return objective(setting)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, most)) as pool:
        # each trial has a copy of the caller's properties
        waiting = [pool.submit(inheritable_thread_target(spark)(run), i, s) for i, s in enumerate(settings)]
        return [w.result() for w in waiting]


def uniform(*parts: Column | str, seed: int = 42) -> Column:
    """A number between 0 and 1 that the parts decide."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def width(n: Column) -> Column:
    """The width of the bell over each of n trials, in the unit interval."""
    return F.greatest(F.lit(0.03), 0.5 * F.pow(F.greatest(n, F.lit(1)).cast("double"), F.lit(-0.2)))


def candidates(trials: DataFrame, bounds: Bounds, *, n: int = 24, share: float = 0.25, seed: int = 42) -> DataFrame:
    """candidate, the parameters, ratio: settings drawn around good trials, and
    how much likelier each is among good trials than among the others.

    trials: trial, fitness and the parameters.  Good are the best share of them,
    at least one.  Each group's density is, by parameter, the mean of a bell over
    each trial and of one uniform; the ratio is the sum of the logs over the
    parameters.  Trials without fitness, or outside of the bounds, count as
    others and at the bound.  Without trials there are no candidates.
    """
    spark, names = trials.sparkSession, list(bounds)
    unit = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(k).cast("double") - lo) / ((hi - lo) or 1.0))).alias(f"_u{i}") for i, (k, (lo, hi)) in enumerate(bounds.items())]
    rows = trials.select("trial", "fitness", *unit)
    order, everything = Window.orderBy(F.desc_nulls_last("fitness"), "trial"), Window.partitionBy()
    rows = rows.select("*", F.row_number().over(order).alias("_rank"), F.count(F.lit(1)).over(everything).alias("_n"))
    rows = rows.withColumn("_k", F.greatest(F.lit(1), F.ceil(F.col("_n") * share)).cast("int"))
    good = rows.where("_rank <= _k")
    drawn = spark.range(n).select(F.col("id").cast("int").alias("candidate"))
    # each candidate's centre by rank; k is a scalar of the trials
    k = rows.agg(F.max("_k")).scalar()
    drawn = drawn.withColumn("_centre", (F.floor(uniform(F.col("candidate"), "centre", seed=seed) * k) + 1).cast("int"))
    drawn = drawn.join(good, F.col("_centre") == F.col("_rank"))
    noise = lambda i: F.sqrt(-2.0 * F.log(uniform(F.col("candidate"), f"a{i}", seed=seed))) * F.cos(2 * math.pi * uniform(F.col("candidate"), f"b{i}", seed=seed))
    xs = [F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"_u{i}") + width(F.col("_k")) * noise(i))).alias(f"x{i}") for i in range(len(names))]
    drawn = drawn.select("candidate", *xs)
    listed = drawn.agg(F.collect_list(F.struct("candidate", *[f"x{i}" for i in range(len(names))]))).scalar()  # n of them
    pairs = rows.select("*", F.explode(listed).alias("c"))
    sums = []
    for i in range(len(names)):
        for group, which, size in (("l", F.col("_rank") <= F.col("_k"), F.col("_k")), ("g", F.col("_rank") > F.col("_k"), F.col("_n") - F.col("_k"))):
            h = width(size)
            bell = F.exp(-0.5 * F.pow((F.col(f"c.x{i}") - F.col(f"_u{i}")) / h, F.lit(2.0))) / (h * math.sqrt(2 * math.pi))
            sums.append(((F.lit(1.0) + F.coalesce(F.sum(F.when(which, bell)), F.lit(0.0))) / (F.count_if(which) + 1)).alias(f"_{group}{i}"))
    scored = pairs.groupBy("c.candidate", *[F.col(f"c.x{i}").alias(f"_x{i}") for i in range(len(names))]).agg(*sums)
    ratio = sum((F.log(f"_l{i}") - F.log(f"_g{i}") for i in range(len(names))), F.lit(0.0))
    return scored.select("candidate", *[(F.lit(float(lo)) + F.col(f"_x{i}") * (hi - lo)).alias(k_) for i, (k_, (lo, hi)) in enumerate(bounds.items())], ratio.alias("ratio"))


def suggest(trials: DataFrame, bounds: Bounds, **options) -> dict | None:
    """The candidate of the largest ratio, the first of equals; none without trials."""
    best = candidates(trials, bounds, **options).orderBy(F.desc("ratio"), "candidate").first()
    return {k: best[k] for k in bounds} if best else None
