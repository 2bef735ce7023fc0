"""Ensembles of boosted models: the members of the best trials, trained, kept
as a table and asked together.

The members' nodes are one table (member, fitness and the columns of a model's
nodes).  A vote walks every member where the rows are and weighs the members'
probabilities by the softmax of their fitness: nothing is shuffled, and what a
task carries is as large as the members' settings allow.
"""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import boost

MEMBERS = f"member int, fitness double, {boost.NODES}"


def best_trials(trials: DataFrame, k: int = 5) -> list[dict]:
    """The settings of the k best trials, the best first; ties to the smaller
    trial; trials without a fitness don't count."""
    return [r.asDict() for r in trials.where("fitness IS NOT NULL AND NOT isnan(fitness)").orderBy(F.desc("fitness"), "trial").limit(k).collect()]


def train(rows: DataFrame, names: list[str], settings: list[boost.Setting], *, classes: int, most: int = 8) -> list[boost.Model]:
    """A model of each setting; as many as most grow in the same passes over the
    rows, if they have the same bins.  rows: the features, y, held."""
    rows, found = stored(rows, "members"), {}
    for bins in {s.bins for s in settings}:
        same = [i for i, s in enumerate(settings) if s.bins == bins]
        for part in (same[k : k + most] for k in range(0, len(same), most)):
            found |= zip(part, boost.fit_many(rows, names, [settings[i] for i in part], classes=classes), strict=True)
    return [found[i] for i in range(len(settings))]


def fitness(rows: DataFrame, models: list[boost.Model]) -> list[float]:
    """The share of held-out rows that each model gets right, in one pass; 0
    without such rows."""
    spark, held = rows.sparkSession, rows.where("held AND y IS NOT NULL")
    if not models:
        return []
    said = boost.walk_many(held, {f"_s{i}": m.table(spark) for i, m in enumerate(models)})
    right = [F.avg((boost.answer(f"_s{i}") == F.col("y")).cast("double")).alias(f"m{i}") for i in range(len(models))]
    return [x or 0.0 for x in said.agg(*right).first()]


def keep(spark: SparkSession, models: list[boost.Model], fit: list[float], path: str, k: int = 5) -> DataFrame:
    """The k fittest models written as a table to path, and that table; members
    are numbered from 0 by fitness, ties to the earlier model."""
    order = sorted(range(len(models)), key=lambda i: (-fit[i], i))[:k]
    rows = [(n, fit[i], *r) for n, i in enumerate(order) for r in models[i].rows()]
    spark.createDataFrame(rows, MEMBERS).write.mode("overwrite").parquet(path)
    return spark.read.schema(MEMBERS).parquet(path)


def _times(p: Column, weight: float) -> Column:
    return F.transform(p, lambda v: v * weight)


def vote(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with p (array by class), base (what the fittest member says) and
    ensemble (the class of the largest weighted probability, the first of
    equals).  Without members it is a ValueError."""
    known = [(r["member"], r["fitness"]) for r in members.select("member", "fitness").distinct().orderBy("member").collect()]
    if not known:
        raise ValueError("an ensemble without members")
    top = max(f for _, f in known)
    raw = [math.exp(f - top) for _, f in known]
    walks = {f"_s{m}": members.where(F.col("member") == m).drop("member", "fitness") for m, _ in known}
    # scores are stored first, so that no tree is walked twice
    rows = stored(boost.walk_many(rows, walks), "members-said")
    weighted = [_times(boost.probabilities(c), w / sum(raw)) for c, w in zip(walks, raw, strict=True)]
    p = weighted[0]
    for more in weighted[1:]:
        p = F.zip_with(p, more, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    return rows.withColumn("p", p).withColumn("base", boost.answer(next(iter(walks)))).withColumn("ensemble", boost.answer("p")).drop(*walks)


def settings(trials: list[dict], start: boost.Setting) -> list[boost.Setting]:
    """A setting of each trial: what it names, over start."""
    return [replace(start, **{k: v for k, v in t.items() if k in boost.Setting.__dataclass_fields__ and v is not None}) for t in trials]
