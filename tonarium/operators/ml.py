"""Stress classifiers on MLlib: features, fit, search, prediction, ensemble."""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK
from ..functions.features import base, base_groups, places, universal
from ..profiles import UKRAINIAN, Profile
from . import evaluate, filters, optimize, variants

MOST_CLASSES = 11


def usable_rows(table: DataFrame) -> DataFrame:
    """Rows of a training table that one can learn from: kinds of ambiguity that
    morphology can tell apart, and forms whose part of speech and features have
    one pattern."""
    rows = table.where(filters.unambiguous("variant_type"))
    return variants.conflict_filter(rows, ["form", "pos", "features_json"], "stress_indices")


def training_set(rows: DataFrame, profile: Profile = UKRAINIAN) -> DataFrame:
    """lemma, form, pos, y and the base and universal features.

    rows: lemma, form, pos, feats, stress (array).  The label is the first
    stressed vowel; forms of fewer than two vowels or labels out of range go.
    """
    found = {n: x for g in base_groups(SPARK, profile).values() for n, x in g.items()} | universal(SPARK, profile)
    rows = rows.selectExpr("*", *[f"{x} AS {n}" for n, x in base(SPARK, profile).items()])
    rows = rows.selectExpr("*", *[f"{x} AS {n}" for n, x in places(SPARK, profile).items()])
    rows = rows.where("k >= 2 AND size(stress) > 0").withColumn("y", F.get("stress", F.lit(0)))
    rows = rows.where(f"y BETWEEN 0 AND least(k - 1, {MOST_CLASSES - 1})")
    return rows.selectExpr("lemma", "form", "pos", "k AS syllables", "double(y) AS y", *[f"double({x}) AS {n}" for n, x in found.items()])


def fit(train: DataFrame, *, trees: int = 20, depth: int = 8, seed: int = 42, fraction: float = 1.0) -> PipelineModel:
    names = [c for c in train.columns if c not in ("lemma", "form", "pos", "syllables", "y")]
    train = train if fraction >= 1 else train.sample(fraction, seed=seed)
    forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    # the copy leaves the training summary: it holds the session, which tasks can't be sent once counts were observed in it
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep"), forest]).fit(train).copy()


def predict(model: PipelineModel, rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """lemma, form, pos, syllables, y, yhat, p (array): the likeliest vowel; none
    (null) if the form has no such vowel or the model is less sure."""
    out = model.transform(rows).withColumn("p", vector_to_array("probability"))
    best = (F.array_position("p", F.array_max("p")) - 1).cast("int")
    known = (best < F.col("syllables")) & (F.array_max("p") >= threshold)
    return out.select("lemma", "form", "pos", "syllables", F.col("y").cast("int").alias("y"), F.when(known, best).alias("yhat"), "p")


BOUNDS = {"trees": (5, 60), "depth": (3, 12)}


def search(train: DataFrame, test: DataFrame, *, trials: int = 4, seed: int = 42, fraction: float = 0.5, most: int = 4) -> list[dict]:
    """Three phases: random settings, an evolution that adapts a covariance from
    the best of them, and settings by density ratio; 30, 25 and 45 % of the
    trials.  The trials of a phase that don't wait for each other run at once, at
    most ``most``.  Parameters, phase and held-out macro-F1 of each trial, best
    first."""
    spark, rng, out = train.sparkSession, random.Random(seed), []

    def objective(trial: dict) -> dict:
        model = fit(train, seed=seed + trial["trial"], fraction=fraction, trees=trial["trees"], depth=trial["depth"])
        score = evaluate.summary_metrics(predict(model, test).select("y", F.coalesce("yhat", F.lit(-1)).alias("yhat"))).first()
        return trial | score.asDict()

    def run(settings: list[dict], phase: int) -> list[dict]:
        numbered = [{k: round(v) for k, v in s.items()} | {"trial": len(out) + i, "phase": phase} for i, s in enumerate(settings)]
        done = optimize.at_once(spark, objective, numbered, most)
        out.extend(done)
        return done

    first, second = max(1, round(trials * 0.3)), max(2, round(trials * 0.55))
    run([{k: rng.uniform(lo, hi) for k, (lo, hi) in BOUNDS.items()} for _ in range(min(first, trials))], 1)
    evolution = optimize.Evolution(BOUNDS, start=max(out, key=lambda t: t["macro_f1"]), seed=seed)
    while len(out) < min(second, trials):
        evolution.tell([t["macro_f1"] for t in run(evolution.ask(min(evolution.size, min(second, trials) - len(out))), 2)])
    while len(out) < trials:
        known = spark.createDataFrame([(t["trial"], float(t["macro_f1"]), float(t["trees"]), float(t["depth"])) for t in out], "trial int, fitness double, trees double, depth double")
        run([optimize.suggest(known, BOUNDS, seed=seed + len(out))], 3)
    return sorted(out, key=lambda t: -t["macro_f1"])


def refit(train: DataFrame, hand: DataFrame, **setting) -> PipelineModel:
    """The winner's setting on all rows and the hand-made words of one answer
    (columns of training_set(); of such words those with a label)."""
    return fit(train.unionByName(hand.where("y IS NOT NULL").select(*train.columns)), **setting)


def manifest(model: PipelineModel, score: dict, n: int = 20) -> dict:
    """What is stored beside a model: its features, classes and figures."""
    assembler, forest = model.stages
    return {"features": assembler.getInputCols(), "classes": forest.numClasses, "trees": forest.getNumTrees, "score": score, "importances": importances(model, n)}


#: Ways to resolve, and whether each needs a model or a lookup table.
MODES = {"auto": (False, False), "db": (False, True), "hybrid": (True, True), "ml": (True, False)}


def resolver_mode(mode: str, has_model: bool, has_table: bool) -> str:
    """The mode that is used: auto takes what there is.  An unknown mode is a
    ValueError; one that lacks its model or table a FileNotFoundError."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "auto":
        mode = "hybrid" if has_model and has_table else "ml" if has_model else "db"
    model, table = MODES[mode]
    if model and not has_model or table and not has_table:
        raise FileNotFoundError(f"mode {mode} lacks its {'model' if model and not has_model else 'table'}")
    return mode


def importances(model: PipelineModel, n: int = 20) -> list[tuple[str, float]]:
    assembler, forest = model.stages
    return sorted(zip(assembler.getInputCols(), forest.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:n]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def same_answers(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, agree: two models' answers for the same forms (a stored model and the
    one that it was made from must agree on all)."""
    met = a.select("form", "pos", F.col("yhat").alias("x")).join(b.select("form", "pos", F.col("yhat").alias("z")), ["form", "pos"])
    return met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("z"))).alias("agree"))
