"""Queries over training, models as tables and the search for settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import features
from ..operators import boost, ensemble, evaluate, optimize
from ..profiles import LATIN
from ..sources import scratch
from .catalog import ORACLE_SQL, QUERIES, TRIALS, query, read, trials, word_forms
from .products import TRAINING, training_rows

__all__ = ["ORACLE_SQL", "QUERIES"]

BOUNDS = {"leaves": (0.0, 300.0), "depth": (0.0, 17.0)}
_U = "(('0x' || substr(md5('42|' || c || '|{}'), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
_N = "(sqrt(-2.0::DOUBLE * ln({a})) * cos(2 * pi() * {b}))"
_W = "greatest(0.03::DOUBLE, 0.5::DOUBLE * pow(greatest({n}, 1)::DOUBLE, -0.2::DOUBLE))"
_BELL = "exp(-0.5::DOUBLE * pow((x{i} - u{i}) / {w}, 2)) / ({w} * sqrt(2 * pi()))"


def _density(i: int, which: str, n: str) -> str:
    return f"(1.0::DOUBLE + coalesce(sum({_BELL.format(i=i, w=_W.format(n=n))}) FILTER (WHERE {which}), 0)) / (count(*) FILTER (WHERE {which}) + 1)"


@query(
    f"""WITH {TRIALS}, r AS (SELECT least(1, greatest(0, leaves / 300)) AS u0, least(1, greatest(0, depth / 17)) AS u1, row_number() OVER (ORDER BY fitness DESC, trial) AS rank, count(*) OVER () AS n FROM trials),
k AS (SELECT *, greatest(1, ceil(n * 0.25::DOUBLE))::INT AS k FROM r), c AS (SELECT unnest(range(24))::INT AS c),
d AS (SELECT c, {", ".join(f"least(1, greatest(0, u{i} + {_W.format(n='k')} * {_N.format(a=_U.format(f'a{i}'), b=_U.format(f'b{i}'))})) AS x{i}" for i in range(2))} FROM c JOIN k ON rank = floor({_U.format("centre")} * k)::INT + 1),
s AS (SELECT c, x0, x1, {" + ".join(f"ln({_density(i, 'rank <= k', 'k')}) - ln({_density(i, 'rank > k', 'n - k')})" for i in range(2))} AS ratio FROM d, k GROUP BY c, x0, x1, n, k)
SELECT c AS candidate, round(x0 * 300, 6) AS leaves, round(x1 * 17, 6) AS depth, round(ratio, 6) AS ratio, (row_number() OVER (ORDER BY ratio DESC, c) = 1)::INT AS chosen FROM s"""
)
def next_setting(spark, sf_dir):
    """The next setting of a search: candidates drawn around the good trials,
    and how much likelier each is among those."""
    found = scratch.stored(optimize.candidates(trials(spark, sf_dir), BOUNDS), "candidates")
    best = found.orderBy(F.desc("ratio"), "candidate").select("candidate").limit(1).scalar()
    return found.select("candidate", F.round("leaves", 6).alias("leaves"), F.round("depth", 6).alias("depth"), F.round("ratio", 6).alias("ratio"), (F.col("candidate") == best).cast("int").alias("chosen"))


@query(
    """WITH curves AS (SELECT l_suppkey AS trial, l_linenumber AS round, avg(l_extendedprice) AS loss FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, median(loss) OVER w AS median, count(loss) OVER w AS n FROM curves WINDOW w AS (PARTITION BY round ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, coalesce(loss > median, FALSE) AND n >= 5 AND round >= 3 AS pruned FROM m)
SELECT round, count(*) AS trials, count(*) FILTER (WHERE pruned) AS pruned, round(max(median), 4) AS greatest_median FROM p GROUP BY round"""
)
def pruning_report(spark, sf_dir):
    """Of a search's trials (suppliers; line numbers are rounds), how many the
    median rule would end at each round."""
    curves = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("trial"), F.col("l_linenumber").alias("round")).agg(F.avg("l_extendedprice").alias("loss"))
    found = boost.prunes(curves)
    return found.groupBy("round").agg(F.count(F.lit(1)).alias("trials"), F.count_if("pruned").alias("pruned"), F.round(F.max("median"), 4).alias("greatest_median"))


#: Whole-number features, so that every value is a threshold.
SPLIT = ["word_len", "vowel_count", "dist_to_first_vowel", "dist_from_last_vowel"]
_RATE, _L2 = 0.1, 1.0


def labelled(spark, sf_dir, groups: list[str]) -> tuple[DataFrame, list[str]]:
    """The training rows with the features of the groups, and those features."""
    rows = scratch.stored(training_rows(spark, sf_dir), "training-rows")
    # features of the forms that are trained on, not of all
    forms = word_forms(spark, sf_dir).join(rows.select(F.lower("form").alias("form")).distinct(), "form", "left_semi")
    known = features.feature_columns(forms, LATIN, groups).drop("pos")
    names = [c for c in known.columns if c != "form"]
    rows = rows.withColumn("_f", F.lower("form")).join(known.withColumnRenamed("form", "_f"), "_f").drop("_f")
    return rows.select("form", "syllables", F.col("label").alias("y"), (F.col("split") == "test").alias("held"), *names), names


_LABELLED = TRAINING + (
    """, one AS (SELECT form, pos, features_json FROM training WHERE pos IS NOT NULL AND features_json IS NOT NULL AND variant_type NOT IN ('free_variant', 'grammatical_homonym') GROUP BY form, pos, features_json HAVING min(stress_indices) = max(stress_indices)),
usable AS (SELECT t.*, {VOWELS}::INT AS k, CASE WHEN len(stress) > 0 THEN stress[1] END AS y FROM training t SEMI JOIN one USING (form, pos, features_json) WHERE variant_type NOT IN ('free_variant', 'grammatical_homonym')),
labelled AS (SELECT lower(form) AS form, y FROM usable WHERE k >= 2 AND y BETWEEN 0 AND least(k - 1, 10) AND split = 'train')"""
)


def _split_sql() -> str:
    from ..functions import dialect as X
    from .catalog import FORMS

    # the forms' CTE is FORMS without its tokens, which TRAINING has
    forms = FORMS[FORMS.index(", firsts AS") :]
    shapes = features.feature_sql(LATIN, ["shape"], "SELECT * FROM forms")
    return (
        "WITH "
        + _LABELLED.replace("{VOWELS}", X.vowel_count(X.DUCK, "lower(form)", LATIN))
        + f"""{forms}, shapes AS ({shapes}),
x AS (SELECT l.y, unnest({SPLIT!r}) AS feature, unnest([{", ".join(f"s.{c}::INT" for c in SPLIT)}]) AS v FROM labelled l JOIN shapes s USING (form)),
prior AS (SELECT y AS class, count(*)::DOUBLE / (SELECT count(*) FROM labelled) AS p FROM labelled GROUP BY y),
cells AS (SELECT class, feature, v, sum(p - (y = class)::INT) AS g, count(*) * any_value(p) * (1 - any_value(p)) AS h FROM x, prior GROUP BY class, feature, v),
runs AS (SELECT *, sum(g) OVER left_side AS gl, sum(h) OVER left_side AS hl, sum(g) OVER everything AS g0, sum(h) OVER everything AS h0 FROM cells
  WINDOW left_side AS (PARTITION BY class, feature ORDER BY v), everything AS (PARTITION BY class, feature)),
gains AS (SELECT *, gl * gl / (hl + {_L2}) + (g0 - gl) * (g0 - gl) / (h0 - hl + {_L2}) - g0 * g0 / (h0 + {_L2}) AS gain FROM runs WHERE hl >= 1 AND h0 - hl >= 1)
SELECT class, feature, v::DOUBLE AS threshold, round(-{_RATE} * gl / (hl + {_L2}), 6) AS "left", round(-{_RATE} * (g0 - gl) / (h0 - hl + {_L2}), 6) AS "right"
FROM gains WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(gain, 6) DESC, list_position({SPLIT!r}, feature), v) = 1"""
    )


@query(_split_sql())
def boosted_split(spark, sf_dir):
    """The first split of each class's first tree: feature, threshold and the
    values of its two leaves."""
    rows = scratch.stored(labelled(spark, sf_dir, ["shape"])[0], "labelled")
    model = boost.fit(rows, SPLIT, setting=boost.Setting(rounds=1, depth=1, rate=_RATE, l2=_L2, patience=9), stop=None)
    nodes = boost.Model(model.names, model.edges, model.prior, model.grown).table(spark)
    root, leaf = nodes.where("node = 0 AND feature >= 0"), nodes.where("node > 0").select("tree", "node", "leaf")
    side = lambda c: leaf.select("tree", F.col("node").alias(c), F.round("leaf", 6).alias(f"_{c}"))
    found = root.select("tree", "class", F.col("name").alias("feature"), "threshold", "left", "right").join(side("left"), ["tree", "left"]).join(side("right"), ["tree", "right"])
    return found.select("class", "feature", "threshold", F.col("_left").alias("left"), F.col("_right").alias("right"))


GROUPS = ["shape", "clusters", "contexts", "morphology"]
SETTING = boost.Setting(rounds=8, depth=3, rate=0.4, patience=2)


@query(None)
def boosted_rounds(spark, sf_dir):
    """Losses of a boosted model's rounds on the training and the held-out rows,
    and the round that is kept."""
    rows, names = labelled(spark, sf_dir, GROUPS)
    model = boost.fit(scratch.stored(rows, "labelled"), names, setting=SETTING)
    return model.rounds(spark).select("round", F.round("train_loss", 6).alias("train_loss"), F.round("held_loss", 6).alias("held_loss"), F.col("best").cast("int").alias("best"))


@query(None)
def resolve_by_model(spark, sf_dir):
    """Each training form's stressed vowel by a model that was stored as a table
    and read back; none if the model names a vowel that the word lacks."""
    rows, names = labelled(spark, sf_dir, GROUPS)
    rows, path = scratch.stored(rows, "labelled"), scratch.place(spark, "model")
    boost.fit(rows, names, setting=SETTING).table(spark).write.parquet(path)
    found = boost.walk(rows, spark.read.parquet(path))
    return found.select("form", "syllables", "y", boost.answer("scores", F.col("syllables")).alias("yhat"), F.round(F.array_max(boost.probabilities("scores")), 6).alias("p"), F.col("held").cast("int").alias("held"))


#: The settings that the members come from; a search would propose them.
TRIED = [{"depth": d, "rate": r} for d, r in ((1, 0.5), (2, 0.3), (2, 0.5), (3, 0.3), (3, 0.5), (3, 0.8))]
#: What they share: the held-out loss ends a member, the rounds of a whole search are only a bound.
MEMBER = boost.Setting(rounds=1000, patience=5)


def voted(spark, sf_dir) -> DataFrame:
    """Every training row with what the fittest member and the ensemble say:
    form, y, held, base, ensemble, p.  The members are stored and read back."""
    rows, names = labelled(spark, sf_dir, GROUPS)
    rows, classes = scratch.stored(rows, "labelled"), 11
    models = ensemble.train(rows, names, ensemble.settings(TRIED, MEMBER), classes=classes)
    members = ensemble.keep(spark, models, ensemble.fitness(rows, models), scratch.place(spark, "members"))
    return ensemble.vote(rows, members).select("form", "syllables", "y", "held", "base", "ensemble", F.round(F.array_max("p"), 6).alias("p"))


@query(None)
def trained_ensemble(spark, sf_dir):
    """Each training form's stressed vowel by the five fittest of six boosted
    models, asked together; beside it what the fittest says alone."""
    return voted(spark, sf_dir).select("form", "syllables", "y", F.when(F.col("base") < F.col("syllables"), F.col("base")).alias("base"), F.when(F.col("ensemble") < F.col("syllables"), F.col("ensemble")).alias("ensemble"), "p", F.col("held").cast("int").alias("held"))


@query(None)
def trained_ensemble_accepted(spark, sf_dir):
    """Is the trained ensemble taken: does it gain enough on the held-out rows?
    The words of the hand-made test are the held-out forms of three vowels."""
    rows = scratch.stored(voted(spark, sf_dir), "voted").where("held")
    return evaluate.accepted(rows.withColumn("is_hand", F.col("syllables") == 3))
