"""Stress lookup and disambiguation: joins with a scored choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.scratch import stored


def match_score(token_pos: Column, token_feats: Column, pos: Column, feats: Column) -> Column:
    """0.4 for the part of speech, 0.4 times the share of the token's features
    (map) that the variant (map of arrays) allows."""
    entries = F.map_entries(F.coalesce(token_feats, F.create_map().cast("map<string,string>")))
    agree = F.size(F.filter(entries, lambda e: F.coalesce(F.array_contains(feats[e["key"]], e["value"]), F.lit(False))))
    shared = F.when((F.size(entries) > 0) & (F.coalesce(F.size(feats), F.lit(0)) > 0), 0.4 * agree / F.size(entries)).otherwise(0.0)
    return 0.4 * F.coalesce(F.array_contains(pos, F.upper(token_pos)), F.lit(False)).cast("double") + shared


def confidence(n_variants: Column, score: Column) -> Column:
    return F.when(n_variants.isNull() | (n_variants == 0), "none").when(n_variants == 1, "exact").when(score >= 0.8, "exact").when(score >= 0.5, "partial").otherwise("fallback")


def lexicon_arrays(lexicon: DataFrame) -> DataFrame:
    """One row a form: its variants as an array in order, so that the choice
    needs no shuffle after the join.

    lexicon: form_norm, ord, stress, pos (array), feats (map of arrays).
    """
    return lexicon.groupBy("form_norm").agg(F.array_sort(F.collect_list(F.struct("ord", "stress", "pos", F.map_entries("feats").alias("feats")))).alias("variants"))


def resolve(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with stress, score, confidence, n_variants.

    tokens: token_id, form_norm, pos, feats (map, or JSON text).  The variant of
    the highest score wins, the first of equals; a token without variants has
    null stress.

    Each distinct form, part of speech and features is scored once.  The scored
    table is stored, so that the tokens of a common word are split among tasks.
    """
    is_text = isinstance(tokens.schema["feats"].dataType, StringType)
    tokens = tokens.select("token_id", "form_norm", "pos", F.col("feats").alias("_f") if is_text else F.to_json("feats").alias("_f"))
    asked = tokens.select("form_norm", "pos", "_f").distinct().withColumn("feats", F.from_json("_f", "map<string,string>"))
    met = asked.join(lexicon_arrays(lexicon), "form_norm", "left")
    scored = F.transform(
        "variants",
        lambda v: F.struct(match_score(F.col("pos"), F.col("feats"), v["pos"], F.map_from_entries(v["feats"])).alias("score"), v["stress"].alias("stress")),
    )
    met = met.withColumn("_s", scored)
    best = F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), F.get("_s", F.lit(0)), lambda b, x: F.when(x["score"] > b["score"], x).otherwise(b))
    met = met.withColumn("_b", best)
    score = F.when(F.size("_s") == 1, 1.0).otherwise(F.coalesce("_b.score", F.lit(0.0)))
    known = met.select(
        F.col("form_norm").alias("_form"),
        F.col("pos").alias("_pos"),
        F.col("_f").alias("_feats"),
        F.col("_b.stress").alias("stress"),
        score.alias("score"),
        confidence(F.size("variants"), F.col("_b.score")).alias("confidence"),
        F.coalesce(F.size("variants"), F.lit(0)).alias("n_variants"),
    )
    known = stored(known, "resolved")
    same = F.col("form_norm").eqNullSafe(F.col("_form")) & F.col("pos").eqNullSafe(F.col("_pos")) & F.col("_f").eqNullSafe(F.col("_feats"))
    return tokens.join(known, same).select("token_id", "form_norm", "stress", "score", "confidence", "n_variants")


def hybrid(model_stress: Column, model_score: Column, lookup_stress: Column, threshold: float = 0.70) -> Column:
    """The model's answer if it is sure, else the lookup's, else the model's."""
    sure = model_stress.isNotNull() & (model_score >= threshold)
    return F.when(sure, model_stress).when(lookup_stress.isNotNull(), lookup_stress).otherwise(model_stress)


def ranked_best(rows: DataFrame, keys: list[str], score: str, order: str) -> DataFrame:
    """The relational form of the same choice: the row of the best score."""
    best = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    return rows.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def coverage(resolved: DataFrame, by: str) -> DataFrame:
    """Per group: words, words with stress, and the percentage (0 if none)."""
    counts = resolved.groupBy(by).agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("stress").isNotNull()).alias("stressed"))
    return counts.select(by, "words", "stressed", F.coalesce(F.try_divide(F.col("stressed") * 100.0, F.col("words")), F.lit(0.0)).alias("percent"))
