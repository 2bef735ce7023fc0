"""Kinds of stress ambiguity, heteronyms, conflicts, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def variant_types(forms: DataFrame) -> DataFrame:
    """lemma, variant_type, is_disambiguable, is_homonym from the distinct
    patterns, (part of speech, features) and definitions of a lemma."""
    # distinct rows first: common words hardly travel
    rows = forms.select("lemma", F.coalesce("pattern", F.lit("")).alias("p"), F.concat_ws("|", F.coalesce("pos", F.lit("X")), F.coalesce("feats", F.lit(""))).alias("m"), F.coalesce("definition", F.lit("")).alias("d")).distinct()
    counted = rows.groupBy("lemma").agg(*[F.size(F.collect_set(c)).alias(f"_{c}") for c in "pmd"])
    kind = F.when(F.col("_p") <= 1, "single").when(F.col("_m") > 1, "morphological_variant").when(F.col("_d") > 1, "grammatical_homonym").otherwise("free_variant")
    return counted.select("lemma", kind.alias("variant_type")).selectExpr(
        "lemma", "variant_type", "CAST(variant_type IN ('morphological_variant', 'grammatical_homonym') AS INT) AS is_disambiguable", "CAST(variant_type <> 'single' AS INT) AS is_homonym"
    )


def lemma_pos(forms: DataFrame) -> DataFrame:
    """lemma, pos: its most frequent part of speech but X, the first seen among
    equals; X if there is none."""
    first = F.struct("src_ord", "form_ord")
    counts = forms.where("pos IS NOT NULL AND pos <> 'X'").groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    best = Window.partitionBy("lemma").orderBy(F.desc("n"), "first")
    best = counts.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("lemma", "pos")
    return forms.select("lemma").distinct().join(best, "lemma", "left").select("lemma", F.coalesce("pos", F.lit("X")).alias("pos"))


def pos_distribution(rows: DataFrame) -> DataFrame:
    """pos, n, and the mean confidences of part of speech and features."""
    return rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pos_confidence"), 6).alias("pos_confidence"), F.round(F.avg("features_confidence"), 6).alias("features_confidence"))


def heteronyms(forms: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """form_norm, stress, stress2, n_stresses, is_variative, is_heteronym: the
    distinct indices of a form in row order.

    forms: form_norm, ord, stress (array).  listed: form_norm of words with
    several right stresses; its size is Spark's to judge.
    """
    # outer, so that no filter on the list is inferred, which would be computed
    # again from the text below
    seen = forms.select("form_norm", "ord", F.posexplode_outer("stress").alias("at", "index")).where("index IS NOT NULL")
    seen = seen.groupBy("form_norm", "index").agg(F.min(F.struct("ord", "at")).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "index"))), lambda s: s["index"])
    found = seen.groupBy("form_norm").agg(ordered.alias("indices"))
    if listed is None:
        found = found.withColumn("listed", F.lit(False))
    else:
        known = listed.select("form_norm").distinct().withColumn("_in", F.lit(True))
        found = found.join(known, "form_norm", "left").withColumn("listed", F.coalesce("_in", F.lit(False)))
    many = F.size("indices") > 1
    return found.select(
        "form_norm",
        F.get("indices", F.lit(0)).alias("stress"),
        F.get("indices", F.lit(1)).alias("stress2"),
        F.size("indices").alias("n_stresses"),
        (many & F.col("listed")).alias("is_variative"),
        (many & ~F.col("listed")).alias("is_heteronym"),
    )


def conflict_filter(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows whose key has one value; rows with a null key or no value go."""
    known = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    one = known.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_lo = _hi").select(*keys)
    return known.join(stored(one, "one-value"), keys, "left_semi")


def conflict_report(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with several values: key, n_values, values (sorted, by '|')."""
    found = rows.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.array_join(F.array_sort(F.collect_set(value)), "|").alias("values"))
    return found.where("n_values > 1")


def enrich(pos: Column, feats: Column, lemma_pos: Column, providers: list[tuple[Column, Column, float]]) -> dict[str, Column]:
    """Part of speech and features from the data, else the lemma, else the
    providers in turn, each with the confidence of where they come from."""
    known = pos.isNotNull() & (pos != "X")
    out_pos, confidence = F.when(known, pos), F.when(known, 1.0)
    out_feats, feats_confidence = F.when(feats.isNotNull(), feats), F.when(feats.isNotNull(), 1.0)
    lemma_known = lemma_pos.isNotNull() & (lemma_pos != "X")
    out_pos, confidence = out_pos.when(lemma_known, lemma_pos), confidence.when(lemma_known, 0.9)
    for p, f, score in providers:
        out_pos, confidence = out_pos.when(p.isNotNull(), p), confidence.when(p.isNotNull(), score)
        out_feats, feats_confidence = out_feats.when(f.isNotNull(), f), feats_confidence.when(f.isNotNull(), score)
    return {"pos": out_pos.otherwise("X"), "pos_confidence": confidence.otherwise(0.0), "feats": out_feats, "features_confidence": feats_confidence.otherwise(0.0)}
