"""Dictionary counts over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as X
from ..profiles import LATIN, Profile


def form_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def pattern_counts(stream: DataFrame, profile: Profile = LATIN, text_col: str = "text") -> DataFrame:
    """lemma, pattern, n over all texts so far; state is one row a pattern.

    Merging whole entries depends on the order of sources and stays a batch
    job; counts and patterns don't, so they can follow a stream (update mode).
    """
    S = X.SPARK
    words = stream.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"(\p{L}+)"), 1)).alias("form"))
    words = words.selectExpr("form", f"{X.marked(S, 'form', profile)} AS marked")
    rows = words.selectExpr(f"{X.dictionary_form(S, 'form', profile)} AS lemma", f"to_json({X.stress_indices(S, 'marked', profile)}) AS pattern")
    return rows.where("pattern <> '[]'").groupBy("lemma", "pattern").agg(F.count(F.lit(1)).alias("n"))


def event_windows(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events by type and window; late rows beyond the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
