"""Lookup-service views, token gates, validation and small conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import SPARK, mark_many
from ..profiles import Profile

#: Parts of speech and feature keys that a form may have.
UPOS = "ADJ ADP ADV AUX CCONJ DET INTJ NOUN NUM PART PRON PROPN PUNCT SCONJ SYM VERB X".split()
FEATURE_KEYS = "Gender Animacy Number Case Definite Degree VerbForm Mood Tense Aspect Voice Evident Polarity Person Polite Clusivity PronType NumType Poss Reflex Foreign Abbr Typo".split()


def point_lookup(forms: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of forms whose lemma or form is one of the words (column word):
    one equi-join instead of an OR."""
    keyed = forms.withColumn("word", F.explode(F.array_distinct(F.array("lemma", "form"))))
    return keyed.join(words.select("word").distinct(), "word", "left_semi").drop("word").distinct()


def service_view(lexicon: DataFrame) -> DataFrame:
    """form_norm, n_variants (distinct stresses), is_heteronym, pos_tags
    (sorted, distinct).  lexicon: form_norm, stress (array), pos."""
    rows = lexicon.groupBy("form_norm").agg(F.count_distinct(F.to_json("stress")).alias("n_variants"), F.array_join(F.array_sort(F.collect_set("pos")), ",").alias("pos_tags"))
    return rows.select("form_norm", "n_variants", (F.col("n_variants") > 1).cast("int").alias("is_heteronym"), "pos_tags")


def rendered_variants(lexicon: DataFrame, profile: Profile) -> DataFrame:
    """form_norm, variants (array of the word with its marks, one for each
    distinct stress, in the order in which they first stand), is_heteronym.

    lexicon: form_norm, stress (array; null counts as none), form_ord.  Each
    task reduces its rows to one a form and stress before anything is shuffled.
    """
    rows = lexicon.where("form_norm IS NOT NULL").groupBy("form_norm", F.coalesce("stress", F.array().cast("array<int>")).alias("stress")).agg(F.min("form_ord").alias("_o"))
    listed = rows.groupBy("form_norm").agg(F.array_sort(F.collect_list(F.struct("_o", "stress"))).alias("_v"))
    one = listed.select("form_norm", F.posexplode("_v").alias("_k", "_s")).selectExpr("form_norm", "_k", f"{mark_many(SPARK, 'form_norm', '_s.stress', profile)} AS marked")
    found = one.groupBy("form_norm").agg(F.array_sort(F.collect_list(F.struct("_k", "marked"))).alias("_v"))
    return found.select("form_norm", F.col("_v.marked").alias("variants"), (F.size("_v") > 1).cast("int").alias("is_heteronym"))


def sample_report(view: DataFrame, keys: int = 50_000, n: int = 20) -> DataFrame:
    """section, name, n: of the first ``keys`` forms, n that have several
    stresses, and how many forms have each part of speech."""
    first = view.orderBy("form_norm").limit(keys)
    sample = first.where("n_variants > 1").orderBy("form_norm").limit(n).select(F.lit("sample").alias("section"), F.col("form_norm").alias("name"), F.col("n_variants").alias("n"))
    tags = first.where("pos_tags <> ''").select(F.explode(F.split("pos_tags", ",")).alias("name"))
    return sample.unionByName(tags.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("histogram").alias("section"), "name", "n"))


def megabytes(column: str) -> Column:
    """Bytes as a text in megabytes."""
    return F.format_string("%.2f MB", F.col(column) / 1048576.0)


def duration(column: str) -> Column:
    """Seconds as a text: 7s, 3m 5s, 2h 0m."""
    s = F.col(column).cast("long")
    text = F.when(s < 60, F.concat(s, F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60), F.lit("m "), s % 60, F.lit("s")))
    return text.otherwise(F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s % 3600 / 60), F.lit("m")))


def word_gate(form: str, digits: bool = False) -> Column:
    """Is it a word: letters (and apostrophes) only."""
    return F.col(form).rlike(r"^[\p{L}ʼ'’]+$" if not digits else r"^[\p{L}\p{N}ʼ'’]+$")


def parse_features(column: str) -> Column:
    """A 'key:value|key:value' text as a map; of equal keys the last counts."""
    pairs = F.filter(F.split(column, r"\|"), lambda p: F.instr(p, F.lit(":")) > 0)
    key = lambda p: F.substring_index(p, ":", 1)
    keys = F.array_distinct(F.transform(pairs, key))
    value = lambda k: F.element_at(F.filter(pairs, lambda p: key(p) == k), -1)
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.substring(value(k), F.length(k) + 2, F.length(value(k))))))


def validated(forms: DataFrame, pos: str = "pos", feats: str = "feats") -> DataFrame:
    """forms with a column error (null: valid): unknown part of speech, unknown
    feature key.  Rows are kept, so that bad ones can be put aside."""
    bad_pos = ~F.coalesce(F.col(pos), F.lit("X")).isin(UPOS)
    bad_key = F.exists(F.coalesce(F.map_keys(feats), F.array().cast("array<string>")), lambda k: ~k.isin(FEATURE_KEYS))
    return forms.withColumn("error", F.when(bad_pos, "unknown part of speech").when(bad_key, "unknown feature"))


def smoke_check(forms: DataFrame, expected: DataFrame) -> DataFrame:
    """word, expected, ok: whether some form of the word has that stress.

    forms: form_norm, stress (array); expected: word, expected (int).
    """
    seen = forms.groupBy("form_norm").agg(F.array_distinct(F.flatten(F.collect_set("stress"))).alias("seen"))
    met = expected.join(seen, F.col("word") == F.col("form_norm"), "left")
    return met.select("word", "expected", F.coalesce(F.array_contains("seen", F.col("expected")), F.lit(False)).cast("int").alias("ok"))


def size_mb(column: str) -> Column:
    """Megabytes of texts like '1.5 GB'; null if they are none."""
    number, unit = F.regexp_extract(column, r"^\s*([0-9.]+)\s*([KMGT]?)i?B\s*$", 1), F.regexp_extract(column, r"^\s*([0-9.]+)\s*([KMGT]?)i?B\s*$", 2)
    scale = F.when(unit == "T", 1024.0 * 1024).when(unit == "G", 1024.0).when(unit == "M", 1.0).when(unit == "K", 1 / 1024.0).otherwise(1 / 1048576.0)
    return F.try_to_number(number, F.lit("999999999.999999")).cast("double") * scale


def narrowed(best: Column, low: float, high: float, share: float = 0.5) -> tuple[Column, Column]:
    """A search range of share around the best value, within its bounds."""
    return F.greatest(F.lit(low), best * (1 - share)), F.least(F.lit(high), best * (1 + share))
