"""Dictionary sources: marked text, trie payloads, nested JSON lines, lists.

Readers keep the order of their input in columns (file line, place in the
line or array), because later "first" rules need it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dialect as X
from ..profiles import POS_NAMES, TAG_FEATURES, TRIE_TAGS, UKRAINIAN, Profile

S = X.SPARK


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (long, from 0 over all files in the order of their names),
    value: text files, also compressed ones, with the order of their lines.

    Spark deals splits by size, so its row ids order lines inside a split only.
    Splits are ordered by file and first byte; running sums of their counts give
    the numbers.  Only one row a split is brought together for that.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_from").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file", "_from").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_from", (F.coalesce(before, F.lit(0)) - F.col("_least")).alias("_shift"))
    return rows.join(splits, ["file", "_from"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def map_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def marked_text(rows: DataFrame, profile: Profile = UKRAINIAN) -> DataFrame:
    """line, at, form, stress: words of a marked-text dictionary.

    rows: line, value; other columns, or none but value, are kept as they are
    (equal lines may come once, with their number).  Blank lines and comments go, hyphens part words; the
    marks are U+0301 and U+00B4.  A word of one vowel needs no mark; unmarked
    longer words go.
    """
    rows = rows.where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    own = [c for c in rows.columns if c != "value"]
    words = rows.select(*own, F.posexplode(F.split(F.trim(F.regexp_replace("value", "-", " ")), r"\s+")).alias("at", "raw")).where("raw <> ''")
    words = words.withColumn("raw", F.lower(F.translate("raw", "´", "́")))
    words = words.selectExpr(*own, "at", f"{X.normal_apostrophes(S, X.without_marks(S, 'raw'))} AS form", f"{X.stress_indices(S, 'raw', profile)} AS stress")
    words = words.withColumn("stress", F.expr(f"CASE WHEN size(stress) = 0 AND {X.vowel_count(S, 'form', profile)} = 1 THEN array(0) ELSE stress END"))
    return words.where(F.size("stress") > 0)


def single_values(rows: DataFrame) -> DataFrame:
    """word, payload of the words that have exactly one distinct value."""
    found = rows.groupBy("word").agg(F.count_distinct("payload").alias("n"), F.min("payload").alias("payload"))
    return found.where("n = 1").select("word", "payload")


def trie_payloads(rows: DataFrame, profile: Profile = UKRAINIAN) -> DataFrame:
    """word, record, stress, pos, feats: decoded (word, payload) rows.

    Records end with 0xFF; a record is stress positions, then after 0xFE tag
    bytes.  A position p stresses character p - 1; zero, positions on other
    letters and beyond the word go.  Unknown tags are ignored.
    """
    byte = "conv(substr(h, 2 * i + 1, 2), 16, 10)"
    rows = rows.withColumn("h", F.hex("payload"))
    rows = rows.withColumn("bytes", F.expr(f"transform(filter(sequence(0, greatest(0, length(h) div 2 - 1)), i -> 2 * i < length(h)), i -> int({byte}))"))
    text = F.expr("array_join(transform(bytes, b -> if(b = 255, '/', concat(b, ','))), '')")
    rows = rows.select("word", F.posexplode(F.filter(F.split(text, "/"), lambda r: r != "")).alias("record", "r"))
    numbers = lambda k: F.transform(F.filter(F.split(F.coalesce(F.get(F.split("r", r"(?:^|(?<=,))254,"), F.lit(k)), F.lit("")), ","), lambda x: x != ""), lambda x: x.cast("int"))
    rows = rows.withColumn("places", numbers(0)).withColumn("tags", numbers(1)).withColumn("low", F.lower("word"))
    rows = rows.withColumn("v", F.expr(X.vowel_positions(S, "low", profile)))
    stress = "array_sort(array_distinct(transform(filter(places, p -> p > 0 AND array_contains(v, p - 1)), p -> int(array_position(v, p - 1) - 1))))"
    key, value = (map_of({str(b): x[i] for b, x in TRIE_TAGS.items()}) for i in (0, 1))
    known = F.filter("tags", lambda t: F.try_element_at(key, t.cast("string")).isNotNull())
    pairs = F.transform(known, lambda t: F.struct(F.element_at(key, t.cast("string")).alias("k"), F.element_at(value, t.cast("string")).alias("v")))
    rows = rows.withColumn("stress", F.expr(stress)).withColumn("_p", pairs)
    pos = F.try_element_at(F.filter("_p", lambda p: p["k"] == "upos"), F.lit(-1))["v"]
    return rows.select("word", "record", "stress", pos.alias("pos"), last_wins(F.filter("_p", lambda p: p["k"] != "upos")).alias("feats"))


def last_wins(pairs: Column) -> Column:
    """A map of (k, v) pairs; of equal keys the last counts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


_TEMPLATE = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType())), T.StructField("expansion", T.StringType())]))
#: Entries of the nested JSON dictionary.
ENTRY = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("word", "pos", "lang", "lang_code", "etymology_text")],
        T.StructField("etymology_number", T.IntegerType()),
        *[T.StructField(c, _TEMPLATE) for c in ("head_templates", "inflection_templates", "etymology_templates")],
        T.StructField("forms", T.ArrayType(T.StructType([T.StructField("form", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("roman", T.StringType())]))),
        T.StructField("sounds", T.ArrayType(T.StructType([T.StructField("ipa", T.StringType())]))),
        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField(
            "senses",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.StringType()),
                        T.StructField("glosses", T.ArrayType(T.StringType())),
                        T.StructField("tags", T.ArrayType(T.StringType())),
                        T.StructField("categories", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
                    ]
                )
            ),
        ),
    ]
)
BAD_FORMS, BAD_TAGS = ("no-table-tags", "uk-ndecl"), ("inflection-template", "table-tags", "romanization")


def normal_pos(pos: Column) -> Column:
    """The part of speech by its name; unknown: X; null or empty: null."""
    return F.when(pos.isNull() | (pos == ""), None).otherwise(F.coalesce(F.try_element_at(map_of(POS_NAMES), F.lower(pos)), F.lit("X")))


def normal_tags(tags: Column) -> Column:
    """Trimmed, lower-case, distinct and sorted; null if none is left."""
    out = F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))
    return F.when(F.size(out) > 0, out)


def tag_features(tags: Column) -> Column:
    key, value = (map_of({t: x[i] for t, x in TAG_FEATURES.items()}) for i in (0, 1))
    known = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.try_element_at(key, t).isNotNull())
    return last_wins(F.transform(known, lambda t: F.struct(F.element_at(key, t).alias("k"), F.element_at(value, t).alias("v"))))


def nested_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries in the order of their lines; lines that aren't JSON go."""
    raw = lines(spark, path).where("trim(value) <> ''")
    return raw.select("line", F.from_json("value", ENTRY).alias("e")).select("line", "e.*").where("word IS NOT NULL")


def scan_counts() -> dict[str, Column]:
    """Counts over the columns v (line) and e (entry) of parsed_lines(): lines,
    empty, broken (no JSON or no word), entries, forms, dropped_forms (not
    valid), unmarked_forms (valid, without stress)."""
    forms = F.coalesce("e.forms", F.array().cast(ENTRY["forms"].dataType))
    valid = F.filter(forms, _is_valid)
    unmarked = F.filter(valid, lambda f: ~F.contains(f["form"], F.lit("\u0301")))
    good = F.col("e.word").isNotNull()
    return {
        "lines": F.count(F.lit(1)),
        "empty": F.count_if(F.col("v") == ""),
        "broken": F.count_if((F.col("v") != "") & ~F.coalesce(good, F.lit(False))),
        "entries": F.count_if(good),
        "forms": F.sum(F.when(good, F.size(forms)).otherwise(0)),
        "dropped_forms": F.sum(F.when(good, F.size(forms) - F.size(valid)).otherwise(0)),
        "unmarked_forms": F.sum(F.when(good, F.size(unmarked)).otherwise(0)),
    }


def parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """v (trimmed line) and e (its entry, if any), in no order: one scan."""
    return spark.read.text(path).select(F.trim("value").alias("v"), F.from_json("value", ENTRY).alias("e"))


def scan_report(spark: SparkSession, path: str) -> DataFrame:
    """What scan_counts() says of a nested dictionary."""
    return parsed_lines(spark, path).agg(*[c.alias(k) for k, c in scan_counts().items()])


def _is_valid(f: Column) -> Column:
    """A form that is a word: not one of the table's own marks."""
    bad = F.arrays_overlap(F.coalesce(f["tags"], F.array().cast("array<string>")), F.array(*[F.lit(t) for t in BAD_TAGS]))
    return f["form"].isNotNull() & ~f["form"].isin(*BAD_FORMS) & ~bad


def entry_forms(entries: DataFrame, profile: Profile = UKRAINIAN) -> DataFrame:
    """One row for each sense and valid form of an entry: lemma, form, stress,
    pos, feats, main_definition, alt_definitions, ipa, categories, sense_id,
    tags, roman, etymology and their order."""
    empty = F.array().cast("array<string>")
    senses = entries.select("*", F.posexplode_outer("senses").alias("sense_at", "sense"))
    rows = senses.select("*", F.posexplode("forms").alias("form_at", "f"))
    rows = rows.where(_is_valid(F.col("f")))
    rows = rows.withColumn("raw", F.lower("f.form")).withColumn("stress", F.expr(X.stress_indices(S, "raw", profile))).where(F.size("stress") > 0)
    names = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<name:string>>")), lambda x: x["name"])
    own = names(F.col("categories"))
    return rows.select(
        F.expr(X.normal_apostrophes(S, X.without_marks(S, "word"))).alias("lemma"),
        F.expr(X.normal_apostrophes(S, X.without_marks(S, "f.form"))).alias("form"),
        "stress",
        normal_pos(F.col("pos")).alias("pos"),
        tag_features(normal_tags(F.col("f.tags"))).alias("feats"),
        F.get("sense.glosses", F.lit(0)).alias("main_definition"),
        F.slice(F.coalesce("sense.glosses", empty), F.lit(2), F.greatest(F.lit(1), F.size(F.coalesce("sense.glosses", empty)))).alias("alt_definitions"),
        F.get(F.filter(F.transform("sounds", lambda s: s["ipa"]), lambda i: i.isNotNull()), F.lit(0)).alias("ipa"),
        F.when(F.size(own) > 0, own).otherwise(names(F.col("sense.categories"))).alias("categories"),
        F.col("sense.id").alias("sense_id"),
        normal_tags(F.col("f.tags")).alias("tags"),
        F.col("f.roman").alias("roman"),
        F.col("etymology_text").alias("etymology"),
        "etymology_number",
        "line",
        "sense_at",
        "form_at",
    )


def word_list(rows: DataFrame, profile: Profile = UKRAINIAN) -> DataFrame:
    """form_norm: words of a list, one a line, comments left out."""
    rows = rows.where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    return rows.selectExpr(f"{X.dictionary_form(S, 'trim(value)', profile)} AS form_norm").distinct()


def hand_tests(spark: SparkSession, path: str) -> DataFrame:
    """word, pos, expected (array; null: not scored), description, feats."""
    kinds = "word string, pos string, expected_vowel_index string, description string, features_json string"
    rows = spark.read.option("header", True).option("comment", "#").option("enforceSchema", True).schema(kinds).csv(path)
    expected = F.when(F.trim(F.coalesce("expected_vowel_index", F.lit(""))) != "", F.transform(F.split("expected_vowel_index", ","), lambda x: F.trim(x).cast("int")))
    return rows.where("word IS NOT NULL AND NOT startswith(ltrim(word), '#')").select(
        F.expr(X.normal_apostrophes(S, "word")).alias("word"), F.coalesce(F.when(F.trim("pos") != "", F.trim("pos")), F.lit("X")).alias("pos"), expected.alias("expected"), "description", F.col("features_json").alias("feats")
    )


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """The columns that training needs of an exported table, by pushdown."""
    return spark.read.parquet(path).select("lemma", "form", "stress_indices", "pos", "features_json", "variant_type")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of whole files, to see whether a source has changed."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
