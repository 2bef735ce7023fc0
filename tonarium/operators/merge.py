"""Merging dictionary sources: ordered, lossless, first source first.

Frames are flat word forms with ``lemma``, ``src_ord`` (order of sources) and
``form_ord`` (order inside a source).  Rows have no order of their own, so
every "first" is a window over these two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..sources.scratch import stored

ORDER = ("src_ord", "form_ord")


def canonical(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as keys that can be grouped: maps by their sorted entries."""
    return [F.array_sort(F.map_entries(f.name)).alias(f.name) if isinstance(f.dataType, MapType) else F.col(f.name) for f in map(df.schema.__getitem__, columns)]


def reduced(forms: DataFrame, keys: list[Column | str]) -> DataFrame:
    """The keys, src_ord and the least form_ord of each key and source: sums up
    in hash tables on the map side, so that common words hardly travel."""
    return forms.groupBy(*keys, "src_ord").agg(F.min("form_ord").alias("form_ord"))


def merge_sources(forms: DataFrame, fields: list[str]) -> DataFrame:
    """Per lemma: every row of its first source, and the distinct others.

    Two forms are the same if all ``fields`` are equal, nulls included; what is
    no field comes from the first such row.  Rows without a lemma go.  The rows
    of the first source meet a stored table, so that a common lemma is split.
    """
    own, others = merge_parts(forms, fields)
    return own.unionByName(others)


def merge_parts(forms: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two parts of merge_sources(): rows of the first source, the others.
    Rows that repeat fields and source may be left out but the first: the others
    are the same, and the first part says which are taken."""
    forms = forms.where("lemma IS NOT NULL")
    keys, names = canonical(forms, fields), [f"_k{i}" for i in range(len(fields))]
    least = stored(reduced(forms.withColumns(dict(zip(names, keys, strict=True))), ["lemma", *names]), "merge-distinct")
    first = stored(least.groupBy("lemma").agg(F.min("src_ord").alias("_first")), "merge-first")
    own = forms.join(first, "lemma").where("src_ord = _first").select(*forms.columns)
    least = least.groupBy("lemma", *names).agg(F.min(F.struct(*ORDER)).alias("_o")).select("lemma", F.col("_o.src_ord").alias("src_ord"), F.col("_o.form_ord").alias("form_ord"), *names)
    least = least.join(first, "lemma").where("src_ord > _first").drop("_first")
    if set(forms.columns) == {"lemma", *ORDER, *fields} and not any(isinstance(f.dataType, MapType) for f in forms.schema):
        others = least.withColumnsRenamed(dict(zip(names, fields, strict=True)))
    else:  # fetch the other columns of those rows
        others = forms.join(stored(least.select("lemma", *ORDER).distinct(), "merge-others"), ["lemma", *ORDER], "left_semi")
    return own, others.select(*forms.columns)


def lemma_patterns(forms: DataFrame, stress: str = "stress") -> DataFrame:
    """lemma, patterns: its distinct sorted stress patterns; lemmas without
    any are left out."""
    patterns = F.array_sort(F.collect_set(F.when(F.size(stress) > 0, F.array_sort(stress))))
    return forms.groupBy("lemma").agg(patterns.alias("patterns")).where(F.size("patterns") > 0)


def first_by(forms: DataFrame, keys: list[str], order: list = ORDER) -> DataFrame:
    """The first row of each key (insert-or-ignore); descending order keeps the
    last (insert-or-replace)."""
    ranked = forms.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rn = 1").drop("_rn")


def union_of_stress(forms: DataFrame, keys: list[str], rest: list[str], stress: str = "stress") -> DataFrame:
    """One row a key: the union of all patterns, other fields of the first row
    (words with several right stresses)."""
    first = F.min_by(F.struct(*rest), F.struct(*ORDER)).alias("_r")
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set(stress)))).alias(stress)
    return forms.groupBy(*keys).agg(union, first).select(*keys, stress, "_r.*")


def variative_merge(forms: DataFrame) -> DataFrame:
    """One row of each lemma, sense, part of speech and number, with the union
    of the patterns; a form without a number counts as singular, one without a
    part of speech as X.  Other fields come from the first row."""
    rows = forms.withColumn("number", F.coalesce(F.col("feats")["Number"], F.lit("Sing"))).withColumn("pos", F.coalesce("pos", F.lit("X")))
    keys = ["lemma", "sense_id", "pos", "number"]
    return union_of_stress(rows, keys, [c for c in forms.columns if c not in (*keys, *ORDER, "stress")])


def last_values(entries: DataFrame) -> DataFrame:
    """lemma, key, value: the latest source's value of each key of meta (map).
    The last ordinal of each value comes first: whole numbers are kept in hash
    tables, so that the rows of a common word are not sorted."""
    pairs = entries.select("lemma", *ORDER, F.explode("meta").alias("key", "value"))
    pairs = pairs.groupBy("lemma", "key", "value", "src_ord").agg(F.max("form_ord").alias("form_ord"))
    return pairs.groupBy("lemma", "key").agg(F.max_by("value", F.struct(*ORDER)).alias("value"))


def merged_meta(entries: DataFrame) -> DataFrame:
    """lemma, meta (map): keys of all sources, the latest source's value."""
    last = last_values(entries)
    return last.groupBy("lemma").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("meta"))
