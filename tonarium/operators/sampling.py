"""Deterministic samples and splits: order by a digest, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*columns: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def stratified_sample(words: DataFrame, n: int, floor: int = 50, seed: int = 42) -> DataFrame:
    """At least ``floor`` words of each bucket (syllables, 7 and more together),
    the rest of n from all others, by digest.  words: form, pos, syllables."""
    rows = words.dropDuplicates(["form", "pos"]).where("syllables >= 2")
    rows = rows.withColumn("bucket", F.least("syllables", F.lit(7))).withColumn("_d", digest("form", "pos", seed=seed))
    order = ("_d", "form", "pos")
    # both parts keep few rows of each task before anything is shuffled
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where(F.col("_k") <= floor).drop("_k")
    rest = rows.orderBy(*order).limit(n + 6 * floor).join(first.select("form", "pos"), ["form", "pos"], "left_anti")
    both = first.withColumn("_r", F.lit(0)).unionByName(rest.withColumn("_r", F.lit(1)))
    return both.orderBy("_r", *order).limit(n).drop("_d", "_r")


def group_split(key: Column, tenths: int = 1) -> Column:
    """'test' for about tenths/10 of the keys, else 'train': a key is never in
    both."""
    return F.when(F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(10)) < tenths, "test").otherwise("train")


def weighted_batch(rows: DataFrame, kind: str, shares: dict[str, int], id_col: str, seed: int = 42) -> DataFrame:
    """So many rows of each kind, by digest."""
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(digest(id_col, seed=seed), id_col))
    quota = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    rows = rows.withColumn("_k", rank).where(F.col("_k") <= max(shares.values()))
    return rows.where(F.col("_k") <= F.coalesce(F.try_element_at(quota, F.col(kind)), F.lit(0))).drop("_k")


def oversample(rows: DataFrame, weight: Column) -> DataFrame:
    """Each row as often as its integer weight says (0: not at all)."""
    return rows.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(1), F.greatest(weight, F.lit(1))), lambda i: i <= weight)))


def newest_versions(rows: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The n first rows of each key in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def bag_union(**parts: DataFrame) -> DataFrame:
    """The rows of all parts, repeats included, with the part's name in a column
    part; columns are matched by name, what a part lacks is null."""
    if not parts:
        raise ValueError("no parts")
    first, *rest = (df.withColumn("part", F.lit(name)) for name, df in parts.items())
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
