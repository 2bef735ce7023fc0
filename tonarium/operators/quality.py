"""Data quality: one pass over a table for each report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profiles import APOSTROPHE, WRONG_APOSTROPHES


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, nulls, empty (strings), rows."""
    kinds = dict(df.dtypes)
    columns = columns or df.columns
    one = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), (F.count_if(F.col(c) == "") if kinds[c] == "string" else F.lit(0).cast("long")).alias("empty"), F.count(F.lit(1)).alias("rows")).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.agg(*one).select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("r")).select("r.*")


def json_validity(df: DataFrame, column: str) -> DataFrame:
    """rows, invalid (text that isn't JSON; null counts as valid)."""
    bad = F.col(column).isNotNull() & F.try_parse_json(column).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("invalid"))


def distribution(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n most frequent values; ties in the order of values."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def stats(df: DataFrame, **measures: Column) -> DataFrame:
    """name, value (long): several measures in one pass."""
    row = df.agg(*[m.cast("long").alias(k) for k, m in measures.items()])
    return row.unpivot([], list(measures), "name", "value")


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, fingerprint: a hash of the rows in no order.

    Row digests are summed in four 32-bit parts, so the state is of fixed size
    and partial sums combine on the map side.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    digest = F.md5(text)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long"))
    sums = df.agg(F.count(F.lit(1)).alias("rows"), *[part(i).alias(f"s{i}") for i in range(4)])
    return sums.select("rows", F.md5(F.concat_ws(",", *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)])).alias("fingerprint"))


def apostrophe_report(df: DataFrame, column: str) -> DataFrame:
    """character (code point), n: apostrophes and what stands for them."""
    signs = F.regexp_extract_all(column, F.lit(f"([{APOSTROPHE}{WRONG_APOSTROPHES}])"), 1)
    found = df.select(F.explode(signs).alias("c"))
    return found.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select(F.expr("ascii(c)").alias("code"), (F.col("c") == APOSTROPHE).cast("int").alias("is_right"), "n")


def baseline_delta(n: Column, baseline: int, tolerance: float = 0.001) -> Column:
    return F.abs(n - baseline) / baseline <= tolerance
