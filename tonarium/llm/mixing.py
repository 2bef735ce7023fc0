"""Mixing sources to target weights, as a time-varying curriculum.

Targets: sources in code-point order (null last) get the weights in turn and
share ``share`` times all words; no target exceeds ``cap`` times its source,
and what it would exceed is shared again by weight.  Sorted by the level at
which they are full, the sources need one pass of running sums for that.

Order: a source's documents are laid end to end in the order of a hash of
doc_id and text (many rows may lack an id or repeat one), again and again until
the target is full.  The running sums have two
levels: sums over about sqrt(n) hash ranges of a source, then sums within a
range, so that no task holds a whole source.

Curriculum: a source's weight changes linearly over training time 0 to 1.  Its
integral is the share of the target that is due by then; inverting it at the
words that lie before a document gives the document's training position, and
sorting all copies by position gives the training order.  All of it is
DataFrame expressions.

Cases: null or empty texts have no words and are never taken; a source whose
documents are all empty has target 0; ties in the hash are ordered by doc_id;
repeated rows are documents of their own; an empty table gives an empty
result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, text_of, written

WEIGHTS = (3, 1, 2)
#: Relative weight at the start and the end of training, in turn like WEIGHTS.
SCHEDULE = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))
SHARE, CAP = 1.5, 2


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, schedule=SCHEDULE, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a source: _key, source_size, target, _quota (whole words),
    _buckets, _a and _b (its schedule).  Windows here run over sources."""
    totals = sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (turn + 1).cast("int"))
    totals = totals.select("*", pick(weights).alias("_w"), pick([a for a, _ in schedule]).alias("_a"), pick([b for _, b in schedule]).alias("_b"))
    totals = totals.withColumn("_cap", (F.col("source_size") * cap).cast("double")).withColumn("_level", F.col("_cap") / F.col("_w"))
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    totals = totals.select("*", ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)).alias("_try"))
    level = F.max(F.when(F.col("_try") <= F.col("_level"), F.col("_try"))).over(everything)
    target = F.least(F.col("_cap"), level * F.col("_w"))
    totals = totals.select("_key", "source_size", F.coalesce(target, "_cap").alias("target"), F.ceil(F.sqrt("_n")).alias("_buckets"), "_a", "_b")
    return totals.withColumn("_quota", F.floor(F.col("target") + 0.5).cast("long"))


def time_of(share: Column, a: Column, b: Column) -> Column:
    """When this share of a source's words is due, if its weight goes from a to b."""
    below = a + F.sqrt(a * a + (b - a) * (a + b) * share)
    return F.when(below > 0, share * (a + b) / below).otherwise(F.lit(0.0))


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedule=SCHEDULE, share: float = SHARE, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted),
    copies (array of training position and words, one for each time that the
    document is taken; the last document of a source may be taken in part),
    and kept (a struct of the columns in keep, if any).  Kept columns also order
    rows of one doc_id, and aren't stored on the way: docs is read three times."""
    kept = [F.struct(*keep).alias("kept")] if keep else []
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_text"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"), F.md5(text_of(text_col)).alias("_text"), *kept)
    sized = sized.select("*", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), order.alias("_order")).drop("_text")
    sized = sized if keep else written(sized, "mix-sizes")
    targets = written(source_targets(sized, weights, schedule, share, cap), "mix-targets")
    rank = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    placed = sized.join(targets, "_key").withColumn("_bucket", F.floor(rank * F.col("_buckets") / 4294967296.0).cast("long"))
    sums = placed.groupBy("_key", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.select("_key", "_bucket", (F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("_sum")).alias("_offset"))
    sums = written(sums, "mix-offsets")
    within = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", *([F.xxhash64("kept")] if keep else [])).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_before", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(sums, ["_key", "_bucket"]).withColumn("_begin", F.col("_offset") + F.col("_before"))
    copy = lambda e: F.struct(
        time_of((F.col("_begin") + e * F.col("source_size")) / F.col("_quota"), F.col("_a"), F.col("_b")).alias("position"),
        F.least(F.col("size"), F.col("_quota") - (F.col("_begin") + e * F.col("source_size"))).alias("words"),
    )
    due = F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda e: (F.col("size") > 0) & (F.col("_begin") + e * F.col("source_size") < F.col("_quota")))
    placed = placed.withColumn("copies", F.transform(due, copy))
    return placed.select("doc_id", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"]).alias("taken"), "copies", *(["kept"] if keep else []))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of them, in training order of
    their first copy (documents that are not taken come first)."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    position = F.round(F.get("copies", F.lit(0))["position"], 9).alias("position")
    return plan.select("doc_id", "size", "source_size", "target", "taken", position).orderBy("position", "doc_id")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS o FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
turned AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM totals),
weighed AS (
  SELECT *, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         CASE turn WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS a,
         CASE turn WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS b,
         (2 * s)::DOUBLE AS cap FROM turned),
tried AS (
  SELECT *, cap / w AS lev,
         (sum(s) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM weighed),
aimed AS (SELECT *, least(cap, max(CASE WHEN try <= lev THEN try END) OVER () * w) AS target FROM tried),
quota AS (SELECT *, floor(target + 0.5)::BIGINT AS q FROM aimed),
begun AS (
  SELECT z.doc_id, z.size, t.s, t.target, t.q, t.a, t.b,
         (sum(z.size) OVER (PARTITION BY z.source ORDER BY z.o, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - z.size)::BIGINT AS begin
  FROM sized z JOIN quota t ON z.source IS NOT DISTINCT FROM t.source),
shares AS (SELECT *, CASE WHEN size > 0 AND begin < q THEN begin::DOUBLE / q END AS u FROM begun)
SELECT doc_id, size, s AS source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(size, q - begin)) + greatest(0, least(size, q - begin - s)) END::BIGINT AS taken,
       round(CASE WHEN u IS NULL THEN NULL WHEN a + sqrt(a * a + (b - a) * (a + b) * u) > 0 THEN u * (a + b) / (a + sqrt(a * a + (b - a) * (a + b) * u)) ELSE 0 END, 9) AS position
FROM shares
"""
