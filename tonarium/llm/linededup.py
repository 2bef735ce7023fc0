"""Line dedup by overlapping windows of three consecutive lines.

Every run of ``window`` consecutive lines is hashed (128 bits over the lines
joined by line feeds).  A hash that occurs more than once keeps its earliest
occurrence; the positions that its later occurrences cover are merged for each
document, and the lines there are removed.  Windows are judged on the input,
not on what is left.  All of it is DataFrame expressions.

Occurrences are ordered by doc_id (null first), then the text's hash, then
position.  The first occurrences of repeated windows are written as a table,
so that the join back to all occurrences has an exchange on either side and a
window that many documents share is split among tasks.

Cases: a null text stays null, an empty one empty; a text of fewer lines than a
window has no window and stays as it is; rows that repeat a doc_id and text are
one document and are all kept alike; of different texts under one doc_id the
smaller hash comes first; an empty table gives an empty result; other columns
pass through, whatever their names, but for columns of the names n_lines and
n_lines_removed, which the new ones replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 3


def occurrences(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """doc, hash of its text, position, window hash: one row for each window."""
    lines = F.split(text_col, "\n", -1)
    docs = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.xxhash64(F.col(text_col)).alias("_text"), lines.alias("_lines"))
    docs = docs.where(F.size("_lines") >= window)
    key = lambda i: F.unhex(F.md5(F.array_join(F.slice("_lines", i, window), "\n")))
    return docs.select("_doc", "_text", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_lines") - (window - 1)), key)).alias("_at", "_key"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents, later occurrences of repeated windows removed from the
    text, and two more columns: n_lines and n_lines_removed (long; null text:
    null and 0)."""
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of its own can clash
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    found = written(occurrences(docs, id_col, text_col, window), "line-occurrences")
    first = found.groupBy("_key").agg(F.min(F.struct("_doc", "_text", "_at")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = written(first.where("_n > 1").select("_key", "_first"), "line-windows")
    later = found.join(first, "_key").where(~F.struct("_doc", "_text", "_at").eqNullSafe(F.col("_first")))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("_at"), lambda p: F.sequence(p, p + (window - 1)))))
    later = later.groupBy("_doc", "_text").agg(covered.alias("_covered"))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_covered")), lambda i: F.get(lines, i))
    joined = docs.join(later, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col(text_col)) == F.col("_text")), "left")
    text = F.when(F.col("_covered").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(text if c == text_col else F.col(c)).alias(name) for c, name in zip(docs.columns, names, strict=True) if name not in ("n_lines", "n_lines_removed")],
        F.when(F.col(text_col).isNotNull(), F.size(lines).cast("long")).alias("n_lines"),
        F.when(F.col("_covered").isNull(), F.lit(0)).otherwise(F.size("_covered")).cast("long").alias("n_lines_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later occurrences of three-line windows."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM docs WHERE len(lines) >= 3),
keyed AS (
  SELECT doc_id, pos, array_to_string(list_slice(lines, pos, pos + 2), chr(10)) AS k FROM windows),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM keyed),
covered AS (
  SELECT DISTINCT doc_id, pos + i AS pos FROM ranked, (VALUES (0), (1), (2)) v(i) WHERE n > 1),
lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM docs),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL) AS text,
         count(*) AS n_lines, count(c.pos) AS n_lines_removed
  FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       k.n_lines, coalesce(k.n_lines_removed, 0) AS n_lines_removed
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
