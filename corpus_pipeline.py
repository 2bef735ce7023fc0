"""A corpus pipeline from five of the training-data operators.

Each stage reads what its predecessor wrote.  All but the last return the
columns of documents; the last returns the pieces of packed sequences.

Cases, of every stage: an empty table gives an empty one; null and empty texts
are kept by the stages that filter and have no words for the mix, which leaves
them out; rows without a doc_id, and rows that repeat one, are rows like others;
without labels a short list of public insults decides what is toxic; other
columns than those of documents go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonarium.llm import common, linededup, mixing, nearcopies, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; documents of
    which nothing is left go."""
    kept = linededup.dedup_lines(docs.select(*COLUMNS))
    kept = kept.where((F.col("n_lines_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (those that similarities of
    0.8 or more of five-word shingles connect; SimHash fingerprints find the pairs
    within three bits, min-hashes those beyond): a row of its smallest doc_id, or
    one without a doc_id if no row of the group has one.  Rows that share a
    doc_id, or lack one, are told apart by their row numbers.
    """
    rows = common.written(nearcopies.marked(docs.select(*COLUMNS)), "near-prints")  # fixes the row numbers
    found = rows.select("_print", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text"), F.xxhash64(*COLUMNS), "_row").alias("_key"))
    found = found.join(nearcopies.groups(rows), F.col("_print") == F.col("node"), "left").select(F.coalesce("root", "_print").alias("group"), "_key")
    found = common.written(found, "near-keys")
    least = found.groupBy("group").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("group", "least")
    others = found.join(common.written(least, "least"), "group").where("_key._row <> least._row").select("_key._row")
    return rows.join(common.written(others, "others"), "_row", "left_anti").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order.  A copy
    that the mix takes in part is there if over half of its words are due.
    Documents without a doc_id, and rows that repeat one, are taken like others."""
    plan = mixing.plan_mix(docs.select(*COLUMNS), keep=tuple(COLUMNS))
    copies = plan.select("kept", "size", F.explode("copies").alias("c")).where(F.col("c.words") * 2 > F.col("size"))
    return copies.select("kept.*", F.col("c.position").alias("position")).orderBy("position", "doc_id").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the mix as pieces of sequences of at most 4096 tokens."""
    return packing.digest(packing.pack_documents(docs, packing.tokenizer_path()))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: The toxicity model and fingerprint links can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's output written and reread;
    what a stage wrote on the way goes once its output is written."""
    docs, since = common.table(spark, sf_dir, "documents"), common.made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs, name)
            common.clean(spark, since, but=docs)
    return docs
