"""The table function for payloads against the reader of byte tries."""

import pytest
from pyspark.sql import functions as F

from tonarium.functions import registry
from tonarium.profiles import LATIN
from tonarium.sources import readers

ROWS = [("casa", "0002FE61FF"), ("lobo", "02FF04FE1112FE"), ("", "01FF"), ("aeiou", "050301FAFF"), ("x", None), ("y", ""), ("casa", "0400FF"), (None, "01")]


def test_equals_the_reader(spark):
    registry.register(spark, LATIN)
    rows = spark.createDataFrame(ROWS, "word string, hex string").select("word", F.unhex("hex").alias("payload"))
    rows.createOrReplaceTempView("packed_words")
    want = sorted((r.word, r.record, r.stress) for r in readers.trie_payloads(rows.where("word IS NOT NULL"), LATIN).collect())
    for call in ("TABLE(packed_words)", "TABLE(packed_words) PARTITION BY word", "TABLE(packed_words) WITH SINGLE PARTITION"):
        found = spark.sql(f"SELECT * FROM payloads({call})").where("word IS NOT NULL").collect()
        assert sorted((r.word, r.record, r.stress) for r in found) == want
        assert {tuple(r.tags) for r in found if r.word == "lobo"} == {(), (17, 18)}
    with pytest.raises(Exception, match="word"):
        spark.sql("SELECT * FROM payloads(TABLE(SELECT 1 AS a))").collect()
