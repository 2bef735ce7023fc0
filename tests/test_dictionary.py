"""The dictionary file against the plain writer, and the data source."""

import random

import pytest

from tonarium.sources import dictionary, sinks

LETTERS = "abcdeé'-"
SCHEMA = "form_norm string, stress int, stress2 int, is_variative boolean, is_heteronym boolean"


def words(n=400, seed=1):
    rng = random.Random(seed)
    forms = {"".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 7))) for _ in range(n)} | {"aa" + "b" * k for k in range(30)}
    return [(w, rng.randrange(0, 250), rng.choice([None, 3]), rng.random() < 0.3, rng.random() < 0.3) for w in sorted(forms)]


@pytest.mark.parametrize("size", [1, 7, dictionary.PIECE])
def test_file_equals_the_plain_writer(spark, tmp_path, size):
    rows = words(60 if size == 1 else 400)
    left_out = [("xyz", 1, None, False, False), ("abc" * 9, None, None, False, False), ("cab" * 9, 255, None, False, False)]
    frame = spark.createDataFrame(rows + left_out, SCHEMA).repartition(4)
    path = str(tmp_path / "words.bin")
    assert dictionary.write_dictionary(frame, f"file://{path}", LETTERS, size=size) == len(rows)
    names = SCHEMA.replace(" string", "").replace(" int", "").replace(" boolean", "").split(", ")
    assert open(path, "rb").read() == sinks._trie_bytes([dict(zip(names, r)) for r in rows], LETTERS)


def test_data_source(spark, tmp_path):
    rows, path = words(), str(tmp_path / "words.bin")
    dictionary.write_dictionary(spark.createDataFrame(rows, SCHEMA), path, LETTERS)
    dictionary.register(spark)
    for parts in (1, 3, 40):
        found = spark.read.format("packed_dictionary").option("parts", parts).load(path)
        assert sorted(map(tuple, found.collect())) == rows
    found = spark.read.format("packed_dictionary").option("parts", 3).load(path)
    for where, want in [("form_norm = 'aabb'", lambda w: w == "aabb"), ("form_norm LIKE 'aab%'", lambda w: w.startswith("aab")), ("form_norm IN ('aab', 'aabbb', 'zz')", lambda w: w in ("aab", "aabbb")), ("form_norm = 'zz'", lambda w: False), ("form_norm LIKE 'a%' AND stress > 100", None)]:
        some = found.where(where)
        keep = [r for r in rows if want(r[0])] if want else [r for r in rows if r[0][:1] == "a" and r[1] > 100]
        assert sorted(map(tuple, some.collect())) == keep
        if "stress" not in where:  # the source has taken the filter
            assert " Filter " not in some._jdf.queryExecution().executedPlan().toString()
    assert found.select("form_norm").where("form_norm IS NULL").count() == 0


def test_a_point_read_opens_few_bytes(spark, tmp_path):
    rows, path = words(6000, 2), str(tmp_path / "words.bin")
    dictionary.write_dictionary(spark.createDataFrame(rows, SCHEMA), path, LETTERS)
    nodes = dictionary.Nodes(path)
    at = nodes.descend("aabbb")
    assert dictionary._value(nodes.range(at, at + 1)[0])[0] == dict((r[0], r[1]) for r in rows)["aabbb"]
    assert nodes.read < 8000 < 8 * nodes.n and nodes.descend("aax") is None


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none.bin")
    assert dictionary.write_dictionary(spark.createDataFrame([], SCHEMA), path, LETTERS) in (0, None)
    assert open(path, "rb").read() == sinks._trie_bytes([], LETTERS)
    dictionary.register(spark)
    assert spark.read.format("packed_dictionary").load(path).count() == 0
