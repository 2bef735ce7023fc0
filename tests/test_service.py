from pyspark.sql import functions as F

from tonarium.operators import evaluate, service


def test_lookup_and_view(spark):
    forms = spark.createDataFrame([("a", "ab"), ("b", "b"), ("c", "a"), ("d", "e")], "lemma string, form string")
    got = service.point_lookup(forms, spark.createDataFrame([("a",), ("b",), ("a",)], "word string"))
    assert sorted(map(tuple, got.collect())) == [("a", "ab"), ("b", "b"), ("c", "a")]
    lexicon = spark.createDataFrame([("x", [0], "NOUN"), ("x", [1], "ADJ"), ("x", [1], None), ("y", [], "X")], "form_norm string, stress array<int>, pos string")
    assert sorted(map(tuple, service.service_view(lexicon).collect())) == [("x", 2, 1, "ADJ,NOUN"), ("y", 1, 0, "X")]


def test_parse_and_validate(spark):
    row = spark.createDataFrame([("Case:Nom|Case:Gen|X:a:b|bad",), ("",), (None,)], "f string").select(service.parse_features("f").alias("m")).collect()
    assert [r.m for r in row] == [{"Case": "Gen", "X": "a:b"}, {}, None]
    rows = spark.sql("SELECT * FROM VALUES ('NOUN', map('Case', 'Nom')), ('nope', NULL), (NULL, map('Colour', 'Red')), (NULL, NULL) AS t(pos, feats)")
    assert [r.error for r in service.validated(rows).collect()] == [None, "unknown part of speech", "unknown feature", None]


def test_small_things(spark):
    frame = spark.createDataFrame([("1.5 GB",), ("512 KB",), ("x",), (None,), ("7 MiB",)], "s string")
    assert [r[0] for r in frame.select(service.size_mb("s")).collect()] == [1536.0, 0.5, None, None, 7.0]
    words = spark.createDataFrame([("мʼяч",), ("a1",), ("",), ("don't",)], "w string")
    assert [r[0] for r in words.select(service.word_gate("w")).collect()] == [True, False, False, True]
    low, high = service.narrowed(F.lit(10.0), 6.0, 100.0)
    assert tuple(spark.range(1).select(low, high).first()) == (6.0, 15.0)
    seen = spark.createDataFrame([("вода", [1])], "form_norm string, stress array<int>")
    expected = spark.createDataFrame([("вода", 1), ("вода", 0), ("немає", 0)], "word string, expected int")
    assert sorted(map(tuple, service.smoke_check(seen, expected).collect())) == [("вода", 0, 0), ("вода", 1, 1), ("немає", 0, 0)]
    trials = spark.createDataFrame([(i, i / 10, float(i)) for i in range(20)], "trial int, fitness double, leaves double")
    assert tuple(evaluate.landscape(trials, ["leaves"], 5).first()) == ("leaves", 15.0, 19.0, 17.0)


def test_rendered_variants(spark):
    from tonarium.profiles import LATIN

    rows = [("banana", [1], 9), ("banana", [0], 4), ("banana", [1], 2), ("banana", [], 11), ("xyz", None, 1), ("xyz", [], 2), ("ala", [0, 1], 3), ("ala", [7], 5), (None, [0], 1)]
    lexicon = spark.createDataFrame(rows, "form_norm string, stress array<int>, form_ord long").withColumn("variants", F.lit("clash"))
    got = {r.form_norm: (r.variants, r.is_heteronym) for r in service.rendered_variants(lexicon, LATIN).collect()}
    assert got["banana"] == (["banána", "bánana", "banana"], 1)
    assert got["ala"] == (["álá", "ala"], 1) and got["xyz"] == (["xyz"], 0) and len(got) == 3
    assert service.rendered_variants(lexicon.limit(0), LATIN).count() == 0
