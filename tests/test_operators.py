import random

from pyspark.sql import functions as F

from tonarium.operators import evaluate, merge, quality, resolve, sampling, variants


def test_merge_equals_a_fold(spark):
    rng = random.Random(2)
    rows = []
    for s in range(3):
        for i in range(200):
            rows.append((rng.choice("abcdefgh"), s, i, rng.choice(["x", "y", None]), rng.choice(["N", "V"])))
    want = {}
    for lemma, s, i, form, pos in sorted(rows, key=lambda r: (r[1], r[2])):
        kept = want.setdefault(lemma, (s, []))
        if kept[0] == s or (form, pos) not in [k[:2] for k in kept[1]]:
            kept[1].append((form, pos, s, i))
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "lemma string, src_ord int, form_ord int, form string, pos string")
    got = {(r.lemma, r.form, r.pos, r.src_ord, r.form_ord) for r in merge.merge_sources(frame, ["form", "pos"]).collect()}
    assert got == {(k, *x) for k, (_, v) in want.items() for x in v}


def test_patterns_and_unions(spark):
    frame = spark.createDataFrame([("a", 0, 0, [1], "f"), ("a", 0, 1, [1, 0], "g"), ("a", 1, 0, [1], "h"), ("b", 0, 0, [], "i")], "lemma string, src_ord int, form_ord int, stress array<int>, form string")
    assert [(r.lemma, r.patterns) for r in merge.lemma_patterns(frame).collect()] == [("a", [[0, 1], [1]])]
    got = {r.lemma: (r.stress, r.form) for r in merge.union_of_stress(frame, ["lemma"], ["form"]).collect()}
    assert got == {"a": ([0, 1], "f"), "b": ([], "i")}
    meta = spark.sql("SELECT 'a' AS lemma, 0 AS src_ord, 0 AS form_ord, map('k', '1', 'l', '2') AS meta UNION ALL SELECT 'a', 1, 0, map('k', '3')")
    assert merge.merged_meta(meta).first().meta == {"k": "3", "l": "2"}


def test_variant_types(spark):
    rows = [
        ("замок", "[0]", "NOUN", None, "castle"), ("замок", "[1]", "NOUN", None, "lock"),
        ("блоха", "[0]", "NOUN", "Case=Nom", "flea"), ("блоха", "[1]", "NOUN", "Case=Gen", "flea"),
        ("помилка", "[0]", "NOUN", None, "error"), ("помилка", "[1]", "NOUN", None, "error"), ("книга", "[0]", "NOUN", None, None), ("книга", "[0]", "VERB", None, "x"),
    ]
    got = {r.lemma: (r.variant_type, r.is_disambiguable, r.is_homonym) for r in variants.variant_types(spark.createDataFrame(rows, "lemma string, pattern string, pos string, feats string, definition string")).collect()}
    assert got == {"замок": ("grammatical_homonym", 1, 1), "блоха": ("morphological_variant", 1, 1), "помилка": ("free_variant", 0, 1), "книга": ("single", 0, 0)}


def test_heteronyms(spark):
    frame = spark.createDataFrame([("a", 1, [2, 1]), ("a", 0, [1]), ("b", 0, [0]), ("b", 1, [1]), ("c", 0, [3])], "form_norm string, ord int, stress array<int>")
    listed = spark.createDataFrame([("b",), ("c",)], "form_norm string")
    got = {r.form_norm: tuple(r)[1:] for r in variants.heteronyms(frame, listed).collect()}
    assert got == {"a": (1, 2, 2, False, True), "b": (0, 1, 2, True, False), "c": (3, None, 1, False, False)}


def test_conflicts(spark):
    frame = spark.createDataFrame([("a", "n", "1"), ("a", "n", "2"), ("b", "n", "1"), ("b", "n", None), (None, "n", "1")], "form string, pos string, s string")
    assert {(r.form, r.s) for r in variants.conflict_filter(frame, ["form", "pos"], "s").collect()} == {("b", "1"), ("b", None)}
    assert [tuple(r) for r in variants.conflict_report(frame, "form", "s").collect()] == [("a", 2, "1|2")]


def test_resolution(spark):
    lexicon = spark.sql("""SELECT * FROM VALUES
      ('замок', 0, array(0), array('NOUN'), map('Case', array('Nom'), 'Number', array('Sing', 'Plur'))),
      ('замок', 1, array(1), array('VERB'), map('Case', array('Gen'))),
      ('кава', 0, array(0), array('NOUN'), map('Case', array('Nom'))) AS t(form_norm, ord, stress, pos, feats)""")
    tokens = spark.sql("""SELECT * FROM VALUES (1, 'замок', 'noun', map('Case', 'Nom', 'Number', 'Sing')), (2, 'замок', 'NOUN', map('Case', 'Nom', 'Number', 'Dual')),
      (3, 'замок', 'VERB', map('X', 'Y')), (4, 'замок', 'ADV', map('X', 'Y')), (5, 'кава', 'ADV', NULL), (6, 'немає', 'NOUN', NULL) AS t(token_id, form_norm, pos, feats)""")
    got = {r.token_id: (r.stress, round(r.score, 6), r.confidence) for r in resolve.resolve(tokens, lexicon).collect()}
    assert got == {1: ([0], 0.8, "exact"), 2: ([0], 0.6, "partial"), 3: ([1], 0.4, "fallback"), 4: ([0], 0.0, "fallback"), 5: ([0], 1.0, "exact"), 6: (None, 0.0, "none")}
    covered = resolve.coverage(resolve.resolve(tokens, lexicon), "form_norm").collect()
    assert {r.form_norm: r.percent for r in covered} == {"замок": 100.0, "кава": 100.0, "немає": 0.0}


def test_samples(spark):
    frame = spark.createDataFrame([(f"w{i}", "N", 2 + i % 8) for i in range(500)] + [("w0", "N", 2), ("x", "N", 1)], "form string, pos string, syllables int")
    got = sampling.stratified_sample(frame, 200, floor=20).collect()
    assert len(got) == 200 and len({r.form for r in got}) == 200
    assert min(sum(r.bucket == b for r in got) for b in range(2, 8)) >= 20
    assert sorted(got) == sorted(sampling.stratified_sample(frame, 200, floor=20).collect())
    split = frame.select("form", sampling.group_split(F.col("form")).alias("s")).distinct()
    assert split.count() == 501 and 20 < split.where("s = 'test'").count() < 90
    assert sampling.oversample(frame.where("form IN ('w0', 'w3', 'x')"), F.col("syllables") - 1).count() == 1 + 1 + 4


def test_evaluation(spark):
    frame = spark.createDataFrame([(0, 0, 2), (0, 1, 2), (1, 1, 9), (2, 0, 8)], "y int, yhat int, syllables int")
    m = {r.label: r.f1 for r in evaluate.label_metrics(frame).collect()}
    assert m == {0: 0.5, 1: 2 / 3, 2: 0.0}
    assert evaluate.summary_metrics(frame).first().macro_f1 == round((0.5 + 2 / 3) / 3, 6)
    assert {r.bucket: r.accuracy for r in evaluate.accuracy_by_bucket(frame).collect()} == {2: 50.0, 7: 50.0, None: 50.0}
    parts = {k: F.lit(0.8) for k in ("f1", "external", "hand", "syllables")}
    row = spark.range(1).select(evaluate.fitness("global", parts, F.lit(25.0)).alias("a"), evaluate.fitness("global", parts, F.lit(100.0), F.lit(0.9), F.lit(0.8)).alias("b")).first()
    assert (row.a, row.b) == (0.81, 0.4)
    empty = spark.createDataFrame([], "y int, yhat int, syllables int")
    assert evaluate.label_metrics(empty).collect() == []


def test_quality(spark):
    frame = spark.createDataFrame([("", 1), (None, None), ("x", 2)], "a string, b int")
    assert {tuple(r) for r in quality.null_counts(frame).collect()} == {("a", 1, 1, 3), ("b", 1, 0, 3)}
    one, other = quality.content_hash(frame, ["a", "b"]).first(), quality.content_hash(frame.orderBy(F.desc("b")).repartition(3), ["a", "b"]).first()
    assert one == other != quality.content_hash(frame.limit(2), ["a", "b"]).first()
    bad = spark.createDataFrame([('{"a": 1}',), ("{",), (None,)], "j string")
    assert tuple(quality.json_validity(bad, "j").first()) == (3, 1)


def test_a_fitted_forest_answers_after_counts_were_observed(spark):
    from pyspark.sql import Observation

    from tonarium.operators import ml

    seen = Observation()
    assert len(spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()) == seen.get["n"] == 3
    rows = spark.range(12).selectExpr("'a' AS lemma", "string(id) AS form", "'N' AS pos", "2 AS syllables", "double(id % 2) AS y", "double(id % 2) AS x")
    assert [r.yhat for r in ml.predict(ml.fit(rows, trees=3, depth=2), rows).orderBy(F.col("form").cast("int")).collect()] == [0, 1] * 6
