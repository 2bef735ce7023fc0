"""Lemmas in context, and bags of rows."""

import pytest

from tonarium.operators import filters, sampling

PARSES = "form string, ord int, lemma string, pos string"


def test_lemma_by_part_of_speech(spark):
    parses = [("saw", 1, "see", "VERB"), ("saw", 0, "saw", "NOUN"), ("saw", 2, "saws", "VERB"), ("fast", 0, "fast", "ADJF"), ("fast", 1, "quickly", "ADVB"), ("oh", 0, "ooh", None), ("oh", 1, "OH", "NOUN"), ("gap", 0, None, "NOUN"), ("tie", 0, "b", "NOUN"), ("tie", 0, "a", "NOUN")]
    tokens = [(1, " Saw", "VERB", "x"), (2, "saw", "AUX", "x"), (3, "saw", "NOUN", "x"), (4, "saw", "ADJ", "own"), (5, "fast", "DET", None), (6, "fast", "ADV", None), (7, "oh", "INTJ", None), (8, "oh", None, None), (9, "Gap ", "NOUN", None), (10, None, "NOUN", None), (11, "tie", "NOUN", "x"), (11, "tie", "NOUN", "x"), (12, "", "NOUN", None)]
    rows = spark.createDataFrame(tokens, "id int, form string, pos string, own string")
    table = spark.createDataFrame(parses, PARSES)
    got = sorted(((r.id, r.lemma) for r in filters.lemmatize_in_context(rows, table, "own").collect()), key=lambda x: x[0])
    assert got == [(1, "see"), (2, "see"), (3, "saw"), (4, "own"), (5, "fast"), (6, "quickly"), (7, "ooh"), (8, "ooh"), (9, "gap"), (10, None), (11, "a"), (11, "a"), (12, "")]
    assert filters.lemmatize_in_context(rows, table).where("id = 4").first().lemma == "saw"
    assert filters.lemmatize_in_context(rows, table.limit(0)).count() == 13 and filters.lemmatize_in_context(rows.limit(0), table).count() == 0


def test_bag_union(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x")], "n int, s string"), spark.createDataFrame([("x", 1), ("y", None)], "s string, n int")
    got = sampling.bag_union(data=a, hand=b, none=b.limit(0).select("s"))
    assert sorted(map(str, got.collect())) == sorted(["Row(n=1, s='x', part='data')"] * 2 + ["Row(n=1, s='x', part='hand')", "Row(n=None, s='y', part='hand')"])
    with pytest.raises(ValueError):
        sampling.bag_union()


def test_heads_by_rows_of_a_doc_id(spark, tmp_path):
    from collections import Counter

    from tonarium.plans import products

    texts = [(1, "gatos ven cada perro"), (1, "uno dos"), (2, "casas"), (None, "gatos ven"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'es' AS lang", "'src1' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    lemma = lambda w: w[:-1] if w.endswith("s") and len(w) > 3 else w
    want: Counter = Counter()
    rows = [(d, t.split()) for d, t in texts if t]
    for doc, words in rows:
        for i, w in enumerate(words):
            head = i if i % 3 == 0 else i - 1
            met = [o[head] for d, o in rows if doc is not None and d == doc and head < len(o)]
            want.update((lemma(w), lemma(h)) for h in met) if met else want.update([(lemma(w), None)])
    found = products.QUERIES["lemmas_and_heads"](spark, str(tmp_path))
    assert Counter({(r.lemma, r.head_lemma): r.n for r in found.collect()}) == want
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # pairs are counted before lemmas are looked up
