import math
import random

import pytest
from pyspark.sql import functions as F

from tonarium.operators import evaluate, filters, merge, ml, service, variants
from tonarium.profiles import LATIN, UKRAINIAN


def test_filters(spark):
    rows = [("ліс", "[0]"), ("два слова", "[1]"), ("ліс", "[]"), ("ліс", ""), ("ліс", None), (None, "[0]"), ("", "x"), ("x-y", "[2,3]"), ("кобʼяк", "{}")]
    frame = spark.createDataFrame(rows, "form string, stress string")
    got = frame.select(filters.single_word("form", "stress"), filters.first_index("stress"), filters.in_alphabet("form", UKRAINIAN), filters.in_alphabet("form", LATIN)).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False, True, True, True]
    assert [r[1] for r in got] == [0, 1, None, None, None, 0, None, 2, None]
    assert [r[2] for r in got] == [True, False, True, True, True, False, True, False, True]
    assert [r[3] for r in got] == [False, False, False, False, False, False, True, True, False]
    kinds = spark.createDataFrame([("free_variant",), ("single",), (None,), ("grammatical_homonym",), ("morphological_variant",)], "k string")
    assert [tuple(r) for r in kinds.select(filters.unambiguous("k"), filters.unambiguous("k", keep_null=False)).collect()] == [(False, False), (True, True), (True, False), (False, False), (True, True)]


def test_lemmas_and_heads(spark):
    rows = spark.createDataFrame([(1, 0, " Дерева ", 1), (1, 1, "ростуть", 1), (1, 2, "тут", 9), (2, 0, None, 0)], "doc_id long, i int, form string, head int")
    table = spark.createDataFrame([("дерева", 1, "деревина"), ("дерева", 0, "дерево"), ("Ростуть", 0, "рости")], "form string, ord int, lemma string")
    got = {(r.doc_id, r.i): (r.lemma, r.head_lemma) for r in filters.with_heads(filters.lemmatize(rows, table)).collect()}
    assert got == {(1, 0): ("дерево", "рости"), (1, 1): ("рости", "рости"), (1, 2): ("тут", None), (2, 0): (None, None)}
    assert [r.lemma for r in filters.lemmatize(rows).orderBy("doc_id", "i").collect()] == ["дерева", "ростуть", "тут", None]


def test_token_attributes(spark):
    text = "Hello, wörld!  It's 3.14 €5 at a@b.org?! See https://x.y/z (NOW)."
    frame = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n"), (5, "А.")], "doc_id long, text string")
    rows = filters.token_attributes(frame).orderBy("doc_id", "i").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [r.form for r in one] == ["Hello", ",", "wörld", "!", "It's", "3.14", "€", "5", "at", "a@b.org", "?", "!", "See", "https://x.y/z", "(", "NOW", ")", "."]
    assert all(text[r.idx : r.idx + len(r.form)] == r.form for r in one) and [r.i for r in one] == list(range(18))
    assert [r.sent_id for r in one] == [0] * 4 + [1] * 8 + [2] * 6 and [r.i for r in one if r.is_sent_start] == [0, 4, 12]
    by = {r.form: r for r in one}
    assert by["3.14"].like_num and by["€"].is_currency and by["a@b.org"].like_email and by["https://x.y/z"].like_url and by["("].is_left_punct and by[")"].is_right_punct and by["NOW"].is_upper and by["Hello"].is_title and not by["NOW"].is_title
    assert by["Hello"].shape == "Xxxxx" and by["wörld"].shape == "xxxx" and by["3.14"].shape == "d.dd" and by["!"].has_space == 1 and by["wörld"].has_space == 0 and not by["wörld"].is_ascii
    assert [(r.doc_id, r.form) for r in rows if r.doc_id > 1] == [(5, "А"), (5, ".")]


def test_curves_against_definitions(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), [round(rng.random(), 2) for _ in range(3)]) for _ in range(300)]
    frame = spark.createDataFrame(rows, "y int, p array<double>").repartition(3)

    def area(label):
        pairs = [(a[label] > b[label]) + 0.5 * (a[label] == b[label]) for y, a in rows if y == label for z, b in rows if z != label]
        return sum(pairs) / len(pairs)

    binary = frame.selectExpr("int(y = 1) AS y", "p[1] AS score")
    assert abs(evaluate.auc(binary).first().auc - area(1)) < 1e-6
    assert abs(evaluate.ovr_auc(frame, 3).first().auc - sum(map(area, range(3))) / 3) < 2e-6
    assert evaluate.ovr_auc(frame.where("y < 2"), 3).first().auc == 0.0
    loss = -sum(math.log(min(1 - 1e-15, max(1e-15, p[y]))) for y, p in rows) / len(rows)
    assert abs(evaluate.log_loss(frame).first().log_loss - loss) < 1e-6
    assert evaluate.auc(binary.where("y = 1")).first().auc is None
    labels = spark.createDataFrame([(1, 1, 2), (0, 1, 2), (1, 0, 3), (1, 1, 9)], "y int, yhat int, syllables int")
    assert tuple(evaluate.bucket_mean(labels).first()) == (0.5, 0.5) and tuple(evaluate.binary_metrics(labels).first()) == (0.666667, 0.666667, 0.666667)


def test_reports(spark):
    few = spark.createDataFrame([(i, "p", i / 100, 1.0, False, float(i)) for i in range(19)], "trial int, phase string, fitness double, minutes double, pruned boolean, leaves double")
    assert evaluate.parameter_insight(few, ["leaves"]).collect() == []
    many = few.union(few.selectExpr("trial + 19", "phase", "fitness + 0.19", "minutes", "pruned", "leaves + 19"))
    assert tuple(evaluate.parameter_insight(many, ["leaves"]).first()) == ("leaves", 32.5, 4.5, "higher")
    assert tuple(evaluate.progression(many).first()) == (0.055, 0.315) and tuple(evaluate.progression(few.limit(0)).first()) == (None, None)
    report = {(r.section, r.name): r.value for r in evaluate.training_report(many, ["leaves"]).collect()}
    assert report[("advice", "search")] == "go on" and report[("direction", "leaves")] == "higher" and report[("trials of phase", "p")] == "38"
    assert evaluate.leaderboard_text(many, 1).first().line == "  1  0.370000  #######.............  p 37"
    rows = spark.createDataFrame([(1, 1, 1, True), (0, 1, 0, False), (0, 0, 0, True)], "y int, base int, ensemble int, is_hand boolean")
    assert tuple(evaluate.accepted(rows).first()) == (0.666667, 1.0, 2, 2, 1) and evaluate.accepted(rows.selectExpr("y", "base", "base AS ensemble", "is_hand")).first().accept == 0


def test_merges_and_views(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('а', 's', 'NOUN', map('Number', 'Sing'), array(0), 'f', 0, 0), ('а', 's', 'NOUN', NULL, array(1), 'g', 0, 1), ('а', 's', 'NOUN', map('Number', 'Plur'), array(2), 'h', 0, 2), ('а', 's', NULL, NULL, array(), 'i', 0, 3)
      AS t(lemma, sense_id, pos, feats, stress, form, src_ord, form_ord)""")
    got = {(r.pos, r.number): (r.stress, r.form) for r in merge.variative_merge(rows).collect()}
    assert got == {("NOUN", "Sing"): ([0, 1], "f"), ("NOUN", "Plur"): ([2], "h"), ("X", "Sing"): ([], "i")}
    found = variants.pos_distribution(spark.createDataFrame([("NOUN", 1.0, 0.0), ("NOUN", 0.5, 1.0)], "pos string, pos_confidence double, features_confidence double"))
    assert tuple(found.first()) == ("NOUN", 2, 0.75, 0.5)
    view = spark.createDataFrame([("a", 2, "NOUN,X"), ("b", 1, "NOUN"), ("c", 3, "")], "form_norm string, n_variants int, pos_tags string")
    assert sorted(map(tuple, service.sample_report(view, keys=2, n=5).collect())) == [("histogram", "NOUN", 2), ("histogram", "X", 1), ("sample", "a", 2)]
    frame = spark.createDataFrame([(1048576.0, 7), (1.0, 185), (0.0, 7200)], "b double, s int")
    assert [tuple(r) for r in frame.select(service.megabytes("b"), service.duration("s")).collect()] == [("1.00 MB", "7s"), ("0.00 MB", "3m 5s"), ("0.00 MB", "2h 0m")]


def test_modes():
    assert ml.resolver_mode("auto", True, True) == "hybrid" and ml.resolver_mode("auto", False, True) == "db" and ml.resolver_mode("auto", True, False) == "ml"
    for mode, error in (("best", ValueError), ("ml", FileNotFoundError), ("hybrid", FileNotFoundError)):
        with pytest.raises(error):
            ml.resolver_mode(mode, False, True)


def test_search_refit_and_storage(spark, tmp_path):
    rows = [(f"л{i}", c + "амо" + d, "NOUN", None, [int(d == "к")]) for i, (c, d) in enumerate((a, b) for a in "бвгдзклмн" for b in "ктсн")]
    data = ml.training_set(spark.createDataFrame(rows, "lemma string, form string, pos string, feats string, stress array<int>")).cache()
    found = ml.search(data, data, trials=4, fraction=1.0)
    assert [t["phase"] for t in sorted(found, key=lambda t: t["trial"])] == [1, 2, 3, 3] and found[0]["macro_f1"] >= found[-1]["macro_f1"]
    model = ml.refit(data, data.limit(3).withColumn("extra", F.lit(1)), trees=5, depth=4)
    ml.save(model, str(tmp_path / "model"))
    assert tuple(ml.same_answers(ml.predict(model, data), ml.predict(ml.load(str(tmp_path / "model")), data)).first()) == (36, 36)
    facts = ml.manifest(model, {"accuracy": 1.0})
    assert facts["trees"] == 5 and len(facts["importances"]) == 20 and facts["score"] == {"accuracy": 1.0}


def test_usable_rows(spark):
    rows = [("а", "ф", "[0]", "NOUN", "{}", "single"), ("а", "г", "[0]", "NOUN", "{}", "free_variant"), ("б", "x", "[0]", "NOUN", "{}", "single"), ("б", "x", "[1]", "NOUN", "{}", "single"), ("в", "y", "[0]", None, "{}", "single")]
    frame = spark.createDataFrame(rows, "lemma string, form string, stress_indices string, pos string, features_json string, variant_type string")
    assert [r.form for r in ml.usable_rows(frame).collect()] == ["ф"]


def test_event_windows_of_a_stream_equal_a_batch(spark, tmp_path):
    from tonarium.streaming import incremental

    events = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7 % 60, id) AS ts, if(id % 3 = 0, 'a', 'b') AS event_type, double(id) AS value FROM range(200)")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = incremental.form_stream(spark, str(tmp_path / "in"), schema="ts timestamp, event_type string, value double")
    q = incremental.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(str, spark.table("windows").collect()))
    assert got == sorted(map(str, incremental.event_windows(events).collect())) and len(got) > 10
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == 200


def test_results_are_appended_and_training_columns_read(spark, tmp_path):
    from tonarium.sources import readers, sinks

    for kind in ("json", "csv", "parquet"):
        for k in range(2):
            sinks.append_results(spark.createDataFrame([(k, 0.5)], "trial int, fitness double"), str(tmp_path / kind), kind)
        found = spark.read.option("header", True).format(kind).load(str(tmp_path / kind))
        assert sorted(int(r.trial) for r in found.collect()) == [0, 1]
    table = spark.sql("SELECT 'l' AS lemma, 'f' AS form, '[0]' AS stress_indices, 'X' AS pos, '{}' AS features_json, 'single' AS variant_type, 'train' AS split")
    table.write.parquet(str(tmp_path / "t"))
    rows = readers.training_rows(spark, str(tmp_path / "t"))
    assert rows.columns == ["lemma", "form", "stress_indices", "pos", "features_json", "variant_type"] and rows.count() == 1


def test_token_places_of_repeated_and_null_ids(spark):
    from tonarium.operators import filters

    rows = [(1, "Ann sat. She ran!? Yes\n"), (1, "One two"), (None, "A b."), (None, "C  d e"), (2, None), (3, ""), (4, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.sent_id, r.begin, r.end, r["first"], " ".join(t.form for t in r.tokens)) for r in filters.sentences(docs).collect()]
    assert sorted(found, key=str) == sorted([(1, 0, 0, 8, 0, "Ann sat ."), (1, 1, 9, 18, 3, "She ran ! ?"), (1, 2, 19, 22, 7, "Yes"), (1, 0, 0, 7, 0, "One two"), (None, 0, 0, 4, 0, "A b ."), (None, 0, 0, 6, 0, "C d e")], key=str)
    tokens = filters.token_attributes(docs)
    assert "Exchange" not in tokens._jdf.queryExecution().executedPlan().toString()
    by_text = {}
    for r in tokens.collect():
        by_text.setdefault((r.doc_id, r.form), []).append((r.i, r.idx, r.has_space, r.is_sent_start))
    assert by_text[1, "sat"] == [(1, 4, 0, 0)] and by_text[1, "two"] == [(1, 4, 0, 0)] and by_text[1, "Yes"] == [(7, 19, 1, 1)] and by_text[None, "d"] == [(1, 3, 1, 0)]


def test_a_million_words_keep_to_their_document(spark, tmp_path):
    from tonarium.plans import catalog

    rows = [(1, "en", "src0", "a " * 1_000_002), (2, "en", "src0", "b")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.words for r in catalog.QUERIES["coverage_by_doc"](spark, str(tmp_path)).collect()} == {1: 1_000_002, 2: 1}


def test_long_words_are_words(spark, tmp_path):
    from tonarium.plans import products

    long = "b" * 260 + "é" + "b" * 200
    rows = [(1, "fr", "src0", f"café {long}")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert products.QUERIES["mark_many"](spark, str(tmp_path)).count() == 2
    assert {r.word[:4]: r.stress for r in products.QUERIES["trie_scan"](spark, str(tmp_path)).collect()} == {"cafe": "[1]", "bbbb": "[]"}


def test_votes_that_tie_up_to_the_order_of_sums(spark):
    # 0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1: the first label wins all the same
    rows = [(1, 0.5, [a, b]) for a, b in ((0.1, 0.3), (0.2, 0.2), (0.3, 0.1))] + [(2, 0.5, [b, a]) for a, b in ((0.1, 0.3), (0.2, 0.2), (0.3, 0.1))]
    frame = spark.createDataFrame(rows, "row_id int, fitness double, p array<double>").coalesce(1)
    assert {r.row_id: r.yhat for r in evaluate.soft_vote(frame).collect()} == {1: 0, 2: 0}


def test_thirds_of_many_trials(spark):
    rows = [(k * 7 % 5003 * 3, float(k)) for k in range(5003)]
    frame = spark.createDataFrame(rows, "trial long, fitness double").repartition(3)
    ordered = [f for _, f in sorted(rows)]
    third = len(rows) // 3
    found = evaluate.progression(frame)
    assert tuple(found.first()) == (round(sum(ordered[:third]) / third, 6), round(sum(ordered[-third:]) / third, 6))
    alone = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [row_number" in line]
    assert len(alone) == 2  # only inside the ranges that a third ends in
    none = spark.createDataFrame([(None, 1.0), (5, 3.0), (9, None)], "trial long, fitness double")
    assert tuple(evaluate.progression(none).first()) == (1.0, None)


def test_tokens_are_described_once_a_form(spark):
    from tonarium.operators import filters

    text = "Aa bB CCCCCC dddddd Eeeeeee. x, " * 400 + "A! B? no space.End  " * 3
    plan = filters.token_attributes(spark.createDataFrame([(1, text)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "regexp_replace" not in plan  # no pattern is matched for every token
    held = filters.PIECES_HELD, filters.TEXT_HELD, filters.PIECES_KNOWN
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None, 1], "text": [text, " ", text]})
    whole = pa.Table.from_batches(filters._attributes(iter([batch]))).to_pylist()
    try:
        filters.PIECES_HELD, filters.TEXT_HELD, filters.PIECES_KNOWN = 50, 37, 3
        cut = pa.Table.from_batches(filters._attributes(iter([batch]))).to_pylist()
    finally:
        filters.PIECES_HELD, filters.TEXT_HELD, filters.PIECES_KNOWN = held
    assert cut == whole and all(text[r["idx"] :].startswith(r["form"]) for r in whole)
    one = whole[: len(whole) // 2]
    assert [r["i"] for r in one] == list(range(len(one))) and whole[len(one) :] == one
    found = {r["form"]: (r["shape"], r["is_lower"], r["is_upper"], r["is_title"]) for r in one}
    assert found["bB"] == ("xX", 0, 0, 0) and found["CCCCCC"] == ("XXXX", 0, 1, 0) and found["dddddd"] == ("xxxx", 1, 0, 0) and found["Eeeeeee"] == ("Xxxxx", 0, 0, 1) and found["A"] == ("X", 0, 1, 1)
