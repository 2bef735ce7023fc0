import json

import pytest

from tonarium.operators import ml, variants
from tonarium.sources import readers, scratch, sinks
from tonarium.streaming import incremental
from pyspark.sql import functions as F

ALPHABET = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюяʼ"


def test_marked_text(spark, tmp_path):
    (tmp_path / "d.txt").write_text("# comment\n\nза́мок\nзамо́к\nпо´милка\nтемно-си́ній\nкнига\nрік\nкоб'я́к\n", encoding="utf-8")
    got = [(r.form, r.stress) for r in readers.marked_text(readers.lines(spark, str(tmp_path / "d.txt"))).orderBy("line", "at").collect()]
    assert got == [("замок", [0]), ("замок", [1]), ("помилка", [0]), ("синій", [0]), ("рік", [0]), ("кобʼяк", [1])]


def test_trie_payloads(spark):
    rows = [("вода", bytes([4])), ("вода", bytes([2, 4])), ("вода", bytes.fromhex("02fe611120ff04fe611220ff")), ("вода", bytes([0, 1, 9, 2])), ("вода", bytes.fromhex("02fe99ff")), ("вода", b"")]
    frame = spark.createDataFrame([(i, w, p) for i, (w, p) in enumerate(rows)], "i int, word string, payload binary")
    got = {}
    for i in range(len(rows)):
        got[i] = sorted((r.record, r.stress, r.pos, r.feats) for r in readers.trie_payloads(frame.where(f"i = {i}").select("word", "payload")).collect())
    assert got[0] == [(0, [1], None, {})] and got[1] == [(0, [0, 1], None, {})]
    assert got[2] == [(0, [0], "NOUN", {"Number": "Sing", "Case": "Nom"}), (1, [1], "NOUN", {"Number": "Plur", "Case": "Nom"})]
    assert got[3] == [(0, [0], None, {})] and got[4] == [(0, [0], None, {})] and got[5] == []


def test_nested_json(spark, tmp_path):
    entry = {
        "word": "замок", "pos": "noun", "etymology_number": 1, "sounds": [{"rhymes": "x"}, {"ipa": "ˈzamok"}], "categories": [],
        "forms": [{"form": "за́мок", "tags": ["Singular", "nominative "]}, {"form": "zamok", "tags": ["romanization"]}, {"form": "замок", "tags": []}, {"form": "no-table-tags"}],
        "senses": [{"id": "s1", "glosses": ["castle", "fort"], "categories": [{"name": "c"}]}, {"id": "s2", "glosses": ["lock"]}],
    }
    (tmp_path / "k.jsonl").write_text(json.dumps(entry, ensure_ascii=False) + "\n\nnot json\n" + json.dumps({"pos": "noun"}) + "\n", encoding="utf-8")
    got = readers.entry_forms(readers.nested_json(spark, str(tmp_path / "k.jsonl"))).orderBy("sense_at").collect()
    assert [(r.lemma, r.form, r.stress, r.pos, r.main_definition, r.alt_definitions) for r in got] == [("замок", "замок", [0], "NOUN", "castle", ["fort"]), ("замок", "замок", [0], "NOUN", "lock", [])]
    assert got[0].feats == {"Number": "Sing", "Case": "Nom"} and got[0].ipa == "ˈzamok" and got[0].categories == ["c"]


def test_lists_and_hand_tests(spark, tmp_path):
    (tmp_path / "h.csv").write_text("word,pos,expected_vowel_index,description,features_json\nм'яч,NOUN,0,ball,\n# no,NOUN,1,,\nпоми́лка,,\"1,2\",either,\nх,NOUN,,none,\n", encoding="utf-8")
    got = {r.word: (r.pos, r.expected) for r in readers.hand_tests(spark, str(tmp_path / "h.csv")).collect()}
    assert got["мʼяч"] == ("NOUN", [0]) and ("X", [1, 2]) in got.values() and got["х"] == ("NOUN", None) and len(got) == 3
    (tmp_path / "w.txt").write_text("# list\nЇжа\nїжа\n", encoding="utf-8")
    assert [r[0] for r in readers.word_list(readers.lines(spark, str(tmp_path / "w.txt"))).collect()] == ["іжа"]


def test_compact_dictionary_round_trip(spark):
    rows = [("вода", 1, None, False, False), ("замок", 0, 1, False, True), ("за", 0, None, False, False), ("зам", 0, None, True, False)]
    frame = spark.createDataFrame([*rows, ("wrong", 0, None, False, False), ("а", None, None, False, False)], "form_norm string, stress int, stress2 int, is_variative boolean, is_heteronym boolean")
    for prefix, parts in ((0, {"": 4}), (1, {"в": 1, "з": 3}), (3, {"вод": 1, "зам": 2, "за": 1})):
        packed = sinks.pack_trie(frame, ALPHABET, prefix=prefix)
        assert {r.part: r.n_words for r in packed.collect()} == parts
        assert sorted(map(tuple, sinks.unpack_trie(packed).collect())) == sorted(rows)
        asked = spark.createDataFrame([(w,) for w in ("вода", "вод", "замок", "за", "зама", "водаа", "x", "", None, "вода")], "form_norm string")
        found = {r.form_norm: r.stress for r in sinks.trie_lookup(packed, asked, prefix).collect()}
        assert found == {"вода": 1, "вод": None, "замок": 0, "за": 0, "зама": None, "водаа": None, "x": None, "": None}
    nodes = sinks.trie_nodes(frame.where("form_norm <> 'wrong' AND stress IS NOT NULL"))
    assert nodes.count() == 9 and nodes.where("stress IS NOT NULL").count() == 4


def test_layout_of_a_packed_dictionary():
    data = sinks._trie_bytes([{"form_norm": "ба", "stress": 0, "stress2": 2, "is_variative": True, "is_heteronym": False}, {"form_norm": "в", "stress": 1, "stress2": None, "is_variative": False, "is_heteronym": True}], "абв")
    head = b"UKST" + bytes([2, 0]) + (4).to_bytes(4, "little") + (2).to_bytes(4, "little") + (3).to_bytes(4, "little") + bytes(2)
    letters = b"".join(bytes([0xFF]) + ord(c).to_bytes(2, "little") for c in "абв")
    nodes = [(0xFF, 0xFF, 2, 0xFF, 1), (1, 0xFF, 2, 0xFF, 3), (2, 1, 4, 0xFF, 0), (0, 0, 1 | 8, 2, 0)]
    assert data == head + letters + b"".join(bytes(n[:4]) + n[4].to_bytes(4, "little") for n in nodes)
    assert list(sinks.Trie(data)) == [("в", 1, None, False, True), ("ба", 0, 2, True, False)]
    for bad in (b"XXXX" + data[4:], data[:-1]):
        try:
            sinks.Trie(bad)
        except ValueError:
            continue
        raise AssertionError


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    import gzip

    (tmp_path / "a.txt").write_text("a0\na1\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(20_000)))
    with gzip.open(tmp_path / "c.txt.gz", "wt") as f:
        f.write("c0\nc1")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [(r.line, r.value) for r in readers.lines(spark, str(tmp_path)).orderBy("line").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert got == list(enumerate(["a0", "a1", *(f"b{i}" for i in range(20_000)), "c0", "c1"]))


def test_many_glosses_and_counts_of_a_scan(spark, tmp_path):
    entry = {"word": "замок", "pos": "noun", "forms": [{"form": "за́мок"}, {"form": "замок"}, {"form": "x", "tags": ["romanization"]}], "senses": [{"glosses": [f"g{i}" for i in range(2500)]}, {"glosses": []}, {}]}
    (tmp_path / "k.jsonl").write_text(json.dumps(entry) + "\n\nno json\n" + json.dumps({"pos": "noun"}) + "\n", encoding="utf-8")
    rows = readers.entry_forms(readers.nested_json(spark, str(tmp_path))).orderBy("sense_at").collect()
    assert [(r.main_definition, len(r.alt_definitions)) for r in rows] == [("g0", 2499), (None, 0), (None, 0)]
    report = readers.scan_report(spark, str(tmp_path)).first()
    assert tuple(report) == (4, 1, 2, 1, 3, 1, 1)


def test_last_write_and_cache(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, 0, 0), ("a", 2, 1, 0), ("b", 3, 0, 5)], "form_norm string, v int, src_ord int, form_ord int")
    sinks.write_lookup(frame, str(tmp_path / "kv"), order=["src_ord", "form_ord"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "kv")).collect())) == [("a", 2), ("b", 3)]
    made = []

    def make():
        made.append(1)
        return frame

    key = f"words of {tmp_path}"
    assert scratch.cached(spark, key, make).count() == scratch.cached(spark, key, make).count() == 3 and made == [1]
    sinks.write_json_array(frame.select("form_norm", "v"), str(tmp_path / "j"), ["v"])
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == [{"form_norm": "a", "v": 1}, {"form_norm": "a", "v": 2}, {"form_norm": "b", "v": 3}]


def test_tables(spark, tmp_path):
    forms = spark.sql("SELECT 'a' AS lemma, 'af' AS form, array(0) AS stress, 'NOUN' AS pos, map('Case', 'Nom') AS feats, 'd' AS main_definition, 0 AS src_ord, 0 AS form_ord, array('t') AS tags, array('c', 'e') AS categories")
    tables = sinks.star_schema(forms)
    sinks.write_tables(tables, str(tmp_path / "star"))
    assert {n: spark.read.parquet(str(tmp_path / "star" / n)).count() for n in tables} == {"word_form": 1, "lemma_entry": 1, "definition": 1, "feature": 1, "tag": 1, "category": 2, "possible_stress_index": 1}
    types = variants.variant_types(forms.select("lemma", F.to_json("stress").alias("pattern"), "pos", F.to_json("feats").alias("feats"), F.col("main_definition").alias("definition")))
    rows = forms.union(forms).select("lemma", "form", F.to_json("stress").alias("stress_indices"), "pos", F.to_json("feats").alias("features_json"), F.lit(1.0).alias("pos_confidence"), F.lit(1.0).alias("features_confidence"), "src_ord", "form_ord")
    assert sinks.training_table(rows, types, F.lit("train")).count() == 1
    sinks.write_lookup(forms.select(F.col("form").alias("form_norm"), "stress"), str(tmp_path / "kv"))
    found = sinks.lookup(spark.read.parquet(str(tmp_path / "kv")), spark.createDataFrame([("af",), ("zz",)], "form_norm string"))
    assert {r.form_norm: r.stress for r in found.collect()} == {"af": [0], "zz": None}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "canción acción", "es", "s", 1), (2, "canción así", "es", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    q = incremental.pattern_counts(incremental.form_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("patterns").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("patterns").collect())) == sorted(map(tuple, incremental.pattern_counts(docs).collect()))
    assert spark.table("patterns").where("lemma = 'cancion'").first().n == 2


def test_classifier(spark):
    rows = [(f"л{i}", c + "амо" + d, "NOUN", None, [int(d == "к")]) for i, (c, d) in enumerate((a, b) for a in "бвгдзклмн" for b in "ктсн")]
    data = ml.training_set(spark.createDataFrame(rows, "lemma string, form string, pos string, feats string, stress array<int>"))
    model = ml.fit(data, trees=5, depth=4)
    got = ml.predict(model, data).collect()
    assert len(got) == 36 and sum(r.y == r.yhat for r in got) >= 34 and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    assert len(ml.importances(model, 5)) == 5


def test_tables_of_many_forms(spark, tmp_path):
    # equal rows are rows of their own: each child has one form
    row = "SELECT 'a' AS lemma, 'af' AS form, array(0) AS stress, 'NOUN' AS pos, 'd' AS main_definition, 0 AS src_ord, 0 AS form_ord, b AS block FROM VALUES (1), (1), (2) AS t(b)"
    tables = sinks.star_tables(spark.sql(row).repartition(4, "block"), ["array('c', 'e') AS categories", "map(src_ord, form) AS meta"], 4)
    assert {n: t.count() for n, t in tables.items()} == {"word_form": 3, "lemma_entry": 1, "definition": 1, "category": 6, "meta": 1, "possible_stress_index": 1}
    joined = tables["category"].join(tables["word_form"].hint("merge").withColumnRenamed("id", "word_form_id"), ["block", "word_form_id"])
    assert joined.count() == 6
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan  # following a reference shuffles nothing
    made = [t.name for t in spark.catalog.listTables() if t.name.startswith("star_")]
    scratch.clean(spark)
    assert made and not [t.name for t in spark.catalog.listTables() if t.name.startswith("star_")]


@pytest.mark.parametrize("dealt", [True, False])
def test_tables_of_many_forms_are_kept_in_order(spark, dealt):
    # rows that come out of order, and those of a bucket from several tasks
    rows = spark.range(600).selectExpr("concat('l', id % 7) AS lemma", "concat('f', id) AS form", "array(int(id % 3), 4) AS stress", "'NOUN' AS pos", "'d' AS main_definition", "0 AS src_ord", "599 - id AS form_ord", "pmod(hash(id), 40) AS block")
    rows = rows.repartition(4, "block") if dealt else rows.repartition(3)
    tables = sinks.star_tables(rows, ["array(form, 'c') AS categories"], 4)
    assert {r.stress_indices for r in tables["word_form"].collect()} == {"[0,4]", "[1,4]", "[2,4]"}
    joined = tables["category"].join(tables["word_form"].hint("merge").withColumnRenamed("id", "word_form_id"), ["block", "word_form_id"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan
    # as stored, or each join sorts all forms anew; several files of a bucket are no order
    assert not dealt or scratch.one_file_each(tables["word_form"]) and "Sort [" not in plan
    assert sorted((r.form, r.category) for r in joined.collect()) == sorted((f"f{k}", c) for k in range(600) for c in (f"f{k}", "c"))


def test_equal_lines_are_read_once(spark, tmp_path):
    from tonarium.plans import products

    rows = [(k, "así casa así") for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'es' AS lang", "'src1' AS source").write.parquet(str(tmp_path / "documents.parquet"))
    counted, real = [], products.stored_counts
    products.stored_counts = lambda lines: counted.append(real(lines)) or counted[-1]
    try:
        got = products.QUERIES["marked_text_scan"](spark, str(tmp_path)).collect()
    finally:
        products.stored_counts = real
    assert [(r.stress, r.n) for r in got] and counted[0].count() < 12 and counted[0].agg({"times": "sum"}).first()[0] == 120
