from collections import Counter

import corpus_pipeline
from tonarium.llm import mixing, simhash, toxicity


def test_stages_by_hand(spark, tmp_path):
    words = "tree house river stone cloud table green walk north south light water".split()
    line = lambda i: " ".join(words[(i * k + i // 7) % 12] + str((i * 31 + k) % 97) for k in range(1, 30))
    rows = [(i, line(i), "en", f"s{i % 3}", 100) for i in range(60)]
    rows += [(100 + i, f"{line(200 + i)} blorg snarf", "en", "s1", 100) for i in range(20)]
    rows += [(200, rows[3][1], "en", "s2", 100), (201, "a\nb\nc\nown line", "en", "s0", 14), (202, "a\nb\nc\nother line of more words", "en", "s0", 14), (203, "a\nb\nc", "en", "s1", 5), (204, None, "en", None, None)]
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf_dir, kept = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = corpus_pipeline.common.written(stage(spark, kept, sf_dir), name)
        if name != "packing":
            assert kept.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "toxicity":
            assert not ids & set(range(100, 120)) and ids >= set(range(60)) | {200, 201, 204}
        if name == "line_dedup":
            text = {r.doc_id: r.text for r in kept.collect()}
            assert text[201] == "a\nb\nc\nown line" and text[202] == "other line of more words" and 203 not in text and 204 in text
        if name == "simhash":
            groups = simhash.near_duplicates(before).toPandas().groupby("component_id").doc_id.min()
            assert ids == set(groups) and 200 not in ids and 3 in ids
        if name == "mixing":
            assert kept.groupBy("doc_id").count().where("count > 2").count() == 0 and 204 not in ids
    assert kept.count() > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == kept.count()
    assert toxicity.THRESHOLD == 0.3


def test_mix_holds_what_is_planned_for_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(5 + k % 7))
    rows = [(None if k % 3 == 0 else k // 2, text(k), "en", f"s{k % 3}" if k % 5 else None, k) for k in range(60)]
    docs = corpus_pipeline.common.written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "mix-test")
    got = Counter(tuple(r) for r in corpus_pipeline.mixed(spark, docs, "").collect())
    plan = mixing.plan_mix(docs, keep=tuple(corpus_pipeline.COLUMNS)).collect()
    due = Counter({tuple(r.kept): sum(c.words * 2 > r["size"] for c in r.copies) for r in plan})
    assert got == +due and sum(n for row, n in got.items() if row[0] is None) > 10
    assert sum(r.taken for r in plan) == sum(r.taken for r in mixing.plan_mix(docs).collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_empty_tables_and_odd_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(1, None, None, None, None), (1, "", "en", None, 0), (None, "two words", None, "s", 9), (None, "two words", None, "s", 9), (2, "two words", "en", "s", 9), (2, "own text here", "en", "t", 13), (3, "x\ny", "en", "t", 3)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, SCHEMA)
        kept = corpus_pipeline.common.written(docs.withColumn("extra", corpus_pipeline.F.lit(1)), "odd")
        sizes = []
        for name, stage in corpus_pipeline.STAGES:
            kept = corpus_pipeline.common.written(stage(spark, kept, str(tmp_path)), name)
            sizes.append(kept.count())
            if name != "packing":
                assert kept.columns == corpus_pipeline.COLUMNS
        if not rows:
            assert sizes == [0] * 5
        else:  # the null and the empty text are one group, and so are the three of two words
            assert sizes[:3] == [7, 7, 4] and sizes[3] > 0 and sizes[4] >= sizes[3]


def test_copies_without_an_id_go(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text, "en", "s", 1)] * 3 + [(5, text, "en", "s", 1), (None, "other words", None, None, None), (None, "other words", None, None, None)]
    docs = corpus_pipeline.common.written(spark.createDataFrame(rows, SCHEMA), "no-ids")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(5, text), (None, "other words")], key=str)
