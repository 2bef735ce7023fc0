import random

from tonarium.llm import linededup


def brute(rows, window=3):
    seen, covered = set(), [set() for _ in rows]
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        lines = (rows[k][1] or "").split("\n") if rows[k][1] is not None else []
        for i in range(len(lines) - window + 1):
            key = tuple(lines[i : i + window])
            if key in seen:
                covered[k] |= set(range(i, i + window))
            seen.add(key)
    out = {}
    for (doc, text), gone in zip(rows, covered, strict=True):
        out[doc] = (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone), len(gone))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a\nb"), (103, "\n\n\n\n\n"), (104, rows[5][1]), (105, "q\nr\ns\n" * 300)]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _key string").repartition(3)
    got = linededup.dedup_lines(frame).collect()
    assert {r.doc_id: (r.text, r.n_lines_removed) for r in got} == brute(rows)
    assert all(r._key == "k" for r in got) and len(got) == len(rows)


def test_repeated_rows_and_null_ids(spark):
    text = "a\nb\nc"
    frame = spark.createDataFrame([(2, text), (2, text), (None, text), (3, "x\n" + text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in linededup.dedup_lines(frame).collect())
    assert got == [("2", ""), ("2", ""), ("3", "x"), ("None", text)]
    assert linededup.dedup_lines(frame.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    names = ["_doc", "_text", "_covered", "_key", "n_lines", "_at", "c0", "doc_id", "text"]
    rows = [tuple(f"{n}{i}" for n in names[:-2]) + (i, "a\nb\nc\nown%d" % i) for i in range(3)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, names))
    assert got.columns == [n for n in names if n != "n_lines"] + ["n_lines", "n_lines_removed"]
    assert sorted((r.doc_id, r._doc, r._covered, r.c0, r.text, r.n_lines) for r in got.collect()) == [(i, f"_doc{i}", f"_covered{i}", f"c0{i}", "own%d" % i if i else "a\nb\nc\nown0", 4) for i in range(3)]
