import random

import numpy as np

from tonarium.llm import toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = [("moron", False, 0), ("idiot", False, 0), ("scum", False, 1), ("lowei", True, 0), ("worthless", False, 0), ("ñañá", False, 1)]
    automaton = toxicity.Automaton(terms)
    classes = automaton.classes()
    rng = random.Random(0)
    words = [t for t, _, _ in terms] + ["Moron", "LOWEIxyz", "lowe", "mooron", "mron", "scums"]
    for t, _, _ in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "x", "o", "é", t[0]])
            words.append("".join(w))
    for w in words:
        starts, ends, states, n = automaton.match(np.frombuffer(w.encode("utf-32-le"), np.uint32), classes)
        low = w.lower()
        good = any(low.startswith(t) if stem else edits(low, t) <= (len(t) >= toxicity.FUZZY) for t, stem, _ in terms) and low.isalpha()
        assert (len(states) > 0) == good, w
        if good and not low.startswith("lowei"):
            assert automaton.distance[states[0]] == min(edits(low, t) for t, stem, _ in terms if not stem and edits(low, t) <= (len(t) >= toxicity.FUZZY))


def test_context():
    say = lambda t: toxicity.in_context(t, t.index("moron"), t.index("moron") + 5)
    assert say("you moron")[0] > say("the moron")[0] > say('she said "moron" again')[0]
    assert say('he wrote "a moron" once') == (0.3 * 0.6, True) and not say("a moron\n\"x\"")[1]


def table(n, rng):
    words = ["tree", "house", "river", "stone", "cloud", "table", "green", "walk"]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        t = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                t.insert(rng.randrange(len(t)), rng.choice(["blorg", "Snarf", "vexinal", "vexinor"]))
        rows.append((i, " ".join(t), "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_from_labels(spark):
    rng = random.Random(3)
    rows, labels = table(600, rng)
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "a snarff by the river", "en"), (1003, "x " * 50_000 + "blorg snarf vexinal", "en"), (1004, "the tree", "en"), (1004, "the tree", "en")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (5, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    scored = toxicity.score(docs, model).toPandas()
    assert len(scored) == 606 and scored.score.between(0, 1).all()
    truth = dict(labels)
    y = np.array([truth.get(i, 0) for i in scored.doc_id[:600]])
    assert ((scored.score[:600] >= toxicity.THRESHOLD) == y).mean() > 0.98
    by = dict(zip(scored.doc_id, scored.score, strict=True))
    assert by[1000] == by[1001] < toxicity.THRESHOLD and by[1002] > by[1004]
    held = {r.doc_id for r in docs.where(toxicity.held_out()).collect()}
    flipped = spark.createDataFrame([(i, 1 - t if i in held else t) for i, t in labels], "doc_id long, toxic int")
    again = toxicity.fit(docs, flipped)
    assert again.terms == model.terms and (again.weights == model.weights).all()


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "a tree")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert got[1] > got[2]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).collect() == []


def test_number_of_terms_follows_from_the_rows():
    names = [f"term{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}{chr(97 + k // 676)}" for k in range(450)]
    docs = {t: {10 * k + j for j in range(10)} for k, t in enumerate(names)}
    toxic = set(range(4500))
    found = toxicity.choose(names, docs, toxic, set(range(10_000, 20_000)))
    assert {t for t, _, tier in found if tier == 0} == set(names)


def test_few_labels_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a blorg here"), (1, "a blorg here"), (2, "a tree"), (None, "blorg"), (None, None), (3, "blorg"), (4, "the river")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (None, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(scored) == 7 and all(0 <= r.score <= 1 for r in scored) and sum(r.doc_id is None for r in scored) == 2
    assert toxicity.logistic(np.zeros((0, toxicity.FEATURES)), np.zeros(0)).tolist() == list(toxicity.PRIOR)
