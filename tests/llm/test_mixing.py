import random
import re
from collections import defaultdict

from tonarium.llm import mixing


def targets(sizes, weights=(3, 1, 2)):
    """Share by weight; stop at twice the size; share the excess again."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % 3] for i, n in enumerate(names)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = [n for n in names if n not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[n] for n in rest)
        over = {n: 2.0 * sizes[n] for n in rest if level * weight[n] > 2 * sizes[n]}
        if not over:
            return full | {n: level * weight[n] for n in rest}
        full |= over


def test_targets_and_taken(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        source = rng.choice(["b", "a", "Z", "é", None, "hot", "hot", "hot", "hot"])
        n = rng.choice([0, 1, 5, 40, 200 if source == "b" else 3])
        rows.append((i, None if i == 7 else " \t w".join(["x"] * n), source, "extra"))
    rows += [rows[20], rows[21]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)
    got = mixing.plan_mix(frame).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    size = {}
    for i, text, source, _ in rows:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += size[i]
    want, source = targets(dict(sizes)), {r[0]: r[2] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(c.words for c in r.copies)
        assert all(0 <= c.position <= 1 for c in r.copies)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(frame).collect()))


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 5, "a" if i % 2 else "b") for i in range(400)]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedule=((1.0, 1.0), (2.0, 0.0))).collect()
    for name, first_half in (("a", 0.5), ("b", 0.75)):
        times = [c.position for r in got if ("a" if r.doc_id % 2 else "b") == name for c in r.copies]
        assert abs(sum(t < 0.5 for t in times) / len(times) - first_half) < 0.02


def test_empty_tables(spark):
    assert mixing.plan_mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    none = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.plan_mix(none).collect()] == [(0, 0.0, 0)] * 2


def test_rows_without_an_id_are_spread(spark):
    rows = [(None if i % 2 else 7, f"w{i} x", "s") for i in range(400)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    order = plan.select("copies").where("size(copies) > 0").collect()
    assert len({c.position for r in order for c in r.copies}) > 390  # no two at one place
