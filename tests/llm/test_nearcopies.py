import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonarium.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text):
    words = text.lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts):
    """For each text, the first that similarities of 0.8 connect it with."""
    sets, group = [grams(t or "") for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def planted(rng, n):
    """Texts with copies that have some words replaced, cut off or added."""
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 30, 80, 200, 600]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = word()
            copy = copy[: rng.randrange(len(copy) * 8 // 10, len(copy)) + 1] + [word() for _ in range(rng.randrange(3))]
            base = copy if rng.random() < 0.5 else base
            texts.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return [*texts, None, "", " \n", "a b", "A  b"]


def test_stage_equals_brute_force(spark):
    texts = planted(random.Random(5), 120)
    group = brute_groups(texts)
    assert len(texts) - len(set(group)) > 60
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.one_of_each_group(spark, frame, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert corpus_pipeline.one_of_each_group(spark, frame.limit(0), "").collect() == []


def test_rows_of_one_id_in_different_groups(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, b), (1, a), (1, a + " end"), (2, b), (3, a), (4, c), (None, c), (None, c), (5, c)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.one_of_each_group(spark, frame, "").collect()
    assert len(kept) == 5 and sum(r.doc_id is None for r in kept) == 2
    assert sorted((r.doc_id, r.text[0]) for r in kept if r.doc_id) == [(1, "a"), (1, "b"), (4, "c")]


def test_crowded_keys_are_split_again(spark):
    texts = planted(random.Random(6), 40)
    rows = nearcopies.written(nearcopies.marked(spark.createDataFrame([(t,) for t in texts], "text string")), "rows")
    small, usual = ({(r.node, r.root) for r in nearcopies.groups(rows, crowd=c).collect()} for c in (1, nearcopies.CROWD))
    assert small == usual and usual


def test_groups_of_many_blocks(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = planted(rng, 30)
    for k in range(60):  # a chain: each is like the one before
        base = [*base[1:], f"x{k}"]
        texts.append(" ".join(base))
    rows = nearcopies.written(nearcopies.marked(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)), "rows")
    split, usual = ({(r.node, r.root) for r in nearcopies.groups(rows, block=b).collect()} for b in (2500, nearcopies.BLOCK))

    def sets(links):
        members = {}
        for node, root in links:
            members.setdefault(root, {root}).add(node)
        return sorted(map(sorted, members.values()))

    assert sets(split) == sets(usual) and max(map(len, sets(usual))) >= 60


@pytest.mark.parametrize("sizes", [[], [1], [3, 1, 5], [9], [2, 2, 2, 2]])
def test_pieces_end_where_the_key_changes(sizes):
    keys = np.repeat(np.arange(len(sizes)), sizes)
    for step in (1, 2, 3, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + step])], ["key"]) for k in range(0, len(keys), step)]
        pieces = [p.column(0).to_pylist() for p, more in nearcopies._cut(iter(batches), 100) if not more]
        assert sum(pieces, []) == keys.tolist()
        assert all(a[-1] != b[0] for a, b in zip(pieces, pieces[1:]))
        for crowd in (0, 1, 2, 4):  # a crowded value's later pieces repeat its first row
            seen = []
            for p, more in nearcopies._cut(iter(batches), crowd):
                values = p.column(0).to_pylist()
                assert not more or len(set(values)) == 1
                seen += values[1:] if more else values
            assert seen == keys.tolist()


def test_only_blocks_of_different_parts_meet(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    copies = [" ".join([*base, f"x{k}"]) for k in range(60)]  # all alike
    far = " ".join([*base[:104], *(f"y{k}" for k in range(12))])  # like enough to meet, not to be linked
    near = " ".join([*base[:112], *(f"z{k}" for k in range(4))])
    texts = [*copies, far, near]
    rows = nearcopies.written(nearcopies.marked(spark.createDataFrame([(t,) for t in texts], "text string")), "rows")
    prints = {r.text: r._print for r in rows.collect()}
    large = spark.createDataFrame([(0, prints[t], k, len(t)) for k, t in enumerate(texts)], "_group long, _print long, _row long, _size long")
    first = min(prints[t] for t in copies)
    known = spark.createDataFrame([(prints[t], first) for t in copies if prints[t] != first], "node long, root long")
    block = 8 * len(texts[0])
    tasks = nearcopies._across(large, known, block).collect()
    blocks = -(-sum(map(len, copies)) // block)
    assert len(tasks) == len(copies) + 2 * blocks + 2  # each copy once, the two lesser ones with each block and each other
    alone = nearcopies._across(large.where(F.col("_row") < 60), known, block)
    assert alone.collect() == []
    split = {(r.node, r.root) for r in nearcopies.groups(rows, block=block).collect()}
    usual = {(r.node, r.root) for r in nearcopies.groups(rows).collect()}
    assert split == usual and len(usual) >= 60


def test_known_parts_are_connected_already():
    rng = np.random.default_rng(3)
    base = np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64))
    other = np.sort(rng.integers(0, 1 << 62, 100).astype(np.uint64))
    sets = [base, other, base[:90], base[:40]]
    assert nearcopies.connected(sets).tolist() == [0, 1, 0, 3]
    assert nearcopies.connected(sets, [7, 8, 9, 8]).tolist() == [0, 1, 0, 1]
    assert nearcopies.connected(sets, [7, 7, 9, 9]).tolist() == [0, 0, 0, 0]


def test_fingerprints_find_pairs_within_three_bits(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    texts = [" ".join([*base, *(f"x{j}" for j in range(k))]) for k in range(4)] + [" ".join(f"y{rng.randrange(5000)}" for _ in range(2000))]
    sets = [nearcopies.shingle_set(t.encode()) for t in texts]
    apart = lambda i, j: (nearcopies.fingerprint(sets[i]) ^ nearcopies.fingerprint(sets[j])).bit_count()
    assert all(apart(i, i + 1) <= 3 for i in range(3)) and apart(0, 4) > 3
    rows = nearcopies.written(nearcopies.marked(spark.createDataFrame(list(enumerate(texts)), "i int, text string")), "rows")
    # keys that agree nowhere: only the SimHash operator can find a pair
    alone = nearcopies.written(rows.withColumn("_keys", F.transform("_keys", lambda k: k + F.col("i"))), "rows")
    name = {r._print: r.i for r in rows.collect()}
    for given in (rows, alone):
        found = nearcopies.groups(given).collect()
        assert {name[r.node] for r in found} | {name[r.root] for r in found} == {0, 1, 2, 3}
        assert len({r.root for r in found}) == 1 and len(found) == 3


def test_fingerprints_that_agree_are_checked_exactly(spark):
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in "ab"]
    rows = nearcopies.marked(spark.createDataFrame([(t,) for t in texts], "text string")).withColumn("_fingerprint", F.lit(5).cast("long"))
    rows = nearcopies.written(rows, "rows")
    assert nearcopies.fingerprint_links(rows).count() == 1
    assert nearcopies.groups(rows).collect() == []
