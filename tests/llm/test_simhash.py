import numpy as np

import random

import pytest

from tonarium.llm import simhash


def brute(values):
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values if find(v) != v}


@pytest.mark.parametrize("crowd", [4096, 1, 7])
def test_links_find_every_component(spark, crowd):
    rng = random.Random(5)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(rng.randrange(12)):
            w = v
            for _ in range(rng.randrange(1, 5)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
            if rng.random() < 0.5:
                v = w
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(3)
    got = {r.node: r.root for r in simhash.components(simhash.links(frame, crowd=crowd)).collect()}
    assert got == brute(signed)


def test_documents_of_all_kinds(spark):
    rows = [(3, None), (1, ""), (2, " \t"), (7, "One two"), (6, "one TWO"), (9, "x" * 50_000), (None, "one two"), (6, "one TWO")]
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, key int, fingerprint string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame).collect()), key=str)
    by = {i: (f, c) for i, f, c in got}
    assert len(got) == 8
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[6] == by[7] == by[None] and by[6][1] == 6
    assert by[9][1] == 9


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_neighbours_looked_up_or_compared():
    rng = np.random.default_rng(5)
    for free, n in ((18, 6000), (40, 300), (12, 4000), (3, 8), (0, 1)):
        spread = np.zeros(n, np.uint64)
        for bit in rng.choice(64, free, replace=False).tolist():
            spread |= rng.integers(0, 2, n, np.uint64) << np.uint64(bit)
        values = np.unique(spread ^ np.uint64(0x0123456789ABCDEF))
        a, b = simhash.near(values, 3)
        group = {int(v): int(v) for v in values}
        group |= dict(zip(a.tolist(), b.tolist(), strict=True))
        root = lambda v: v if group[v] == v else root(group[v])
        x = values[:600]
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3)
        assert all(root(int(x[p])) == root(int(x[q])) for p, q in zip(i.tolist(), j.tolist(), strict=True))
        assert len(a) < max(1, len(values))
    # a key of 32,768 members stays a forest
    values = np.unique(rng.integers(0, 1 << 18, 60_000, np.uint64))[:32_768]
    a, b = simhash.near(values, 3)
    assert len(a) < len(values)


def test_query_against_brute_force(spark):
    import os

    import xxhash

    if not os.path.exists("/root/testdata/sf0.001"):
        import pytest

        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()

    def print_of(text):
        words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {r.doc_id: print_of(r.text) for r in docs}
    least = {d: d for d in prints}
    for d in sorted(prints):
        near = {least[e] for e in prints if (prints[d] ^ prints[e]).bit_count() <= 3}
        least = {e: min(near) if x in near else x for e, x in least.items()}
    got = simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{p:016x}", least[d]) for d, p in prints.items()}
