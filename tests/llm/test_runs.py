"""Runs against the definition, on small alphabets, documents and odd rows."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tonarium.llm import runs
from tonarium.llm.common import table

SF = "/root/testdata/sf0.01"


def brute(words, least):
    """Every maximal stretch of each period, with smallest periods only."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items() if n >= max(least, 2 * q))


def quick(words, least):
    """brute() with arrays, for whole documents."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    s, found = np.array([ids[w] for w in words]), {}
    for q in range(1, len(s) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.r_[0, s[q:] == s[:-q], 0].astype(int)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= q:
                found.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in found.items() if n >= max(least, 2 * q))


def by_rule(words, found):
    drop = {i for a, n, q in found for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in drop)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=4), st.integers(2, 13))
def test_small_alphabets(documents, least):
    found = runs.document_runs([(d, runs.stretches(d, least)) for d in documents], least)
    assert found == [brute(d, least) for d in documents]
    for words, r in zip(documents, found):
        assert runs.collapse(words, r) == by_rule(words, r)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=6), st.integers(1, 6)), max_size=8))
def test_powers(parts):
    words = [w for part, times in parts for w in part * times]
    assert runs.document_runs([(words, [(0, len(words))])], 2) == [brute(words, 2)] if words else True
    assert quick(words, 2) == brute(words, 2)


def test_fibonacci_and_one_word():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b, [b"x"] * 700, [b"x", b"y"] * 300 + [b"y"]):
        assert runs.document_runs([(words, runs.stretches(words))]) == [quick(words, 12)]


def test_all_documents(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    found = {r.doc_id: r for r in runs.op12_periodic_runs(spark, SF).collect()}
    assert found.keys() == docs.keys()
    some = 0
    for doc, text in docs.items():
        words = runs.planted(doc, (text or "").encode().split())
        want, r = quick(words, 12), found[doc]
        best = max(want, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(by_rule(words, want)).hexdigest()
        some += bool(want)
    assert some > 80


def test_planted_words():
    words = [str(i).encode() for i in range(50)]
    same = [d for d in range(200) if runs.planted(d, words) == words]
    import zlib

    assert all(zlib.crc32(str(d).encode()) % 10 for d in same) and 150 < len(same) < 200
    assert runs.planted(None, words) == words and runs.planted(7, []) == []


def test_cases(spark):
    line = "one two three four five six "
    rows = [(1, line * 3, "x"), (1, line * 3, "x"), (None, "a\t\nb" + " a b" * 9, None), (3, None, ""), (4, "", ""), (5, " \n ", ""), (6, "été " * 12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = sorted(([tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs).collect())
    once = ([(0, 18, 6)], line.strip())
    assert found == sorted([once, once, ([(0, 20, 2)], "a b"), ([], ""), ([], ""), ([], ""), ([(0, 12, 1)], "été")])
    assert runs.find_runs(docs.limit(0)).count() == 0
    assert [r.collapsed for r in runs.find_runs(docs.where("doc_id = 1"), batch=1).collect()] == [line.strip()] * 2
