import random

import numpy as np
import pytest

from tonarium.llm import sufdedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    places = {}
    for d, t in enumerate(data):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((d, i))
    masks = [np.zeros(len(t), bool) for t in data]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                masks[d][i : i + length] = True
    return [(len(t), int(m.sum()), int((np.diff(np.r_[False, m].astype(int)) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~m])) for t, m in zip(data, masks, strict=True)]


def some_texts(rng, n):
    passage = "".join(rng.choice("abcd") for _ in range(90))
    texts = [None, "", "x" * 100, "ab" * 40, passage, passage]
    for _ in range(n):
        t = "".join(rng.choice("abcdefghé ") for _ in range(rng.randrange(0, 160)))
        if rng.random() < 0.5:
            i = rng.randrange(40)
            t += passage[i : i + rng.randrange(90)] + "".join(rng.choice("ab") for _ in range(30))
        texts.append(t)
        if rng.random() < 0.2:
            texts.append(t)
    return texts


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for _ in range(30):
        segments = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))).encode() for _ in range(rng.randrange(1, 8))]
        text, order, end = sufdedup.suffix_array(segments)
        full = [(tuple(text[i : end[i]]), int(end[i])) for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: full[i])
        prefixes = sufdedup.common_prefixes(text, order, end, 1000)
        for r in range(1, len(order)):
            a, b = full[order[r - 1]][0], full[order[r]][0]
            k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefixes[r] == k


@pytest.mark.parametrize("shard", [1 << 20, 600])
def test_against_brute_force(spark, shard):
    rng = random.Random(7)
    texts = some_texts(rng, 60)
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, tid int, anchor string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in sufdedup.remove_repeats(frame, length=40, gram=8, shard=shard).collect()}
    want = brute(texts, 40)
    assert [got[i] for i in range(len(texts))] == want


def test_empty_table(spark):
    assert sufdedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_at_the_border_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(sufdedup, "PIECE", 64)
    anchors, rng = sufdedup.Anchors(40, 8), random.Random(3)
    monkeypatch.undo()
    whole = sufdedup.Anchors(40, 8)
    for n in (39, 40, 63, 64, 65, 103, 104, 105, 500):
        text = bytes(rng.randrange(97, 100) for _ in range(n))
        monkeypatch.setattr(sufdedup, "PIECE", 64)
        cut = anchors.segments(text)
        monkeypatch.undo()
        one = whole.segments(text)
        expand = lambda s: [(h, i) for h, a, b in zip(*(x.tolist() for x in s), strict=True) for i in range(a, b + 1)]
        assert expand(cut) == expand(one)


def test_long_text_null_ids_and_repeated_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(90))
    long = " ".join(word() for _ in range(120_000))  # more than one piece
    cut = sufdedup.PIECE - 200
    long = long[:cut] + passage + long[cut:]
    rows = [(1, long), (None, "x " + passage), (2, passage[:300]), (3, "own"), (3, "own"), (4, passage + passage)]
    got = sufdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    want = [(d, *w) for (d, _), w in zip(rows, brute([t for _, t in rows], sufdedup.LENGTH), strict=True)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == sorted(want, key=str)


def test_query_against_brute_force(spark):
    import hashlib
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        import pytest

        pytest.skip("no tables")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(docs, brute([r.text for r in docs], sufdedup.LENGTH), strict=True)}
    got = sufdedup.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {d: (n, m, s, hashlib.sha256(k).hexdigest()) for d, (n, m, s, k) in want.items()}
    assert all(r.has_repeat == (r.n_removed > 0) and r.kept_bytes == r.n_bytes - r.n_removed for r in got)
