"""Resampling against a plain version, on all documents and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tonarium.llm import resample
from tonarium.llm.common import table

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, buckets=10000, percent=5, min_words=20):
    where = lambda text: Counter(zlib.crc32(f.encode()) % buckets for f in features(text)[0])
    ours = [(i, where(t), features(t)[1]) for i, t in docs]
    s, t = sum((c for _, c, _ in ours), Counter()), sum(map(where, target), Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, c, n in ours:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = plain(docs, [r.text for r in table(spark, SF, "benchmark").collect()])
    found = resample.op13_importance_resampling(spark, SF)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = found.collect()
    assert ordered(rows) == ordered(want)
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 1 + sum(r.n_features >= 57 for r in rows) * 5 // 100))


def test_cases(spark):
    words = "Alpha beta,gamma 12 déjà ÉCOLE " * 6
    rows = [(1, words, "x"), (1, words, "x"), (None, words, None), (None, words, ""), (3, None, ""), (4, "", ""), (5, " -- ", ""), (6, "one", ""), (7, "one two", ""), (8, "x " * 20, ""), (9, "x " * 19, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, buckets string")
    target = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    for size in (resample.BATCH, 40, 1):
        found = resample.resample(docs, target, percent=60, batch_bytes=size).collect()
        assert ordered(found) == ordered(plain([r[:2] for r in rows], ["alpha beta", None], percent=60))
    nothing = spark.createDataFrame([], "text string")
    assert ordered(resample.resample(docs, nothing).collect()) == ordered(plain([r[:2] for r in rows], []))
    assert resample.resample(docs.limit(0), target).count() == 0


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_parts_hold_each_word_once(size):
    text = b"  aa b  ccc d eeeeeeeeee f   g "
    own = []
    for skip, part in resample.parts(text, size):
        words = part.split()
        assert words[:skip] == own[len(own) - skip :] and (skip == min(2, len(own)))
        assert part.split(b" ")[:skip] == words[:skip]
        own += words[skip:]
    assert own == text.split()
    assert list(resample.parts(b"", size)) == [(0, b"")]
