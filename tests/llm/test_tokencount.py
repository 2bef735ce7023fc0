"""Token counts against the library, on all documents and on odd texts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonarium.llm import tokencount
from tonarium.llm.common import table
from tonarium.llm.packing import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n\n  a", "it's  we'll\t\tthey'd'", "<|endoftext|>", "a<|endoftext|>  b <|endoftext|>\n", "1 22  333 x\u0085y", "中文字 и кириллица  123४५", "a͸ᷲ b", "\U0003d000x  y", "x" * 5000, "é \x1c\x1f z"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_all_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = tokencount.op11_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == docs.count()
    assert found[0].__fields__ == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    for r in found:
        n = library(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_cases(spark, library):
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate([*ODD, None, "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = tokencount.count_tokens(docs, PATH, limit=3).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.over_limit) for r in found) == sorted((-1 if i is None else i, library(t), library(t) > 3) for i, t, _ in rows)
    assert tokencount.count_tokens(docs.limit(0), PATH).count() == 0


def test_table_is_bounded_and_right(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lengths = tokencount.frequent_lengths(docs, PATH, size=500)
    assert len(lengths) == 500
    assert all(library(k) == n and len(k) <= tokencount.PIECE for k, n in lengths.items())
    words = tokencount.Counter(w for r in docs.collect() for w in (r.text or "").split())
    assert all(" " + w in lengths for w, _ in words.most_common(50) if re.fullmatch("[a-z]+", w))


def test_a_small_cache_and_lazy_cutting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokencount, "LONG", 8)
    pieces = tokencount.Pieces(PATH)
    cache = tokencount.Cache(pieces.length, 400)
    get = tokencount.Frequent({" a": 1}, cache).__getitem__
    for text in ["the cat sat on a mat", "a a a b c d e f g h", "it's  a test"] * 2:
        assert sum(map(get, pieces.cut(text))) == library(text)
        assert len(cache) <= 3


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab '\n\t1é<|>endoftext ", max_size=40)))
def test_random_texts(text):
    count = test_random_texts.count = getattr(test_random_texts, "count", None) or tokencount.counter(tokencount.Pieces(PATH), {" a": 1})
    assert count(text) == len(Tokenizer_.encode(text, add_special_tokens=False).ids)


Tokenizer_ = Tokenizer.from_file(PATH)


def test_other_files_use_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    pieces = tokencount.Pieces(path)
    assert not pieces.plain
    assert tokencount.counter(pieces, {})("Two words") == len(Tokenizer.from_file(path).encode("Two words", add_special_tokens=False).ids)
