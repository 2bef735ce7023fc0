import random

import numpy as np
import pytest

from tonarium.llm import packing

pytest.importorskip("public_tokenizers")


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def test_differencing_is_even():
    rng = random.Random(0)
    sizes = [rng.randrange(1, 500) for _ in range(400)]
    dealt = packing.karmarkar_karp(sizes, 20)
    assert sorted(i for x in dealt for i in x) == list(range(400))
    loads = [sum(sizes[i] for i in x) for x in dealt]
    assert max(loads) - min(loads) <= 10
    assert packing.karmarkar_karp([], 3) == [[], [], []]


def test_windows_rise_when_capacity_is_exceeded():
    assert len(packing.windows([6, 6, 6], 10)) == 3
    assert len(packing.windows([5, 5, 6, 4], 10)) == 2


def test_words_equal_the_library():
    rng = random.Random(1)
    words = packing.Words(packing.tokenizer_path())
    assert words.fast
    odd = ["", " \n", "don't can't 'S it's", "<|endoftext|> a<|startoftext|>b", "x\x1cy", "İstanbul ﬁ ½ ²3 123abc __a_b", "é é ÀÉ ß ẞ", "a\u00a0b\u2003c", "{}~|`^\\\x00", "日本語 кіт", "aaaaaaaaaaaaaaaa bbb!!??...---###"]
    texts = odd + ["".join(rng.choice("abcdeth inrouséüß.,!'&%0 1\nABC") for _ in range(rng.randrange(80))) for _ in range(300)]
    for text, got in zip(texts, words.encode(texts, b""), strict=True):
        assert got == words.whole(text), text


def test_pieces(spark):
    rng = random.Random(2)
    texts = [None, "", "word " * 9000, "a" * 30_000] + [" ".join(rng.choice(["tree", "house", "Xyzzy,", "42"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0), (None, "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(2)
    pieces = packing.pack_documents(frame, packing.tokenizer_path(), batch_pieces=32).toPandas()
    seen = {}
    for p in pieces.itertuples():
        doc = -1 if p.doc_id != p.doc_id else int(p.doc_id)
        seen.setdefault(doc, []).append((p.start, np.frombuffer(p.ids, "<u4"), p.doc_tokens))
    assert set(seen) == {-1, *range(len(texts))}
    for doc, parts in seen.items():
        want = ids_of("x" if doc < 0 else texts[doc])
        copies = 2 if doc == 5 else 1
        assert sum(len(x) for _, x, _ in parts) == copies * len(want)
        assert all((want[s : s + len(x)] == x).all() and n == len(want) for s, x, n in parts)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= packing.CAPACITY
    again = packing.pack_documents(frame, packing.tokenizer_path(), batch_pieces=32).toPandas()
    assert again.equals(pieces)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), packing.tokenizer_path()).collect() == []


def test_all_documents_equal_the_library():
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables")
    texts = [t or "" for t in pq.read_table(path).column("text").to_pylist()]
    words = packing.Words(packing.tokenizer_path(), limit=400_000)  # forgets on the way
    got = [x for at in range(0, len(texts), 100) for x in words.encode(texts[at : at + 100], b"")]
    assert got == [words.whole(t) for t in texts]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    words = packing.Words(packing.tokenizer_path())
    texts = ["", "tree house " * 200, "x" * 300 + " y", "l'été " * 80, "no", "", "antidisestablishmentarianism 12,345.67 " * 9, "donaudampfschifffahrtsgesellschaft"]
    assert words.encode(texts, b"") == [words.whole(t) for t in texts]


def test_many_empty_texts_wait_for_a_whole_window():
    import time

    import pyarrow as pa

    run = packing._pack(packing.CAPACITY, packing.tokenizer_path(), packing.END_ID, packing.BATCH)
    began = time.process_time()
    out = pa.Table.from_batches(run([pa.RecordBatch.from_pydict({"doc_id": list(range(16_384)), "text": [""] * 16_384})]))
    assert out.num_rows == 16_384 and time.process_time() - began < 6
    assert len(set(out["sequence_id"].to_pylist())) <= 8


def test_a_worker_remembers_a_bounded_number_of_bytes():
    """Words that the library encodes are objects of their own: they count by
    their bytes, and a long text is forgotten between its chunks, too."""
    words = packing.Words(packing.tokenizer_path(), limit=1 << 20)
    texts = [" ".join(f"слово{i}ї{j}" for j in range(300)) for i in range(60)]
    most = 0
    for text in texts:
        assert words.encode([text], b"") == [words.whole(text)]
        most = max(most, words.held())
    one = 300 * (packing.OBJECT_BYTES + 4 * 10 + 4 * 16)  # what a text can add
    assert words.odd_bytes and most <= (1 << 20) + one
    long = " ".join(texts)
    words.forget()
    before, packing.CHUNK = packing.CHUNK, 1 << 14
    try:
        assert words.encode([long], b"") == [words.whole(long)]
    finally:
        packing.CHUNK = before
    assert words.held() < 2 << 20
