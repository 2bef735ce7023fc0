"""Token counts of whole texts, by a map-side lookup in two tiers.

A byte-level BPE never merges across the pieces that its pattern cuts a text
into, so a text has as many tokens as its pieces have together.  The first tier
is a table of the corpus's frequent pieces and their lengths in tokens, sent to
every executor; its size is bounded by TABLE entries of at most PIECE letters.
The second is a cache in each Python worker, filled by encoding what the first
lacks and emptied when it has grown to CACHE_BYTES.  Neither changes a count,
and no piece is ever shuffled.

The table's words are counted over all texts: each task keeps its most frequent
ones, and those summaries, each of at most WORDS words, are merged as a tree.

Pieces are cut by classes that list the letters, numbers and spaces up to
U+052F; texts with others use the tokenizer's pattern itself, and those with
code points that this Python doesn't know are encoded by the library as a
whole, as are all texts if the file is no plain byte-level BPE.

Cases: null and empty texts have no tokens; special strings in a text are
special tokens, as the library has it; repeated rows and null ids are rows like
others; an empty table gives an empty result; other columns than id and text
are not read, so their names can't clash.  Long texts are cut lazily; the
longest single piece is what a task must hold beside the text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .packing import tokenizer_path

LIMIT = 512
#: Entries of the first tier, and letters of an entry, at most: 2 MB.
TABLE, PIECE = 32_768, 64
#: Words that the summary of a task keeps.
WORDS = 32_768
#: Bytes of the second tier in a worker, with about 150 of overhead an entry.
CACHE_BYTES = 64 << 20
#: Texts of more letters are cut lazily.
LONG = 1 << 20
LAST = 0x52F


class Pieces:
    """What the tokenizer file's pattern cuts texts into, and pieces' lengths."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        cutter, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.plain = (
            spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and spec.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space", True) and not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        self.special = [x["content"] for x in added]
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        near = range(LAST + 1)
        letters, numbers = ("".join(re.escape(chr(c)) for c in near if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        spaces = "".join(re.escape(chr(c)) for c in near if regex.match(r"\s", chr(c)))
        # fixed values: the pattern of byte-level BPE files
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{S}+(?!{X})|{S}+"
        self.near = re.compile(pattern.format(L=f"[{letters}]", N=f"[{numbers}]", O=f"[^{spaces}{letters}{numbers}]", S=f"[{spaces}]", X=f"[^{spaces}]"))
        self.all = regex.compile(pattern.format(L=r"\p{L}", N=r"\p{N}", O=r"[^\s\p{L}\p{N}]", S=r"\s", X=r"\S"))
        self.far = re.compile(f"[^\\x00-{chr(LAST)}]")

    def length(self, piece: str) -> int:
        """Tokens of a piece, or of a whole text."""
        return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def pattern(self, text: str):
        """The pattern that cuts this text; None if only the library can."""
        if not self.plain:
            return None
        if self.far.search(text) is None:
            return self.near
        return None if any(unicodedata.category(c) == "Cn" for c in set(text)) else self.all

    def cut(self, text: str) -> Iterator[str] | list[str]:
        pattern = self.pattern(text)
        if pattern is None:
            raise ValueError("only the library can cut this text")
        return pattern.findall(text) if len(text) < LONG else (m[0] for m in pattern.finditer(text))


class Cache(dict):
    """The second tier: lengths of pieces this worker has met."""

    def __init__(self, length, limit: int = CACHE_BYTES):
        self.encode, self.limit, self.held = length, limit, 0

    def __missing__(self, piece: str) -> int:
        n = self.encode(piece)
        if len(piece) <= PIECE:
            self.held += 150 + len(piece)
            if self.held > self.limit:
                self.clear()
                self.held = 150 + len(piece)
            self[piece] = n
        return n


class Frequent(dict):
    """The first tier; what it lacks is looked up in the second."""

    def __init__(self, lengths: dict[str, int], cache: Cache):
        super().__init__(lengths)
        self.cache = cache

    def __missing__(self, piece: str) -> int:
        return self.cache[piece]


def counter(pieces: Pieces, lengths: dict[str, int]):
    """The function from a text to its number of tokens."""
    get = Frequent(lengths, Cache(pieces.length)).__getitem__

    def count(text: str) -> int:
        if pieces.pattern(text) is None:
            return pieces.length(text)
        if any(x in text for x in pieces.special):
            parts = pieces.cut_special.split(text)
            # around a special token, a text is cut as if it began or ended there
            return len(parts) - 1 + sum(sum(map(get, pieces.cut(x))) for x in parts)
        return sum(map(get, pieces.cut(text)))

    return count


def _most(counts: dict[str, int], n: int) -> dict[str, int]:
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n])


def _summary(keep: int):
    """The function of one task: its most frequent words, one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text), LONG):  # a word on a border counts as two
                    seen.update(text[at : at + LONG].split())
                    if len(seen) > 8 * keep:
                        seen = Counter(_most(seen, keep))
        found = {k: n for k, n in _most(seen, keep).items() if len(k) < PIECE}
        yield pa.RecordBatch.from_arrays([pa.array([list(found)], pa.list_(pa.string())), pa.array([list(found.values())], pa.list_(pa.int64()))], ["words", "counts"])

    return run


def frequent_lengths(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", size: int = TABLE, words: int = WORDS) -> dict[str, int]:
    """The first tier: the most frequent pieces of the words of all texts, and
    their lengths in tokens; at most ``size`` entries."""

    def merge(a: dict, b: dict) -> dict:
        small, large = sorted((a, b), key=len)
        large = dict(large)
        for k, n in small.items():
            large[k] = large.get(k, 0) + n
        return _most(large, words)

    pieces = Pieces(tokenizer_path)
    if not pieces.plain:
        return {}
    rows = docs.select(text_of(text_col).alias("text")).mapInArrow(_summary(words), "words array<string>, counts array<long>")
    seen = rows.rdd.map(lambda r: dict(zip(r["words"], r["counts"], strict=True))).treeAggregate({}, merge, merge)
    found = Counter()
    for word, n in seen.items():
        if pieces.pattern(word) is not None:
            for piece in pieces.cut(" " + word):
                if len(piece) <= PIECE:
                    found[piece] += n
    return {piece: pieces.length(piece) for piece in _most(found, size) if piece not in pieces.special}


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, size: int = TABLE) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); one row
    for each of docs."""
    lengths = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text_col=text_col, size=size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(Pieces(tokenizer_path), lengths.value)
        for batch in batches:
            ids, texts = batch.columns
            tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pc.binary_length(texts).cast(pa.int64()), tokens], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their tokens, and whether they exceed 512."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
