"""Periodic runs of words, by the linear tandem-repeat method of Gusfield and
Stoye.

A run is a stretch of words with smallest period q, at least twice as long as q
(and at least ``least`` words), that no neighbouring word extends.  Documents
are rows that Spark deals out; a task looks at the words of several of them as
one string in which each stretch ends with a symbol of its own:

1. The string is indexed: ranks of all substrings of 1, 2, 4.. symbols (which
   also give the suffix array and common extensions to either side), and the
   suffix tree with suffix links, as arrays.
2. The blocks of its Lempel-Ziv factorisation give a leftmost-covering set of
   squares: every square's first occurrence is one of them or follows from one
   to its left by moving one word at a time (two kinds of squares per block, by
   the half that holds the block's border).
3. From each of these, suffix-link walks in the tree go to the square that
   starts one word later, until one is known; then the vocabulary of squares
   is complete.  Squares whose root is itself a power are left out, since runs
   have smallest periods.
4. The leaves below a square's place are its occurrences; occurrences of one
   period at consecutive words are one run.

Only stretches that can hold a run are indexed: all words of a run of ``least``
words stand in strings of ``least // 2`` words that occur twice in the document,
so the others cut a text into stretches.  Hashes choose the stretches, never a
run.

Cases: null and empty texts have no words and no runs; white space between kept
words becomes one space; repeated rows and null ids are rows like others; an
empty table gives an empty result; other columns than id and text are not read,
so their names can't clash.  A task holds some 300 bytes for each word of such
stretches in the longest text.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

LEAST = 12
#: Words that are indexed at once, or one document's.
BATCH = 1 << 16
#: Bytes of texts that a task holds back for that.
HELD = 8 << 20


class Index:
    """Suffix array, common extensions and suffix tree of a string of numbers
    whose first and last symbols occur once."""

    def __init__(self, s: np.ndarray):
        self.s, self.n = s, len(s)
        self.levels = list(self._levels())
        self.rank = self.levels.pop()
        self.sa = np.empty(self.n, np.int64)
        self.sa[self.rank] = np.arange(self.n)

    def _levels(self) -> Iterator[np.ndarray]:
        """Ranks of the substrings of 1, 2, 4.. symbols, equal for equal ones;
        the last tells all apart.  Only what is tied is sorted again."""
        order = np.argsort(self.s, kind="stable")
        first = np.r_[True, self.s[order][1:] != self.s[order][:-1], True]
        rank = np.empty(self.n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(first[:-1], np.arange(self.n), 0))
        yield rank
        step = 1
        while len(tied := np.flatnonzero(~(first[:-1] & first[1:]))):
            at = order[tied]
            key = rank[at].astype(np.int64) * self.n + rank[at + step]
            by = np.argsort(key, kind="stable")
            key, order[tied] = key[by], at[by]
            first[tied] = new = np.r_[True, key[1:] != key[:-1]]
            rank = rank.copy()
            rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
            yield rank
            step *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the symbols from i and from j on agree (i <> j)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = (level[np.minimum(i, self.n - 1)] == level[np.minimum(j, self.n - 1)]) & (np.maximum(i, j) < self.n)
            i[same] += 1 << k
            j[same] += 1 << k
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the symbols up to i and up to j agree (i <> j)."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, back = self.levels[k], (1 << k) - 1
            same = (level[np.maximum(i - back, 0)] == level[np.maximum(j - back, 0)]) & (np.minimum(i, j) >= back)
            i[same] -= 1 << k
            j[same] -= 1 << k
        return begin - i

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size symbols from i and from j on are equal (size >= 1)."""
        out = np.zeros(len(i), bool)
        k = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, len(self.levels))
        out[i == j] = True
        for level in np.unique(k[k < len(self.levels)]):
            at = np.flatnonzero(k == level)
            ranks, last = self.levels[level], size[at] - (1 << int(level))
            out[at] = (ranks[i[at]] == ranks[j[at]]) & (ranks[i[at] + last] == ranks[j[at] + last])
        return out

    def interval(self, i: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place in the suffix array with the size symbols from i on."""
        ends = []
        for way in (-1, 1):
            inside = self.rank[i].astype(np.int64)
            outside = np.full(len(i), -1 if way < 0 else self.n, np.int64)
            while len(todo := np.flatnonzero(np.abs(outside - inside) > 1)):
                middle = (inside[todo] + outside[todo]) // 2
                start = self.sa[middle]
                fits = start + size[todo] <= self.n
                fits[fits] = self.same(start[fits], i[todo][fits], size[todo][fits])
                inside[todo[fits]], outside[todo[~fits]] = middle[fits], middle[~fits]
            ends.append(inside)
        return ends[0], ends[1]

    def blocks(self) -> np.ndarray:
        """Where the blocks of the factorisation begin: each is the longest
        string that also starts earlier, or a single new symbol."""
        before, after, stack = [-1] * self.n, [-1] * self.n, []
        for i in self.sa.tolist():  # nearest suffixes in order that start earlier
            while stack and stack[-1] > i:
                after[stack.pop()] = i
            if stack:
                before[i] = stack[-1]
            stack.append(i)
        longest = np.zeros(self.n, np.int64)
        for other in (np.array(before), np.array(after)):
            at = np.flatnonzero(other >= 0)
            longest[at] = np.maximum(longest[at], self.forward(at, other[at]))
        jumps, starts, i = np.maximum(longest, 1).tolist(), [], 0
        while i < self.n:
            starts.append(i)
            i += jumps[i]
        return np.array(starts, np.int64)

    def tree(self) -> None:
        """The suffix tree: leaves are places in the suffix array, inner nodes
        follow; of each node parent, depth, first and last leaf; suffix links;
        children by parent and symbol."""
        n = self.n
        common = self.forward(self.sa[:-1], self.sa[1:]).tolist()
        common.append(0)
        parent, depth, left, right = [n] * (n + 1), [0], [0], [n - 1]
        stack = [n]
        for leaf, shared in enumerate(common):
            child, begin = leaf, leaf
            while depth[stack[-1] - n] > shared:
                node = stack.pop()
                parent[child], right[node - n] = node, leaf
                child, begin = node, left[node - n]
            if depth[stack[-1] - n] < shared:
                stack.append(n + len(depth))
                depth.append(shared)
                left.append(begin)
                right.append(-1)
                parent.append(n)
            parent[child] = stack[-1]
        self.root = n
        self.parent = np.array(parent, np.int64)
        self.depth = np.r_[n - self.sa, depth].astype(np.int64)
        self.left, self.right = np.r_[np.arange(n), left], np.r_[np.arange(n), right]
        inner = np.arange(n + 1, len(parent))
        where = self.left * n + self.right
        by = np.argsort(where[n:])
        self.nodes, self.places = by + n, where[n:][by]
        self.link = np.full(len(parent), n, np.int64)
        deep = inner[self.depth[inner] > 1]
        if len(deep):
            self.link[deep] = self.node(*self.interval(self.sa[self.left[deep]] + 1, self.depth[deep] - 1))
        below = np.flatnonzero(np.arange(len(parent)) != n)
        up = self.parent[below]
        key = up * (n + 1) + self.s[self.sa[self.left[below]] + self.depth[up]]
        by = np.argsort(key)
        self.keys, self.children = array("q", key[by].tobytes()), array("q", below[by].astype(np.int64).tobytes())

    def node(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The node whose leaves go from first to last."""
        at = np.minimum(np.searchsorted(self.places, first * self.n + last), len(self.places) - 1)
        return np.where(first == last, first, self.nodes[at])


def covering(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares that cover, leftmost first, all squares."""
    s, n, h = index.s, index.n, index.blocks()
    ends = np.r_[h[1:], n]
    sizes = ends - h
    found = []

    def pairs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.repeat(np.arange(len(h)), counts)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    block, k = pairs(np.where(ends < n, sizes, 0))  # the right half holds the border behind the block
    border = ends[block]
    keep = s[border] == s[border - k]
    border, k = border[keep], k[keep]
    q = border - k
    ahead, back = index.forward(border, q), index.backward(border - 1, q - 1)
    keep = ahead + back >= k
    found.append((np.maximum(q - back, q - k + 1)[keep], k[keep]))

    block, k = pairs(sizes + np.r_[sizes[1:], 0])  # the left half holds the block's first border
    begin, q = h[block], h[block] + k
    keep = (q < n) & (begin > 0)
    keep[keep] = (s[begin[keep]] == s[q[keep]]) & (s[begin[keep] - 1] == s[q[keep] - 1])
    block, begin, q, k = block[keep], begin[keep], q[keep], k[keep]
    ahead, back = index.forward(begin, q), index.backward(begin - 1, q - 1)
    start = np.maximum(begin - back, begin - k + 1)
    keep = (ahead + back >= k) & (start + k <= ends[block])
    found.append((start[keep], k[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def with_primitive_root(index: Index, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power of a shorter string."""
    left, primitive = k.copy(), np.ones(len(k), bool)
    factor = 2
    while len(todo := np.flatnonzero(left > 1)):
        if factor * factor > int(left[todo].max()):  # what is left are primes
            prime = left[todo]
        else:
            todo = todo[left[todo] % factor == 0]
            prime = np.full(len(todo), factor)
        d = k[todo] // np.maximum(prime, 1)
        primitive[todo] &= ~index.same(start[todo], start[todo] + d, 2 * k[todo] - d)
        if factor * factor > int(left.max()):
            break
        while len(again := np.flatnonzero(left % factor == 0)):
            left[again] //= factor
        factor += 1
    return primitive


def vocabulary(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """All squares with a primitive root: nodes below them in the tree, periods."""
    start, k = covering(index)
    keep = with_primitive_root(index, start, k)
    start, k = start[keep], k[keep]
    if not len(k):
        return start, k
    index.tree()
    n, root = index.n, index.root
    known = dict.fromkeys((index.node(*index.interval(start, 2 * k)) * (n + 1) + k).tolist())
    s, sa, parent, depth, left, link = (x.tolist() for x in (index.s, index.sa, index.parent, index.depth, index.left, index.link))
    keys, children = index.keys, index.children

    def child(node: int, symbol: int) -> int:
        key = node * (n + 1) + symbol
        at = bisect_left(keys, key)
        return children[at] if at < len(keys) and keys[at] == key else -1

    for square in list(known):
        node, p = divmod(square, n + 1)
        size = 2 * p
        while True:
            at = sa[left[node]]
            symbol = s[at]
            node = parent[node]
            node = link[node] if node != root else root
            while depth[node] < size - 1:  # skip down to the place without the first word
                node = child(node, s[at + 1 + depth[node]])
            if depth[node] == size - 1:
                node = child(node, symbol)
                if node < 0:
                    break
            elif s[sa[left[node]] + size - 1] != symbol:
                break
            square = node * (n + 1) + p
            if square in known:
                break
            known[square] = None
    found = np.fromiter(known, np.int64, len(known))
    return found // (n + 1), found % (n + 1)


def string_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of a string of numbers
    whose first and last symbols occur once."""
    index = Index(s)
    node, p = vocabulary(index)
    if not len(p):
        return p, p, p
    counts = index.right[node] - index.left[node] + 1
    places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - index.left[node], counts)
    start, p = index.sa[places], np.repeat(p, counts)
    by = np.lexsort((start, p))
    start, p = start[by], p[by]
    new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(p)] - 1
    return start[new], start[last] + 2 * p[new] - start[new], p[new]


def stretches(words: list[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """The parts of a document that can hold a run of least words: those in
    which each word stands in a string of least // 2 words that occurs twice."""
    gram = least // 2
    n = len(words) - gram + 1
    if len(words) < least:
        return []
    if gram < 2:
        return [(0, len(words))]
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(gram):
        key = key * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    order = np.argsort(key)
    twice = np.flatnonzero(key[order][1:] == key[order][:-1])
    if not len(twice):
        return []
    change = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.r_[order[twice], order[twice + 1]])
    np.add.at(change, starts, 1)
    np.add.at(change, starts + gram, -1)
    edge = np.flatnonzero(np.diff(np.r_[0, np.cumsum(change[:-1]) > 0, 0]))
    return [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= least]


def document_runs(documents: list[tuple[list[bytes], list[tuple[int, int]]]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start and period;
    a document comes as its words and stretches."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    ids: dict[bytes, int] = {}
    symbols, origin, base = [-1], [], [0]
    for k, (words, parts) in enumerate(documents):
        for a, b in parts:
            base.append(len(symbols))
            origin.append((k, a))
            symbols += [ids.setdefault(w, len(ids)) for w in words[a:b]]
            symbols.append(-1)
    if not origin:
        return found
    s = np.array(symbols, np.int64)
    ends = np.flatnonzero(s < 0)
    s[ends] = len(ids) + np.arange(len(ends))
    start, length, period = string_runs(s)
    keep = length >= np.maximum(least, 2 * period)
    start, length, period = start[keep], length[keep], period[keep]
    part = np.searchsorted(base, start, "right") - 1
    for i, x, n, p in sorted(zip(part.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True)):
        k, a = origin[i - 1]
        found[k].append((x - base[i] + a, n, p))
    return found


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, with one space between."""
    kept, at, drop_to = [], 0, 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        a = max(a, drop_to)
        if a < b:
            kept += words[at:a]
            at = drop_to = b
    return b" ".join([*kept, *words[at:]])


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batch: int = BATCH, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start and period),
    collapsed (the text without repetitions of a run's first period).

    prepare, if given, makes the words to look at of a row's id and words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # id, words, stretches

        def rows() -> pa.RecordBatch:
            runs = document_runs([x[1:] for x in held], least)
            texts = pa.array([collapse(x[1], r) for x, r in zip(held, runs, strict=True)], pa.binary()).cast(pa.string())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            found = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs], kind)
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], ids.type), found, texts], ["doc_id", "runs", "collapsed"])
            held.clear()
            return out

        for part in batches:
            ids = part.column(0)
            symbols = size = 0
            for doc, text in zip(ids.to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = text.split()
                words = prepare(doc, words) if prepare else words
                held.append((doc, words, stretches(words, least)))
                symbols += sum(b - a for a, b in held[-1][2])
                size += len(text)
                if symbols >= batch or size >= HELD:
                    symbols = size = 0
                    yield rows()
            if held:
                yield rows()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by id, made periodic from some word on."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them made periodic: how many runs, the longest
    one, digests of all runs and of the words that are kept."""
    found = find_runs(table(spark, sf_dir, "documents"), prepare=planted)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.concat_ws("\n", F.concat(lines, F.array(F.lit("")))).alias("lines"), "collapsed")
    return found.select(
        "doc_id", "n_runs", (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"), F.expr("1000 * r.length div -r.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
