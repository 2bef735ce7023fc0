"""Packing: documents to token sequences of a fixed capacity.

Every document is tokenised and ended with ``end_id``.  Whole windows of a long
document become sequences of their own; what is left of each document is packed
by Karmarkar-Karp multiway differencing: partial partitions, each a vector of
window loads, are merged two by two, the largest loads of one against the
smallest of the other, starting with the two of the largest spread.  If a load
then exceeds the capacity, the number of windows rises and the differencing is
done again.

The operator is one pass without a shuffle: a task packs the documents of its
own partition, in batches of a bounded number of pieces, and carries the
smallest pieces over to its next batch so that each batch nearly fills its
windows.  At the end of a partition the odd rest is cut into sequences whose
length is a power of two, which need no padding.

Cases: null and empty texts give the end token alone; repeated rows are
documents of their own; ties keep input order; an empty table gives an empty
result; columns other than id and text are ignored, so their names can't clash.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

CAPACITY = 4096
END_ID = 2
#: Remainders that are differenced at once, or as many more as a window takes:
#: bounds a task's memory.
BATCH = 1024
#: One part in ROOM of a window is left free for uneven loads.
ROOM = 96
#: Bytes of the parts of words and their ids that a task remembers; when there
#: are more, between two chunks of CHUNK code points, it forgets them all.
WORD_CACHE = 48 << 20
#: Bytes of a remembered part beside its ids: in arrays, and as an object of its
#: own (the entry of a dict, a string, an array; four bytes a code point come on top).
PART_BYTES, OBJECT_BYTES = 40, 330
#: Code points that are looked at at once.
CHUNK = 1 << 20
SPACES = re.compile("[ \t-\r]")
NONE = np.iinfo(np.int64).max


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Deal the items into k lists with nearly equal sums; items by position."""
    left, right, ids = [], [], len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        loads, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        loads[0], nodes[0] = size, i
        heap.append((-size if k > 1 else 0, i, loads, nodes))
    heapq.heapify(heap)
    if not heap:
        return [[] for _ in range(k)]
    while len(heap) > 1:
        _, tie, loads, nodes = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        loads, theirs = loads + other[::-1], theirs[::-1]
        both = np.flatnonzero((nodes >= 0) & (theirs >= 0))
        merged = np.maximum(nodes, theirs)
        left.append(nodes[both])
        right.append(theirs[both])
        merged[both] = ids + np.arange(len(both))
        ids += len(both)
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), tie, loads, merged[order]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    out = []
    for node in heap[0][3]:
        todo, items = [int(node)] if node >= 0 else [], []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                items.append(x)
            else:
                todo += [int(b[x - len(sizes)]), int(a[x - len(sizes)])]
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int, k: int = 1) -> list[list[int]]:
    """Deal items of at most capacity into as few windows as differencing allows,
    k at least."""
    k = max(k, -(-sum(sizes) // capacity))
    while True:
        dealt = karmarkar_karp(sizes, k)
        worst = max((sum(sizes[i] for i in x) for x in dealt), default=0)
        if worst <= capacity:
            return [x for x in dealt if x]
        k += max(1, k * (worst - capacity) // capacity)


#: Characters that need no normalisation but lower case: printable ASCII and
#: the letters of Latin-1.  Words with others, contractions and special tokens
#: go to the library.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
KIND = np.full(257, ODD, np.uint8)
KIND[9:14] = KIND[32] = SPACE
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
KIND[ord("'")] = ODD
LOWER = np.arange(257, dtype=np.uint16)
LOWER[[*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
#: The first n bytes of a little-endian number.
HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SHORT = 16


class Words:
    """A tokenizer that merges each distinct part of a word once.

    The tokenizer drops white space and never joins across it, so a text's ids
    are the ids of its words, and a plain word's those of its parts: runs of
    letters, single digits, runs of signs.  A chunk's parts are found, reduced
    to distinct ones and looked up as arrays; those of up to SHORT letters are
    told apart by two numbers that hold their bytes.  New ones go through
    merges(), which applies the file's own merge list to many parts at once
    (tests hold it against the library).  The library itself encodes any word
    that needs its normaliser.
    """

    def __init__(self, path: str, limit: int = WORD_CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        spec = json.loads(self.tokenizer.to_str())
        model, vocab = spec["model"], spec["model"].get("vocab", {})
        kinds = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", ())]
        self.fast = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and kinds == ["Split", "ByteLevel"] and not model.get("dropout")
        if self.fast:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = dict(zip([*printable, *(x for x in range(256) if x not in set(printable))], [*map(chr, printable), *map(chr, range(256, 512))], strict=False))
            self.inner = np.array([vocab.get(letters[i], 0) for i in range(256)], np.int64)
            self.last = np.array([vocab.get(letters[i] + "</w>", 0) for i in range(256)], np.int64)
            pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
            keys = np.array([vocab[x] * len(vocab) + vocab[y] for x, y in pairs], np.int64)
            made = np.array([vocab[x + y] for x, y in pairs], np.int64)
            order = np.argsort(keys)
            self.size, self.keys, self.ranks, self.made = len(vocab), keys[order], order, made
        self.forget()

    def forget(self) -> None:
        """Empty the memory of parts."""
        none = np.zeros(0, np.uint64)
        #: hash, first and second eight bytes of known parts, sorted by hash
        self.hash, self.first, self.second = none, none, none
        #: where their ids begin, and how many there are
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.odd: dict[str, np.ndarray] = {}
        self.odd_bytes = 0

    def held(self) -> int:
        """About how many bytes are remembered."""
        return len(self.hash) * PART_BYTES + self.ids.nbytes + self.odd_bytes

    def rank(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each pair in the merge list; NONE if it isn't there."""
        key = first * self.size + second
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merges(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, one after the other, and how many each has: the
        earliest merge of each part, leftmost first, until none applies."""
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(x) for x in parts])
        ends = np.cumsum(sizes) - 1
        ids, word = self.inner[raw], np.repeat(np.arange(len(parts)), sizes)
        ids[ends] = self.last[raw[ends]]
        ranks = np.full(len(ids), NONE, np.int64)
        ranks[:-1] = np.where(word[:-1] == word[1:], self.rank(ids[:-1], ids[1:]), NONE)
        done_ids, done_word = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[starts, len(ids)])
            best = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            over = best == NONE
            if over.any():
                done_ids.append(ids[over])
                done_word.append(word[over])
                ids, word, ranks, best = (x[~over] for x in (ids, word, ranks, best))
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == best)
            at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            ids[at] = self.made[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where they stand after the removal
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            for i in (moved, moved[moved > 0] - 1):
                j = np.minimum(i + 1, len(ids) - 1)
                ranks[i] = np.where((i < j) & (word[i] == word[j]), self.rank(ids[i], ids[j]), NONE)
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_ids)[order].astype(np.uint32), np.bincount(word, minlength=len(parts))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def known(self, key: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each part among those remembered, -1 for new ones."""
        if not len(self.hash):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, key), len(self.hash) - 1)
        return np.where((self.hash[at] == key) & (self.first[at] == first) & (self.second[at] == second), at, -1)

    def learn(self, key: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
        """Remember the ids of new parts: of one hash only the first."""
        place = np.searchsorted(self.hash, key)
        if len(self.hash):
            keep = self.hash[np.minimum(place, len(self.hash) - 1)] != key
            place, key, first, second = place[keep], key[keep], first[keep], second[keep]
        raw = np.column_stack([first, second]).astype("<u8").view(f"S{SHORT}").ravel().tolist()
        ids, n = self.merges([x.decode("latin-1").encode() for x in raw])
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, ids])
        known = (self.hash, self.first, self.second, self.at, self.n)
        self.hash, self.first, self.second, self.at, self.n = (np.insert(x, place, y) for x, y in zip(known, (key, first, second, at, n), strict=True))

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of a text, and for each of its parts where it starts (in code
        points) and how many ids it has."""
        points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 256)
        kind = KIND[points]
        kind[:-1][(points[:-1] == ord("<")) & (points[1:] == ord("|"))] = ODD
        edge = np.flatnonzero(np.diff(np.r_[True, kind == SPACE, True].astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return np.zeros(0, np.uint32), begin, begin
        odd = np.logical_or.reduceat(np.r_[kind == ODD, False], np.column_stack([begin, end]).ravel())[::2]
        if odd.any():  # an odd word is one part
            mark = np.zeros(len(kind) + 1, np.int8)
            mark[begin[odd]], mark[end[odd]] = 1, -1
            kind[np.cumsum(mark[:-1]) > 0] = ODD
        before = np.r_[np.uint8(SPACE), kind[:-1]]
        starts = np.flatnonzero((kind != SPACE) & ((kind != before) | (kind == DIGIT)))
        sizes = np.minimum(np.r_[starts[1:], len(kind)], end[np.searchsorted(end, starts, "right")]) - starts
        low = np.zeros(len(points) + SHORT, np.uint8)
        low[: len(points)] = LOWER[points]
        words = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))  # eight bytes from each place
        first, second = words[starts] & HEAD[np.minimum(sizes, 8)], words[starts + 8] & HEAD[np.clip(sizes - 8, 0, 8)]
        short = (sizes <= SHORT) & (kind[starts] != ODD)
        key = first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
        key[~short] = 0
        distinct, some, which = np.unique(key, return_index=True, return_inverse=True)
        new = (self.known(distinct, first[some], second[some]) < 0) & short[some]
        self.learn(distinct[new], first[some[new]], second[some[new]])
        place = self.known(distinct, first[some], second[some])[which]
        # parts of one hash but other bytes are not what was looked up
        rest = np.flatnonzero(~short | (place < 0) | (first != first[some][which]) | (second != second[some][which]))
        place[rest] = 0
        at, n = (self.at[place], self.n[place]) if len(self.at) else (np.zeros(len(place), np.int64), np.zeros(len(place), np.int64))
        ids = self.ids
        if len(rest):
            found = []
            for i, j in zip(starts[rest].tolist(), (starts + sizes)[rest].tolist(), strict=True):
                word = text[i:j]
                if word not in self.odd:
                    self.odd[word] = np.frombuffer(self.whole(word), np.uint32)
                    self.odd_bytes += OBJECT_BYTES + 4 * len(word) + self.odd[word].nbytes
                found.append(self.odd[word])
            n[rest] = [len(x) for x in found]
            at[rest] = len(ids) + np.cumsum(n[rest]) - n[rest]
            ids = np.concatenate([ids, *found])
        total = np.cumsum(n)
        return ids[np.repeat(at - total + n, n) + np.arange(total[-1])], starts, n

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Each text's ids and the end id, as little-endian unsigned 32-bit numbers."""
        if not self.fast:
            return [self.whole(t) + end for t in texts]
        text = "\n".join(texts)
        cuts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        flat, counts = [], np.zeros(len(texts), np.int64)
        at = 0
        while at < len(text):
            stop = min(len(text), at + CHUNK)
            if stop < len(text):  # cut at white space, so that no word is cut
                gap = SPACES.search(text, stop)
                stop = gap.start() if gap else len(text)
            if self.held() > self.limit:
                self.forget()
            ids, starts, n = self.chunk(text[at:stop])
            flat.append(ids.astype("<u4", copy=False).tobytes())
            if len(starts):
                counts += np.bincount(np.searchsorted(cuts, starts + at, "right") - 1, n, len(texts)).astype(np.int64)
            at = stop
        ids, cuts = b"".join(flat), (np.cumsum(np.r_[0, counts]) * 4).tolist()
        return [ids[i:j] + end for i, j in zip(cuts, cuts[1:], strict=False)]


def _pack(capacity: int, path: str, end_id: int, batch_pieces: int):
    """The function of one task: Arrow batches of (doc_id, text) to pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = Words(path)
        end = np.array([end_id], "<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []
        pending: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        held = 0  # their ids

        def emit(pieces: list[tuple]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, ids, total, sequence, at))
                at += n
            sequence += 1

        def flush(last: bool) -> None:
            nonlocal pending, held
            total = held
            k = total // capacity
            goal = k * (capacity - capacity // ROOM)  # room for uneven loads
            pending.sort(key=lambda x: len(x[2]))
            rest = []
            while total > goal:  # the least piece that is as long as what is over, else the longest
                over = total - goal
                x = pending.pop(min(bisect_left(pending, over * 4, key=lambda x: len(x[2])), len(pending) - 1))
                n = len(x[2]) // 4
                if last and n > over:  # cut it: the sum then is the goal
                    pending.append((x[0], x[1], x[2][: (n - over) * 4], x[3]))
                    x = (x[0], x[1] + n - over, x[2][(n - over) * 4 :], x[3])
                    n = over
                rest.append(x)
                total -= n
            for window in windows([len(x[2]) // 4 for x in pending], capacity, k) if pending else ():
                emit([pending[i] for i in window])
            pending, held = rest, sum(len(x[2]) // 4 for x in rest)
            if last:
                total = held
                while total:
                    room = 1 << (min(total, capacity).bit_length() - 1)
                    total -= room
                    sequence_pieces = []
                    while room:
                        doc, start, ids, tokens = pending.pop(0)
                        n = min(room, len(ids) // 4)
                        sequence_pieces.append((doc, start, ids[: n * 4], tokens))
                        if n * 4 < len(ids):
                            pending.insert(0, (doc, start + n, ids[n * 4 :], tokens))
                        room -= n
                    emit(sequence_pieces)

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                columns = list(zip(*rows, strict=True))
                rows = []
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for at in range(0, batch.num_rows, batch_pieces):
                part = batch.slice(at, batch_pieces)
                docs = part.column(0).to_pylist()
                for doc, ids in zip(docs, words.encode(part.column(1).to_pylist(), end), strict=True):
                    total, start = len(ids) // 4, 0
                    while total - start >= capacity:
                        emit([(doc, start, ids[start * 4 : (start + capacity) * 4], total)])
                        start += capacity
                    if start < total:
                        pending.append((doc, start, ids[start * 4 :], total))
                        held += total - start
                        if len(pending) >= batch_pieces and held >= capacity:
                            flush(False)
                yield from out()
        flush(True)
        yield from out()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, batch_pieces: int = BATCH) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each id of each document is in exactly one piece; a sequence's pieces have
    gapless offsets and sum to at most ``capacity``.  Sequence ids are unique
    and repeat when a task is run again on the same partition.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    if batch_pieces < 1:
        raise ValueError("batch_pieces must be positive")
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_pack(capacity, tokenizer_path, end_id, batch_pieces), schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens."""
    return digest(pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
