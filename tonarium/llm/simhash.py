"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has bit b set if over half of its shingles' hashes
have it.  Two fingerprints that differ in at most three of 64 bits, cut into
two segments, have a segment that differs in at most one bit.  So each distinct
fingerprint is filed under each segment with each single bit of it masked out
(a deletion variant): two such fingerprints meet under one key.  An equality
join on keys finds the candidates and a popcount verifies them.

Fingerprints, not documents, are linked: copies collapse into one fingerprint
first.  Under one key, links are reduced to a spanning forest before they leave
the task, which keeps every component and emits at most one link a member.  A
key with more than CROWD members is not compared at once: its members are filed
again, under the same kind of variants of the other segment, whose two
quarters must again agree but for one bit.  A second key leaves 18 free bits,
so its group is bounded by its values, whatever the input, and each member has
987 neighbours at most, which are looked up.

Components come from alternating large-star and small-star steps over the
links, each written to the shared folder.

Cases: null and empty texts, and texts of white space, have fingerprint zero
and are linked like any other; texts of fewer words than a shingle have one
shingle; repeated rows each get their row; a null doc_id is never the smallest
unless its group has no other (then the component is null); an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, text_of, written

SEED = 42
DISTANCE = 3
#: Members of a key that are compared at once.
CROWD = 4096
#: Links that a task holds before it reduces them.
LINKS = 200_000
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle (repeats included), as unsigned numbers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    found = text.translate(LOWER).split()  # bytes: ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[: len(found) - words].tolist()]
    return np.array([digest(line[i:j], SEED) for i, j in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 16_384):  # bounds the memory of very long texts
        counts += np.unpackbits(hashes[at : at + 16_384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (long, the unsigned number's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = [fingerprint(shingle_hashes(t, words)) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def variants(value, bits: int, tag: int):
    """Keys of one segment: each bit masked out; tag tells segments apart."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.lit(tag << 40) + b.cast("long") * F.lit(1 << 33) + value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), b))))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values reduced to (member, smallest member) pairs."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    parent = np.arange(len(names))
    while True:
        low = np.minimum(parent[x], parent[y])
        before = parent.copy()
        np.minimum.at(parent, parent[x], low)
        np.minimum.at(parent, parent[y], low)
        parent = parent[parent]
        if (parent == before).all():
            break
    own = parent != np.arange(len(names))
    return names[own], names[parent[own]]


def near(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs of sorted distinct values within the distance.

    Compares all pairs in blocks, or looks up each value's neighbours if their
    number, which the bits in which the values differ bound, is the smaller.
    Pairs are reduced to a forest as they come."""
    links, held = [(values[:0], values[:0])], 0
    free = int(np.bitwise_or.reduce(values ^ values[:1])) if len(values) else 0
    bits = [1 << b for b in range(64) if free >> b & 1]
    around = sum(math.comb(len(bits), k) for k in range(1, distance + 1))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if around < len(values) // 2:
            for k in range(1, distance + 1):
                for some in itertools.combinations(bits, k):
                    other = values ^ np.uint64(sum(some))
                    at = np.minimum(np.searchsorted(values, other), len(values) - 1)
                    hit = (values[at] == other) & (values < other)
                    yield values[hit], other[hit]
            return
        step = max(1, 2_000_000 // max(1, len(values)))
        for at in range(0, len(values), step):
            part = values[at : at + step]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ values[None, at:]) <= distance)
            keep = i < j
            yield part[i[keep]], values[at:][j[keep]]

    for a, b in pairs():
        links.append((a, b))
        held += len(a)
        if held > LINKS:
            links = [forest(*map(np.concatenate, zip(*links, strict=True)))]
            held = len(links[0][0])
            held = 0 if held > LINKS // 2 else held  # a forest is no larger than the values
    return forest(*map(np.concatenate, zip(*links, strict=True)))


def _link(distance: int, crowd: int | None):
    """Task: rows (key, fingerprint) sorted by key to rows (kind 0: a link;
    kind 1: a crowded key's member, as key and fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["kind", "a", "b"])

        def put(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held, links
            links.append((a, b))
            held += len(a)
            if held > LINKS:
                x, y = forest(*map(np.concatenate, zip(*links, strict=True)))
                links, held = [(x, y)], len(x)
                if held > LINKS // 2:
                    yield from out(0, x, y)
                    links, held = [], 0

        def groups(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups, those of two together, larger ones one by one."""
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            a, b = values[two], values[two + 1]
            ok = np.bitwise_count(a ^ b) <= distance
            yield from put(a[ok], b[ok])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                yield from put(*near(values[s : s + n], distance))

        def stream() -> Iterator[pa.RecordBatch]:
            keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            crowded = None
            for batch in batches:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                values = np.concatenate([values, batch.column(1).to_numpy().view(np.uint64)])
                if crowded is not None:  # the rest of a crowded key
                    n = int(np.searchsorted(keys, crowded, "right"))
                    yield from out(1, keys[:n].view(np.uint64), values[:n])
                    keys, values = keys[n:], values[n:]
                    if not len(keys):
                        continue
                    crowded = None
                if crowd is not None:
                    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                    many = starts[np.diff(np.r_[starts, len(keys)]) > crowd]
                    full = np.isin(keys, keys[many])
                    yield from out(1, keys[full].view(np.uint64), values[full])
                    if full[-1]:
                        crowded = keys[-1]
                    keys, values = keys[~full], values[~full]
                    if crowded is not None or not len(keys):
                        yield from groups(keys, values) if len(keys) else ()
                        keys, values = keys[:0], values[:0]
                        continue
                last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
                if last:
                    yield from groups(keys[:last], values[:last])
                keys, values = keys[last:], values[last:]
            if len(keys):
                yield from groups(keys, values)

        yield from stream()
        if links:
            yield from out(0, *forest(*map(np.concatenate, zip(*links, strict=True))))

    return run


def links(prints: DataFrame, *, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fingerprint, long)
    that connect all that differ in at most ``distance`` bits."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments of one wildcard bit find distances up to 3")
    fp = F.col("fingerprint")
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", fp, F.lit(32))
    keyed = prints.select(F.explode(F.concat(variants(low, 32, 0), variants(high, 32, 1))).alias("key"), "fingerprint")
    schema = "kind int, a long, b long"
    step = lambda rows, limit: rows.repartition("key").sortWithinPartitions("key", "fingerprint").mapInArrow(_link(distance, limit), schema)
    first = written(step(keyed, crowd), "simhash-links")
    crowded = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fingerprint"))
    # the other segment of a crowded key, by the tag in the key
    other = F.when(F.call_function("shiftright", F.col("key"), F.lit(40)).bitwiseAND(F.lit(1)) == 0, high).otherwise(low)
    quarters = F.concat(variants(other.bitwiseAND(F.lit(0xFFFF)), 16, 2), variants(F.call_function("shiftrightunsigned", other, F.lit(16)), 16, 3))
    again = crowded.select(F.explode(quarters).alias("second"), "key", "fingerprint").select(F.xxhash64("key", "second").alias("key"), "fingerprint")
    found = first.where("kind = 0").unionByName(step(again, None))
    return found.select("a", "b").distinct()


def components(edges: DataFrame, name: str = "simhash-components") -> DataFrame:
    """node, root: for every node of the links (a, b), the smallest node that
    is reachable, by alternating large-star and small-star steps."""

    made: list[DataFrame] = []

    def stored(rows: DataFrame) -> DataFrame:
        made.append(written(rows, name))
        return made[-1]

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        """Hang neighbours on the smallest one: all of them if both, else the
        node itself and its smaller ones."""
        if both:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = stored(pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("least")))
            return pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = stored(pairs.groupBy("a").agg(F.min("b").alias("least")))
        hung = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        return hung.unionByName(least.select("a", F.col("least").alias("b")))

    ordered = lambda e: e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    edges = stored(ordered(edges))
    before = mark(edges)
    while before[0]:
        edges = stored(ordered(star(ordered(star(edges, True)), False)))
        discard(*made[:-1])  # this round's table holds all that is known
        made = made[-1:]
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id that can be
    reached over links, the document's own included."""
    prints = written(with_fingerprint(docs, id_col=id_col, text_col=text_col, words=words), "simhash-prints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    hung = components(links(distinct, distance=distance, crowd=crowd))
    rooted = distinct.join(hung, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    rooted = written(rooted, "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(ids, "simhash-ids")
    classes = written(rooted.join(ids, "root").select("fingerprint", "component_id"), "simhash-classes")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
