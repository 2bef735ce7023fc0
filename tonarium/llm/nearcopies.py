"""Groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

A text's print is the digest of its set of shingle hashes; texts of one set
have one print and are linked by it.  Prints meet in two ways, each for the
pairs that the other leaves out:

Those whose SimHash fingerprints differ in at most three bits are linked by the
SimHash operator (simhash.py: deletion variants, popcounts), without exception.

At the least similarity fingerprints differ in about 10 bits, give or take 3,
too many for deletion variants.  For pairs of more than three bits a print is
filed under 32 keys, each made of four min-hashes.  Two prints meet if a key
agrees and 128 bits, one of each min-hash, differ in at most 36.  A pair of
similarity 0.8 fails to meet with a probability below 1e-7 (calculated for
independent min-hashes), a more similar one more rarely.

Prints that meet, directly or over others, form a candidate group (under a key
of more than CROWD prints all meet); the operator's large-star and small-star
steps collect it.  An exact check on the shingles follows: candidate groups
are then split into those that exact similarities connect.  A task holds the
shingle hashes of one group.  A group with more than BLOCK bytes of text is
dealt into blocks.  First each block is connected by itself; the first print of
each part found is dealt again, until that hardly finds more.  This is linear,
and leaves one part of a group of true copies, however large.  Then only blocks
of different parts meet, two in a task: those of a part that fills blocks of its
own with all others, those of lesser parts, which share blocks, with each other.

Cases: null and empty texts, and texts of white space, have one print; texts of
fewer words than a shingle have one shingle; upper-case ASCII letters count as
lower-case; repeated rows each get their row; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import written
from .simhash import DISTANCE, LINKS, SEED, components, fingerprint, forest, links, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 4
#: Bits of the sketch in which candidates may differ.
APART = 36
#: Prints under a key that are compared at once.
CROWD = 2048
#: Bytes of a candidate group's texts that a block holds; a task has two at most.
BLOCK = 1 << 24
_TIMES = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, words))


def digest(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (one a band) and sketch (two numbers) of a set that isn't empty."""
    low = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):  # bounds the memory of very long texts
        np.minimum(low, (shingles[at : at + 512, None] * _TIMES).min(axis=0), out=low)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = keys * _MIX + column
        keys ^= keys >> np.uint64(29)
    return keys, np.packbits((low >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sets of shingles share enough of their union?"""
    part, whole = SIMILAR
    few, many = sorted((len(a), len(b)))
    if few * whole < many * part:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared * whole >= (few + many - shared) * part


def marked(docs: DataFrame, *, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs with _print (long), _keys (array of long), _sketch (array of two
    long), _fingerprint (long: SimHash of the set) and _row, a number of the row
    that stays the same once it is stored."""
    place = docs.columns.index(text_col)
    names = [*docs.columns, "_print", "_keys", "_sketch", "_fingerprint"]
    schema = StructType([*docs.schema.fields]).add("_print", LongType()).add("_keys", ArrayType(LongType())).add("_sketch", ArrayType(LongType())).add("_fingerprint", LongType())

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        flat = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingle_set(t or b"", words) for t in part.column(place).cast(pa.binary()).to_pylist()]
                signs = [signature(s) if len(s) else (none, none) for s in sets]
                prints, fingers = (pa.array(np.array([of(s) for s in sets], np.uint64).view(np.int64)) for of in (digest, fingerprint))
                yield pa.RecordBatch.from_arrays([*part.columns, prints, lists([k for k, _ in signs]), lists([s for _, s in signs]), fingers], names)

    return docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())


def _cut(batches: Iterator[pa.RecordBatch], crowd: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by their first column, in pieces that end where it changes;
    a value of more than crowd rows comes in several pieces, each but the first
    marked True and with the value's very first row before its own."""
    held: list[pa.RecordBatch] = []
    first, n = None, 0  # the first row of the value that held ends in; rows held

    def over() -> Iterator[tuple[pa.Table, bool]]:
        nonlocal held, n
        if n:
            yield pa.Table.from_batches([first, *held] if more else held), more
        held, n = [], 0

    more = False
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if first is not None and first.column(0)[0].as_py() != values[0]:
            yield from over()
            first, more = None, False
        if len(cuts):
            if first is not None:  # the rest of the value before
                held.append(batch.slice(0, int(cuts[0])))
                n += int(cuts[0])
                yield from over()
                whole = batch.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))
            else:
                whole = batch.slice(0, int(cuts[-1]))
            if whole.num_rows:
                yield pa.Table.from_batches([whole]), False
            batch, first, more = batch.slice(int(cuts[-1])), None, False
        if first is None:
            first = batch.slice(0, 1)
        held.append(batch)
        n += batch.num_rows
        if n > crowd:
            yield from over()
            more = True
    yield from over()


def _meet(apart: int, crowd: int):
    """Task: rows (key, print, x, y, f) sorted by key to links (a, b), but for
    those of fingerprints (f) that the SimHash operator links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])

        def groups(more, keys, prints, x, y, f) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if more:
                yield prints[1:], np.full(len(prints) - 1, prints[0])
                return
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            ok = np.bitwise_count(x[two] ^ x[two + 1]) + np.bitwise_count(y[two] ^ y[two + 1]) <= apart
            ok &= np.bitwise_count(f[two] ^ f[two + 1]) > DISTANCE
            yield prints[two][ok], prints[two + 1][ok]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                p = prints[s : s + n]
                if n > crowd:
                    yield p[1:], np.full(n - 1, p[0])
                    continue
                differ = np.bitwise_count(x[s : s + n, None] ^ x[None, s : s + n]) + np.bitwise_count(y[s : s + n, None] ^ y[None, s : s + n])
                far = np.bitwise_count(f[s : s + n, None] ^ f[None, s : s + n]) > DISTANCE
                i, j = np.nonzero(np.triu((differ <= apart) & far, 1))
                yield forest(p[i], p[j])

        for piece, more in _cut(batches, crowd):
            for a, b in groups(more, *(c.to_numpy() if k < 2 else c.to_numpy().view(np.uint64) for k, c in enumerate(piece.columns))):
                if not len(a):
                    continue
                met.append((a, b))
                held += len(a)
                if held > LINKS:
                    met = [forest(*map(np.concatenate, zip(*met, strict=True)))]
                    held = len(met[0][0])
                    if held > LINKS // 2:
                        yield from out(*met[0])
                        met, held = [], 0
        if met:
            yield from out(*forest(*map(np.concatenate, zip(*met, strict=True))))

    return run


def connected(sets: list[np.ndarray], known: list | None = None, apart: int = APART) -> np.ndarray:
    """For each of the sets, the first that similar pairs connect it with; sets
    of one known part are connected already."""
    sketches = np.array([signature(s)[1] for s in sets])
    x, y = sketches[:, 0].copy(), sketches[:, 1].copy()
    f = np.array([fingerprint(s) for s in sets], np.uint64)
    group = np.arange(len(sets))
    seen: dict = {}
    n = 0  # groups so far
    for i in range(len(sets)):
        first = seen.setdefault(i if known is None else known[i], i)
        group[i] = group[first]
        n += first == i
        if first == i and n == 2 and similar(sets[i], sets[0]):
            group[i], n = group[0], 1
            continue
        if n == 1:
            continue
        near = np.flatnonzero((np.bitwise_count(x[:i] ^ x[i]) + np.bitwise_count(y[:i] ^ y[i]) <= apart) | (np.bitwise_count(f[:i] ^ f[i]) <= DISTANCE))
        near = near[group[near] != group[i]]
        while len(near):
            j = near[-1]
            if similar(sets[i], sets[j]):
                low, high = sorted((group[i], group[j]))
                group[: i + 1][group[: i + 1] == high] = low
                n -= 1
                near = near[group[near] != low]
            else:
                near = near[:-1]
    return group


def _verify(words: int):
    """Task: rows (group, first and second block, known part, print, text) sorted
    by the first three to links between parts (node, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            if not sets:
                return
            first = connected(sets, known)
            own = np.unique(known, return_index=True)[1]
            own = own[first[own] != own]
            if len(own):
                names = np.array(prints, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[first[own]])], ["node", "root"])

        now, known, prints, sets = None, [], [], []
        for batch in batches:
            for *task, part, name, text in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5).cast(pa.binary()), strict=True):
                if task != now:
                    yield from out()
                    now, known, prints, sets = task, [], [], []
                known.append(part)
                prints.append(name)
                sets.append(shingle_set(text.as_py(), words))
        yield from out()

    return run


def _linked(rows: DataFrame, tasks: DataFrame, text_col: str, words: int) -> DataFrame:
    """node, root: similar prints of different known parts that meet in a task.
    tasks: _group, _a, _b, _known, _print, _row."""
    task = ["_group", "_a", "_b"]
    dealt = rows.select("_row", F.col(text_col).alias("text")).join(written(tasks, "near-dealt"), "_row")
    dealt = dealt.select(*task, "_known", "_print", "text").repartition(*task).sortWithinPartitions(*task, "_print")
    return written(dealt.mapInArrow(_verify(words), "node long, root long"), "near-links")


def _parts(rows: DataFrame, large: DataFrame, block: int, text_col: str, words: int) -> DataFrame:
    """node, root: links found inside blocks, then among the first prints of what
    each block has connected, as long as a round leaves half of them or less."""
    left, inside, n = large, None, large.count()
    for k in range(n.bit_length()):
        blocks = written(left.groupBy("_group").agg(F.ceil(F.sum("_size") / block).alias("_blocks")), "near-blocks")
        own = F.pmod(F.xxhash64("_print", F.lit(k)), "_blocks").cast("string")
        found = _linked(rows, left.join(blocks, "_group").select("_group", own.alias("_a"), F.lit("").alias("_b"), F.col("_print").alias("_known"), "_print", "_row"), text_col, words)
        inside = found if inside is None else inside.unionByName(found)
        left = written(left.join(found.select(F.col("node").alias("_print")), "_print", "left_anti"), "near-left")
        before, n = n, left.count()
        if 2 * n > before:
            break
    return inside


def _across(large: DataFrame, known: DataFrame, block: int) -> DataFrame:
    """Tasks for _linked() in which all prints of different parts of a group
    meet.  known: node, root, the parts as far as they are connected."""
    rows = large.join(known.select(F.col("node").alias("_print"), F.col("root").alias("_known")), "_print", "left").withColumn("_known", F.coalesce("_known", "_print"))
    rows = written(rows, "near-known")
    parts = rows.groupBy("_group", "_known").agg(F.sum("_size").alias("_bytes"))
    # a part that fills a block has blocks of its own; the others share theirs
    parts = written(parts.withColumn("_of", F.when(F.col("_bytes") > block, F.col("_known").cast("string")).otherwise("")), "near-parts")
    owners = written(parts.groupBy("_group", "_of").agg(F.ceil(F.sum("_bytes") / block).cast("int").alias("_blocks")), "near-owners")
    other = owners.select("_group", F.col("_of").alias("_with"), F.col("_blocks").alias("_many"))
    meet = written(owners.join(other, "_group").where((F.col("_of") != F.col("_with")) | (F.col("_of") == "")), "near-meet")
    rows = rows.join(parts.select("_group", "_known", "_of"), ["_group", "_known"])
    rows = rows.join(meet, ["_group", "_of"]).withColumn("_own", F.pmod(F.xxhash64("_print"), "_blocks").cast("int"))
    name = lambda of, n: F.format_string("%s#%09d", of, n)
    own = name(F.col("_of"), F.col("_own"))
    # of shared blocks each two meet; a single one meets itself
    numbers = F.filter(F.sequence(F.lit(0), F.col("_many") - 1), lambda m: (F.col("_of") != F.col("_with")) | (m != F.col("_own")) | (F.col("_many") == 1))
    tasks = rows.withColumn("_m", F.explode(numbers)).withColumn("_theirs", name(F.col("_with"), F.col("_m")))
    return tasks.select("_group", F.least(own, "_theirs").alias("_a"), F.greatest(own, "_theirs").alias("_b"), "_known", "_print", "_row")


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """a, b: links that connect all prints whose fingerprints differ in at most
    three bits, by the SimHash operator; rows as for groups()."""
    held = rows.where(F.size("_keys") > 0).select(F.col("_fingerprint").alias("fingerprint"), "_print").distinct()
    held = written(held, "near-fingerprints")
    least = written(held.groupBy("fingerprint").agg(F.min("_print").alias("least")), "near-least")
    first = lambda end: least.select(F.col("fingerprint").alias(end), F.col("least").alias(f"_{end}"))
    apart = links(least.select("fingerprint")).join(first("a"), "a").join(first("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = held.join(least, "fingerprint").where("_print <> least").select(F.col("_print").alias("a"), F.col("least").alias("b"))
    return apart.unionByName(same)


def groups(rows: DataFrame, *, text_col: str = "text", words: int = WORDS, apart: int = APART, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """node, root: for each _print that isn't the first of its group, the first.
    rows: what marked() returns, stored."""
    distinct = rows.where(F.size("_keys") > 0).select("_print", "_keys", "_sketch", "_fingerprint").dropDuplicates(["_print"])
    filed = distinct.select(F.explode("_keys").alias("key"), F.col("_print").alias("print"), F.col("_sketch")[0].alias("x"), F.col("_sketch")[1].alias("y"), F.col("_fingerprint").alias("f"))
    met = filed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_meet(apart, crowd), "a long, b long")
    met = components(fingerprint_links(rows).unionByName(met.distinct()), "near-components")
    # a group's first print is a member, too
    members = met.unionByName(met.select(F.col("root").alias("node"), "root")).distinct().withColumnsRenamed({"node": "_print", "root": "_group"})
    # of a print's copies one row is read on, so that no task meets them all
    one = rows.groupBy("_print").agg(F.min("_row").alias("_row"), F.max(F.octet_length(F.col(text_col))).alias("_size"))
    one = written(members.join(one, "_print"), "near-members")
    total = written(one.groupBy("_group").agg(F.sum("_size").alias("_total")), "near-totals")
    small = one.join(total.where(F.col("_total") <= block), "_group")
    found = _linked(rows, small.select("_group", F.lit("").alias("_a"), F.lit("").alias("_b"), F.col("_print").alias("_known"), "_print", "_row"), text_col, words)
    large = total.where(F.col("_total") > block)
    if large.isEmpty():
        return found
    large = written(one.join(large, "_group").drop("_total"), "near-large")
    inside = _parts(rows, large, block, text_col, words)
    pairs = lambda found: found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    known = written(components(pairs(inside), "near-inside"), "near-inside")
    across = _linked(rows, _across(large, known, block), text_col, words)
    return found.unionByName(components(pairs(known.unionByName(across)), "near-across"))
