"""One packed dictionary file, numbered and written by Spark, and read as a data
source.

In the file's order (breadth first, children side by side and sorted) the nodes
of one depth stand in the order of their prefixes, and the descendants of
neighbours at any depth are neighbours.  So numbers are places in one sorted
table of prefixes, and any subtree is one byte range a depth.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from . import scratch
from .sinks import CHILDREN_FLAG, HEAD, HEADER, HETERONYM, LETTER, MAGIC, NODE, NONE, SECOND, VARIATIVE, VERSION

#: Nodes that a task joins to one piece of the file.
PIECE = 1 << 20
#: Nodes that a point read takes at once.
WINDOW = 64


def _codes(prefix: str, alphabet: str) -> Column:
    """The prefix in characters that sort as the alphabet's letters stand."""
    return F.translate(prefix, alphabet, "".join(chr(0x4E00 + i) for i in range(len(alphabet))))


def nodes(words: DataFrame, alphabet: str, key: str = "form_norm") -> DataFrame:
    """number, prefix, letter, stress, flags, second, first (number of the first
    child, 0 for none) of all nodes of the words' trie, the root's prefix empty.

    words: key, stress, stress2, is_variative, is_heteronym, keys unique.  Words
    with other letters, or a stress that is null or beyond 254, have no place in
    the layout and are left out.  A number is the offset of a range partition
    and the place in it; no group of words is held anywhere.
    """
    known = words.where(F.col(key).rlike(f"^[{alphabet}]*$") & F.col("stress").between(0, NONE - 1)).select(F.col(key).alias("prefix"), "stress", "stress2", "is_variative", "is_heteronym")
    known = scratch.stored(known, "dictionary-words")
    prefixes = known.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("prefix")), lambda d: F.substring(F.col("prefix"), F.lit(1), d))).alias("prefix"))
    root = known.sparkSession.range(1).select(F.lit("").alias("prefix"))
    order = [F.length("prefix"), _codes("prefix", alphabet)]
    placed = prefixes.unionByName(root).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.stored(placed.select("prefix", F.monotonically_increasing_id().alias("_at")), "dictionary-places")
    # the id's upper bits are the partition, the lower 33 the place in it
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"))
    placed = placed.join(F.broadcast(sizes), F.shiftright("_at", 33) == F.col("_part")).select("prefix", (F.col("_offset") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("number"))
    placed = scratch.stored(placed, "dictionary-numbers")
    first = placed.where("prefix <> ''").groupBy(F.expr("substr(prefix, 1, length(prefix) - 1)").alias("prefix")).agg(F.min("number").alias("first"))
    rows = placed.join(known, "prefix", "left").join(first, "prefix", "left")
    bit = lambda c, n: F.when(c, n).otherwise(0)
    flags = bit(F.col("is_variative"), VARIATIVE) + bit(F.col("first").isNotNull(), CHILDREN_FLAG) + bit(F.col("is_heteronym"), HETERONYM) + bit(F.col("stress2").isNotNull(), SECOND)
    letter = F.when(F.col("prefix") == "", NONE).otherwise(F.instr(F.lit(alphabet), F.right("prefix", F.lit(1))) - 1)
    byte = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(NONE))
    return rows.select("number", "prefix", letter.cast("int").alias("letter"), byte("stress").alias("stress"), flags.cast("int").alias("flags"), byte("stress2").alias("second"), F.coalesce("first", F.lit(0)).cast("long").alias("first"))


def pieces(found: DataFrame, size: int = PIECE) -> DataFrame:
    """piece, n, words, data: the nodes' bytes in runs of size numbers."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data, words = None, bytearray(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(data) // 8], pa.int64()), pa.array([words], pa.int64()), pa.array([bytes(data)], pa.binary())], ["piece", "n", "words", "data"])

        for batch in batches:
            for piece, *node in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece != now:
                    if now is not None:
                        yield out()
                    now, data, words = piece, bytearray(), 0
                data += struct.pack(NODE, *node)
                words += node[1] != NONE
        if now is not None:
            yield out()

    rows = found.withColumn("piece", F.floor(F.col("number") / size)).repartitionByRange("piece").sortWithinPartitions("number")
    return rows.select("piece", "letter", "stress", "flags", "second", "first").mapInArrow(join, "piece long, n long, words long, data binary")


def write_dictionary(words: DataFrame, path: str, alphabet: str, key: str = "form_norm", size: int = PIECE) -> int:
    """Write the words as one packed file; returns the number of its words.  The
    pieces are stored first and then joined in order, one at a time, through the
    file system's own streams; a file is published whole, by a rename."""
    spark = words.sparkSession
    parts = scratch.stored(pieces(nodes(words, alphabet, key), size), "dictionary-pieces")
    total = parts.agg(F.sum("n"), F.sum("words"), F.count(F.lit(1))).first()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    system = target.getFileSystem(conf)
    stream = system.create(part, True)
    try:
        stream.write(bytearray(struct.pack(HEAD, MAGIC, VERSION, 0, total[0], total[1], len(alphabet)).ljust(HEADER, b"\0")))
        stream.write(bytearray(b"".join(struct.pack(LETTER, ord(c) if ord(c) < 256 else NONE, ord(c)) for c in alphabet)))
        for k in range(total[2]):
            stream.write(bytearray(parts.where(F.col("piece") == k).first()["data"]))
    finally:
        stream.close()
    system.delete(target, False)
    system.rename(part, target)
    return total[1]


# --- reading -------------------------------------------------------------------


def _open(path: str):
    """A file that can be read from any place: local, or by its address."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return open(unquote(at.path) if at.scheme else path, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class Nodes:
    """A packed file's nodes by number, read in ranges.  read counts the bytes."""

    def __init__(self, path: str):
        self.file, self.read = _open(path), 0
        head = self._bytes(0, HEADER)
        if head[:4] != MAGIC or head[4] != VERSION:
            raise ValueError("not a packed dictionary")
        _, _, _, self.n, self.words, size = struct.unpack_from(HEAD, head)
        self.alphabet = "".join(chr(x) for _, x in struct.iter_unpack(LETTER, self._bytes(HEADER, 3 * size)))
        self.begin = HEADER + 3 * size

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        self.read += len(data)
        return data

    def range(self, low: int, high: int) -> list[tuple]:
        return list(struct.iter_unpack(NODE, self._bytes(self.begin + 8 * low, 8 * (min(high, self.n) - low)))) if low < high else []

    def first_child(self, at: int) -> int:
        """The first child of node at or else of the next node with children."""
        while at < self.n:
            for node in self.range(at, at + WINDOW):
                if node[2] & CHILDREN_FLAG:
                    return node[4]
            at += WINDOW
        return self.n

    def below(self, low: int, prefixes: list[str]) -> Iterator[tuple[int, list[str], list[tuple]]]:
        """Depth by depth, the nodes under the neighbours from low on: number of
        the first, prefixes, nodes."""
        while prefixes:
            high = low + len(prefixes)
            level = self.range(low, high)
            yield low, prefixes, level
            following, end = self.first_child(low), self.first_child(high)
            starts = [n[4] if n[2] & CHILDREN_FLAG else None for n in level]
            parents = [(s, p) for s, p in zip(starts, prefixes, strict=True) if s is not None]
            if not parents:
                return
            edges = [s for s, _ in parents[1:]] + [end]
            children = self.range(following, end)
            prefixes = [p + self.alphabet[children[k - following][0]] for (s, p), e in zip(parents, edges, strict=True) for k in range(s, e)]
            low = following

    def descend(self, word: str) -> int | None:
        """The number of the node at a prefix."""
        at = 0
        for c in word:
            wanted = self.alphabet.find(c)
            node = self.range(at, at + 1)[0]
            if wanted < 0 or not node[2] & CHILDREN_FLAG:
                return None
            low, high = node[4], self.first_child(at + 1)
            at = next((low + k for k, n in enumerate(self.range(low, high)) if n[0] == wanted), None)
            if at is None:
                return None
        return at


def _value(node: tuple) -> tuple | None:
    _, stress, flags, second, _ = node
    return None if stress == NONE else (stress, second if flags & SECOND else None, bool(flags & VARIATIVE), bool(flags & HETERONYM))


class Part(InputPartition):
    def __init__(self, low: int, prefixes: list[str], deep: bool = True):
        self.low, self.prefixes, self.deep = low, prefixes, deep


class PackedReader(DataSourceReader):
    """Partitions are neighbours of one depth with all below them; a filter on
    the word's equality or beginning opens the ranges under that node alone."""

    def __init__(self, path: str, parts: int):
        self.path, self.parts, self.wanted = path, parts, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f_column(f) == ("form_norm",):
                continue  # no word is null
            if self.wanted is None and f_column(f) == ("form_norm",):
                if isinstance(f, EqualTo) and isinstance(f.value, str):
                    self.wanted = ("words", [f.value])
                    continue
                if isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                    self.wanted = ("words", sorted(set(f.value)))
                    continue
                if isinstance(f, StringStartsWith):
                    self.wanted = ("prefix", [f.value])
                    continue
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        nodes_ = Nodes(self.path)
        kind, values = self.wanted or ("prefix", [""])
        found = [(at, v) for v in values if (at := nodes_.descend(v)) is not None]
        if kind == "words":
            return [Part(at, [v], False) for at, v in found] or [Part(0, [], False)]
        out: list[InputPartition] = []
        for at, prefix in found:
            for low, prefixes, _ in nodes_.below(at, [prefix]):
                if len(prefixes) >= self.parts:
                    step = -(-len(prefixes) // self.parts)
                    out += [Part(low + k, prefixes[k : k + step]) for k in range(0, len(prefixes), step)]
                    break
                out.append(Part(low, prefixes, False))  # too few neighbours to share: this depth alone
        return out or [Part(0, [], False)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        nodes_ = Nodes(self.path)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        for _, prefixes, level in nodes_.below(partition.low, partition.prefixes):
            rows = [(p, *v) for p, n in zip(prefixes, level, strict=True) if (v := _value(n)) is not None]
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["form_norm", "stress", "stress2", "is_variative", "is_heteronym"])
            if not partition.deep:
                return


def f_column(f: Filter) -> tuple | None:
    """The column path that a filter is on."""
    return getattr(f, "attribute", None)


class PackedDictionary(DataSource):
    """spark.read.format("packed_dictionary").load(path); option parts: how many
    partitions a depth is shared by, at least."""

    @classmethod
    def name(cls) -> str:
        return "packed_dictionary"

    def schema(self) -> str:
        return "form_norm string, stress int, stress2 int, is_variative boolean, is_heteronym boolean"

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options["path"], int(self.options.get("parts", 4 * (os.cpu_count() or 1))))


def register(spark: SparkSession) -> None:
    """Make the format known, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackedDictionary)
