"""Products: lookup tables, star schema, training table, compact dictionary."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import last_values, reduced
from . import scratch


def write_lookup(forms: DataFrame, path: str, key: str = "form_norm", order: list[str] | None = None) -> None:
    """A key-value table: one row a key, sorted by key, so that point reads skip
    row groups.  With an order the last write of a key wins; else keys are unique."""
    if order:
        rest = [c for c in forms.columns if c not in (key, *order)]
        forms = forms.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    forms.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def lookup(table: DataFrame, words: DataFrame, key: str = "form_norm") -> DataFrame:
    """Many point reads as one join; missing keys have nulls."""
    return words.join(table, key, "left")


def content_id(*columns: str):
    """An id of a row's content: a digest in which nulls and borders count, long
    enough that no two contents meet."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


#: Child tables of a form, and the array or map each comes from.
CHILDREN = {
    "feature": ("feats", ("key", "value")), "tag": ("tags", ("tag",)), "category": ("categories", ("category",)), "example": ("examples", ("text",)),
    "translation": ("translations", ("translation",)), "etymology_template": ("etymology_templates", ("template",)), "inflection_template": ("inflection_templates", ("template",)),
}


def star_schema(forms: DataFrame) -> dict[str, DataFrame]:
    """word_form and its children; definitions and etymologies are numbered by
    content.  Ids are digests: they need no global order and repeat from run to
    run.  Forms that have a column id, unique to the row, keep theirs; if they
    have a column block, too, it is kept beside the id.

    forms: lemma, form, stress (array), pos, main_definition, src_ord, form_ord
    and, as far as there are any, feats (map), tags, categories, examples,
    translations, etymology_templates, inflection_templates (arrays), etymology
    (text), meta (map).
    """
    rows = forms if "id" in forms.columns else forms.withColumn("id", content_id("lemma", "form", "stress", "pos", "src_ord", "form_ord"))
    text_id = lambda c: F.when(F.col(c).isNotNull(), F.md5(c))
    block = ["block"] if "block" in forms.columns else []
    etymology = [text_id("etymology").alias("etymology_id")] if "etymology" in forms.columns else []
    # a pattern's JSON without a JSON writer for every row
    pattern = F.concat(F.lit("["), F.array_join(F.col("stress").cast("array<string>"), ",", "null"), F.lit("]"))
    texts = lambda c: rows.where(F.col(c).isNotNull()).select(F.md5(c).alias("id"), F.col(c).alias("text")).distinct()
    out = {
        "word_form": rows.select(*block, "id", "lemma", "form", pattern.alias("stress_indices"), "pos", text_id("main_definition").alias("definition_id"), *etymology, "src_ord", "form_ord"),
        "lemma_entry": rows.where(F.size("stress") > 0).groupBy("lemma").agg(F.to_json(F.array_sort(F.collect_set("stress"))).alias("possible_stress_indices")),
        "definition": texts("main_definition"),
        "possible_stress_index": rows.select("lemma", pattern.alias("pattern")).where("pattern <> '[]'").distinct(),
    }
    if etymology:
        out["etymology_text"] = texts("etymology")
    if "meta" in forms.columns:
        out["meta"] = last_values(rows)
    for name, (column, names) in CHILDREN.items():
        if column in forms.columns:
            out[name] = rows.select(*block, F.col("id").alias("word_form_id"), F.explode(column).alias(*names))
    return out


def star_tables(forms: DataFrame, more: list[str], n: int) -> dict[str, DataFrame]:
    """The tables of star_schema(), written and reread, for many forms.

    forms: the plain columns, from which the expressions of more give the others
    of star_schema(), and block, a number by which they have been dealt into n
    partitions.  Forms are numbered and put in order while they are written; their
    table and their children's are written bucket by bucket in that order, and
    following a reference (block and number) shuffles and sorts nothing.
    """
    # stored with their numbers, so that they are the same in every table
    kept = scratch.bucketed(forms.withColumn("id", F.monotonically_increasing_id()), "block", "id", "star-rows", n)
    rows = kept.selectExpr("*", *more)
    tables = {name: (df, next((c for c in ("word_form_id", "id") if c in df.columns), None)) for name, df in star_schema(rows).items()}
    return {name: scratch.bucketed(df, "block", by, f"star-{name}", n, source=kept) if "block" in df.columns else scratch.stored(df, f"star-{name}") for name, (df, by) in tables.items()}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def training_table(forms: DataFrame, types: DataFrame, split) -> DataFrame:
    """Entries for training: unique by lemma, form, stress, pos, features; the
    first row stays.  types: as variant_types() returns; split: a column."""
    keys = ["lemma", "form", "stress_indices", "pos", "features_json"]
    values = ["pos_confidence", "features_confidence"]
    rows = reduced(forms, [*keys, *values]).groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct("src_ord", "form_ord")).alias("_r")).select(*keys, "_r.*")
    return rows.join(types, "lemma").withColumn("split", split).select(*keys, "pos_confidence", "features_confidence", "variant_type", "is_disambiguable", "is_homonym", "split")


# --- compact dictionary ------------------------------------------------------

#: The layout of a packed dictionary.  A header of 20 bytes (magic,
#: version, 0, numbers of nodes, words and letters, little-endian), 3 bytes a
#: letter (itself or 0xFF, code point), 8 bytes a node (letter, stress, flags,
#: second stress, first child).
MAGIC, VERSION, HEADER = b"UKST", 2, 20
HEAD, LETTER, NODE = "<4sBBIII", "<BH", "<BBBBI"
NONE, VARIATIVE, CHILDREN_FLAG, HETERONYM, SECOND = 0xFF, 1, 2, 4, 8


def trie_nodes(words: DataFrame, key: str = "form_norm") -> DataFrame:
    """prefix, depth, letter, parent and, for whole words, stress, stress2,
    is_variative, is_heteronym: the nodes of the dictionary's trie."""
    rows = words.select(F.explode(F.sequence(F.lit(1), F.length(key))).alias("depth"), key).where(F.length(key) > 0)
    nodes = rows.select(F.expr(f"substr({key}, 1, depth)").alias("prefix"), "depth").distinct()
    nodes = nodes.select("prefix", "depth", F.expr("right(prefix, 1)").alias("letter"), F.expr("substr(prefix, 1, depth - 1)").alias("parent"))
    return nodes.join(words, nodes["prefix"] == words[key], "left").drop(key)


def _trie_bytes(rows: list[dict], alphabet: str) -> bytes:
    """The words as a trie, breadth first, children side by side and sorted."""
    numbers = {c: i for i, c in enumerate(alphabet)}
    root: dict = {}
    for r in rows:
        node = root
        for c in r["form_norm"]:
            node = node.setdefault(numbers[c], {})
        node[-1] = (r["stress"], r["stress2"], r["is_variative"], r["is_heteronym"])
    queue, letters, parts, at, following = [root], [NONE], [], 0, 1
    while at < len(queue):
        node = queue[at]
        stress, second, variative, heteronym = node.get(-1, (NONE, None, False, False))
        children = sorted(k for k in node if k >= 0)
        flags = VARIATIVE * bool(variative) | HETERONYM * bool(heteronym) | SECOND * (second is not None) | CHILDREN_FLAG * bool(children)
        parts.append(struct.pack(NODE, letters[at], stress, flags, NONE if second is None else second, following if children else 0))
        queue += [node[k] for k in children]
        letters += children
        following += len(children)
        queue[at] = {}
        at += 1
    head = struct.pack(HEAD, MAGIC, VERSION, 0, len(parts), len(rows), len(alphabet)).ljust(HEADER, b"\0")
    table = b"".join(struct.pack(LETTER, ord(c) if ord(c) < 256 else NONE, ord(c)) for c in alphabet)
    return head + table + b"".join(parts)


class Trie:
    """A packed dictionary, read: nodes and the range of each one's children.

    Nodes don't say how many children they have; children stand in the order of
    their parents, so a node's end where the next parent's begin.
    """

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or data[4] != VERSION:
            raise ValueError("not a packed dictionary")
        _, _, _, n, self.words, size = struct.unpack_from(HEAD, data)
        if len(data) != HEADER + 3 * size + 8 * n:
            raise ValueError("a packed dictionary of another length than it says")
        self.alphabet = "".join(chr(x) for _, x in struct.iter_unpack(LETTER, data[HEADER : HEADER + 3 * size]))
        self.numbers = {c: i for i, c in enumerate(self.alphabet)}
        self.nodes = list(struct.iter_unpack(NODE, data[HEADER + 3 * size :]))
        self.end = [0] * n
        following = n
        for i in range(n - 1, -1, -1):
            if self.nodes[i][2] & CHILDREN_FLAG:
                self.end[i] = following
                following = self.nodes[i][4]

    def value(self, at: int) -> tuple | None:
        _, stress, flags, second, _ = self.nodes[at]
        if stress == NONE:
            return None
        return stress, second if flags & SECOND else None, bool(flags & VARIATIVE), bool(flags & HETERONYM)

    def find(self, word: str) -> tuple | None:
        """What stands at a word: descend letter by letter, a miss ends it."""
        at = 0
        for c in word:
            wanted, flags, first = self.numbers.get(c), self.nodes[at][2], self.nodes[at][4]
            if wanted is None or not flags & CHILDREN_FLAG:
                return None
            at = next((k for k in range(first, self.end[at]) if self.nodes[k][0] == wanted), None)
            if at is None:
                return None
        return self.value(at)

    def __iter__(self) -> Iterator[tuple]:
        prefixes = [""] * len(self.nodes)
        for i, (_, _, flags, _, first) in enumerate(self.nodes):
            if flags & CHILDREN_FLAG:
                for k in range(first, self.end[i]):
                    prefixes[k] = prefixes[i] + self.alphabet[self.nodes[k][0]]
            if (found := self.value(i)) is not None:
                yield prefixes[i], *found
            prefixes[i] = ""


def pack_trie(words: DataFrame, alphabet: str, key: str = "form_norm", prefix: int = 2) -> DataFrame:
    """part, n_words, data: packed dictionaries, one for all words that share
    their first ``prefix`` letters, so that a common first letter is split; one
    of prefix 0 holds all.  Words with other letters, without stress, or with
    one beyond 254 are left out (they have no place in the layout)."""

    def build(keys: tuple, batch: pa.Table) -> pa.Table:
        rows = batch.to_pylist()
        return pa.table({"part": pa.array([keys[0].as_py()], pa.string()), "n_words": pa.array([len(rows)], pa.int64()), "data": pa.array([_trie_bytes(rows, alphabet)], pa.binary())})

    known = words.where(F.col(key).rlike(f"^[{alphabet}]*$") & F.col("stress").between(0, NONE - 1))
    known = known.select(F.col(key).alias("form_norm"), "stress", "stress2", "is_variative", "is_heteronym")
    return known.groupBy(F.substring("form_norm", 1, prefix).alias("part")).applyInArrow(build, "part string, n_words long, data binary")


FOUND = "form_norm string, stress int, stress2 int, is_variative boolean, is_heteronym boolean"
FOUND_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
FOUND_NAMES = ["form_norm", "stress", "stress2", "is_variative", "is_heteronym"]


def unpack_trie(parts: DataFrame) -> DataFrame:
    """form_norm, stress, stress2, is_variative, is_heteronym of packed
    dictionaries (column data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = list(Trie(data))
                for at in range(0, len(rows), 10_000):
                    columns = list(zip(*rows[at : at + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND_KINDS, strict=True)], FOUND_NAMES)

    return parts.select("data").mapInArrow(run, FOUND)


def trie_lookup(parts: DataFrame, words: DataFrame, prefix: int = 2) -> DataFrame:
    """What the packed dictionaries say of each distinct word (column
    form_norm); nulls for unknown ones.  A word descends in its own part only."""

    def descend(left: pa.Table, right: pa.Table) -> pa.Table:
        tries = [Trie(data) for data in right.column("data").to_pylist()]
        rows = []
        for word in left.column("form_norm").to_pylist():
            found = next((f for t in tries if (f := t.find(word)) is not None), None)
            rows.append((word, *(found or (None,) * 4)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, FOUND_KINDS, strict=True)], FOUND_NAMES)

    asked = words.select("form_norm").where("form_norm IS NOT NULL").distinct().withColumn("part", F.substring("form_norm", 1, prefix))
    return asked.groupBy("part").cogroup(parts.select("part", "data").groupBy("part")).applyInArrow(descend, FOUND)


def write_packed(parts: DataFrame, path: str) -> None:
    """part, n_words, size, sha256 and the bytes compressed; the manifest of the
    dictionary is the same table without the bytes."""
    parts.select("part", "n_words", F.length("data").alias("size"), F.sha2("data", 256).alias("sha256"), "data").write.mode("overwrite").option("compression", "gzip").parquet(path)


def write_json_array(rows: DataFrame, path: str, order: list[str]) -> None:
    """Few ordered rows (a leaderboard) as one text: a JSON array."""
    items = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.to_json(F.struct(*rows.columns)).alias("j"))))
    rows.agg(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["j"]), ","), F.lit("]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """Trial results, added to what is there (json, csv or parquet)."""
    writer = results.write.mode("append")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
