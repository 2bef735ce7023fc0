"""SQL functions: native ones, an Arrow function, and table functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..profiles import UKRAINIAN, Profile
from . import dialect as X

S = X.SPARK


def register(spark: SparkSession, profile: Profile = UKRAINIAN) -> None:
    """Temporary SQL functions vowel_positions, stress_indices, mark_stress,
    lookup_form, dictionary_form, djb2, ipa (all native), nfd_strip (Arrow) and
    the table functions tokenize and payloads (Arrow)."""
    native = {
        "vowel_positions(w STRING) RETURNS ARRAY<INT>": X.vowel_positions(S, "w", profile),
        "stress_indices(w STRING) RETURNS ARRAY<INT>": X.stress_indices(S, "w", profile),
        "mark_stress(w STRING, k INT) RETURNS STRING": X.mark_stress(S, "w", "k", profile),
        "lookup_form(w STRING) RETURNS STRING": X.lookup_form(S, "w"),
        "dictionary_form(w STRING) RETURNS STRING": X.dictionary_form(S, "w", profile),
        "djb2(w STRING, m BIGINT) RETURNS BIGINT": "aggregate(transform(filter(split(w, ''), c -> c <> ''), c -> cast(ascii(c) as bigint)), cast(5381 as bigint), (h, c) -> (h * 33 + c) & 4294967295) % m",
        "transcribe(w STRING, k INT) RETURNS STRING": f"(SELECT {X.ipa(S, 'w', 'k', profile)} FROM (SELECT {X.vowel_positions(S, 'lower(w)', profile)} AS v))",
    }
    for head, body in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("nfd_strip", nfd_strip())
    spark.udtf.register("tokenize", tokenizer())
    spark.udtf.register("payloads", payload_table(profile))


def nfd_strip():
    """Compact-dictionary form for any script: decompose, drop marks."""

    @F.pandas_udf("string")
    def strip(words: pd.Series) -> pd.Series:
        return words.map(lambda w: w if w is None else "".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn"))

    return strip


def tokenizer():
    @F.udtf(returnType="i: int, start: int, form: string")
    class Tokenize:
        def eval(self, text: str):
            import re

            for i, m in enumerate(re.finditer(r"[^\W\d_]+(?:[ʼ'’][^\W\d_]+)*", text or "")):
                yield i, m.start(), m[0]

    return Tokenize


def syllables(ipa, vowels: str = "ɑɐɛeɪiɔouæøy"):
    """Syllables of a transcription: cut after a vowel before one consonant
    and a vowel."""
    return F.split(F.regexp_replace(ipa, f"(?<=[{vowels}])(?=[^{vowels}ˈ][{vowels}])", "\x01"), "\x01")


def format_morphology(feats):
    """Key=Value,Value pairs of a map of arrays, sorted, by '|'."""
    pairs = F.array_sort(F.map_entries(feats))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.array_join(F.array_sort(e["value"]), ","))), "|")


def payload_table(profile: Profile = UKRAINIAN):
    """An Arrow table function over a table of (word, payload), partitioned or
    not: each payload's records, as trie_payloads() reads them:

        SELECT * FROM payloads(TABLE(t) PARTITION BY word)

    Columns: at (the word's place in its partition, from 0), word, record, stress,
    tags (bytes).  Rows without a payload have no records; other columns of the
    table are not read.  (Arrow table functions can't derive their columns from
    the argument, so those are fixed.)
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udtf

    vowels = profile.vowels

    class Payloads:
        def __init__(self):
            self.at = 0

        def eval(self, rows):
            batch = rows if isinstance(rows, (pa.RecordBatch, pa.Table)) else pa.RecordBatch.from_struct_array(rows)
            if not {"word", "payload"} <= set(batch.schema.names):
                raise ValueError("payloads() needs a table with the columns word and payload")
            out = {c: [] for c in ("at", "word", "record", "stress", "tags")}
            for word, payload in zip(batch.column("word").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                places = [k for k, c in enumerate((word or "").lower()) if c in vowels]
                for record, part in enumerate(p for p in (payload or b"").split(b"\xff") if p):
                    marks, *tail = part.split(b"\xfe")
                    found = {places.index(p - 1) for p in marks if p and p - 1 in places}
                    for c, v in zip(out, (self.at, word, record, sorted(found), list(tail[0]) if tail else []), strict=True):
                        out[c].append(v)
                self.at += 1
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return arrow_udtf(Payloads, returnType="at int, word string, record int, stress array<int>, tags array<int>")
