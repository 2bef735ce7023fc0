"""Predicates of the exports, and word attributes."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profiles import APOSTROPHE, Profile
from ..sources.scratch import stored


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def single_word(form: str | Column, stress: str | Column) -> Column:
    """One word with some stress: no blank in it, a list that isn't empty."""
    return F.coalesce(~F.contains(_col(form), F.lit(" ")) & _col(stress).isNotNull() & ~_col(stress).isin("[]", ""), F.lit(False))


def first_index(stress: str | Column) -> Column:
    """The first index of a JSON list; null if the text is no list of numbers,
    or an empty one."""
    return F.get(F.from_json(_col(stress), "array<int>"), F.lit(0))


#: Kinds of ambiguity that training can't learn from.
AMBIGUOUS = ("free_variant", "grammatical_homonym")


def unambiguous(variant_type: str | Column, keep_null: bool = True) -> Column:
    """Not one of the kinds that morphology can't tell apart.  Rows without a
    kind stay, unless keep_null is false."""
    return F.coalesce(~_col(variant_type).isin(*AMBIGUOUS), F.lit(keep_null))


def in_alphabet(form: str | Column, profile: Profile) -> Column:
    """Only letters of the language, its apostrophe and the hyphen; the empty
    word passes, null doesn't."""
    return F.coalesce(_col(form).rlike(f"^[{profile.alphabet}{APOSTROPHE}-]*$"), F.lit(False))


def lemmatize(tokens: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """tokens (form, and others) with lemma: the first parse of a table (form,
    ord, lemma), else the trimmed lower-case form."""
    plain = F.lower(F.trim("form"))
    if table is None:
        return tokens.withColumn("lemma", plain)
    first = table.groupBy(F.lower(F.trim("form")).alias("_form")).agg(F.min_by("lemma", "ord").alias("_lemma"))
    return tokens.withColumn("_form", plain).join(first, "_form", "left").withColumn("lemma", F.coalesce("_lemma", "_form")).drop("_form", "_lemma")


#: The dictionary's part of speech for a universal one.
DICTIONARY_POS = {"NOUN": "NOUN", "VERB": "VERB", "ADJ": "ADJF", "ADV": "ADVB", "PRON": "NPRO", "DET": "ADJF", "NUM": "NUMR", "AUX": "VERB", "ADP": "PREP"}


def lemmatize_in_context(tokens: DataFrame, parses: DataFrame, own: str | None = None) -> DataFrame:
    """tokens (form, pos, and others) with lemma: the first parse whose part of
    speech is what the token's means to the dictionary, else the token's own
    lemma (column own), else the trimmed lower-case form.

    parses: form, ord, lemma, pos.  A token whose part of speech the dictionary
    doesn't have, or that has none, meets parses without one.  Parses are reduced
    to one a form and part of speech before they meet tokens; ties of ord go to
    the smaller lemma; a parse without a lemma is none; a null form has a null
    lemma unless the token has its own.
    """
    first = parses.where("lemma IS NOT NULL").groupBy(F.lower(F.trim("form")).alias("_form"), F.coalesce("pos", F.lit("")).alias("_pos")).agg(F.min_by("lemma", F.struct("ord", "lemma")).alias("_lemma"))
    known = F.create_map(*[F.lit(x) for pair in DICTIONARY_POS.items() for x in pair])
    rows = tokens.withColumn("_form", F.lower(F.trim("form"))).withColumn("_pos", F.coalesce(F.try_element_at(known, F.col("pos")), F.lit("")))
    # stored, so that the tokens of a common form can be split among tasks
    rows = rows.join(stored(first, "parses"), ["_form", "_pos"], "left")
    last = [F.col(own)] if own else []
    return rows.withColumn("lemma", F.coalesce("_lemma", *last, "_form")).drop("_form", "_pos", "_lemma")


def with_heads(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, i, head, lemma) with head_lemma: one equi-join of the
    table with itself; a token whose head isn't there has null."""
    heads = tokens.select("doc_id", F.col("i").alias("head"), F.col("lemma").alias("head_lemma"))
    return tokens.join(heads, ["doc_id", "head"], "left")


#: A token: a word with its apostrophes, a number, an address, one other sign.
TOKEN = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|https?://[^\s]+|\p{L}+(?:[ʼ'’]\p{L}+)*|\d+(?:[.,]\d+)*|[^\s]"
SPACES = " \t\n\x0b\f\r"
#: Tokens that a task hands on at once.
TOKENS_HELD = 1 << 16


def _pattern():
    import regex

    # white space and digits as in the SQL engines: ASCII
    return regex.compile(TOKEN.replace(r"[^@\s]", f"[^@{SPACES}]").replace(r"[^\s]", f"[^{SPACES}]").replace(r"\d", "[0-9]"))


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pattern = _pattern()
    kinds = {"doc_id": None, "sent_id": pa.int32(), "begin": pa.int32(), "end": pa.int32(), "first": pa.int32()}
    for batch in batches:
        kinds["doc_id"] = batch.column(0).type
        rows: list[tuple] = []
        starts, forms, idx, after = [0], [], [], []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            tokens = pa.StructArray.from_arrays([pa.array(forms, pa.string()), pa.array(idx, pa.int32()), pa.array(after, pa.bool_())], ["form", "idx", "has_space"])
            found = pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), tokens)], [*kinds, "tokens"])
            for x in (rows, forms, idx, after):
                x.clear()
            starts[:] = [0]
            return found

        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            i = first = sentence = begin = end = 0
            ended = False
            for m in pattern.finditer(text):
                form = m[0]
                ends = form in ".!?"
                if ended and not ends:  # the token before this one ended a sentence
                    rows.append((doc, sentence, begin, end, first))
                    starts.append(len(forms))
                    sentence, first = sentence + 1, i
                    if len(forms) > TOKENS_HELD:
                        yield out()
                if i == first:
                    begin = m.start()
                end, ended = m.end(), ends
                forms.append(form)
                idx.append(m.start())
                after.append(text[end : end + 1] in SPACES and end < len(text))
                i += 1
            if i:
                rows.append((doc, sentence, begin, end, first))
                starts.append(len(forms))
        if rows:
            yield out()


def sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a sentence: doc_id, sent_id (from 0), begin and end in the text,
    first (its first token's number), tokens (array of form, idx, has_space).

    Sentences end after a run of full stops, question and exclamation marks.
    A text is read in its own row, in order: rows that repeat a doc_id, or lack
    one, are texts of their own, and nothing is shuffled.  Null and empty texts
    have no sentences.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    return rows.mapInArrow(_sentences, f"doc_id {kind}, sent_id int, begin int, `end` int, first int, tokens array<struct<form: string, idx: int, has_space: boolean>>")


#: Pieces between white space that a task collects, and that it remembers.
PIECES_HELD, PIECES_KNOWN = 1 << 16, 1 << 17
#: Characters of a text that are cut at once; of pieces that a task remembers.
TEXT_HELD, LETTERS_KNOWN = 1 << 18, 1 << 23
ATTRIBUTES = {
    "form": "string", "lower": "string", "is_alpha": "int", "is_digit": "int", "is_ascii": "int", "is_lower": "int", "is_upper": "int", "is_title": "int", "is_punct": "int", "is_currency": "int",
    "is_bracket": "int", "is_quote": "int", "is_left_punct": "int", "is_right_punct": "int", "like_num": "int", "like_url": "int", "like_email": "int", "n_chars": "int", "prefix": "string", "suffix": "string", "shape": "string",
}


class Pieces(dict):
    """Numbers of pieces of text without white space, in which tokens lie; an
    unknown one is cut into tokens, an unknown token is described."""

    def __init__(self) -> None:
        super().__init__()
        import regex

        token, letters = _pattern(), regex.compile(r"\p{L}+")
        title, punct, currency = regex.compile(r"(?=\p{L})\p{Lu}\P{Lu}*"), regex.compile(r"\p{P}+"), regex.compile(r"\p{Sc}")
        digits, number, email = regex.compile("[0-9]+"), regex.compile("[0-9]+(?:[.,][0-9]+)*"), regex.compile(f"[^@{SPACES}]+@[^@{SPACES}]+\\.[^@{SPACES}]+")
        shapes = [(regex.compile(x), y) for x, y in ((r"\p{Lu}", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}]", "x"), ("[0-9]", "d"), ("X{5,}", "XXXX"), ("x{5,}", "xxxx"), ("d{5,}", "dddd"))]
        self.tokens: dict[str, int] = {}  # number of a form
        self.first, self.count, self.code, self.at = array("q"), array("q"), array("q"), array("q")
        self.letters, self.fresh, self.table = 0, [], None

        def describe(form: str) -> tuple:
            lower, upper, shape, n = form.lower(), form.upper(), form, len(form)
            if form.isascii() and form.isalpha() and form[1:] in (lower[1:], upper[1:]):  # most forms
                low, capital = int(form == lower), int(form[0] != lower[0] and form[1:] == lower[1:])
                shape = "X" + "x" * min(n - 1, 4) if capital else ("x" if low else "X") * min(n, 4)
                if low or capital or form == upper:
                    return (form, lower, 1, 0, 1, low, int(form == upper), capital, 0, 0, 0, 0, 0, 0, 0, 0, 0, n, form[0], form[-3:], shape)
                shape = form
            for x, y in shapes:
                shape = x.sub(y, shape)
            flags = (
                letters.fullmatch(form), digits.fullmatch(form), form.isascii(), form == lower != upper, form == upper != lower, title.fullmatch(form), punct.fullmatch(form), currency.fullmatch(form),
                form in BRACKETS, form in QUOTES, form in LEFT, form in RIGHT, number.fullmatch(form), form.startswith(("http://", "https://")), email.fullmatch(form),
            )
            return (form, lower, *(int(bool(x)) for x in flags), n, form[:1], form[-3:], shape)

        def cut(piece: str) -> None:
            self.first.append(len(self.code))
            word = piece[:-1]
            if piece.isascii() and piece.isalpha():  # most pieces are a word, or one and a sign
                forms = ((piece, 0),)
            elif word.isascii() and word.isalpha() and piece[-1] in ".,;:!?":
                forms = ((word, 0), (piece[-1], len(word)))
            else:
                forms = [(m[0], m.start()) for m in token.finditer(piece)]
            for form, at in forms:
                number = self.tokens.get(form)
                if number is None:
                    number = self.tokens[form] = len(self.tokens)
                    self.fresh.append(describe(form))
                self.code.append(number)
                self.at.append(at)
            self.count.append(len(self.code) - self.first[-1])
            self.letters += len(piece)

        self.cut = cut

    def __missing__(self, piece: str) -> int:
        self.cut(piece)
        self[piece] = number = len(self)
        return number

    def attributes(self) -> pa.Table:
        """One row a token, by its number."""
        if self.fresh or self.table is None:
            kinds = [pa.string() if t == "string" else pa.int32() for t in ATTRIBUTES.values()]
            columns = list(zip(*self.fresh, strict=True)) or [()] * len(kinds)
            more = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(ATTRIBUTES))
            self.table = more if self.table is None else pa.concat_tables([self.table, more]).combine_chunks()
            self.fresh = []
        return self.table


def _attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: rows (doc_id, text) to tokens; a piece between white space is cut
    and described once, its tokens are taken from there."""
    known, split, blank = Pieces(), re.compile(f"([{SPACES}]+)"), re.compile(f"[{SPACES}]")
    for batch in batches:
        codes, sizes, parts = [], [], []  # pieces; lengths of pieces and of what is between; (row, offset, pieces, ends the text)
        state = (-1, 0, 0, False)  # of the last token: row, tokens and sentences before, ends a sentence

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal known, state
            table = known.attributes()
            first, count, code, at = (np.array(x, np.int64) for x in (known.first, known.count, known.code, known.at))
            row, base, n, last = (np.array(x) for x in zip(*parts, strict=True))
            # pieces and what is between them take turns in each part
            size = np.array(sizes, np.int64)
            ends = np.cumsum(2 * n)
            begin = np.cumsum(size) - size
            begin += np.repeat(base - begin[ends - 2 * n], 2 * n)
            piece, part = np.array(codes, np.int64), np.repeat(np.arange(len(n)), n)
            closed = np.ones(len(piece), bool)  # white space follows
            closed[np.cumsum(n) - 1] = ~last
            many = count[piece]
            of = np.repeat(np.arange(len(piece)), many)
            within = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            place = first[piece][of] + within
            token, idx, doc = code[place], begin[::2][of] + at[place], row[part][of]
            after = closed[of] & (within == many[of] - 1)
            if len(of):
                stop = np.array([known.tokens.get(x, -1) for x in ".!?"])
                fin = np.isin(token, stop)
                head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                runs = np.diff(np.r_[head, len(doc)])
                fresh = doc[0] != state[0]
                before = np.r_[state[3], fin[:-1]]
                before[head[0 if fresh else 1 :]] = False
                new = before & ~fin
                i, sent = np.arange(len(doc)) - np.repeat(head, runs), np.cumsum(new)
                sent = sent - np.repeat(sent[head] - new[head], runs)
                if not fresh:
                    i[: runs[0]] += state[1]
                    sent[: runs[0]] += state[2]
                state = (int(doc[-1]), int(i[-1]) + 1, int(sent[-1]), bool(fin[-1]))
                start = new | (i == 0)
                ids = batch.column(0)
                for k in range(0, len(of), TOKENS_HELD):
                    some = slice(k, k + TOKENS_HELD)
                    own = dict(zip(ATTRIBUTES, table.take(pa.array(token[some])).combine_chunks().columns, strict=True))
                    own |= {"doc_id": ids.take(pa.array(doc[some])), **{c: pa.array(v[some].astype(np.int32)) for c, v in (("i", i), ("idx", idx), ("sent_id", sent), ("is_sent_start", start), ("has_space", after))}}
                    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (own[x] for x in TOKEN_COLUMNS)]
                    yield pa.RecordBatch.from_arrays(columns, list(TOKEN_COLUMNS))
            for x in (codes, sizes, parts):
                x.clear()
            if len(known) > PIECES_KNOWN or known.letters > LETTERS_KNOWN:
                known = Pieces()

        for row, text in enumerate(batch.column(1)):
            text, at = text.as_py(), 0
            while at < len(text):
                to = at + TEXT_HELD
                space = blank.search(text, to) if to < len(text) else None
                to = space.start() if space else len(text)
                found = split.split(text[at:to])
                codes.extend(map(known.__getitem__, found[::2]))
                sizes.extend(map(len, found))
                sizes.append(0)
                parts.append((row, at, len(found) // 2 + 1, to == len(text)))
                at = to
                if len(codes) > PIECES_HELD or known.letters > LETTERS_KNOWN:
                    yield from out()
        if parts:
            yield from out()


TOKEN_COLUMNS = ("doc_id", "i", "idx", "sent_id", "form", "lower", "is_sent_start", "has_space", *list(ATTRIBUTES)[2:])
BRACKETS, QUOTES, LEFT, RIGHT = (frozenset(x) for x in ("()[]{}<>", "\"'«»“”„‘’`", "([{<«“„‘", ")]}>»”’"))


def token_attributes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every token of every text with its surface attributes: doc_id, i, idx
    (place in the text, from 0), sent_id, and what its characters say; sentences
    and texts as in sentences()."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kinds = {"doc_id": kind, **dict.fromkeys(TOKEN_COLUMNS, "int"), **ATTRIBUTES} | {"doc_id": kind}
    return rows.mapInArrow(_attributes, ", ".join(f"{c} {kinds[c]}" for c in TOKEN_COLUMNS))


def shape(form: Column) -> Column:
    """Capitals as X, other letters x, digits d; runs of over four cut to four."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(form, r"\p{Lu}", "X"), r"[\p{Ll}\p{Lo}\p{Lm}]", "x"), r"\d", "d")
    for c in "Xxd":
        out = F.regexp_replace(out, c + "{5,}", c * 4)
    return out
