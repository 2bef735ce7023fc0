"""Expressions as SQL text, for Spark and for the SQL they are checked with.

An expression that is the same in both is written once; what differs in name,
indexing or lambda syntax is a method here.
"""

from __future__ import annotations

from ..profiles import APOSTROPHE, MARK, WRONG_APOSTROPHES, Profile


def text(value: str) -> str:
    """A string literal (no backslashes in it)."""
    return "'" + value.replace("'", "''") + "'"


class Spark:
    name = "spark"

    def fn(self, names: str, body: str) -> str:
        return f"({names}) -> {body}" if "," in names else f"{names} -> {body}"

    def pattern(self, regex: str) -> str:
        return "r'" + regex + "'"

    def text(self, value: str) -> str:
        return "concat(" + ", ".join('"\'"' if p == "'" else "'" + p + "'" for p in _parts(value)) + ")" if "'" in value else "'" + value + "'"

    def each(self, array: str, names: str, body: str) -> str:
        return f"transform({array}, {self.fn(names, body)})"

    def only(self, array: str, names: str, body: str) -> str:
        return f"filter({array}, {self.fn(names, body)})"

    def at(self, array: str, i) -> str:
        return f"get({array}, {i})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def ints(self, first: str, last: str) -> str:
        return f"filter(sequence({first}, greatest({first}, {last})), _q -> _q <= {last})"

    def fold(self, array: str, start: str, body: str) -> str:
        return f"aggregate({array}, {start}, (h, c) -> {body})"

    def replace(self, s: str, regex: str, by: str) -> str:
        return f"regexp_replace({s}, {self.pattern(regex)}, {by})"

    def find(self, s: str, regex: str) -> str:
        return f"regexp_extract_all({s}, {self.pattern(regex)}, 0)"

    def split(self, s: str, regex: str) -> str:
        return f"split({s}, {self.pattern(regex)})"

    def chars(self, s: str) -> str:
        return f"filter(split({s}, ''), c -> c <> '')"

    def code(self, c: str) -> str:
        return f"cast(ascii({c}) as bigint)"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {by})"

    def sort(self, array: str) -> str:
        return f"array_sort({array})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})"

    def largest(self, array: str) -> str:
        return f"array_max({array})"

    def json(self, array: str) -> str:
        return f"to_json({array})"

    def number(self, x: str) -> str:
        return f"cast({x} as double)"

    def match(self, s: str, regex: str) -> str:
        return f"({s} rlike {self.pattern(regex)})"

    def no_ints(self) -> str:
        return "cast(array() as array<int>)"


class Duck(Spark):
    name = "duck"

    def fn(self, names: str, body: str) -> str:
        return f"lambda {names}: {body}"

    def pattern(self, regex: str) -> str:
        return "'" + regex.replace("'", "''") + "'"

    def text(self, value: str) -> str:
        return text(value)

    def each(self, array: str, names: str, body: str) -> str:
        if "," in names:  # this dialect counts from 1
            x, i = (n.strip() for n in names.split(","))
            return f"list_transform({array}, lambda {x}, {i}_1: {body.replace(f'<{i}>', f'({i}_1 - 1)')})"
        return f"list_transform({array}, {self.fn(names, body)})"

    def only(self, array: str, names: str, body: str) -> str:
        return f"list_filter({array}, {self.fn(names, body)})"

    def at(self, array: str, i) -> str:
        return f"(CASE WHEN {i} >= 0 THEN ({array})[({i}) + 1] END)"

    def size(self, array: str) -> str:
        return f"len({array})::INT"

    def ints(self, first: str, last: str) -> str:
        return f"list_transform(range({first}, {last} + 1), lambda _q: _q::INT)"

    def fold(self, array: str, start: str, body: str) -> str:
        return f"list_reduce([({start})::BIGINT] || {array}, lambda h, c: {body})"

    def replace(self, s: str, regex: str, by: str) -> str:
        return f"regexp_replace({s}, {self.pattern(regex)}, {by}, 'g')"

    def find(self, s: str, regex: str) -> str:
        return f"regexp_extract_all({s}, {self.pattern(regex)})"

    def split(self, s: str, regex: str) -> str:
        return f"string_split_regex({s}, {self.pattern(regex)})"

    def chars(self, s: str) -> str:
        return f"list_filter(string_split({s}, ''), lambda c: c <> '')"

    def code(self, c: str) -> str:
        return f"unicode({c})::BIGINT"

    def join(self, array: str, by: str) -> str:
        return f"array_to_string({array}, {by})"

    def sort(self, array: str) -> str:
        return f"list_sort({array})"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def has(self, array: str, x: str) -> str:
        return f"list_contains({array}, {x})"

    def largest(self, array: str) -> str:
        return f"list_max({array})"

    def json(self, array: str) -> str:
        return f"to_json({array})::VARCHAR"

    def number(self, x: str) -> str:
        return f"({x})::DOUBLE"

    def match(self, s: str, regex: str) -> str:
        return f"regexp_matches({s}, {self.pattern(regex)})"

    def no_ints(self) -> str:
        return "[]::INT[]"


def _parts(value: str) -> list[str]:
    out, rest = [], value
    while "'" in rest:
        head, _, rest = rest.partition("'")
        out += [head, "'"]
    return [*out, rest]


SPARK, DUCK = Spark(), Duck()


# --- text -----------------------------------------------------------------


def normal_apostrophes(d: Spark, s: str) -> str:
    """Every character that stands for an apostrophe becomes U+02BC."""
    return f"translate({s}, {d.text(WRONG_APOSTROPHES)}, '{APOSTROPHE * len(WRONG_APOSTROPHES)}')"


def lookup_form(d: Spark, s: str) -> str:
    return f"lower({normal_apostrophes(d, s)})"


def dictionary_form(d: Spark, s: str, p: Profile) -> str:
    """Lookup form without accents (compact-dictionary keys)."""
    out = f"replace({lookup_form(d, s)}, '{MARK}', '')"
    out = f"translate({out}, '{''.join(p.base_letters)}', '{''.join(p.base_letters.values())}')"
    # nothing to do for most words of plain letters, and translating is slow
    return f"CASE WHEN {d.match(s, '^[a-z]+$')} THEN {s} ELSE {out} END"


def marked(d: Spark, s: str, p: Profile) -> str:
    """Accented letters as letter and stress mark."""
    out = f"lower({s})"
    for letter, base in p.accented.items():
        out = f"replace({out}, '{letter}', '{base}{MARK}')"
    if not p.accented:
        return out
    # most words have none
    return f"CASE WHEN {d.match(f'lower({s})', '[' + ''.join(p.accented) + ']')} THEN {out} ELSE lower({s}) END"


def without_marks(d: Spark, s: str, acute_sign: bool = False) -> str:
    return f"translate({s}, '{MARK}´', '')" if acute_sign else f"replace({s}, '{MARK}', '')"


def vowel_positions(d: Spark, s: str, p: Profile) -> str:
    return d.only(d.ints("0", f"length({s})::INT - 1" if d.name == "duck" else f"length({s}) - 1"), "i", f"instr('{p.vowels}', substr({s}, i + 1, 1)) > 0")


def vowel_count(d: Spark, s: str, p: Profile) -> str:
    return f"length({d.replace(s, f'[^{p.vowels}]', repr(''))})"


def stress_indices(d: Spark, s: str, p: Profile) -> str:
    """Ordinals of the vowels that stand before a stress mark."""
    n = f"length({s})::INT" if d.name == "duck" else f"length({s})"
    places = d.only(d.ints("1", f"{n} - 1"), "i", f"substr({s}, i + 1, 1) = '{MARK}' AND instr('{p.vowels}', substr({s}, i, 1)) > 0")
    found = d.each(places, "i", f"cast({vowel_count(d, f'substr({s}, 1, i)', p)} - 1 as int)")
    return f"CASE WHEN instr({s}, '{MARK}') > 0 THEN {found} WHEN {s} IS NOT NULL THEN {d.no_ints()} END"


def mark_many(d: Spark, s: str, stress: str, p: Profile) -> str:
    """The word with a mark after each vowel whose ordinal the list holds;
    ordinals that no vowel has are left out."""
    i = "<i>" if d.name == "duck" else "i"
    n = vowel_count(d, f"lower(substr({s}, 1, ({i} + 1)::INT))" if d.name == "duck" else f"lower(substr({s}, 1, {i} + 1))", p)
    body = f"CASE WHEN instr('{p.vowels}', lower(c)) > 0 AND {d.has(stress, f'cast({n} - 1 as int)')} THEN concat(c, '{MARK}') ELSE c END"
    return d.join(d.each(d.chars(s), "c, i", body), "''")


def mark_stress(d: Spark, s: str, k: str, p: Profile) -> str:
    """The word with a mark after its vowel number k; unchanged if out of range."""
    at = d.at(vowel_positions(d, f"lower({s})", p), k)
    return f"coalesce(concat(substr({s}, 1, {at} + 1), '{MARK}', substr({s}, {at} + 2)), {s})" if d.name == "spark" else f"CASE WHEN {at} IS NULL THEN {s} ELSE concat(substr({s}, 1, {at} + 1), '{MARK}', substr({s}, {at} + 2)) END"


def djb2(d: Spark, s: str, modulus: int) -> str:
    codes = d.each(d.chars(s), "c", d.code("c"))
    start = "cast(5381 as bigint)"
    return f"cast({d.fold(codes, start, '(h * 33 + c) & 4294967295')} % {modulus} as int)"


def ipa(d: Spark, s: str, stress: str, p: Profile) -> str:
    """Sounds letter by letter; the stressed vowel after a stress sign, other
    vowels reduced, unknown letters kept."""
    full, reduced = p.ipa, p.ipa_reduced
    cases = "".join(f" WHEN {d.text(a)} THEN '{b}'" for a, b in full.items())
    weak = "".join(f" WHEN {d.text(a)} THEN '{b}'" for a, b in reduced.items())
    low = f"lower({s})"
    strong = d.at("v", stress)
    i = "<i>" if d.name == "duck" else "i"
    body = f"CASE WHEN {i} = {strong} THEN concat('ˈ', CASE c{cases} ELSE c END) WHEN instr('{p.vowels}', c) > 0 THEN CASE c{weak} ELSE c END ELSE CASE c{cases} ELSE c END END"
    return d.join(d.each(d.chars(low), "c, i", body), "''")
