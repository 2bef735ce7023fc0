"""Numeric features of word forms for stress prediction, as SQL expressions.

Three projections, one after another, so that nothing is computed twice:
``BASE`` (lower-case form, length, vowel positions), ``places()`` (positions of
single vowels, syllable weights), and the features.  Features are grouped like
the queries that report them; a group is a dict of name to expression.
"""

from __future__ import annotations

from ..profiles import POS_NUMBERS, VALUE_NUMBERS, Profile
from .dialect import Spark, djb2, vowel_positions


def _ends(d: Spark, endings: tuple[str, ...], word: str = "low") -> str:
    return "(" + " OR ".join(f"{word} LIKE '%{e}'" for e in endings) + ")"


def _holds(d: Spark, pieces: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"low LIKE '%{p}%'" for p in pieces) + ")"


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def _ratio(d: Spark, x: str, by: str = "n", missing: str = "0.0") -> str:
    return f"CASE WHEN {by} > 0 AND ({x}) IS NOT NULL THEN {d.number(x)} / {by} ELSE {d.number(missing)} END"


def _numbers(column: str, values: dict[str, int], other: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def _vowel_number(p: Profile, at: str, missing: str = "-1") -> str:
    return f"CASE WHEN {at} IS NULL THEN {missing} ELSE instr('{p.vowels}', substr(low, {at} + 1, 1)) - 1 END"


def base(d: Spark, p: Profile) -> dict[str, str]:
    n = "length(lower(form))"
    return {"low": "lower(form)", "n": n + ("::INT" if d.name == "duck" else ""), "v": vowel_positions(d, "lower(form)", p)}


def places(d: Spark, p: Profile) -> dict[str, str]:
    """Positions of the first five and last three vowels (null if absent),
    consonants after each vowel, open syllables."""
    k = d.size("v")
    out = {"k": k}
    out |= {f"v{i}": d.at("v", i) for i in range(5)}
    out |= {name: d.at("v", f"{k} - {i}") for i, name in ((1, "vl"), (2, "vp"), (3, "va"))}
    x = "<i>" if d.name == "duck" else "i"
    after = d.at("v", f"{x} + 1")
    gap = f"substr(low, p + 2, coalesce({after}, n) - p - 1)"
    consonants = d.replace(gap, f"[{p.vowels}]|[^\\p{{L}}]", "''")
    length = "cast(least(2, length({})) as int)"
    out["weights"] = d.each("v", "p, i", length.format(consonants))
    out["opens"] = d.each("v", "p, i", f"CASE WHEN p = n - 1 THEN 1 WHEN coalesce({after}, -9) - p - 1 BETWEEN 0 AND 1 THEN 1 ELSE 0 END")
    return out


def base_groups(d: Spark, p: Profile) -> dict[str, dict[str, str]]:
    """The 100 base features, by group."""
    s = p.suffixes
    out = s["prefix_out"][0]
    tail = lambda k: f"(CASE WHEN n >= {k} THEN substr(low, n - {k - 1}, {k}) ELSE low END)"
    head = lambda k: f"substr(low, 1, {k})"
    total = lambda a, test="TRUE": d.size(d.only(a, "z", test))
    vowels_in = lambda x: f"length({d.replace(x, f'[^{p.vowels}]', repr(''))})"
    groups: dict[str, dict[str, str]] = {}
    groups["shape"] = {
        "word_len": "n",
        "vowel_count": "k",
        "dist_to_first_vowel": "coalesce(v0, 0)",
        "dist_from_last_vowel": "CASE WHEN k > 0 THEN n - vl - 1 ELSE 0 END",
        "first_vowel_ratio": _ratio(d, "coalesce(v0, 0)"),
        "last_vowel_ratio": _ratio(d, "coalesce(vl, 0)"),
        **{f"vowel_ratio_{i}": _ratio(d, f"v{i}", missing="-1") for i in range(5)},
        "vowel_span": f"CASE WHEN k >= 2 THEN {d.number('vl - v0')} / n ELSE {d.number('0')} END",
        "mid_vowel_ratio": _ratio(d, d.at("v", "cast(floor(k / 2.0) as int)")),
        "penult_ratio": _ratio(d, "vp", missing="-1"),
        "antepenult_ratio": _ratio(d, "va", missing="-1"),
        **{f"iv_dist_{i}": _ratio(d, f"v{i + 1} - v{i}", missing="-1") for i in range(4)},
    }
    groups["hashes"] = {
        "vowel_pair_hash": f"CASE WHEN k > 0 THEN {djb2(d, 'concat(substr(low, v0 + 1, 1), substr(low, vl + 1, 1))', 256)} ELSE 0 END",
        **{f"suffix_hash_{i}": djb2(d, tail(i), m) for i, m in ((2, 512), (3, 1024), (4, 2048), (5, 2048), (6, 2048))},
        **{f"prefix_hash_{i}": djb2(d, head(i), m) for i, m in ((2, 512), (3, 1024), (4, 1024))},
        "suffix_pos_hash": djb2(d, f"concat({tail(3)}, '_', pos)", 2048),
        "bigram_pre_lv_hash": f"CASE WHEN vl >= 2 THEN {djb2(d, 'substr(low, vl - 1, 2)', 512)} ELSE 0 END",
        "bigram_post_fv_hash": f"CASE WHEN k > 0 AND v0 + 2 < n THEN {djb2(d, 'substr(low, v0 + 2, 2)', 512)} ELSE 0 END",
        "trigram_ending_hash": djb2(d, tail(3), 512),
    }
    runs = d.each(d.split(d.replace("low", f"[{p.vowels}]|[^\\p{{L}}]", "' '"), " +"), "r", "length(r)")
    groups["clusters"] = {
        "onset_cluster_len": "coalesce(v0, 0)",
        "coda_cluster_len": "CASE WHEN k > 0 THEN n - vl - 1 ELSE 0 END",
        "max_cluster_len": f"coalesce({d.largest(runs)}, 0)",
        "num_open_syllables": total("opens", "z = 1"),
        "last_syllable_open": _flag("k > 0 AND vl = n - 1"),
        "suffix4_vowel_count": vowels_in(tail(4)),
        "suffix4_vowel_ratio": f"CASE WHEN n > 0 THEN {d.number(vowels_in(tail(4)))} / least(n, 4) ELSE {d.number('0')} END",
        "char_diversity": _ratio(d, d.size(d.distinct(d.chars("low")))),
        "has_apostrophe": _flag(f"{d.match('form', '[ʼ’]')} OR instr(form, chr(39)) > 0"),
        "pos_int": _numbers("pos", POS_NUMBERS, len(POS_NUMBERS)),
        "syllable_pattern": "CASE WHEN k = 0 THEN 5 WHEN v0 <= 4 THEN v0 ELSE 6 END",
    }
    groups["endings"] = {
        "has_masc_stress_suffix": _flag(f"pos = 'NOUN' AND {_ends(d, s['masculine'])}"),
        "has_foreign_final_suffix": _flag(_ends(d, s["foreign"])),
        "has_greek_interfix": _flag(_ends(d, s["greek"])),
        "has_vy_prefix_noun": _flag(f"low LIKE '{out}%' AND pos = 'NOUN'"),
        "has_deverbal_suffix": _flag(_ends(d, s["deverbal"])),
        "has_measure_suffix": _flag(_ends(d, s["measure"])),
        "has_diminutive_adj": _flag(f"pos = 'ADJ' AND {_holds(d, s['diminutive'])}"),
        "has_root_stress_adj": _flag(f"pos = 'ADJ' AND {_holds(d, s['root'])}"),
        "is_infinitive": _flag(f"pos = 'VERB' AND {_ends(d, s['infinitive'])}"),
        "is_verb_1pl_2pl": _flag(f"pos = 'VERB' AND {_ends(d, s['plural_verb'])}"),
        "has_vy_prefix_verb": _flag(f"low LIKE '{out}%' AND pos = 'VERB'"),
        "is_reflexive": _flag(_ends(d, s["reflexive"])),
        "is_bisyllable": _flag("k = 2"),
        "stress_on_first_likely": _flag(f"low LIKE '{out}%' AND pos IN ('NOUN', 'VERB')"),
        "has_oxytone_mobile_suffix": _flag(_ends(d, s["oxytone"])),
        "has_penult_stable_suffix": _flag(_ends(d, s["penult"])),
        "has_adcat_suffix": _flag(f"pos = 'ADJ' AND {_ends(d, s['relational'])}"),
    }
    near = lambda i: f"concat(CASE WHEN v{i} > 0 THEN substr(low, v{i}, 1) ELSE '^' END, substr(low, v{i} + 1, 1), CASE WHEN v{i} + 1 < n THEN substr(low, v{i} + 2, 1) ELSE '$' END)"
    wide = lambda i: f"substr(concat('^^', low, '$$'), v{i} + 1, 5)"
    groups["contexts"] = {
        **{f"vowel_char_{i}": _vowel_number(p, f"v{i}") for i in range(5)},
        **{f"vowel_ctx_hash_{i}": f"CASE WHEN v{i} IS NULL THEN 0 ELSE {djb2(d, near(i), 512)} END" for i in range(5)},
        **{f"rel_vowel_{i}": f"CASE WHEN k > {i} THEN {d.number(str(i))} / k ELSE {d.number('-1')} END" for i in range(5)},
        **{f"vowel_wide_ctx_{i}": f"CASE WHEN v{i} IS NULL THEN 0 ELSE {djb2(d, wide(i), 1024)} END" for i in range(5)},
    }
    cv = d.replace(d.replace(d.replace("low", "[^\\p{L}]", "''"), f"[^{p.vowels}]", "'C'"), "[^C]", "'V'")
    soft = p.soft_sign
    last_soft = f"n - instr(reverse(low), '{soft}')"
    interfix = f"instr('{p.interfixes}', substr(low, i + 1, 1)) > 0 AND " + " AND ".join(f"{d.match(f'substr(low, i + {o}, 1)', chr(92) + 'p{L}')} AND instr('{p.vowels}', substr(low, i + {o}, 1)) = 0" for o in (0, 2))
    spots = d.only(d.ints("2", "n - 3"), "i", f"{interfix} AND i * 10 > n * 2 AND i * 10 < n * 7")
    first_spot = f"CASE WHEN n >= 6 AND k >= 3 THEN {d.at(spots, 0)} END"
    prefix_hits = [f"CASE WHEN low LIKE '{x}%' THEN {{}} ELSE 0 END" for x in p.prefixes]
    third = "greatest(1, cast(floor(n / 3.0) as int))"
    density = lambda a, b: f"round({d.number(vowels_in(a))} / {b}, 4)"
    mean = f"({d.number(d.fold('weights', '0' if d.name == 'duck' else '0', 'h + c'))} / k)" if d.name == "duck" else "(cast(aggregate(weights, 0, (h, c) -> h + c) as double) / k)"
    squares = d.each("weights", "z", "z * z")
    mean_square = f"({d.number(d.fold(squares, '0', 'h + c'))} / k)"
    groups["syllables"] = {
        "cv_shape_hash": djb2(d, cv, 2048),
        "soft_sign_count": f"n - length(replace(low, '{soft}', ''))",
        "soft_sign_pos_ratio": f"CASE WHEN instr(low, '{soft}') > 0 THEN {d.number(last_soft)} / n ELSE {d.number('-1')} END",
        "has_double_consonant": _flag(f"{d.size(d.only(d.ints('1', 'n - 1'), 'i', f'substr(low, i, 1) = substr(low, i + 1, 1) AND ' + d.match('substr(low, i, 1)', chr(92) + 'p{L}') + f' AND instr({chr(39)}{p.vowels}{chr(39)}, substr(low, i, 1)) = 0'))} > 0"),
        "heavy_syllable_count": total("weights", "z >= 2"),
        "final_syllable_weight": f"coalesce({d.at('weights', 'k - 1')}, 0)",
        "initial_syllable_weight": f"coalesce({d.at('weights', 0)}, 0)",
        "syllable_weight_var": f"CASE WHEN k >= 2 THEN round({mean_square} - {mean} * {mean}, 6) ELSE {d.number('0')} END",
        "has_compound_interfix": _flag(f"({first_spot}) IS NOT NULL"),
        "interfix_pos_pct": f"coalesce(cast(floor(({first_spot}) * 100.0 / n) as int), 0)",
        "prefix_match_count": " + ".join(x.format(1) for x in prefix_hits),
        "longest_prefix_len": "greatest(" + ", ".join(x.format(len(q)) for x, q in zip(prefix_hits, p.prefixes, strict=True)) + ")",
        "vowel_density_first_third": density(f"substr(low, 1, {third})", third),
        "vowel_density_mid_third": density(f"substr(low, {third} + 1, {third})", third),
        "vowel_density_last_third": f"CASE WHEN n > 2 * {third} THEN {density(f'substr(low, 2 * {third} + 1)', f'greatest(1, n - 2 * {third})')} ELSE {d.number('0')} END",
    }
    value = (lambda key: f"get_json_object(feats, '$.{key}')") if d.name == "spark" else (lambda key: f"CASE WHEN json_valid(feats) THEN json_extract_string(feats, '$.{key}') END")
    count = "coalesce(size(json_object_keys(feats)), 0)" if d.name == "spark" else "coalesce(CASE WHEN json_valid(feats) THEN len(json_keys(feats)) END, 0)::INT"
    groups["morphology"] = {f"morph_{key.lower()}": _numbers(value(key), VALUE_NUMBERS[key], -1) for key in ("Case", "Gender", "Number", "Tense")}
    groups["morphology"]["morph_n_features"] = f"CASE WHEN feats IS NULL OR feats = '' THEN 0 ELSE {count} END"
    return groups


def universal(d: Spark, p: Profile) -> dict[str, str]:
    """32 features that scale with the number of syllables."""
    s = p.suffixes
    tail = lambda k: f"(CASE WHEN n >= {k} THEN substr(low, n - {k - 1}, {k}) ELSE low END)"
    out = {"syllable_count_u": "k", "syllable_count_norm_u": f"least({d.number('k')} / 10, {d.number('1')})"}
    out |= {f"ending_hash_{i}_u": djb2(d, tail(i), 4096) for i in (4, 5, 6)}
    out |= {f"ending_pos_hash_{i}_u": djb2(d, f"concat({tail(i)}, '_', pos)", 4096) for i in (3, 4)}
    for name, at in (("last", "vl"), ("pen", "vp"), ("ante", "va")):
        out[f"dist_from_end_v_{name}_u"] = f"CASE WHEN {at} IS NULL THEN -1 ELSE n - {at} - 1 END"
        out[f"dist_from_end_v_{name}_norm_u"] = _ratio(d, f"n - {at} - 1", missing="-1")
    out["coda_last_u"] = "CASE WHEN vl IS NULL THEN -1 ELSE n - vl - 1 END"
    out["coda_pen_u"] = "coalesce(vl - vp - 1, -1)"
    out["coda_ante_u"] = "coalesce(vp - va - 1, -1)"
    out |= {f"v_{name}_char_u": _vowel_number(p, at) for name, at in (("last", "vl"), ("pen", "vp"), ("ante", "va"))}
    out["iv_last_gap_u"] = _ratio(d, "vl - vp", missing="-1")
    out["iv_pen_gap_u"] = _ratio(d, "vp - va", missing="-1")
    out |= _rule_flags(d, p, "_u")
    out["has_foreign_suffix_u"] = _flag(_ends(d, s["foreign"]))
    out["has_greek_suffix_u"] = _flag(_ends(d, s["greek"]))
    out["has_penult_stable_u"] = _flag(_ends(d, s["penult"] + s["deverbal"]))
    return out


def _rule_flags(d: Spark, p: Profile, suffix: str) -> dict[str, str]:
    s, out = p.suffixes, p.suffixes["prefix_out"][0]
    verbs, iterative, teen = s["verb"], s["iterative"], s["teen"]
    return {
        f"has_vy_prefix{suffix}": _flag(f"low LIKE '{out}%' AND pos IN ('NOUN', 'VERB')"),
        f"has_gerund_suffix{suffix}": _flag(_ends(d, s["deverbal"])),
        f"has_verb_aty{suffix}": _flag(_ends(d, verbs[:1])),
        f"has_verb_yty{suffix}": _flag(_ends(d, verbs[1:2])),
        f"has_verb_uvaty{suffix}": _flag(_ends(d, iterative)),
        f"has_oxytone_mobile{suffix}": _flag(_ends(d, s["oxytone"])),
        f"has_adcat_suffix{suffix}": _flag(f"pos = 'ADJ' AND {_ends(d, s['relational'])}"),
        f"has_num_adtsyat{suffix}": _flag(_ends(d, teen)),
    }


def three_syllables(d: Spark, p: Profile) -> dict[str, str]:
    """22 features for words of three syllables (defined for any word)."""
    tail = lambda k: f"(CASE WHEN n >= {k} THEN substr(low, n - {k - 1}, {k}) ELSE low END)"
    out = {f"ending_hash_{i}": djb2(d, tail(i), 4096) for i in (4, 5)}
    out |= {f"ending_pos_hash_{i}": djb2(d, f"concat({tail(i)}, '_', pos)", 4096) for i in (3, 4)}
    out |= {f"v{i + 1}_char_3syl": _vowel_number(p, f"v{i}") for i in range(3)}
    out["coda_after_v3"] = "coalesce(n - v2 - 1, -1)"
    out["coda_between_v2_v3"] = "coalesce(v2 - v1 - 1, n - v1 - 1, -1)"
    out["coda_between_v1_v2"] = "coalesce(v1 - v0 - 1, n - v0 - 1, -1)"
    out["iv_ratio_12_3syl"] = _ratio(d, "v1 - v0", missing="-1")
    out["iv_ratio_23_3syl"] = _ratio(d, "v2 - v1", missing="-1")
    out |= _rule_flags(d, p, "_3syl")
    out["onset_before_v1_3syl"] = "coalesce(v0, n)"
    out["onset_ratio_3syl"] = _ratio(d, "v0")
    return out


def two_syllables(d: Spark, p: Profile) -> dict[str, str]:
    """6 features for words of two syllables, zero for others."""
    consonants = lambda x: f"length({d.replace(x, f'[{p.vowels}]|[^' + chr(92) + 'p{L}]', repr(''))})"
    two = lambda x: f"CASE WHEN k = 2 THEN {x} ELSE 0 END"
    return {
        "first_vowel_char": two(_vowel_number(p, "v0", "0")),
        "second_vowel_char": two(_vowel_number(p, "v1", "0")),
        "consonant_cluster_between": two(f"least({consonants('substr(low, v0 + 2, v1 - v0 - 1)')}, 5)"),
        "suffix_after_v2_len": two("least(n - v1 - 1, 10)"),
        "consonant_before_v1_count": two(f"least({consonants('substr(low, 1, v0)')}, 5)"),
        "consonant_after_v2_count": two(f"least({consonants('substr(low, v1 + 2)')}, 5)"),
    }


#: What the second of the early feature sets has beyond the first.
LATER = ("suffix_5", "suffix3_pos", "first_vowel_ratio", "last_vowel_ratio")
#: Stresses beyond the sixth vowel are one class.
EARLY_CLASSES = 7


def early(d: Spark) -> dict[str, str]:
    """The 25 columns of the early models and their label, over base() and
    places() of rows with form, pos, feats, stress (array), the two flags of a
    homonym and the two confidences of a training table.  Texts stay texts; a
    label of -1 is a form without stress."""
    ends = lambda i: f"CASE WHEN n >= {i} THEN right(form, {i}) ELSE '' END"
    if d.name == "spark":
        value = lambda key: f"coalesce(get_json_object(feats, '$.{key}'), '')"
    else:
        value = lambda key: f"coalesce(CASE WHEN json_valid(feats) THEN json_extract_string(feats, '$.{key}') END, '')"
    out = {"word_len": "n", "vowel_count": "k", "num_syllables": "k", "dist_to_first_vowel": "coalesce(v0, 0)"}
    out |= {"dist_from_last_vowel": "CASE WHEN k > 0 THEN n - vl - 1 ELSE 0 END", "last_vowel_pos": "coalesce(vl, -1)", "pos": "coalesce(pos, '')"}
    out |= {key.lower(): value(key) for key in ("Case", "Number", "Gender")}
    out |= {"is_homonym": "coalesce(is_homonym, 0)", "is_disambiguable": "coalesce(is_disambiguable, 0)"}
    out |= {"num_stresses": d.size("stress"), "is_multi_stress": _flag(f"{d.size('stress')} > 1")}
    out |= {f"{name}_confidence": f"coalesce({name}_confidence, {d.number('1')})" for name in ("pos", "features")}
    out |= {f"suffix_{i}": ends(i) for i in (2, 3, 4, 5)}
    out["suffix3_pos"] = f"concat({ends(3)}, '_', coalesce(pos, ''))"
    out |= {"first_vowel_ratio": _ratio(d, "v0"), "last_vowel_ratio": _ratio(d, "vl")}
    out["prefix_2"] = "CASE WHEN n >= 2 THEN substr(form, 1, 2) ELSE '' END"
    out["first_syllable_type"] = "CASE WHEN k = 0 THEN 'no_vowel' ELSE concat(repeat('C', v0), 'V') END"
    out["label"] = f"CASE WHEN {d.size('stress')} > 0 THEN least({d.at('stress', 0)}, {EARLY_CLASSES - 1}) ELSE -1 END"
    return out


def early_columns(df, p: Profile, later: bool = True):
    """A Spark frame of such rows as form and the early features; without later,
    the 21 of the first set."""
    from .dialect import SPARK

    df = df.selectExpr("*", *[f"{x} AS {n}" for n, x in base(SPARK, p).items()])
    df = df.selectExpr("*", *[f"{x} AS {n}" for n, x in places(SPARK, p).items()])
    return df.selectExpr("form", *[f"{x} AS {n}" for n, x in early(SPARK).items() if later or n not in LATER])


def early_sql(p: Profile, source: str) -> str:
    """The same as DuckDB SQL over a query of such rows."""
    from .dialect import DUCK

    inner = ", ".join(f"{x} AS {n}" for n, x in base(DUCK, p).items())
    middle = ", ".join(f"{x} AS {n}" for n, x in places(DUCK, p).items())
    return f"SELECT form, {', '.join(f'{x} AS {n}' for n, x in early(DUCK).items())} FROM (SELECT *, {middle} FROM (SELECT *, {inner} FROM ({source})))"


def groups(d: Spark, p: Profile) -> dict[str, dict[str, str]]:
    return base_groups(d, p) | {"universal": universal(d, p), "three_syllables": three_syllables(d, p), "two_syllables": two_syllables(d, p)}


def feature_columns(df, p: Profile, names=None):
    """A Spark frame with form, pos and feats (JSON text) and its features.

    names: groups (all base groups by default).
    """
    from .dialect import SPARK

    found = groups(SPARK, p)
    names = names or list(base_groups(SPARK, p))
    df = df.selectExpr("*", *[f"{x} AS {n}" for n, x in base(SPARK, p).items()])
    df = df.selectExpr("*", *[f"{x} AS {n}" for n, x in places(SPARK, p).items()])
    return df.selectExpr("form", "pos", *[f"{x} AS {n}" for g in names for n, x in found[g].items()])


def feature_sql(p: Profile, names, source: str) -> str:
    """The same as DuckDB SQL over a query with form, pos, feats."""
    from .dialect import DUCK

    found = groups(DUCK, p)
    inner = ", ".join(f"{x} AS {n}" for n, x in base(DUCK, p).items())
    middle = ", ".join(f"{x} AS {n}" for n, x in places(DUCK, p).items())
    outer = ", ".join(f"{x} AS {n}" for g in names for n, x in found[g].items())
    return f"SELECT form, pos, {outer} FROM (SELECT *, {middle} FROM (SELECT *, {inner} FROM ({source})))"
