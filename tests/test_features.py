import json
import re

import numpy as np

from tonarium.functions import dialect as X
from tonarium.functions import features
from tonarium.profiles import POS_NUMBERS, UKRAINIAN

V = UKRAINIAN.vowels
WORDS = ["замок", "університет", "любити", "красивий", "виходити", "", "м'яч", "мʼяч", "тінь", "стрічка", "кантор", "радість", "ббб", "водопровід", "лісопарковий", "аа", "Київський", "бджола", "відділ", "льон"]


def h(s, m):
    x = 5381
    for c in s:
        x = (x * 33 + ord(c)) & 0xFFFFFFFF
    return x % m


def slow(form, pos):
    """A few features from their definitions."""
    low = form.lower()
    n, v = len(low), [i for i, c in enumerate(low) if c in V]
    k = len(v)
    consonants = lambda s: sum(c.isalpha() and c not in V for c in s)
    weights = [min(2, consonants(low[p + 1 : v[i + 1] if i + 1 < k else n])) for i, p in enumerate(v)]
    out = {"word_len": n, "vowel_count": k, "suffix_hash_3": h(low[-3:], 1024), "prefix_hash_4": h(low[:4], 1024), "suffix_pos_hash": h(low[-3:] + "_" + pos, 2048)}
    out["max_cluster_len"] = max((len(r) for r in re.findall(f"[^{V}\\W\\d_]+", low)), default=0)
    out["num_open_syllables"] = sum(p == n - 1 or (i + 1 < k and v[i + 1] - p <= 2) for i, p in enumerate(v))
    out["syllable_weight_var"] = round(float(np.var(weights)), 6) if k >= 2 else 0.0
    out["heavy_syllable_count"] = sum(w == 2 for w in weights)
    out["cv_shape_hash"] = h("".join("V" if c in V else "C" for c in low if c.isalpha()), 2048)
    out["has_double_consonant"] = int(any(a == b and a.isalpha() and a not in V for a, b in zip(low, low[1:])))
    out["pos_int"] = POS_NUMBERS.get(pos, 12)
    out["char_diversity"] = len(set(low)) / n if n else 0.0
    out["vowel_wide_ctx_0"] = h(("^^" + low + "$$")[v[0] : v[0] + 5], 1024) if v else 0
    out["vowel_ctx_hash_1"] = h((low[v[1] - 1] if v[1] else "^") + low[v[1]] + (low[v[1] + 1] if v[1] + 1 < n else "$"), 512) if k > 1 else 0
    spots = [i for i in range(2, n - 2) if low[i] in "оеєі" and consonants(low[i - 1]) and consonants(low[i + 1]) and 0.2 < i / n < 0.7]
    found = n >= 6 and k >= 3 and spots
    out["has_compound_interfix"], out["interfix_pos_pct"] = (1, int(spots[0] / n * 100)) if found else (0, 0)
    out["longest_prefix_len"] = max((len(p) for p in UKRAINIAN.prefixes if low.startswith(p)), default=0)
    out["soft_sign_pos_ratio"] = low.rfind("ь") / n if "ь" in low else -1.0
    out["dist_from_end_v_pen_u"] = n - v[-2] - 1 if k >= 2 else -1
    out["coda_between_v2_v3"] = v[2] - v[1] - 1 if k >= 3 else n - v[1] - 1 if k == 2 else -1
    out["consonant_cluster_between"] = min(5, consonants(low[v[0] + 1 : v[1]])) if k == 2 else 0
    return out


def test_counts():
    found = features.groups(X.SPARK, UKRAINIAN)
    base = features.base_groups(X.SPARK, UKRAINIAN)
    assert sum(map(len, base.values())) == 100
    assert (len(found["universal"]), len(found["three_syllables"]), len(found["two_syllables"])) == (32, 22, 6)


def test_against_definitions(spark):
    rows = [(w, p, f) for w in WORDS for p, f in (("NOUN", '{"Case":"Gen","Number":"Plur"}'), ("ADJ", None), ("?", "not json"))]
    frame = features.feature_columns(spark.createDataFrame(rows, "form string, pos string, feats string"), UKRAINIAN, list(features.groups(X.SPARK, UKRAINIAN)))
    for r in frame.collect():
        for name, value in slow(r.form, r.pos).items():
            assert abs(r[name] - value) < 1e-9, (r.form, name)
        expected = (1, 1, 2) if r.pos == "NOUN" else (-1, -1, 0)
        assert (r.morph_case, r.morph_number, r.morph_n_features) == expected


def test_flags(spark):
    rows = [("київський", "ADJ", None), ("виходити", "VERB", None), ("навчання", "NOUN", None), ("моряк", "NOUN", None)]
    got = {r.form: r for r in features.feature_columns(spark.createDataFrame(rows, "form string, pos string, feats string"), UKRAINIAN, ["endings", "universal"]).collect()}
    assert got["київський"].has_adcat_suffix == 1 and got["виходити"].has_vy_prefix_verb == 1 and got["виходити"].is_infinitive == 1
    assert got["навчання"].has_deverbal_suffix == 1 and got["моряк"].has_masc_stress_suffix == 1 and got["моряк"].has_oxytone_mobile_u == 1


def slow_early(form, pos, feats, stress):
    """The early columns from their definitions."""
    v = [i for i, c in enumerate(form.lower()) if c in V]
    n, has = len(form), json.loads(feats or "{}")
    out = {"word_len": n, "vowel_count": len(v), "num_syllables": len(v), "dist_to_first_vowel": v[0] if v else 0, "dist_from_last_vowel": n - v[-1] - 1 if v else 0}
    out |= {"last_vowel_pos": v[-1] if v else -1, "pos": pos or "", "case": has.get("Case", ""), "number": has.get("Number", ""), "gender": has.get("Gender", "")}
    out |= {"is_homonym": 0, "is_disambiguable": 1, "num_stresses": len(stress), "is_multi_stress": int(len(stress) > 1), "pos_confidence": 1.0, "features_confidence": 0.25}
    out |= {f"suffix_{i}": form[-i:] if n >= i else "" for i in (2, 3, 4, 5)}
    out |= {"suffix3_pos": (form[-3:] if n >= 3 else "") + "_" + (pos or ""), "first_vowel_ratio": v[0] / n if v else 0.0, "last_vowel_ratio": v[-1] / n if v else 0.0}
    out |= {"prefix_2": form[:2] if n >= 2 else "", "first_syllable_type": "C" * v[0] + "V" if v else "no_vowel", "label": min(stress[0], 6) if stress else -1}
    return out


def test_early_features(spark):
    rows = [(w, pos, feats, stress) for w in WORDS for pos, feats, stress in (("NOUN", '{"Case":"Gen","Gender":"Masc"}', [1]), (None, None, []), ("X", "{}", [8, 2]))]
    frame = spark.createDataFrame([(*r, None, 1, None, 0.25) for r in rows], "form string, pos string, feats string, stress array<int>, is_homonym int, is_disambiguable int, pos_confidence double, features_confidence double")
    got = features.early_columns(frame, UKRAINIAN)
    assert len(got.columns) == 1 + 25 + 1
    for r, row in zip(rows, got.collect(), strict=True):
        assert row.asDict() == {"form": r[0]} | slow_early(*r), r
    assert len(features.early_columns(frame, UKRAINIAN, later=False).columns) == 1 + 21 + 1
