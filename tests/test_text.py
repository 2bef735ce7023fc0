import pytest

from tonarium.functions import dialect as X
from tonarium.functions import registry
from tonarium.profiles import LATIN, UKRAINIAN

S = X.SPARK


def evaluate(spark, expression, words, kind="w string"):
    rows = spark.createDataFrame([w if isinstance(w, tuple) else (w,) for w in words], kind)
    return [r[0] for r in rows.selectExpr(f"{expression} AS x").collect()]


def test_stress_indices_and_vowels(spark):
    words = ["за́мок", "замо́к", "вода́", "по́ми́лка", "книга", "", None]
    assert evaluate(spark, X.stress_indices(S, "w", UKRAINIAN), words)[:6] == [[0], [1], [1], [0, 1], [], []]
    assert evaluate(spark, X.vowel_positions(S, "w", UKRAINIAN), ["сонцесяйний", "університет", ""]) == [[1, 4, 6, 9], [0, 2, 4, 7, 9], []]


def test_normal_forms(spark):
    assert evaluate(spark, X.lookup_form(S, "w"), ["М'ЯЧ", "м’яч", "мʻя`ч´", None]) == ["мʼяч", "мʼяч", "мʼяʼчʼ", None]
    assert evaluate(spark, X.dictionary_form(S, "w", UKRAINIAN), ["Мій їх за́мок"]) == ["міи іх замок"]
    assert evaluate(spark, X.without_marks(S, "w"), ["за́мок"]) == ["замок"]
    assert evaluate(spark, X.marked(S, "w", LATIN), ["Canción"]) == ["cancio" + "́" + "n"]


def test_marks_and_sounds(spark):
    rows = [("замок", 0), ("замок", 1), ("замок", 2), ("замок", -1), ("замок", None)]
    got = evaluate(spark, X.mark_stress(S, "w", "k", UKRAINIAN), rows, "w string, k int")
    assert got == ["за́мок", "замо́к", "замок", "замок", "замок"]
    v = X.vowel_positions(S, "w", UKRAINIAN)
    frame = spark.createDataFrame(rows[:2], "w string, k int").selectExpr("w", "k", f"{v} AS v")
    assert [r[0] for r in frame.selectExpr(X.ipa(S, "w", "k", UKRAINIAN)).collect()] == ["zˈɑmok", "zɐmˈɔk"]


@pytest.mark.parametrize(("word", "modulus", "value"), [("тет", 1024, 702), ("итет", 4096, 1174), ("бити", 4096, 1288), ("ивий", 4096, 224), ("дити", 4096, 2603), ("", 512, 261)])
def test_hash(spark, word, modulus, value):
    assert evaluate(spark, X.djb2(S, "w", modulus), [word]) == [value]


def test_registered_functions(spark):
    registry.register(spark, UKRAINIAN)
    row = spark.sql("SELECT stress_indices('вода́'), djb2('тет', 1024), nfd_strip('Мій'), mark_stress('вода', 1), dictionary_form('Їх')").first()
    assert list(row) == [[1], 702, "міи", "вода́", "іх"]
    got = spark.sql("SELECT form, start FROM tokenize('Ми йдемо, м''яч!')").collect()
    assert [tuple(r) for r in got] == [("Ми", 0), ("йдемо", 3), ("м'яч", 10)]


def test_syllables_and_morphology(spark):
    row = spark.sql("SELECT 'zˈɑmok' AS ipa, map('Gender', array('Masc'), 'Case', array('Nom', 'Acc')) AS f").select(registry.syllables("ipa"), registry.format_morphology("f")).first()
    assert row[0] == ["zˈɑ", "mok"] and row[1] == "Case=Acc,Nom|Gender=Masc"


def test_a_query_name_is_given_once():
    from tonarium.plans import catalog, models, products  # noqa: F401

    def distribution(spark, sf_dir):
        """A second query of a name that is taken."""

    with pytest.raises(ValueError, match="distribution"):
        catalog.query(None)(distribution)
    assert catalog.QUERIES["distribution"] is not distribution
    assert {"ensemble_accepted", "trained_ensemble_accepted"} <= set(catalog.QUERIES)
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
