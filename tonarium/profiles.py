"""Language profiles: what the text operators need to know of a language."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Combining acute accent, the stress mark.
MARK = "́"
#: Characters that stand for an apostrophe, and the right one.
WRONG_APOSTROPHES, APOSTROPHE = "’'ʻ`´", "ʼ"


@dataclass(frozen=True)
class Profile:
    name: str
    vowels: str
    alphabet: str
    #: Letters that carry their stress mark with them, and the letter below it.
    accented: dict[str, str] = field(default_factory=dict)
    #: Letters that the dictionary form replaces by a base letter.
    base_letters: dict[str, str] = field(default_factory=dict)
    ipa: dict[str, str] = field(default_factory=dict)
    ipa_reduced: dict[str, str] = field(default_factory=dict)
    soft_sign: str = ""
    interfixes: str = ""
    prefixes: tuple[str, ...] = ()
    suffixes: dict[str, tuple[str, ...]] = field(default_factory=dict)


#: Letters, sounds, prefixes and suffixes of Ukrainian.
UKRAINIAN = Profile(
    name="uk",
    vowels="аеєиіїоуюя",
    alphabet="абвгґдеєжзиіїйклмнопрстуфхцчшщьюя",
    base_letters={"й": "и", "ї": "і"},
    ipa={
        "а": "ɑ", "е": "ɛ", "є": "jɛ", "и": "ɪ", "і": "i", "ї": "ji", "о": "ɔ", "у": "u", "ю": "ju", "я": "jɑ",
        "б": "b", "в": "ʋ", "г": "ɦ", "ґ": "ɡ", "д": "d", "ж": "ʒ", "з": "z", "й": "j", "к": "k", "л": "l", "м": "m", "н": "n", "п": "p",
        "р": "r", "с": "s", "т": "t", "ф": "f", "х": "x", "ц": "ts", "ч": "tʃ", "ш": "ʃ", "щ": "ʃtʃ", "ь": "ʲ", "'": "ʔ", "ʼ": "ʔ",
    },
    ipa_reduced={"а": "ɐ", "е": "e", "є": "je", "и": "ɪ", "і": "i", "ї": "ji", "о": "o", "у": "u", "ю": "ju", "я": "jɐ"},
    soft_sign="ь",
    interfixes="оеєі",
    prefixes=("без", "від", "до", "з", "за", "на", "над", "не", "об", "пере", "перед", "під", "по", "при", "про", "роз", "ви"),
    suffixes={
        "masculine": ("ак", "як", "аль", "ань", "ач", "ій", "іж", "чук", "ун", "няк", "усь", "ар", "яр", "іст", "ист"),
        "foreign": ("ист", "іст", "ізм", "ант", "ент"),
        "greek": ("лог", "граф", "фон", "скоп", "метр"),
        "deverbal": ("ання", "ення", "іння"),
        "measure": ("метр", "грам", "літр"),
        "diminutive": ("еньк", "есеньк", "юсіньк"),
        "root": ("лив", "аст", "ист", "ев", "ав", "ів", "зьк", "цьк"),
        "oxytone": ("ак", "як", "ар", "яр", "ач", "ун", "няк", "аль", "ань"),
        "penult": ("ість",),
        "relational": ("зький", "цький", "ський"),
        "infinitive": ("ти", "сти", "зти"),
        "plural_verb": ("емо", "имо", "ємо", "ете", "ите"),
        "reflexive": ("ся", "сь"),
        "prefix_out": ("ви",),
        "verb": ("ати", "ити", "увати"),
        "iterative": ("увати", "ювати"),
        "teen": ("адцять",),
    },
)

_ACUTE = {"á": "a", "é": "e", "í": "i", "ó": "o", "ú": "u", "à": "a", "è": "e", "ù": "u", "ê": "e", "î": "i", "ô": "o", "â": "a", "û": "u"}
#: One profile for the Latin-script languages; accents count as stress marks.
LATIN = Profile(
    name="la",
    vowels="aeiouyäöü",
    alphabet="abcdefghijklmnopqrstuvwxyzäöüßñç",
    accented=_ACUTE,
    base_letters={"ä": "a", "ö": "o", "ü": "u", "ñ": "n", "ç": "c", **_ACUTE},
    ipa={"a": "ɑ", "e": "ɛ", "i": "i", "o": "ɔ", "u": "u", "y": "ɪ", "ä": "æ", "ö": "ø", "ü": "y", "c": "k", "g": "ɡ", "h": "ɦ", "j": "ʒ", "q": "k", "v": "ʋ", "w": "w", "x": "ks", "ß": "s", "ñ": "nʲ", "ç": "s"},
    ipa_reduced={"a": "ɐ", "e": "e", "i": "i", "o": "o", "u": "u", "y": "ɪ", "ä": "æ", "ö": "ø", "ü": "y"},
    soft_sign="ß",
    interfixes="oei",
    prefixes=("re", "des", "en", "un", "in", "con", "ver", "be", "ge", "th"),
    suffixes={
        "masculine": ("or", "ar", "er", "eur"),
        "foreign": ("ist", "ism", "ant", "ent"),
        "greek": ("log", "graph", "phon", "scop", "metr"),
        "deverbal": ("tion", "ment", "ung"),
        "measure": ("metr", "gram", "litr"),
        "diminutive": ("ito", "ette", "chen"),
        "root": ("ly", "lich", "al", "ble"),
        "oxytone": ("on", "eau", "or", "al"),
        "penult": ("ado", "keit", "ness"),
        "relational": ("ing", "isch", "ique"),
        "infinitive": ("ar", "er", "ir", "en"),
        "plural_verb": ("amos", "ons", "ez"),
        "reflexive": ("se", "st"),
        "prefix_out": ("ex",),
        "verb": ("ar", "ir", "uer"),
        "iterative": ("uer",),
        "teen": ("teen", "zehn", "ze"),
    },
)

#: Parts of speech by their names in sources.
POS_NAMES = {
    "noun": "NOUN", "verb": "VERB", "adj": "ADJ", "adjective": "ADJ", "adv": "ADV", "adverb": "ADV", "pron": "PRON", "pronoun": "PRON",
    "propn": "PROPN", "proper_noun": "PROPN", "num": "NUM", "number": "NUM", "det": "DET", "determiner": "DET", "adp": "ADP", "adposition": "ADP",
    "aux": "AUX", "auxiliary": "AUX", "cconj": "CCONJ", "conj": "CCONJ", "sconj": "SCONJ", "part": "PART", "particle": "PART",
    "intj": "INTJ", "interjection": "INTJ", "punct": "PUNCT", "punctuation": "PUNCT", "sym": "SYM", "symbol": "SYM", "x": "X", "other": "X",
}

#: Morphological tags and their universal features.
TAG_FEATURES = {
    "singular": ("Number", "Sing"), "plural": ("Number", "Plur"),
    "masculine": ("Gender", "Masc"), "feminine": ("Gender", "Fem"), "neuter": ("Gender", "Neut"),
    "nominative": ("Case", "Nom"), "genitive": ("Case", "Gen"), "dative": ("Case", "Dat"), "accusative": ("Case", "Acc"),
    "instrumental": ("Case", "Ins"), "locative": ("Case", "Loc"), "vocative": ("Case", "Voc"),
    "inanimate": ("Animacy", "Inan"), "animate": ("Animacy", "Anim"), "imperfective": ("Aspect", "Imp"), "perfective": ("Aspect", "Perf"),
    "present": ("Tense", "Pres"), "past": ("Tense", "Past"), "future": ("Tense", "Fut"),
    "first-person": ("Person", "1"), "second-person": ("Person", "2"), "third-person": ("Person", "3"),
    "infinitive": ("VerbForm", "Inf"), "imperative": ("VerbForm", "Imp"), "participle": ("VerbForm", "Part"), "adverbial": ("VerbForm", "Conv"),
    "active": ("Voice", "Act"), "passive": ("Voice", "Pass"), "comparative": ("Degree", "Cmp"), "superlative": ("Degree", "Sup"),
    "reflexive": ("Reflex", "Yes"), "negative": ("Polarity", "Neg"), "positive": ("Polarity", "Pos"),
}

#: Tag bytes of the trie source.
TRIE_TAGS = {
    0x11: ("Number", "Sing"), 0x12: ("Number", "Plur"),
    0x20: ("Case", "Nom"), 0x21: ("Case", "Gen"), 0x22: ("Case", "Dat"), 0x23: ("Case", "Acc"), 0x24: ("Case", "Ins"), 0x25: ("Case", "Loc"), 0x26: ("Case", "Voc"),
    0x30: ("Gender", "Neut"), 0x31: ("Gender", "Masc"), 0x32: ("Gender", "Fem"), 0x41: ("VerbForm", "Inf"), 0x42: ("VerbForm", "Conv"), 0x50: ("Person", "0"),
    0x61: ("upos", "NOUN"), 0x62: ("upos", "ADJ"), 0x63: ("upos", "INTJ"), 0x64: ("upos", "CCONJ"), 0x65: ("upos", "PART"), 0x66: ("upos", "PRON"), 0x67: ("upos", "VERB"),
    0x68: ("upos", "PROPN"), 0x69: ("upos", "ADV"), 0x6A: ("upos", "NOUN"), 0x6B: ("upos", "NUM"), 0x6C: ("upos", "ADP"),
}

#: Numbers of parts of speech and of feature values in vectors.
POS_NUMBERS = {p: i for i, p in enumerate("NOUN VERB ADJ ADV NUM PRON DET PART CONJ ADP INTJ X".split())}
VALUE_NUMBERS = {
    "Case": {"Nom": 0, "Gen": 1, "Dat": 2, "Acc": 3, "Ins": 4, "Loc": 5, "Voc": 6},
    "Gender": {"Masc": 0, "Fem": 1, "Neut": 2},
    "Number": {"Sing": 0, "Plur": 1},
    "Tense": {"Past": 0, "Pres": 1, "Fut": 2},
}
