"""Word-level text columns: readability, terms, folding and the Porter stemmer."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.binding import let

WORD = r"[\p{L}\p{N}]+"
LETTERS = r"\p{L}+"
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"

# Reading ease of a text (Flesch 1948) and the shortest text that is scored.
FLESCH_BASE, FLESCH_SENTENCE, FLESCH_SYLLABLE = 206.835, 1.015, 84.6
MIN_READABLE_CHARS = 100

# English stop words of the public Snowball list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her "
    "hers herself it its itself they them their theirs themselves what which who whom this that these "
    "those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where "
    "why how all any both each few more most other some such no nor not only own same so than too very s "
    "t can will just don should now"
).split()


def reading_ease(text: Column) -> Column:
    """Flesch reading ease; 0.0 for a text of 100 characters or less, or without words.

    A syllable is a run of vowels, and a word without vowels has one.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))
    return let(found, lambda words: _ease(text, words))


def _ease(text: Column, found: Column) -> Column:
    words = F.size(found)
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+")), F.lit(1))
    vowel_runs = F.regexp_count(F.lower(text), F.lit(f"[{VOWELS}]+"))
    # Counted word by word: one pattern for a word with a vowel would go back over every word without one.
    voiceless = F.size(F.filter(found, lambda w: ~w.rlike(f"[{VOWELS}]")))
    syllables = vowel_runs + voiceless
    score = (
        F.lit(FLESCH_BASE)
        - F.lit(FLESCH_SENTENCE) * (words / sentences)
        - F.lit(FLESCH_SYLLABLE) * (syllables / F.greatest(words, F.lit(1)))
    )
    return F.when((F.length(text) > MIN_READABLE_CHARS) & (words > 0), score).otherwise(F.lit(0.0))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their plain letters, from the Unicode decompositions."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if char.islower() and base != char and base.isascii() and base.isalpha():
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents, the form in which terms are compared."""
    accented, plain = _accent_table()
    return F.translate(F.lower(text), accented, plain)


def fold_body(text: Column) -> Column:
    """``fold`` of a long text, a column: one without accents is not looked through letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(fold(text))


def words(text: Column) -> Column:
    """All words of a text in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


# Endings of the steps 2, 3 and 4 of Porter 1980 (with "bli" and "logi" of its author's later program).
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
).split()

# A stem as runs of consonants and vowels; a "y" that is a consonant is written "Y". The measure is the number of vowel runs
# that a consonant run follows.
HAS_VOWEL = "[aeiouy]"
MEASURE_1_UP, MEASURE_2_UP = "^[^aeiouy]*+[aeiouy]++[^aeiouy]", "^[^aeiouy]*+[aeiouy]++[^aeiouy]++[aeiouy]++[^aeiouy]"
SHORT_END = "[^aeiouy][aeiouy][^aeiouywxY]$"
DOUBLE_END = r"([^aeiouy])\1$"


def _chopped(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _replaced(word: Column, endings: dict[str, str], measure: str) -> Column:
    """The longest ending that ``word`` has replaced, if the stem before it has the measure; no shorter one is tried."""
    out = None
    for ending in sorted(endings, key=len, reverse=True):
        stem_ = _chopped(word, len(ending))
        allowed = stem_.rlike(measure) & stem_.rlike("[st]$") if ending == "ion" else stem_.rlike(measure)
        new = F.when(allowed, F.concat(stem_, F.lit(endings[ending]))).otherwise(word)
        out = F.when(word.endswith(ending), new) if out is None else out.when(word.endswith(ending), new)
    return out.otherwise(word)


def _plural(word: Column) -> Column:
    return (
        F.when(word.endswith("sses") | word.endswith("ies"), _chopped(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss"), _chopped(word, 1))
        .otherwise(word)
    )


def _past(word: Column) -> Column:
    """Cut ``-ed`` and ``-ing`` from a word that keeps a vowel without them, and mend what is left."""

    def tidy(cut: Column) -> Column:
        return (
            F.when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e")))
            .when(cut.rlike(DOUBLE_END) & ~cut.rlike("[lsz]$"), _chopped(cut, 1))
            .when(cut.rlike(SHORT_END) & cut.rlike(MEASURE_1_UP) & ~cut.rlike(MEASURE_2_UP), F.concat(cut, F.lit("e")))
            .otherwise(cut)
        )

    ed, ing = _chopped(word, 2), _chopped(word, 3)
    return (
        F.when(word.endswith("eed"), F.when(ing.rlike(MEASURE_1_UP), _chopped(word, 1)).otherwise(word))
        .when(word.endswith("ed") & ed.rlike(HAS_VOWEL), let(ed, tidy))
        .when(word.endswith("ing") & ing.rlike(HAS_VOWEL), let(ing, tidy))
        .otherwise(word)
    )


def _final_y(word: Column) -> Column:
    return F.when(word.rlike("[yY]$") & _chopped(word, 1).rlike(HAS_VOWEL), F.concat(_chopped(word, 1), F.lit("i"))).otherwise(word)


def _final_e(word: Column) -> Column:
    cut = _chopped(word, 1)
    drop = cut.rlike(MEASURE_2_UP) | (cut.rlike(MEASURE_1_UP) & ~cut.rlike(SHORT_END))
    return F.when(word.endswith("e") & drop, cut).otherwise(word)


def _final_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & word.rlike(MEASURE_2_UP), _chopped(word, 1)).otherwise(word)


def stem(term: Column) -> Column:
    """Stem of a lower-case word by all steps of Porter 1980; words of one or two letters stay.

    Letters outside a to z count as consonants. The steps test endings and measures of a word, so a job
    stems its distinct words once and joins them back.
    """
    steps = [
        _plural, _past, _final_y, lambda w: _replaced(w, STEP_2, MEASURE_1_UP), lambda w: _replaced(w, STEP_3, MEASURE_1_UP),
        lambda w: _replaced(w, dict.fromkeys(STEP_4, ""), MEASURE_2_UP), _final_e, _final_l,
    ]
    word = F.regexp_replace(term, "(^|[aeiouy])y", "$1Y")
    for step in steps:
        word = let(word, step)
    return F.when(F.length(term) <= 2, term).otherwise(F.lower(word))
