"""Text columns: blank tests, word tokens, English stems, headline tone."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the `english` text-search configuration.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now
""".split()

# Headline keyword lists, tested as substrings, positive list first.
POSITIVE_WORDS = ["rise", "gain", "rally", "surge", "growth", "bullish", "record", "high", "up", "profit"]
NEGATIVE_WORDS = ["fall", "drop", "crash", "loss", "fear", "bearish", "low", "decline", "debt", "crisis"]

# The published English (Porter2) stemming rules.
IRREGULAR_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED_WORDS = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
UNCHANGED_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
TENSE_SUFFIXES = ["eed", "eedly", "ed", "edly", "ing", "ingly"]
STEP2_SUFFIXES = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3_SUFFIXES = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEP4_SUFFIXES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
]
WORD_BREAK = r"[^\p{L}\p{N}]+"
WORD = re.compile(r"[^\W_]+")
ASCII_BREAKS = {i: " " for i in range(128) if not chr(i).isalnum()}
SHORT_SYLLABLE = r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
SYLLABLE = r"[^aeiouy]*[aeiouy]+[^aeiouy]"


def not_blank(col: Column) -> Column:
    """Any character besides Unicode white space; the search stops at the first one."""
    return col.rlike(r"(?U)\S")


def words(col: Column) -> Column:
    """Lower-case runs of letters and digits, in text order, empty pieces included."""
    return F.split(F.lower(col), WORD_BREAK)


def lower_words(text: str) -> list[str]:
    """The runs of letters and digits that WORD finds, in lower case."""
    low = text.lower()
    return low.translate(ASCII_BREAKS).split() if low.isascii() else WORD.findall(low)


def headline_tone(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(low.rlike("|".join(POSITIVE_WORDS)), "POS")
        .when(low.rlike("|".join(NEGATIVE_WORDS)), "NEG")
        .otherwise("NEU")
    )


# Endings by step: their lengths, longest first, and the endings themselves.
TENSE, STEP2, STEP3, STEP4 = (
    (sorted({len(e) for e in endings}, reverse=True), frozenset(endings))
    for endings in (TENSE_SUFFIXES, STEP2_SUFFIXES, STEP3_SUFFIXES, STEP4_SUFFIXES)
)
# A word with none of these endings is its own stem.
ANY_ENDING = tuple({*TENSE_SUFFIXES, *STEP2_SUFFIXES, *STEP3_SUFFIXES, *STEP4_SUFFIXES, "s", "ied", "y", "e", "l"})
FIRST_REGION, REGION = re.compile(f"gener|commun|arsen|{SYLLABLE}"), re.compile(SYLLABLE)
ENDS_SHORT, VOWEL = re.compile(SHORT_SYLLABLE), re.compile("[aeiouy]")
PLURAL, FINAL_Y, VOWEL_Y = re.compile("[aeiouy].+s$"), re.compile("^(.+[^aeiouy])[yY]$"), re.compile("([aeiouy])y")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
BEFORE_LI = tuple("cdeghkmnrt")


def _split_ending(word: str, endings: tuple[list[int], frozenset[str]]) -> tuple[str, str]:
    """The word without the longest of the endings it has, and that ending ("" if none)."""
    for size in endings[0]:
        if word[-size:] in endings[1] and len(word) >= size:
            return word[:-size], word[-size:]
    return word, ""


def _drop_plural(word: str) -> str:
    if not word.endswith(("s", "ied")):
        return word
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-1] if len(word) == 4 else word[:-2]
    return word[:-1] if not word.endswith(("us", "ss")) and PLURAL.search(word) else word


def _drop_tense(word: str, r1: int) -> str:
    start, ending = _split_ending(word, TENSE)
    if ending in ("eed", "eedly"):
        return f"{start}ee" if len(start) >= r1 else word
    if not ending or not VOWEL.search(start):
        return word
    if start.endswith(("at", "bl", "iz")):
        return f"{start}e"
    if start.endswith(DOUBLES):
        return start[:-1]
    return f"{start}e" if r1 >= len(start) and ENDS_SHORT.search(start) else start


def _derived(word: str, r1: int, r2: int) -> str:
    """Steps 2 to 4: the endings of derived words."""
    start, ending = _split_ending(word, STEP2)
    fits = start.endswith("l") if ending == "ogi" else ending != "li" or start.endswith(BEFORE_LI)
    if ending and len(start) >= r1 and fits:
        word = start + STEP2_SUFFIXES[ending]
    start, ending = _split_ending(word, STEP3)
    if ending and len(start) >= (r2 if ending == "ative" else r1):
        word = start + STEP3_SUFFIXES[ending]
    start, ending = _split_ending(word, STEP4)
    return start if ending and len(start) >= r2 and (ending != "ion" or start.endswith(("s", "t"))) else word


def stem_word(token: str) -> str:
    """The English stem of a lower-case word."""
    if token in IRREGULAR_STEMS:
        return IRREGULAR_STEMS[token]
    if len(token) <= 2 or token in UNCHANGED_WORDS or not token.endswith(ANY_ENDING):
        return token
    # A y that starts the word or follows a vowel counts as a consonant, written Y.
    word = token
    if "y" in word:
        word = VOWEL_Y.sub(r"\1Y", f"Y{word[1:]}" if word[0] == "y" else word)
    # The regions begin after the first and second syllable, beyond any word if there is none.
    found = FIRST_REGION.match(word)
    r1 = found.end() if found else 1000
    found = REGION.match(word, r1)
    r2 = found.end() if found else 1000
    word = _drop_plural(word)
    if word in UNCHANGED_AFTER_PLURAL:
        return word
    word = FINAL_Y.sub(r"\1i", _drop_tense(word, r1))
    word = _derived(word, r1, r2)
    start = word[:-1]
    if word.endswith("e") and (len(start) >= r2 or len(start) >= r1 and not ENDS_SHORT.search(start)):
        word = start
    elif word.endswith("ll") and len(start) >= r2:
        word = start
    return word.lower()


class Stems(dict):
    """Stems by word; each distinct word is stemmed once."""

    def __missing__(self, token: str) -> str:
        self[token] = found = stem_word(token)
        return found


def stem(token: Column) -> Column:
    """The English stem of a column of lower-case words."""

    def run(tokens: pa.Array) -> pa.Array:
        stems = Stems()
        return pa.array([None if t is None else stems[t] for t in tokens.to_pylist()], pa.string())

    run.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(token)
