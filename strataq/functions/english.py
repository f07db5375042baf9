"""English words for an index: lower-cased, without stop words, reduced to their stems.

The stems are those of the published Porter2 ("English Snowball") algorithm. A batch's different words are stemmed once
each, and the stems of the latest ``MOST_KEPT`` words are kept from batch to batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strataq.functions import text as T

#: Words whose stems a Python worker keeps; a corpus has ever more different words.
MOST_KEPT = 1 << 16
# Words that are not indexed.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
    it its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)

# Words that the published algorithm lists with their stems.
LISTED = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Endings with what stands for them, longest first, for the steps 2, 3 and 4.
STEP_2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = tuple((e, "") for e in "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split())

_REGION = re.compile("[aeiouy][^aeiouy]")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SHORT = re.compile("(^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts behind the first and behind the second vowel and consonant begin."""
    begin = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if begin is None:
        m = _REGION.search(word)
        begin = m.end() if m else len(word)
    m = _REGION.search(word, begin)
    return begin, m.end() if m else len(word)


def _short_syllable(word: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", word))


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search("[aeiouy]", word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    for ending in ("eedly", "eed"):
        if word.endswith(ending):
            return word[: -len(ending)] + "ee" if len(word) - len(ending) >= r1 else word
    for ending in ("ingly", "edly", "ing", "ed"):
        if word.endswith(ending):
            left = word[: -len(ending)]
            if not re.search("[aeiouy]", left):
                return word
            if left.endswith(("at", "bl", "iz")):
                return left + "e"
            if _DOUBLE.search(left):
                return left[:-1]
            return left + "e" if len(left) <= r1 and _short_syllable(left) else left
    return word


def _replaced(word: str, rules: Iterable[tuple[str, str]], r1: int, r2: int) -> str:
    """The longest ending that the word has, replaced if it lies where it must."""
    for ending, by in rules:
        if word.endswith(ending):
            left = word[: -len(ending)]
            region = r2 if rules is STEP_4 or ending == "ative" else r1
            wanted = {"ogi": "l", "li": "cdeghkmnrt", "ion": "st"}.get(ending)
            fits = len(left) >= region and (wanted is None or (left and left[-1] in wanted))
            return left + by if fits else word
    return word


@lru_cache(MOST_KEPT)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2 or word in LISTED:
        return LISTED.get(word, word)
    word = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(word)
    word = _plural(re.sub("('s'|'s|')$", "", word))
    if word in KEPT:
        return word
    word = _past(word, r1)
    word = re.sub("(.[^aeiouy])[yY]$", r"\1i", word)
    for rules in (STEP_2, STEP_3, STEP_4):
        word = _replaced(word, rules, r1, r2)
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def content_words(text: Column) -> Column:
    """Lower-cased letter and digit runs that are no stop words."""
    return F.filter(T.lexemes(text), lambda w: ~w.isin(*STOP_WORDS))


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """The stem of each word of an array."""
    coded = words.flatten().dictionary_encode()
    found = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), found.take(coded.indices), mask=words.is_null())


def english(text: Column) -> Column:
    """The stems of a text's content words, in order."""
    return stems(content_words(text))
