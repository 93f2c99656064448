"""English lexemes: words without stop words, reduced to stems by the published Snowball rules for English."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from sparkquill.functions import text as T

# ---- fixed values ----

#: English words that full text leaves out.
ENGLISH_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don should now"
).split()
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
_KEPT = set("inning outing canning herring earring proceed exceed succeed".split())
#: Suffixes that change in the first region: what they become, and what must stand before them.
_SECOND = [
    ("ational", "ate", ""), ("fulness", "ful", ""), ("iveness", "ive", ""), ("ization", "ize", ""), ("ousness", "ous", ""), ("biliti", "ble", ""), ("lessli", "less", ""), ("tional", "tion", ""),
    ("alism", "al", ""), ("aliti", "al", ""), ("ation", "ate", ""), ("entli", "ent", ""), ("fulli", "ful", ""), ("iviti", "ive", ""), ("ousli", "ous", ""), ("abli", "able", ""), ("alli", "al", ""),
    ("anci", "ance", ""), ("ator", "ate", ""), ("enci", "ence", ""), ("izer", "ize", ""), ("bli", "ble", ""), ("ogi", "og", "l"), ("li", "", "cdeghkmnrt"),
]
_THIRD = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", None), ("ical", "ic"), ("ness", ""), ("ful", "")]
_FOURTH = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile("[aeiouy]")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _regions(word: str) -> tuple[int, int]:
    """Where the first and second region begin: behind the first consonant after a vowel, and the same again."""
    head = re.match("gener|commun|arsen", word)
    found = _REGION.search(word)
    first = head.end() if head else found.end() if found else len(word)
    again = _REGION.search(word, first)
    return first, again.end() if again else len(word)


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3 or word in _WHOLE:
        return _WHOLE.get(word, word)
    word = re.sub("(?<![^aeiouy])y", "Y", word[0]) + re.sub("(?<=[aeiouy])y", "Y", word)[1:]  # a y that is no vowel
    r1, r2 = _regions(word)

    def ends(*suffixes: str) -> str | None:
        return max((s for s in suffixes if word.endswith(s)), key=len, default=None)

    if word.endswith("sses"):
        word = word[:-2]
    elif ends("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not ends("us", "ss") and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word
    found = ends("eed", "eedly", "ed", "edly", "ing", "ingly")
    if found in ("eed", "eedly"):
        word = word[: -len(found)] + "ee" if len(word) - len(found) >= r1 else word
    elif found and _VOWEL.search(word[: -len(found)]):
        word = word[: -len(found)]
        if ends("at", "bl", "iz"):
            word += "e"
        elif _DOUBLE.search(word):
            word = word[:-1]
        elif r1 >= len(word) and _SHORT_END.search(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for suffix, new, before in _SECOND:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1 and (not before or word[at - 1 : at] in tuple(before)):
                word = word[:at] + new
            break
    for suffix, new in _THIRD:
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= (r2 if new is None else r1):
                word = word[:at] + (new or "")
            break
    found = ends(*_FOURTH)
    if found and len(word) - len(found) >= r2 and (found != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(found)]
    if word.endswith("e"):
        at = len(word) - 1
        word = word[:-1] if at >= r2 or (at >= r1 and not _SHORT_END.search(word[:-1])) else word
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


#: Lists that are stemmed together, whatever the size of a batch.
ROWS = 2048


@F.arrow_udf(ArrayType(StringType()))
def _stems(words: pa.Array) -> pa.Array:
    """Each distinct word of ROWS lists is stemmed once."""
    parts = [_stemmed(words.slice(lo, ROWS)) for lo in range(0, len(words), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def _stemmed(words: pa.Array) -> pa.Array:
    coded = words.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pa.array(words.value_lengths().fill_null(0).to_numpy().cumsum(), pa.int64())]).cast(pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))


def lexemes(text: Column) -> Column:
    """Stems of the words that aren't stop words, in order. A null text has none."""
    return _stems(F.filter(T.words(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(ENGLISH_STOP)))
