"""English stemming by the published Porter2 rules, in Arrow batches.

Each different word is stemmed once a worker. The rules are those of the algorithm's
description; words are lower case.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The algorithm's exceptional words, endings and letter classes.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STOPS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion",
    "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous",
    "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
VOWEL = "[aeiouy]"
REGION = re.compile("[aeiouy][^aeiouy]")
SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _after(word: str, start: int) -> int:
    m = REGION.search(word, start)
    return m.end() if m else len(word)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.lstrip("'")
    # A y that sounds as a consonant is written as a capital until the end.
    word = re.sub("^y|(?<=[aeiouy])y", "Y", word)
    head = re.match("gener|commun|arsen", word)
    r1 = head.end() if head else _after(word, 0)
    r2 = _after(word, r1)
    word = re.sub("'s'$|'s$|'$", "", word)

    # Plurals.
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in STOPS:
        return word

    # Past and progressive forms.
    m = re.search("(?:eedly|ingly|edly|eed|ing|ed)$", word)
    if m and m[0] in ("eed", "eedly"):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif m and re.search(VOWEL, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and SHORT.search(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    word = _replace(word, r1, STEP2)
    if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
        word = word[:-1]
    elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
        word = word[:-2]
    word = _replace(word, r1, STEP3)
    if word.endswith("ative") and len(word) - 5 >= r2:
        word = word[:-5]

    for ending in STEP4:
        if word.endswith(ending):
            if len(word) - len(ending) >= r2:
                word = word[: -len(ending)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]

    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not SHORT.search(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def _replace(word: str, region: int, table: dict[str, str]) -> str:
    """Replace the longest ending of the table, if it lies in the region."""
    for ending, new in sorted(table.items(), key=lambda x: -len(x[0])):
        if word.endswith(ending):
            return word[: -len(ending)] + new if len(word) - len(ending) >= region else word
    return word


def stems(words: Column) -> Column:
    """Stems of an array of words; NULL stays NULL."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)
