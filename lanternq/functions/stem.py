"""The English stemmer of the Snowball project (Porter2), written from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

VOWELS = "aeiouy"
#: Fixed values of the published algorithm: words with their own stems, and words left alone after step 1a.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes of steps 2, 3 and 4, longest first within a step.
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
ENDS2, ENDS3 = (tuple(suffix for suffix, _ in step) for step in (STEP2, STEP3))
#: What some step takes away or changes at the end; all other words are their own stems.
ENDS = ("'", "s", "y", "e", "ed", "ing", "ll", *ENDS2, *ENDS3, *STEP4)
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if start is None:
        m = _REGION.search(word)
        start = m.end() if m else len(word)
    m = _REGION.search(word, start)
    return start, m.end() if m else len(word)


def _has_vowel(part: str) -> bool:
    return any(c in VOWELS for c in part)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if not word.endswith(ENDS) and word[0] != "'":
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    word = word.removeprefix("'")
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    # 1a: plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _has_vowel(word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    # 1b: past and progressive forms
    if word.endswith(("eedly", "eed")):
        cut = 5 if word.endswith("eedly") else 3
        if len(word) - cut >= r1:
            word = word[:-cut] + "ee"
    else:
        suffix = next((s for s in ("ingly", "edly", "ing", "ed") if word.endswith(s)), None)
        if suffix and _has_vowel(word[: -len(suffix)]):
            word = word[: -len(suffix)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _SHORT.search(word):
                word += "e"
    # 1c: final y
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"
    # 2
    for suffix, new in STEP2 if word.endswith(ENDS2) else ():
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                before = word[: -len(suffix)]
                if (suffix != "ogi" or before.endswith("l")) and (suffix != "li" or before[-1:] in tuple("cdeghkmnrt")):
                    word = before + new
            break
    # 3
    for suffix, new in STEP3 if word.endswith(ENDS3) else ():
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                word = word[:at] + new
            break
    # 4
    for suffix in STEP4 if word.endswith(STEP4) else ():
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if at >= r2 and (suffix != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
