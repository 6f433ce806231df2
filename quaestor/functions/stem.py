"""English stemming by the published Porter2 algorithm, as a vectorised column function."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor.functions.text import STOPWORDS

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the algorithm: special words and suffix tables.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
_LATE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    start = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if start is None:
        m = re.search(f"[{_V}][^{_V}]", w)
        start = m.end() if m else len(w)
    m = re.search(f"[{_V}][^{_V}]", w[start:])
    return start, start + m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """Porter2 stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'")
    w = re.sub(f"(^|[{_V}])y", lambda m: m.group(1) + "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # Plurals.
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _LATE:
        return w
    # Past and present forms.
    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m and m.group() in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif len(w) <= r1 and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # Derived forms, in three steps; only the longest suffix of a step counts.
    for suffix, new in _STEP2:
        if w.endswith(suffix):
            before = w[: -len(suffix)]
            if len(before) >= r1 and not (suffix == "ogi" and not before.endswith("l")) and not (suffix == "li" and before[-1:] not in tuple("cdeghkmnrt")):
                w = before + new
            break
    for suffix, new in _STEP3:
        if w.endswith(suffix):
            before = len(w) - len(suffix)
            if before >= r1 and (suffix != "ative" or before >= r2):
                w = w[:before] + new
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            before = w[: -len(suffix)]
            if len(before) >= r2 and (suffix != "ion" or before.endswith(("s", "t"))):
                w = before
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def _stem(words: pd.Series) -> pd.Series:
    stop = set(STOPWORDS)
    codes, distinct = pd.factorize(words)
    found = pd.Series([w if w in stop else stem(w) for w in distinct], dtype=object)
    return found.reindex(codes).where(codes >= 0, None).reset_index(drop=True)


def may_stem_to(word: Column, target: str) -> Column:
    """False only for words whose stem is another one; no Python is run. Words are lower-case.

    No step makes a word longer, and each keeps all but the last two letters of what it returns, so a stem's other letters begin the word.
    """
    return F.startswith(F.ltrim(word, F.lit("'")), F.lit(target[:-2]))


def stem_of(word: Column) -> Column:
    """Stem of a lower-case word; stop words stay as they are. Each distinct word of a batch is stemmed once."""
    return _stem(word)
