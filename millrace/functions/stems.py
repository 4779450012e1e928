"""Stems of English words, by the suffix rules of the public Porter2 description, and its stop words.

The rules work on one word; ``Stems`` keeps what a task has stemmed, so that each distinct word is stemmed once."""

from __future__ import annotations

import re

#: The words that an English full-text search leaves out.
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
    they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between into through during before
    after above below to from up down in out on off over under again further then once here there when where why how all any both each
    few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
#: Fixed values of the public description: words with stems of their own, and words that stay after the plural is gone.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
SINGULARS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
#: Suffixes and what replaces them within the first region, longer ones before their own ends.
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("ization", "ize"), ("izer", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"),
    ("fulli", "ful"), ("lessli", "less"), ("ogi", "og"), ("li", ""),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]

_VOWELS = "aeiouy"
_REGION = re.compile(f"[{_VOWELS}][^{_VOWELS}]")
_SHORT = re.compile(f"(^|[^{_VOWELS}])[{_VOWELS}][^{_VOWELS}wxY]$|^[{_VOWELS}][^{_VOWELS}]$")
_DOUBLE = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _has_vowel(part: str) -> bool:
    return any(c in _VOWELS for c in part)


def _regions(word: str) -> tuple[int, int]:
    """Where the two regions begin in which suffixes may go."""
    lead = re.match("gener|commun|arsen", word)
    found = _REGION.search(word)
    first = lead.end() if lead else found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _without_ending(w: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if w.endswith(suffix):
            return w[: -len(suffix)] + "ee" if len(w) - len(suffix) >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if not _has_vowel(base):
                return w
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if _DOUBLE.search(base):
                return base[:-1]
            return base + "e" if _SHORT.search(base) and len(base) <= r1 else base
    return w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub(f"(?<=[{_VOWELS}])y|^y", "Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in SINGULARS:
        return w
    w = _without_ending(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for suffix, other in STEP_2:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if len(base) >= r1 and (suffix != "ogi" or base.endswith("l")) and (suffix != "li" or base[-1:] in tuple("cdeghkmnrt")):
                w = base + other
            break
    for suffix, other in STEP_3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= (r2 if suffix == "ative" else r1):
                w = w[: -len(suffix)] + other
            break
    for suffix in STEP_4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(suffix)]
            break
    if w.endswith("e"):
        if len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.replace("Y", "y")


class Stems(dict):
    """word -> stem, "" for a stop word; forgets all when it has grown beyond ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = "" if word in STOP_WORDS else stem(word)
        return out
