"""English lexemes of a text: tokens without stopwords, stemmed by the Snowball English algorithm (Porter 2)."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

#: The Snowball project's English stopwords.
STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they "
    "them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does "
    "did doing a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Words that the algorithm takes as they are or maps by hand.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent",
    "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize",
    "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: Positions of one lexeme, and of a text, that a text vector can tell apart.
MOST_POSITIONS, LAST_POSITION = 255, 16_383

_TOKEN = re.compile(rb"[a-z0-9]+")
_V, _C = "[aeiouy]", "[^aeiouy]"
_REGION = re.compile(f"{_V}{_C}")
_SHORT_END = re.compile(f"(?:{_C}{_V}[^aeiouywxY]|^{_V}{_C})$")


def _regions(w: str) -> tuple[int, int]:
    """Where the first and the second region of a word start."""
    head = re.match("gener|commun|arsen", w)
    m = _REGION.search(w)
    r1 = head.end() if head else m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _longest(w: str, endings) -> str:
    return max((e for e in endings if w.endswith(e)), key=len, default="")


@lru_cache(200_000)
def stem(word: str) -> str:
    """Stem of a lower-cased word of ASCII letters; other words are their own."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    w = re.sub(f"(?<={_V})y", "Y", "Y" + word[1:] if word[0] == "y" else word)
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V, w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_1A:
        return w
    # past forms and gerunds
    if end := _longest(w, ("eed", "eedly")):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif (end := _longest(w, ("ed", "edly", "ing", "ingly"))) and re.search(_V, w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _SHORT_END.search(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # suffixes of the first region, then of the second
    if (end := _longest(w, STEP_2)) and len(w) - len(end) >= r1:
        before = w[: -len(end)]
        if end == "li":
            w = before if before[-1:] in tuple("cdeghkmnrt") else w
        elif end != "ogi" or before.endswith("l"):
            w = before + STEP_2[end]
    if (end := _longest(w, STEP_3)) and len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
        w = w[: -len(end)] + STEP_3[end]
    if (end := _longest(w, STEP_4)) and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def _tokens(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased."""
    return [t.decode() for t in _TOKEN.findall((text or "").encode("utf-8", "replace").lower())]


def lexemes(tokens: list[str]) -> list[str]:
    return [stem(t) for t in tokens if t not in STOPWORDS]


def plain_counts(text: str | None) -> Counter:
    return Counter(_tokens(text))


def counted_lexemes(text: str | None) -> Counter:
    """Positions of each lexeme of a text, as many as a text vector holds; positions from the last one on are one."""
    places: dict[str, set[int]] = {}
    for at, t in enumerate(_tokens(text), 1):
        if t not in STOPWORDS:
            mine = places.setdefault(stem(t), set())
            if len(mine) < MOST_POSITIONS:
                mine.add(min(at, LAST_POSITION))
    return Counter({t: len(p) for t, p in places.items()})


def cover_density(text: str | None, terms: list[str]) -> float:
    """Cover density rank of a text for a query of alternatives: every position of a term is a cover of its own and weighs a tenth."""
    counts = counted_lexemes(text)
    return sum(counts[t] for t in dict.fromkeys(lexemes(terms))) / 10
