"""The published English stemmer (the second version of Porter's), for the keyword index and its queries."""

from __future__ import annotations

import re
from functools import lru_cache

VOWEL, NOT_VOWEL = "[aeiouy]", "[^aeiouy]"

# fixed values: the stemmer's published word and ending lists
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAYING = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_HEADS = ("gener", "commun", "arsen")
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
QUALITY = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
CLOSING = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STOPPED = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"""
STOP = frozenset(STOPPED.split())


def _behind(word: str) -> int:
    """Where the region behind the first non-vowel that follows a vowel begins."""
    m = re.search(VOWEL + NOT_VOWEL, word)
    return m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search(rf"(?:{NOT_VOWEL}{VOWEL}[^aeiouywxY]|^{VOWEL}{NOT_VOWEL})$", word))


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 18)
def stemmed(word: str) -> str:
    """The stem of one lower-case word."""
    if word in WHOLE or len(word) <= 2:
        return WHOLE.get(word, word)
    w = re.sub(rf"(?:(?<=^)|(?<={VOWEL}))y", "Y", word)
    head = next((h for h in LONG_HEADS if w.startswith(h)), None)
    r1 = len(head) if head else _behind(w)
    r2 = r1 + _behind(w[r1:])
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in STAYING:
        return w
    # past and progressive
    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search(VOWEL, w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    if re.search(rf".{NOT_VOWEL}[yY]$", w):
        w = w[:-1] + "i"
    # derived words
    ending = _longest(w, DERIVED)
    if ending and len(w) - len(ending) >= r1:
        rest = w[: -len(ending)]
        if not (ending == "ogi" and not rest.endswith("l") or ending == "li" and not re.search("[cdeghkmnrt]$", rest)):
            w = rest + DERIVED[ending]
    ending = _longest(w, QUALITY)
    if ending and len(w) - len(ending) >= (r2 if ending == "ative" else r1):
        w = w[: -len(ending)] + QUALITY[ending]
    ending = _longest(w, CLOSING)
    if ending and len(w) - len(ending) >= r2 and (ending != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(ending)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
