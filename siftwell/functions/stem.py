"""Snowball stemmers for English (Porter2) and Russian, written from the
published descriptions of the algorithms."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Exceptional forms and suffix tables of the published algorithm.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int) -> int:
    """Where the region after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


def english(word: str) -> str:
    """Porter2 stem of a lower-case ASCII word."""
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    w = word.lstrip("'") if word[0] == "'" else word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1) if r1 < len(w) else len(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not w.endswith(s):
            continue
        if s.startswith("eed"):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
        elif any(c in _VOWELS for c in w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
        break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1 and (s != "ogi" or w.endswith("logi")) and (s != "li" or w[-3] in "cdeghkmnrt"):
                w = w[: -len(s)] + to
            break
    for s, to in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + to
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1] in "st"):
                w = w[:at]
            break
    if w.endswith("e"):
        at = len(w) - 1
        if at >= r2 or (at >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_RU_VOWELS = "аеиоуыэюя"
_PERFECTIVE = (("ившись", "ывшись", "ивши", "ывши", "ив", "ыв"), ("вшись", "вши", "в"))
_ADJECTIVE = ("ими", "ыми", "его", "ого", "ему", "ому", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею")
_PARTICIPLE = (("ивш", "ывш", "ующ"), ("ем", "нн", "вш", "ющ", "щ"))
_VERB = (
    ("ейте", "уйте", "ила", "ыла", "ена", "ите", "или", "ыли", "ило", "ыло", "ено", "ует", "уют", "ены", "ить", "ыть", "ишь", "ей", "уй", "ил", "ыл", "им", "ым", "ен", "ят", "ит", "ыт", "ую", "ю"),
    ("нно", "ешь", "йте", "ете", "ла", "на", "ли", "ем", "ло", "но", "ет", "ют", "ны", "ть", "й", "л", "н"),
)
_NOUN = ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ев", "ов", "ие", "ье", "еи", "ии", "ей", "ой", "ий", "ям", "ем", "ам", "ом", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я")


def _longest(w: str, at: int, free: tuple[str, ...], after_a: tuple[str, ...] = ()) -> str | None:
    """The longest ending of ``w`` beyond ``at``; those of ``after_a`` need а or я before them."""
    for n in range(6, 0, -1):
        end = w[-n:]
        if len(w) - n < at or len(end) < n:
            continue
        if end in free:
            return end
        if end in after_a and len(w) - n - 1 >= at and w[-n - 1] in "ая":
            return end
    return None


def russian(word: str) -> str:
    """Snowball stem of a lower-case Russian word; ё counts as е."""
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_VOWELS), len(w))

    def region(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _RU_VOWELS and w[i - 1] in _RU_VOWELS:
                return i + 1
        return len(w)

    r2 = region(region(0)) if region(0) < len(w) else len(w)

    def cut(end: str | None) -> bool:
        nonlocal w
        if end:
            w = w[: -len(end)]
        return bool(end)

    if not cut(_longest(w, rv, *_PERFECTIVE)):
        cut(_longest(w, rv, ("ся", "сь")))
        if cut(_longest(w, rv, _ADJECTIVE)):
            cut(_longest(w, rv, *_PARTICIPLE))
        elif not cut(_longest(w, rv, *_VERB)):
            cut(_longest(w, rv, _NOUN))
    if len(w) > rv and w.endswith("и"):
        w = w[:-1]
    for s in ("ость", "ост"):
        if w.endswith(s) and len(w) - len(s) >= r2:
            w = w[: -len(s)]
            break
    for s in ("ейше", "ейш"):
        if w.endswith(s) and len(w) - len(s) >= rv:
            w = w[: -len(s)]
            break
    if w.endswith("нн") and len(w) - 1 >= rv:
        return w[:-1]
    if w.endswith("ь") and len(w) - 1 >= rv:
        return w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(term: str) -> str:
    """English for ASCII terms, Russian for terms of Russian letters, else as is."""
    if term.isascii():
        return english(term)
    if all("а" <= c <= "я" or c == "ё" for c in term):
        return russian(term)
    return term
