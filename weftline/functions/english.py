"""English lexemes: the stop words and the stemmer of the Snowball project's published English algorithm, written anew."""

from __future__ import annotations

import re
from functools import lru_cache

#: The usual English stop words.
STOP = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don should now""".split())

#: Words with stems of their own, and words that stay as they are once the plural is gone.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
INVARIANT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Endings and what takes their place, the longest first; lower case after the arrow is literal.
STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")

_VOWEL = "aeiouy"
_REGION = re.compile(rf"[{_VOWEL}][^{_VOWEL}]")
_SHORT_END = re.compile(rf"(?:[^{_VOWEL}][{_VOWEL}][^{_VOWEL}wxY]|^[{_VOWEL}][^{_VOWEL}])$")


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first consonant after a vowel, and once more from there."""
    begin = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    if begin is None:
        found = _REGION.search(word)
        begin = found.end() if found else len(word)
    again = _REGION.search(word, begin)
    return begin, again.end() if again else len(word)


def _ends(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of other scripts, with digits or of one or two letters stay."""
    if len(word) <= 2 or not re.fullmatch(r"[a-z']+", word):
        return word
    word = word.lstrip("'")
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub(rf"(?:^|(?<=[{_VOWEL}]))y", "Y", word)
    r1, r2 = _regions(word)
    for tail in ("'s'", "'s", "'"):
        if word.endswith(tail):
            word = word[: -len(tail)]
            break
    word = _plural(word)
    if word in INVARIANT:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWEL:
        word = word[:-1] + "i"
    word = _derived(word, r1, r2)
    return word.replace("Y", "y")


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")) or not word.endswith("s"):
        return word
    return word[:-1] if re.search(rf"[{_VOWEL}].", word[:-1]) else word


def _past(word: str, r1: int) -> str:
    tail = _ends(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if tail in ("eed", "eedly"):
        return word[: -len(tail)] + "ee" if len(word) - len(tail) >= r1 else word
    if not tail or not re.search(f"[{_VOWEL}]", word[: -len(tail)]):
        return word
    word = word[: -len(tail)]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(DOUBLES):
        return word[:-1]
    return word + "e" if len(word) <= r1 and _SHORT_END.search(word) else word


def _derived(word: str, r1: int, r2: int) -> str:
    tail = _ends(word, STEP2)
    if tail and len(word) - len(tail) >= r1:
        before = word[: -len(tail)]
        if (tail != "ogi" or before.endswith("l")) and (tail != "li" or before[-1:] in tuple("cdeghkmnrt")):
            word = before + STEP2[tail]
    tail = _ends(word, STEP3)
    if tail and len(word) - len(tail) >= (r2 if tail == "ative" else r1):
        word = word[: -len(tail)] + STEP3[tail]
    tail = _ends(word, STEP4)
    if tail and len(word) - len(tail) >= r2 and (tail != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(tail)]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _SHORT_END.search(word[:-1]))):
        return word[:-1]
    return word[:-1] if word.endswith("ll") and len(word) - 1 >= r2 else word


def lexeme(word: str) -> str | None:
    """The lexeme of a word; null for a stop word."""
    word = word.lower()
    return None if word in STOP else stem(word)
