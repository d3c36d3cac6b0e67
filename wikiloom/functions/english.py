"""English lexemes: words without stop words, reduced to stems by the published Porter2 rules."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results depend on them.
STOPWORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now".split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what stands for them, where they lie in the first region (steps 2 and 3) or the second (step 4).
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")
_FIRST = re.compile("gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy]")
_REGION = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _longest(word: str, endings: dict[str, str]) -> str | None:
    return next((e for n in range(min(7, len(word)), 1, -1) if (e := word[-n:]) in endings), None)


@lru_cache(1 << 14)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two characters stay."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub("(?<=[aeiouy])y|^y", "Y", word)  # a consonant there
    first = m.end() if (m := _FIRST.match(w)) else len(w)
    second = m.end() if (m := _REGION.match(w, first)) else len(w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT_AFTER_PLURAL:
        return w

    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), "")
    if ending.startswith("eed"):
        if len(w) - len(ending) >= first:
            w = w[: len(w) - len(ending)] + "ee"
    elif ending and _VOWEL.search(w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= first and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not _VOWEL.match(w[-2]):
        w = w[:-1] + "i"

    e = _longest(w, STEP_2)
    if e and len(w) - len(e) >= first:
        before = w[: -len(e)]
        if not (e == "ogi" and before[-1:] != "l" or e == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            w = before + STEP_2[e]
    e = _longest(w, STEP_3)
    if e and len(w) - len(e) >= (second if e == "ative" else first):
        w = w[: -len(e)] + STEP_3[e]
    e = _longest(w, STEP_4)
    if e and len(w) - len(e) >= second and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) > second or len(w) > first and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > second:
        w = w[:-1]
    return w.replace("Y", "y")


@F.arrow_udf(T.StringType())
def stems(words: pa.Array) -> pa.Array:
    """The stem of each word; null of null."""
    return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())


def meaningful(lexeme: Column) -> Column:
    """Whether a lexeme is no stop word."""
    return ~lexeme.isin(*sorted(STOPWORDS))


def question_stems(question: str) -> list[str]:
    """The stems of a question's words, each once, without stop words."""
    words = re.findall(r"[^\W_]+", question.lower())
    return list(dict.fromkeys(stem(w) for w in words if w not in STOPWORDS))
