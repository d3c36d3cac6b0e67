"""Lexical search: lexemes, queries of prefixes, ranks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikiloom.functions.vectors import let

# Results depend on them.
STOPWORDS = ("och", "att", "det", "som", "för", "med", "till", "från", "den", "detta", "har", "kan", "vi", "ni", "om")
SYNONYMS = {
    "kontaktuppgifter": ("kontaktinformation", "kontaktinfo", "kontakt", "info"),
    "kontaktinformation": ("kontaktuppgifter", "kontaktinfo", "kontakt", "info"),
    "kontaktinfo": ("kontaktuppgifter", "kontaktinformation", "kontakt", "info"),
    "telefonnummer": ("telefon", "tel", "nummer"),
    "epost": ("mail", "e post", "epost"),
    "email": ("mail", "epost"),
    "löner": ("lön", "ersättning"),
}
WEIGHT_D, WEIGHT_B, WEIGHT_A = 0.1, 0.4, 1.0
RANK_SCALE = 1.64493406685
LEAST_TERM = 3
#: A letter or digit that a pattern looks back at. U+10000, a letter itself, is named because Java looks back by code points only in
#: patterns that name one beyond U+FFFF; in others it sees half of such a letter.
_BEFORE = "[\\p{L}\\p{N}\U00010000]"


def focus_terms(question: str) -> list[str]:
    """A question's terms: lower case, at least three characters, no stop words."""
    found = re.sub(r"[^\w\s]|_", " ", question.lower()).split()
    return [w for w in found if len(w) >= LEAST_TERM and w not in STOPWORDS]


def expand_terms(question: str) -> list[str]:
    """The terms and their synonyms, each once, in order of first appearance."""
    spread = [x for w in focus_terms(question) for x in (w, *SYNONYMS.get(w, ()))]
    return [w for w in dict.fromkeys(spread) if len(w) >= LEAST_TERM]


def query_prefixes(question: str) -> list[str]:
    """The prefixes of which a text must hold one: the expanded terms, cut into terms again."""
    return focus_terms(" ".join(expand_terms(question)))


def like_patterns(question: str) -> tuple[list[str], list[str]]:
    """Substring patterns of the expanded terms over three characters, and of the focus terms; none match only ''."""
    wide = [f"%{w}%" for w in expand_terms(question) if len(w) > LEAST_TERM]
    return wide or [""], [f"%{w}%" for w in focus_terms(question)] or [""]


def lexemes(c: Column) -> Column:
    """Lower-case runs of letters and digits, in order; none of a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1)


def starts_with_any(lexeme: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (lexeme.startswith(p) for p in prefixes), F.lit(False))


def hits(tokens: Column, prefixes: list[str]) -> Column:
    """How many lexemes start with one of the prefixes."""
    return F.size(F.filter(tokens, lambda t: starts_with_any(t, prefixes)))


def lowered(c: Column) -> Column:
    """A text in small letters, an empty one for null."""
    return F.lower(F.coalesce(c, F.lit("")))


def text_hits(low: Column, prefixes: list[str]) -> Column:
    """``hits`` of the lexemes of a text in small letters, counted in the text: starts of lexemes at which one of the prefixes
    stands. What stands before a prefix is looked at last, as few places have the prefix."""
    if not prefixes:
        return F.lit(0)
    each = (f"{p}(?<!{_BEFORE}{p})" for p in map(re.escape, prefixes))
    return F.regexp_count(low, F.lit("|".join(each)))


def holds_any(low: Column, patterns: list[str]) -> Column:
    """Whether a text in small letters is like one of some patterns of like_patterns."""
    return reduce(lambda a, b: a | b, (low.contains(p.strip("%")) if p else low == "" for p in patterns), F.lit(False))


def term_count(c: Column, term: str) -> Column:
    """How many of a text's lexemes are ``term``."""
    own = re.escape(term)
    return F.regexp_count(lowered(c), F.lit(f"{own}(?<!{_BEFORE}{own})(?![\\p{{L}}\\p{{N}}])"))


def cover_rank(tokens: Column, prefixes: list[str], weight: float = WEIGHT_D) -> Column:
    """Cover-density rank of an OR query: every matching place is a cover of its own."""
    return hits(tokens, prefixes) * F.lit(weight)


def frequency_rank(tokens: Column, term: str, weight: float = WEIGHT_D) -> Column:
    """Frequency rank of one term: the places' weights, each over the square of its number, scaled."""
    return rank_of_count(F.size(F.filter(tokens, lambda t: t == term)), weight)


def rank_of_count(count: Column, weight: float = WEIGHT_D) -> Column:
    """Frequency rank of a term that occurs so often."""
    places = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(let(count, places), F.lit(0.0).cast("double"), lambda a, j: a + F.lit(weight) / (j * j)) / RANK_SCALE


def ilike_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.ilike(p) for p in patterns), F.lit(False))
