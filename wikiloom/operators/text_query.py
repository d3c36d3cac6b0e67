"""Conditions on texts, put together in Python and answered from a text index: words, prefixes, phrases, and, or, not.

    every(word("salary"), some(prefix("holid"), phrase("days off")), without(word("draft")))

``matching`` gives the ids for which a condition holds, ``cover_ranked`` those of a conjunction by cover density: each
smallest stretch of a text that holds all its parts adds the mean weight of the places in it, less the more other words
stand between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.lexemes import WEIGHT_D
from wikiloom.operators.text_index import TextIndex, live


@dataclass(frozen=True)
class Word:
    """A lexeme, or with ``open`` all that begin so."""

    text: str
    open: bool = False


@dataclass(frozen=True)
class Phrase:
    words: tuple[Word, ...]


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Some:
    parts: tuple


@dataclass(frozen=True)
class Without:
    part: object


def word(text: str) -> Word:
    return Word(text.lower())


def prefix(text: str) -> Word:
    return Word(text.lower(), True)


def phrase(text: str) -> Phrase:
    """Words that follow each other, as the text's lexemes are."""
    return Phrase(tuple(word(w) for w in re.findall(r"[^\W_]+", text)))


def every(*parts) -> Every:
    return Every(parts)


def some(*parts) -> Some:
    return Some(parts)


def without(part) -> Without:
    return Without(part)


def words_of(part) -> list[Word]:
    """The words of a condition, each once."""
    own = {Word: lambda p: [p], Phrase: lambda p: p.words, Without: lambda p: words_of(p.part)}.get(type(part))
    found = own(part) if own else [w for p in part.parts for w in words_of(p)]
    return list(dict.fromkeys(found))


def _is(w: Word) -> Column:
    return F.col("term").startswith(w.text) if w.open else F.col("term") == w.text


def _places(words: list[Word], part) -> Column:
    """The places at which a word or phrase begins."""
    own = lambda w: F.col(f"p{words.index(w)}")
    if isinstance(part, Word):
        return own(part)
    back = lambda places, n: F.transform(places, lambda x: x - n)
    return reduce(F.array_intersect, [back(own(w), n) for n, w in enumerate(part.words)])


def _holds(words: list[Word], part) -> Column:
    if isinstance(part, Every | Some):
        tests = [_holds(words, p) for p in part.parts]
        return reduce(lambda a, b: a & b if isinstance(part, Every) else a | b, tests) if tests else F.lit(isinstance(part, Every))
    if isinstance(part, Without):
        return ~_holds(words, part.part)
    if isinstance(part, Phrase) and not part.words:
        return F.lit(False)
    return F.size(_places(words, part)) > 0


def needs_words(part) -> bool:
    """Whether a text without any of the condition's words can't fulfil it."""
    if isinstance(part, Every):
        return any(map(needs_words, part.parts))
    if isinstance(part, Some):
        return all(map(needs_words, part.parts))
    return not isinstance(part, Without)


def _gathered(index: TextIndex, condition) -> DataFrame:
    """(id, p0, p1, ...): the places of each word of a condition, in order."""
    if not needs_words(condition):
        raise ValueError("a condition that texts without any of its words fulfil can't be answered from an index")
    words = words_of(condition)
    rows = live(index, reduce(lambda a, b: a | b, map(_is, words), F.lit(False)))
    gather = lambda w: F.array_sort(F.flatten(F.collect_list(F.when(_is(w), F.col("places")))))
    return rows.groupBy("id").agg(*(gather(w).alias(f"p{n}") for n, w in enumerate(words)))


def matching(index: TextIndex, condition) -> DataFrame:
    """The ids of texts for which a condition holds. An empty conjunction or one of Without alone is refused."""
    return _gathered(index, condition).where(_holds(words_of(condition), condition)).select("id")


def covers(groups: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """(first, last, places) of each smallest stretch with a place of every group, from left to right; places: how many of
    all groups stand in it, a place of several groups counted once."""
    events: dict[int, set[int]] = {}
    for n, own in enumerate(groups):
        for x in own:
            events.setdefault(x, set()).add(n)
    order = sorted(events)
    number = {x: i for i, x in enumerate(order)}
    last = [None] * len(groups)
    begun = None
    for x in order:
        for n in events[x]:
            last[n] = x
        if None not in last and (first := min(last)) != begun:
            begun = first
            yield first, x, number[x] - number[first] + 1


def cover_density(groups: list[list[int]], weight: float = WEIGHT_D) -> float:
    """The sum over all covers: the weight, divided by one more than the words between the places."""
    return sum(weight / (1 + (last - first) - (n - 1)) for first, last, n in covers(groups))


def cover_ranked(index: TextIndex, condition: Every | Some | Word | Phrase, weight: float = WEIGHT_D) -> DataFrame:
    """(id, rank) of the texts for which a condition holds, by cover density. The condition is a conjunction of words,
    phrases, alternatives of these, and Without; other ones can be matched, but have no covers here."""
    words = words_of(condition)
    parts = [p for p in (condition.parts if isinstance(condition, Every) else (condition,)) if not isinstance(p, Without)]
    groups = [p.parts if isinstance(p, Some) else (p,) for p in parts]
    if not groups or not all(isinstance(p, Word | Phrase) for g in groups for p in g):
        raise ValueError("cover density is for conjunctions of words, phrases and alternatives of these")

    @F.pandas_udf("double")
    def density(found: pd.Series) -> pd.Series:
        return pd.Series([cover_density([list(g) for g in own], weight) for own in found], dtype=float)

    held = _gathered(index, condition).where(_holds(words, condition))
    of = lambda g: reduce(F.array_union, [_places(words, p) for p in g])
    return held.select("id", density(F.array(*map(of, groups))).alias("rank"))


def web_condition(question: str) -> Every:
    """A condition from what people write in search fields: "phrases", -words, a or b; all else must be there."""
    parts: list = []
    joins = False
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', question):
        if not sign and bare.lower() == "or" and parts:
            joins = True
            continue
        own = phrase(quoted or bare)
        if own.words:
            part = own.words[0] if len(own.words) == 1 else own
            if joins and not sign:
                last = parts.pop()
                parts.append(Some((*(last.parts if isinstance(last, Some) else (last,)), part)))
            else:
                parts.append(Without(part) if sign else part)
        joins = False
    return Every(tuple(parts))
