"""PII (operator 9): format-preserving Feistel pseudonyms.

Validated values (card numbers with a right check digit, account numbers with right IBAN check digits, telephone
numbers, addresses of machines, social security numbers, dates, mail addresses) are replaced by values of the same
format: a keyed Feistel network permutes the value within the numbers of its format. So the replacement is valid again,
equal values stay linked across documents, different ones stay different, and who holds the key can turn them back
(``pseudonym`` with back=True).

A text is read three times: for values that their signs, letters or check digits tell apart; then for cards, among the
digit groups that these left, by the way cards are grouped; then for telephone numbers in what remains.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wikiloom.llm.token_counts import slices

ROUNDS = 8
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")
DAY_ZERO, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to the end of 2099

MAIL = r"(?P<email>(?<![\w.+-])[\w.+-]*\w@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-]))"
IBAN = r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
#: With blanks only where it is named.
SSN_NAMED = r"(?<!\w)(?:[Ss][Ss][Nn]|[Ss]ocial [Ss]ecurity(?: [Nn]umber)?)(?: is)?[ :#]{1,3}(?P<named>\d{3} \d{2} \d{4}(?![\w-]))"
DATE = r"(?P<date>(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d))"
IP = r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
IP6 = r"(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d))"
PHONE = r"(?P<phone>(?<![\w+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-]))"
INTERNATIONAL = r"(?P<abroad>(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?![\w-]))"
#: What is looked for first, and last; where two of the first could start, the one listed first.
FIRST, LAST = (MAIL, IBAN, SSN, SSN_NAMED, DATE, IP, IP6), (INTERNATIONAL, PHONE)
FIRST_ANY, LAST_ANY = re.compile("|".join(FIRST)), re.compile("|".join(LAST))
EACH = {FIRST_ANY: tuple(map(re.compile, FIRST)), LAST_ANY: tuple(map(re.compile, LAST))}
KIND_OF = {"abroad": "phone", "named": "ssn", "ip6": "ip"}
#: Digit groups that blanks or hyphens join, and how the digits of a card are grouped, the commonest first.
RUN, GROUP = re.compile(r"(?<!\w)[0-9]+(?:[ -][0-9]+)*"), re.compile(r"[0-9]+")
SHAPES = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 1), (4, 3, 3, 3), (4, 4, 5), (6, 13), (6, 10), (8, 8), (4, 12), (4, 4, 8), (4, 8, 4), (8, 4, 4))
CARD_DIGITS = range(13, 20)
#: First digits that card issuers have.
ISSUED = re.compile(r"[346]|5[0-8]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720")
#: Characters of an account number by country.
_SIZES = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
IBAN_SIZES = {x[:2]: int(x[2:]) for x in _SIZES.split()}
#: The digit sum of twice a digit.
DOUBLED = {str(d): d * 2 - 9 * (d > 4) for d in range(10)}
DECIMALS = re.compile(r"\.\d")


def permute(value: int, size: int, key: bytes, name: str, back: bool = False, inside: Callable[[int], bool] | None = None) -> int:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network on the next larger square, walked until below size.

    ``inside``: a part of these numbers that ``value`` is of; the walk goes on until it is back in it, which permutes it.
    """
    if size < 2:
        return value
    half = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, half)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = (right - _mask(left, r, key, name, size)) % half, left
            else:
                left, right = right, (left + _mask(right, r, key, name, size)) % half
        value = left * half + right
        if value < size and (inside is None or inside(value)):
            return value


def _mask(half: int, r: int, key: bytes, name: str, size: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name}:{size}:{r}:{half}".encode(), key=key, digest_size=16).digest(), "big")


def luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + it valid."""
    total = sum(map(DOUBLED.__getitem__, digits[::-2])) + sum(map(int, digits[-2::-2]))
    return -total % 10


def iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def spread(form: str, chars: str) -> str:
    """``chars`` in the places of letters and digits of ``form``."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


def mixed(value: str, key: bytes, name: str, back: bool) -> str:
    """Permute a string within its classes of characters: digits, small and capital letters; others (as letters) small."""
    sets = ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() and c.isascii() else "abcdefghijklmnopqrstuvwxyz" if c.isascii() else sorted_other(c) for c in value if c.isalnum()]
    number, size = 0, 1
    for c, s in zip((c for c in value if c.isalnum()), sets, strict=True):
        number, size = number * len(s) + s.index(c), size * len(s)
    number = permute(number, size, key, name, back)
    out = []
    for s in reversed(sets):
        number, at = divmod(number, len(s))
        out.append(s[at])
    return spread(value, "".join(reversed(out)))


@lru_cache(4096)
def sorted_other(c: str) -> str:
    """The letters of the 64 code points around a letter beyond ASCII, which stand for its class."""
    first = ord(c) & ~63
    same = "".join(x for x in map(chr, range(first, first + 64)) if x.isalnum() and x.isupper() == c.isupper() and x.isdigit() == c.isdigit() and not x.isascii())
    return same if c in same else c


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The replacement of a value, or None where it isn't valid; ``back``: the value of a replacement."""
    digits = "".join(c for c in value if c.isdigit())
    if not digits.isascii():
        return None
    if kind == "email":
        user, _, host = value.rpartition("@")
        labels = host.split(".")
        return ".".join([f"{mixed(user, key, 'mail', back)}@{mixed(labels[0], key, 'host', back)}", *labels[1:]])
    if kind == "card":
        if luhn(digits[:-1]) != int(digits[-1]) or not 13 <= len(digits) <= 19 or not int(digits):
            return None
        size = 10 ** (len(digits) - 1)
        body = f"{permute(int(digits[:-1]), size, key, 'card', back, bool):0{len(digits) - 1}d}"
        return spread(value, body + str(luhn(body)))
    if kind == "rest":
        return f"{permute(int(value), 10 ** len(value), key, 'rest', back):0{len(value)}d}"
    if kind == "iban":
        bare = value.replace(" ", "")
        if not 15 <= len(bare) <= 34 or int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 != 1:
            return None
        account = mixed(bare[4:], key, "iban", back)
        return spread(value, bare[:2] + iban_check(bare[:2], account) + account)
    if kind == "ssn":
        sign = value[3]
        area, group, serial = (int(x) for x in value.split(sign))
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return None
        number = permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, "ssn", back)
        rest, serial = divmod(number, 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}{sign}{group + 1:02d}{sign}{serial + 1:04d}"
    if kind == "ip":
        return _address6(value, key, back) if ":" in value else _address(value, key, back)
    if kind == "date":
        return _date(value, key, back)
    if not 7 <= len(digits) <= 15:
        return None
    country = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    fixed = len(country[0]) - 1 if country else 0
    own = digits[fixed:]
    return spread(value, digits[:fixed] + f"{permute(int(own), 10 ** len(own), key, 'phone', back):0{len(own)}d}")


def _octets(part: str) -> range:
    """The numbers that are written like a part of an address: as many digits, zeros in front or not."""
    if part[0] == "0" and len(part) > 1:
        return range(10 ** (len(part) - 1))
    return range(10 ** (len(part) - 1) if len(part) > 1 else 0, min(10 ** len(part), 256))


def _address(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    if max(map(int, parts)) > 255:
        return None
    likes = [_octets(p) for p in parts]
    number, size = 0, 1
    for p, like in zip(parts, likes, strict=True):
        number, size = number * len(like) + int(p) - like[0], size * len(like)
    number = permute(number, size, key, "ip" + "".join(str(len(p)) for p in parts), back)
    out = []
    for p, like in zip(reversed(parts), reversed(likes), strict=True):
        number, at = divmod(number, len(like))
        out.append(f"{like[at]:0{len(p)}d}")
    return ".".join(reversed(out))


def _address6(value: str, key: bytes, back: bool) -> str | None:
    """The hexadecimal digits of an address of machines are permuted where they stand; in small letters, unless it has
    capitals."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    digits = value.replace(":", "")
    if len([x for x in value.split(":") if x]) < 3:
        return None
    number = permute(int(digits, 16), 16 ** len(digits), key, "ip6", back)
    new = f"{number:0{len(digits)}x}"
    return spread(value, new.upper() if digits != digits.lower() else new)


def _date(value: str, key: bytes, back: bool) -> str | None:
    """Dates are permuted among those that can be written the same way: day or month of one digit or two, and, where
    the month comes first because no month is above 12, days above 12."""
    sign = next(c for c in value if not c.isdigit())
    parts = value.split(sign)
    year_first = len(parts[0]) == 4
    if year_first:
        year, month, day = map(int, parts)
        swapped = False
    else:
        day, month, year = map(int, parts)
        swapped = sign == "/" and month > 12
        if swapped:
            day, month = month, day
    try:
        number = datetime.date(year, month, day).toordinal() - DAY_ZERO
    except ValueError:
        return None
    if not 0 <= number < DAYS:
        return None
    date = lambda n: datetime.date.fromordinal(DAY_ZERO + n)
    if year_first:
        new = date(permute(number, DAYS, key, "date", back))
        return f"{new.year:04d}{sign}{new.month:02d}{sign}{new.day:02d}"
    order = lambda d: (d.month, d.day) if swapped else (d.day, d.month)
    padded = len(parts[0]) == len(parts[1]) == 2  # 05.03 and 13.11 are one way of writing, 5.3 and 13.3 are others

    def alike(n: int) -> bool:
        d = date(n)
        return (not swapped or d.day > 12) and (padded or all((x < 10) == (int(p) < 10) for x, p in zip(order(d), parts, strict=False)))

    new = date(permute(number, DAYS, key, "date", back, alike))
    return sign.join([*(f"{x:0{len(p)}d}" for x, p in zip(order(new), parts, strict=False)), f"{new.year:04d}"])


def stops(kind: str, text: str, start: int, stop: int) -> list[int]:
    """Where a value that was matched from start to stop may end. Blanks let the match of an account number run on into
    the number or word after it: it ends where its country's length is reached."""
    if kind != "iban":
        return [stop]
    size = IBAN_SIZES.get(text[start : start + 2])
    return [i for i in (stop, *(i for i in range(stop - 1, start, -1) if text[i] == " ")) if i - start - text.count(" ", start, i) == size]


def value_at(patterns: re.Pattern, text: str, start: int, stop: int, key: bytes) -> tuple[str, int, int, str] | None:
    """(kind, start, end, replacement) of the first valid value that a pattern finds there."""
    for pattern in EACH[patterns]:
        if m := pattern.match(text, start, stop):
            kind = KIND_OF.get(m.lastgroup, m.lastgroup)
            begin, end = m.span(m.lastgroup)
            for last in stops(kind, text, begin, end):
                new = pseudonym(kind, text[begin:last], key)
                if new is not None:
                    return kind, begin, last, new
    return None


def values(patterns: re.Pattern, text: str, start: int, stop: int, key: bytes) -> Iterator[tuple[str, int, int, str]]:
    """The values of some kinds between start and stop, from left to right."""
    while m := patterns.search(text, start, stop):
        found = value_at(patterns, text, m.start(), stop, key)
        if found:
            yield found
            start = found[2]
            continue
        start = m.start() + 1
        while start < m.end() and text[start - 1].isalnum():
            start += 1  # on to the next part of an invalid value


@dataclass(frozen=True, order=True)
class Grouping:
    """Digit groups that may be a card, the likelier ones less: those with an issuer's first digits and a usual shape
    before those without, before even stretches; then those that tear no number that hyphens join; then the commoner shapes;
    then the first."""

    tier: int
    torn: int
    shape: int
    first: int
    last: int
    issued: bool


def groupings(text: str, groups: list[tuple[int, int]]) -> list[Grouping]:
    """The valid cards among the digit groups of a run, each from the start of a group to the end of one.

    A short group before a decimal point isn't the likely end of a card, and one after a plus sign isn't the start of one. Other groupings than the
    usual ones count where groups of one size, the last one shorter perhaps, make up a card with an issuer's first digits
    and no such group stands beside them.
    """
    sizes = [b - a for a, b in groups]
    plus = text[groups[0][0] - 1 : groups[0][0]] == "+"
    found = []

    def add(first: int, last: int, shape: int, even: bool = False) -> None:
        digits = "".join(text[a:b] for a, b in groups[first:last])
        issued = bool(ISSUED.match(digits))
        if not (issued or not (plus or even)) or plus and first == 0 or luhn(digits[:-1]) != int(digits[-1]) or not int(digits):
            return
        doubtful = not issued or sizes[last - 1] < 4 and bool(DECIMALS.match(text, groups[last - 1][1]))
        signs = {text[groups[i][1]] for i in range(first, last - 1)}
        torn = len(signs) > 1 or "-" not in signs and (first > 0 and text[groups[first][0] - 1] == "-" or last < len(groups) and text[groups[last - 1][1]] == "-")
        found.append(Grouping(2 if even else int(doubtful), int(torn), shape, first, last, issued))

    for i, size in enumerate(sizes):
        if size in CARD_DIGITS:
            add(i, i + 1, 0)
        elif size in (4, 6, 8):
            for n, shape in enumerate(SHAPES):
                if shape[0] == size and tuple(sizes[i : i + len(shape)]) == shape:
                    add(i, i + len(shape), n)
    i = 0
    while i < len(sizes):
        stop = i + 1
        while stop < len(sizes) and sizes[stop] == sizes[i]:
            stop += 1
        if sizes[i] != 4:
            for last in (stop, stop + 1):
                if last <= len(sizes) and (last == stop or sizes[stop] < sizes[i]) and last - i > 2 and sum(sizes[i:last]) in CARD_DIGITS:
                    add(i, last, 0, even=True)
        i = stop
    return found


def cards(text: str, taken: list[tuple[str, int, int, str]], key: bytes) -> Iterator[tuple[str, int, int, str]]:
    """The cards outside the values that are taken, in order of place.

    Of valid cards that share digit groups the likeliest is one. The groups that only another one with an issuer's first
    digits has are replaced by themselves, so that no digit of either stays; a number beside a card that makes a card of
    other groups by chance, without an issuer's first digits, stays.
    """
    starts = [v[1] for v in taken]

    def free(a: int, b: int) -> bool:
        """Whether a group is a number of its own: no part of a word, a decimal or another value."""
        at = bisect_right(starts, a) - 1
        inside = at >= 0 and taken[at][2] > a or at + 1 < len(taken) and starts[at + 1] < b
        return not inside and not (text[b : b + 1].isalnum() or text[b : b + 1] == "_") and not (text[a - 1 : a] == "." and text[a - 2 : a - 1].isdigit())

    for run in RUN.finditer(text):
        if run.end() - run.start() < CARD_DIGITS[0]:
            continue
        parts: list[list[tuple[int, int]]] = [[]]
        for m in GROUP.finditer(text, run.start(), run.end()):
            if free(*m.span()):
                parts[-1].append(m.span())
            elif parts[-1]:
                parts.append([])
        for groups in filter(None, parts):
            used = bytearray(len(groups))
            chosen, over = [], []
            for g in sorted(groupings(text, groups)):
                if any(used[g.first : g.last]):
                    over.append(g)
                    continue
                used[g.first : g.last] = b"\1" * (g.last - g.first)
                chosen.append((groups[g.first][0], groups[g.last - 1][1], "card"))
            for i in {i for g in over if g.issued and g.tier < 2 for i in range(g.first, g.last) if not used[i]}:
                chosen.append((*groups[i], "rest"))
            for a, b, kind in sorted(chosen):
                yield "card", a, b, pseudonym(kind, text[a:b], key)


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its values replaced, and (kind, start, end) of each in the old text."""
    if not re.search(r"[0-9@:]", text):
        return text, []
    taken = list(values(FIRST_ANY, text, 0, len(text), key))
    taken = sorted([*taken, *cards(text, taken, key)], key=lambda v: v[1])
    bounds = [0, *(x for v in taken for x in v[1:3]), len(text)]
    for a, b in zip(bounds[::2], bounds[1::2], strict=True):
        taken += values(LAST_ANY, text, a, b, key)
    out, at = [], 0
    for _, start, stop, new in sorted(taken, key=lambda v: v[1]):
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]]), sorted(((k, a, b) for k, a, b, _ in taken), key=lambda v: v[1])


def pseudonymous(df: DataFrame, key: str, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``df`` with personal values in text_col replaced; with ``spans`` also pii_spans, an array of (kind, start, stop).

    key: any string; the same key gives the same pseudonyms. A null text stays null and has no spans, an empty one
    stays empty; nulls in other columns, repeated rows and empty tables pass as they are. With ``spans`` a column named
    pii_spans is replaced; without, it stays like all others. Values that fail validation (a card number with a wrong check digit, the 31st of June) stay; whatever numbers
    stand before or after a value, it is found. Every match is taken from the whole text.
    """
    secret = hmac.new(b"wikiloom-pii", key.encode(), "sha256").digest()
    at = df.columns.index(text_col)
    kept = [c for c in df.columns if not spans or c != "pii_spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                done = [(None, []) if t is None else pseudonymise(t, secret) for t in batch.column(at).to_pylist()]
                columns = [pa.array([t for t, _ in done], batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)]
                names = list(batch.schema.names)
                if spans:
                    columns.append(pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in s] for _, s in done], kind))
                    names.append("pii_spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    source = df.select(*kept)
    at = kept.index(text_col)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = T.StructType([*source.schema, T.StructField("pii_spans", T.ArrayType(span))]) if spans else source.schema
    return source.mapInArrow(run, schema)


def pii_counts(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, the pseudonymous text, and how many values of each kind were replaced."""
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, text_col, *counts)
