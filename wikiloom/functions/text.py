"""Text functions of the knowledge base, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikiloom.functions.vectors import let

# Results depend on them.
ABBREVIATIONS = ("t.ex", "bl.a", "dvs", "ev", "ca", "fr.o.m", "t.o.m", "Mr", "Mrs", "Dr", "St", "etc", "vs", "No", "fig")
SENTENCE_END = "(?U)(?<=[.!?])\\s+(?=[A-ZÅÄÖ0-9\"'(])"
PARAGRAPH_END = "(?U)\\n\\s*\\n+"
WORD_TOKENS = 1.3
SLUG_LENGTH = 120
EXCERPT_LENGTH = 200
PAGE_CAP = 120_000
PAGE_CUT = "\n…(avkortat)"

#: Latin letters with marks and what is left of them without, one for one.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def strip(c: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def words(c: Column) -> Column:
    """The words of a text, split at white space of any script."""
    return F.filter(F.split(c, "(?U)\\s+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    """ceil(words * 1.3); a null or empty text has 0."""
    return F.coalesce(F.ceil(F.regexp_count(c, F.lit("(?U)\\S+")) * F.lit(WORD_TOKENS)), F.lit(0)).cast("int")


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, PARAGRAPH_END), strip), lambda p: p != "")


def sentences(c: Column) -> Column:
    """Sentences, trimmed; the stop of an abbreviation ends none."""
    masked = c
    for i, abbreviation in enumerate(ABBREVIATIONS):
        masked = F.replace(masked, F.lit(abbreviation + "."), F.lit(f"\x01{chr(0xE000 + i)}"))
    parts = F.filter(F.transform(F.split(masked, SENTENCE_END), strip), lambda p: p != "")

    def unmask(p: Column) -> Column:
        own = p
        for i, abbreviation in enumerate(ABBREVIATIONS):
            own = F.replace(own, F.lit(f"\x01{chr(0xE000 + i)}"), F.lit(abbreviation + "."))
        return F.when(p.contains("\x01"), own).otherwise(p)  # few sentences hold one

    return F.transform(parts, unmask)


def hard_pieces(c: Column, max_tokens: int) -> Column:
    """Runs of words that fill max_tokens at two tokens a word."""
    step = max(1, max_tokens // 2)

    def pieces(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, step), " "))

    return let(words(c), pieces)


def slugify(c: Column) -> Column:
    """Lower case without marks, runs of other signs as one dash, at most 120 characters."""
    plain = F.translate(F.lower(c), MARKED, PLAIN)
    plain = F.regexp_replace(plain, "[\\u0300-\\u036f]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, SLUG_LENGTH)


def html_escape(c: Column) -> Column:
    """The five signs that markup needs, as references."""
    for sign, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(sign), F.lit(reference))
    return c


def excerpt(c: Column, length: int = EXCERPT_LENGTH) -> Column:
    """The first characters, with dots if more follow."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def capped_page(c: Column, length: int = PAGE_CAP) -> Column:
    """A page's content, cut where it is beyond what an answer can use."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit(PAGE_CUT))).otherwise(c)


def plain_title(html: Column) -> Column:
    """The text of the title element, common references decoded, white space made plain."""
    raw = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(reference), F.lit(sign))
    return strip(F.regexp_replace(raw, "(?U)\\s+", " "))


def host(url: Column) -> Column:
    """The host of an address."""
    return F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1)


def without_citations(c: Column) -> Column:
    """A generated answer without its [1, 2] marks."""
    return F.regexp_replace(c, "\\s*\\[\\s*\\d+(?:\\s*,\\s*\\d+)*\\s*\\]", "")


def answer_fields(raw: Column) -> Column:
    """struct(grounded, answer) from a model's reply, whatever stands around its JSON object."""
    return F.from_json(F.regexp_extract(raw, "(?s)\\{.*\\}", 0), "grounded boolean, answer string", {"mode": "PERMISSIVE"})


def kilobytes(size: Column) -> Column:
    """A file's size in kB with one decimal."""
    return F.concat(F.format_string("%.1f", size / 1024), F.lit(" kB"))


def ascii_file_name(name: Column) -> Column:
    """A file name for headers: other signs as underscores."""
    return F.regexp_replace(name, "[^\\x20-\\x7E]", "_")


def without_nul(c: Column) -> Column:
    return F.regexp_replace(c, "\\x00", "")
