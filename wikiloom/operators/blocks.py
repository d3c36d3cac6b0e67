"""Structural blocks of stored pages: (id, block, type, level, content).

Markdown is read with windows over its lines. Markup needs a tree: a small parser per page, nothing more, in Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import strip
from wikiloom.plans.session import bound_arrow_batches

MARKUP = "<[a-zA-Z][^>]*>"
HEADING = "(?U)^(#{1,6})\\s+(.*)$"
LIST = "(?U)^\\s*([-*+]|\\d+\\.)\\s+"
BULLET = "• "
#: Characters of pages whose blocks go back together, about.
PAGES_CHARS = 1 << 20

SELECTED = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "code", "ul", "ol", "table", "blockquote")
WHOLE = ("pre", "blockquote", "ul", "ol", "table")
ENDS_PARAGRAPH = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
HOLDS = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}


class Node:
    __slots__ = ("name", "parts", "above")

    def __init__(self, name: str, above: Node | None):
        self.name, self.above, self.parts = name, above, []

    def text(self) -> str:
        out, waiting = [], [self]
        while waiting:
            x = waiting.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.name not in ("script", "style"):
                waiting += reversed(x.parts)
        return "".join(out)

    def walk(self) -> Iterator[Node]:
        waiting = [self]
        while waiting:
            x = waiting.pop()
            yield x
            waiting += [y for y in reversed(x.parts) if isinstance(y, Node)]


class Tree(HTMLParser):
    """Elements with their ancestors; end tags that markup may leave out are implied."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", None)
        self.feed(page)
        self.close()
        for node in self.root.walk():  # without the way back a tree is no cycle, and goes as soon as it isn't needed
            node.above = None

    def _leave(self, name: str, bounds: tuple[str, ...] = ()) -> None:
        at = self.now
        while at.above is not None and at.name not in bounds:
            if at.name == name:
                self.now = at.above
                return
            at = at.above

    def handle_starttag(self, name: str, attrs: list) -> None:
        if name in ENDS_PARAGRAPH:
            self._leave("p")
        for kind in CLOSES.get(name, ()):
            self._leave(kind, HOLDS[name])
        child = Node(name, self.now)
        self.now.parts.append(child)
        if name not in VOID:
            self.now = child

    def handle_endtag(self, name: str) -> None:
        self._leave(name)

    def handle_data(self, data: str) -> None:
        self.now.parts.append(data)


def _block(node: Node) -> tuple[str, int | None, str] | None:
    name = node.name
    if name in ("ul", "ol"):
        items = [t for x in node.walk() if x.name == "li" and (t := x.text().strip())]
        return ("list", None, "\n".join(BULLET + t for t in items)) if items else None
    if name == "table":
        rows = [[c.text().strip() for c in tr.walk() if c.name in ("td", "th")] for tr in node.walk() if tr.name == "tr"]
        rows = [" | ".join(r) for r in rows if r]
        return ("table", None, "\n".join(rows)) if rows else None
    kind = {"p": "paragraph", "pre": "code", "code": "code", "blockquote": "quote"}.get(name, "heading")
    text = node.text().strip()
    return (kind, int(name[1]) if kind == "heading" else None, text) if text else None


def page_blocks(page: str) -> list[tuple[str, int | None, str]]:
    """A page's blocks in document order; what stands inside a block that is taken whole isn't taken again."""
    out, waiting = [], [Tree(page).root]
    while waiting:
        node = waiting.pop()
        if node.name in SELECTED and (found := _block(node)):
            out.append(found)
        if node.name not in WHOLE:
            waiting += [x for x in reversed(node.parts) if isinstance(x, Node)]
    return out


def _few(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, pages) of a batch, few pages at once."""
    start, chars, pages = 0, 0, []
    for n in range(batch.num_rows):
        pages.append(batch.column(1)[n].as_py())
        chars += len(pages[-1] or "")
        if chars >= PAGES_CHARS or n + 1 == batch.num_rows:
            yield batch.column(0).slice(start, n + 1 - start), pages
            start, chars, pages = n + 1, 0, []


def markup_blocks(df: DataFrame) -> DataFrame:
    """Blocks of (id, text) where text is markup."""
    kind = df.schema["id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, pages in _few(batch):
                found = [[{"type": t, "level": n, "content": c} for t, n, c in page_blocks(page)] for page in pages]
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, struct)], names=["id", "blocks"])

    bound_arrow_batches(df.sparkSession)
    parsed = df.select("id", "text").mapInArrow(run, f"id {kind}, blocks array<struct<type: string, level: int, content: string>>")
    return parsed.select("id", F.posexplode("blocks").alias("block", "b")).select("id", "block", "b.type", "b.level", "b.content")


def page_text(page: str) -> str:
    """All text of a page but scripts and styles, white space made plain, no NUL."""
    return " ".join(Tree(page).root.text().replace("\0", "").split())


def plain_text(df: DataFrame) -> DataFrame:
    """(id, content) of (id, text): all text of a page but scripts and styles, white space made plain, no NUL; null of null."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, pages in _few(batch):
                texts = [None if t is None else page_text(t) for t in pages]
                yield pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], names=["id", "content"])

    bound_arrow_batches(df.sparkSession)
    return df.select("id", "text").mapInArrow(run, f"id {kind}, content string")


def markdown_blocks(df: DataFrame) -> DataFrame:
    """Blocks of (id, text) where text is markdown or plain."""
    line, by_line = F.col("line"), Window.partitionBy("id").orderBy("n")
    before = by_line.rowsBetween(Window.unboundedPreceding, -1)
    lines = df.select("id", F.posexplode(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n")).alias("n", "line"))
    fence = strip(line).startswith("```")
    fenced = lines.withColumn("fence", fence).withColumn("fences", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)))
    plain = F.when(F.col("fence"), "fence").when(F.col("fences") % 2 == 1, "code").when(strip(line) == "", "blank").when(line.rlike(HEADING), "heading").when(line.rlike(LIST), "list").otherwise("paragraph")
    kinds = fenced.withColumn("kind", plain)
    # A list line right after a paragraph's line belongs to the paragraph.
    other = F.last(F.when(F.col("kind") != "list", F.col("kind")), ignorenulls=True).over(before)
    kinds = kinds.withColumn("kind", F.when((F.col("kind") == "list") & (other == "paragraph"), "paragraph").otherwise(F.col("kind")))
    starts = (F.col("kind") == "heading") | (F.col("kind") != F.coalesce(F.lag("kind").over(by_line), F.lit("")))
    numbered = kinds.withColumn("block", F.sum(starts.cast("int")).over(by_line)).where(~F.col("kind").isin("fence", "blank"))
    said = F.when(F.col("kind") == "code", line).when(F.col("kind") == "list", F.concat(F.lit(BULLET), strip(F.regexp_replace(line, LIST, "")))).when(F.col("kind") == "heading", strip(F.regexp_extract(line, HEADING, 2))).otherwise(strip(line))
    grouped = numbered.groupBy("id", "block", F.col("kind").alias("type")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("said")))), lambda x: x["said"]).alias("parts"),
        F.max(F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, HEADING, 1)))).alias("level"),
    )
    joined: Column = F.when(F.col("type") == "paragraph", F.array_join("parts", " ")).otherwise(F.array_join("parts", "\n"))
    return grouped.select("id", "block", "type", "level", joined.alias("content"))


def blocks(df: DataFrame) -> DataFrame:
    """Blocks of (id, text), each text read as what it looks like; null and empty texts have none."""
    known = df.where("text IS NOT NULL AND text != ''")
    marked = F.col("text").rlike(MARKUP)
    return markup_blocks(known.where(marked)).unionByName(markdown_blocks(known.where(~marked)))
