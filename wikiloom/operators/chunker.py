"""Structure-aware chunks with a token budget, as a plan over blocks, sections and pieces.

Every step of the cascade (section, paragraphs, sentences, runs of words) is a projection with an explode, so that long
documents spread over tasks; only the merge of tiny chunks folds over a document's chunks, in an aggregate expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.text import WORD_TOKENS, hard_pieces, paragraphs, sentences, strip, token_estimate, words
from wikiloom.functions.vectors import let
from wikiloom.operators.blocks import blocks

GAP = "\n\n"


@dataclass(frozen=True)
class ChunkOptions:
    """Budgets. Defaults are fixed values: results depend on them."""

    max_tokens: int = 300
    max_characters: int = 1000
    overlap_tokens: int = 50
    min_tokens: int = 80


def pack(pieces: Column, o: ChunkOptions) -> Column:
    """Pieces joined in order while they fit; array<string>."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"), F.lit(0).alias("tokens"))

    def flush(acc: Column) -> Column:
        return let(strip(acc["buf"]), lambda own: F.when(own == "", acc["done"]).otherwise(F.array_append(acc["done"], own)))

    def step(acc: Column, p: Column) -> Column:
        full = acc["buf"] != ""
        over = full & ((acc["tokens"] + p["t"] > o.max_tokens) | (F.length(acc["buf"]) + len(GAP) + p["n"] > o.max_characters))
        return F.struct(
            F.when(over, flush(acc)).otherwise(acc["done"]).alias("done"),
            F.when(over | ~full, p["s"]).otherwise(F.concat(acc["buf"], F.lit(GAP), p["s"])).alias("buf"),
            F.when(over, p["t"]).otherwise(acc["tokens"] + p["t"]).alias("tokens"),
        )

    measured = F.transform(pieces, lambda p: F.struct(p.alias("s"), token_estimate(p).alias("t"), F.length(p).alias("n")))  # each piece once
    return F.aggregate(measured, start, step, flush)


def fits(c: Column, o: ChunkOptions) -> Column:
    return (F.length(c) <= o.max_characters) & (token_estimate(c) <= o.max_tokens)  # the words of a long text aren't counted


def overlap_tail(c: Column, tokens: int) -> Column:
    """The last sentences within the budget (one at least, if there are several), else the last words."""
    start = F.struct(F.array().cast("array<string>").alias("buf"), F.lit(0).alias("tokens"), F.lit(False).alias("stop"))

    def step(acc: Column, s: Column) -> Column:
        stop = acc["stop"] | ((acc["tokens"] + s["t"] > tokens) & (F.size(acc["buf"]) > 0))
        return F.struct(F.when(stop, acc["buf"]).otherwise(F.array_prepend(acc["buf"], s["s"])).alias("buf"), F.when(stop, acc["tokens"]).otherwise(acc["tokens"] + s["t"]).alias("tokens"), stop.alias("stop"))

    measured = lambda own: F.transform(F.reverse(own), lambda s: F.struct(s.alias("s"), token_estimate(s).alias("t")))
    several = lambda own: F.aggregate(measured(own), start, step, lambda acc: F.array_join(acc["buf"], " "))
    most = max(1, int(tokens / WORD_TOKENS + 0.5))
    last = lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - most, F.lit(0)) + 1, most), " ")
    return let(sentences(c), lambda own: F.when(F.size(own) > 1, several(own)).otherwise(let(words(c), last)))


def sections(found: DataFrame) -> DataFrame:
    """(id, section, path, blocks): from each heading to the next; path: the headings it stands under."""
    upto = Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("type") == "heading"
    out = found.withColumn("section", F.coalesce(F.sum(heading.cast("int")).over(upto), F.lit(0)))
    for n in range(1, 7):
        out = out.withColumn(f"h{n}", F.max(F.when(heading & (F.col("level") == n), F.struct("block", "content"))).over(upto))
    # A heading counts until one of a higher level comes after it.
    since = lambda n: F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(f"h{m}.block", F.lit(-1)) for m in range(1, n)))
    path = F.concat_ws(" > ", *(F.when(F.col(f"h{n}.block") > since(n), F.col(f"h{n}.content")) for n in range(1, 7)))
    placed = out.select("id", "section", path.alias("path"), F.struct("block", "type", "level", "content").alias("b"))
    return placed.groupBy("id", "section").agg(F.first("path").alias("path"), F.array_sort(F.collect_list("b")).alias("blocks"))


def chunks(df: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """Chunks of (id, title, text): id, chunk_index, content, chunk_type, character_count, token_count, start_position,
    heading_path, split_strategy. Lengths count characters. Null and empty texts give none."""
    o = options or ChunkOptions()
    mark = lambda b: F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(2))), F.lit(" "))
    shown = lambda b: F.when(b["type"] == "heading", F.concat(mark(b), b["content"])).otherwise(b["content"])
    split = F.flatten(F.transform("blocks", lambda b: F.when(b["type"] == "paragraph", paragraphs(b["content"])).otherwise(F.array(shown(b)))))
    body = F.filter("blocks", lambda b: b["type"] != "heading")
    cut = sections(blocks(df)).select("id", "section", "path", F.coalesce(F.get(body, F.lit(0))["type"], F.lit("heading")).alias("kind"), F.array_join(F.transform("blocks", shown), GAP).alias("whole"), split.alias("parts"))
    cut = cut.withColumn("fits", fits(F.col("whole"), o))
    first = cut.select("id", "section", "path", "kind", "fits", F.posexplode(F.when(F.col("fits"), F.array("whole")).otherwise(pack(F.col("parts"), o))).alias("i", "c"))
    first = first.withColumn("over", ~F.col("fits") & ~fits(F.col("c"), o))
    second = first.select("id", "section", "path", "kind", "fits", "i", "over", F.posexplode(F.when(F.col("over"), pack(sentences(F.col("c")), o)).otherwise(F.array("c"))).alias("j", "s"))
    second = second.withColumn("hard", F.col("over") & ~fits(F.col("s"), o))
    third = second.select("id", "section", "path", "kind", "fits", "i", "j", "over", "hard", F.posexplode(F.when(F.col("hard"), hard_pieces(F.col("s"), o.max_tokens)).otherwise(F.array("s"))).alias("k", "piece"))
    per_section, in_order = Window.partitionBy("id", "section"), Window.partitionBy("id", "section").orderBy("i", "j", "k")
    last_over = F.max(F.when(F.col("over"), F.struct("i", F.col("hard").cast("int").alias("hard")))).over(per_section)
    strategy = F.when(F.col("fits"), "section").when(last_over.isNull(), "paragraph").when(last_over["hard"] == 1, "hard").otherwise("sentence")
    before = F.lag("piece").over(in_order)
    third = third.withColumn("strategy", strategy).withColumn("before", before)
    tail = overlap_tail(F.col("before"), o.overlap_tokens) if o.overlap_tokens > 0 else F.lit("")
    shown_tail = let(tail, lambda t: F.when(t == "", "").otherwise(F.concat(t, F.lit(GAP))))
    text = F.when(F.col("before").isNull(), F.col("piece")).otherwise(F.concat(shown_tail, F.col("piece")))
    titled = third.withColumn("text", text).join(df.select("id", F.coalesce("title", F.lit("")).alias("title")), "id")
    header = F.concat_ws(" > ", F.when(F.col("title") != "", F.col("title")), F.when(F.col("path") != "", F.col("path")))
    content = F.when(header == "", F.col("text")).otherwise(F.concat(F.lit("["), header, F.lit("]\n"), F.col("text")))
    emitted = titled.select("id", "section", "i", "j", "k", "path", "kind", "strategy", content.alias("content"))
    counted = emitted.withColumn("tokens", token_estimate(F.col("content"))).withColumn("chars", F.length("content"))
    order = Window.partitionBy("id").orderBy("section", "i", "j", "k")
    placed = counted.withColumn("at", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    gathered = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "content", "kind", "chars", "tokens", "start", "path", "strategy"))).alias("all"))
    merged = gathered.select("id", F.posexplode(_merge_tiny(F.col("all"), o)).alias("chunk_index", "c"))
    return merged.select("id", "chunk_index", "c.content", F.col("c.kind").alias("chunk_type"), F.col("c.chars").alias("character_count"), F.col("c.tokens").alias("token_count"), F.col("c.start").alias("start_position"), F.col("c.path").alias("heading_path"), F.col("c.strategy").alias("split_strategy"))


def _merge_tiny(all_: Column, o: ChunkOptions) -> Column:
    """A small chunk joins the one before it, if both fit together and stand under the same headings."""
    shape = "struct<at: int, content: string, kind: string, chars: int, tokens: int, start: int, path: string, strategy: string>"
    start = F.struct(F.array().cast(f"array<{shape}>").alias("done"), F.lit(None).cast(shape).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        last = acc["last"]
        joins = F.coalesce((c["tokens"] < o.min_tokens) & (last["tokens"] + c["tokens"] <= o.max_tokens) & (last["chars"] + c["chars"] <= o.max_characters) & (last["path"] == c["path"]), F.lit(False))
        text = F.concat(last["content"], F.lit(GAP), c["content"])
        both = F.struct(last["at"].alias("at"), text.alias("content"), last["kind"].alias("kind"), F.length(text).alias("chars"), token_estimate(text).alias("tokens"), last["start"].alias("start"), last["path"].alias("path"), last["strategy"].alias("strategy"))
        done = F.when(joins | last.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], last))
        return F.struct(done.alias("done"), F.when(joins, both).otherwise(c).cast(shape).alias("last"))

    return F.aggregate(all_, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"])))
