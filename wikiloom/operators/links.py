"""Links between pages: read from markup, resolved against the pages, followed by one hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.functions.text import strip


def hrefs(html: Column) -> Column:
    """The addresses of a page's links, trimmed, without empty ones."""
    found = F.regexp_extract_all(html, F.lit("(?is)<a\\b[^>]*?\\shref\\s*=\\s*[\"']([^\"']*)[\"']"), 1)
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), strip), lambda h: h != "")


def linked_ids(html: Column) -> Column:
    """Ids of linked pages, each once, in order: from the path, or else from the query of an address."""
    by_path = lambda h: F.regexp_extract(h, "(?i)/pages/(\\d+)", 1)
    by_query = lambda h: F.regexp_extract(h, "(?i)[?&]pageId=(\\d+)", 1)
    return F.array_distinct(F.filter(F.transform(hrefs(html), lambda h: F.when(by_path(h) != "", by_path(h)).otherwise(by_query(h))), lambda i: i != ""))


def linked_titles(html: Column, default_space: Column) -> Column:
    """struct(space, title) of pages that are linked by title, each (space, lower title) once, the first spelling."""
    tags = F.coalesce(F.regexp_extract_all(html, F.lit("(?is)<ri:page\\b([^>]*)>"), 1), F.array().cast("array<string>"))

    def parse(tag: Column) -> Column:
        space = strip(F.regexp_extract(tag, "(?i)ri:space-key\\s*=\\s*\"([^\"]*)\"", 1))
        return F.struct(F.when(space == "", default_space).otherwise(space).alias("space"), strip(F.regexp_extract(tag, "(?i)ri:content-title\\s*=\\s*\"([^\"]*)\"", 1)).alias("title"))

    named = F.filter(F.transform(tags, parse), lambda r: r["title"] != "")
    key = lambda r: F.concat(r["space"], F.lit("::"), F.lower(r["title"]))
    keys = F.transform(named, key)
    return F.filter(named, lambda r, i: F.array_position(keys, key(r)) == i + 1)


def resolve_titles(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_id, page_id) for references (source_id, space, title): the first page of that space and title."""
    wanted = refs.select("source_id", "space", F.lower("title").alias("key"))
    known = pages.select(F.col("space"), F.lower("title").alias("key"), "page_id").groupBy("space", "key").agg(F.min("page_id").alias("page_id"))
    return wanted.join(known, ["space", "key"]).select("source_id", "page_id").distinct()


def expand_one_hop(seed: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """The seed pages and those they link to, each once; a linked page that is a seed counts as the seed."""
    first = seed.select("page_id").distinct().withColumn("hop", F.lit(0))
    linked = edges.join(first.select(F.col("page_id").alias("source_id")), "source_id", "left_semi").select("page_id").distinct().withColumn("hop", F.lit(1))
    reached = first.unionByName(linked).groupBy("page_id").agg(F.min("hop").alias("hop"))
    return reached.join(pages, "page_id")
