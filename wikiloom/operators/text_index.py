"""A stored inverted index of texts: postings with positions, in files of whole blocks, each in order of terms.

A row of ``postings`` holds, for a term and a field, the ids of one block and the term's places in each of them; blocks are
parts of the ids by their hash, the same for all terms. ``best``, the most places that one of these ids has, bounds what the
row can add to a score: a search for the k best sums the bounds of its terms by block, scores the blocks of the highest
sums, and reads of the others only those whose sum reaches the k-th score.

Texts are shuffled once, by block, and inverted where their block is: no row for each word leaves a task, and postings are
written where they are made.

Texts that are written again, or deleted, leave what was written before as it is: each write is a segment, and ``dead`` lists
the ids that a segment no longer speaks for. ``merge`` writes one segment of all that is left. A file's rows are in order of
terms, so that a prefix reads the pages of its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.functions.lexemes import WEIGHT_A, WEIGHT_B, WEIGHT_D, lexemes, like_patterns, query_prefixes, starts_with_any
from wikiloom.operators.retrieval import CANDIDATES, CONTENT_BONUS, TITLE_BONUS
from wikiloom.plans.session import bound_arrow_batches
from wikiloom.plans.shared import shared_path, shared_table

#: Ids of a block, about.
BLOCK_IDS = 1024
#: Blocks of the highest sums that give the first k-th score.
FIRST_BLOCKS = 8
ROW_GROUP_BYTES, PAGE_BYTES = 8 << 20, 128 << 10
#: Bytes of texts that a task inverts, about; words that it holds at once, of a block or of a part of a large one.
TASK_BYTES, HELD_WORDS = 32 << 20, 1 << 20


@dataclass(frozen=True)
class TextIndex:
    """Postings at a path. ``fields``: the columns indexed, in the order of their numbers."""

    spark: SparkSession
    path: str
    id_type: str
    fields: tuple[str, ...]
    blocks: int
    segments: tuple[int, ...]
    version: int

    @property
    def postings(self) -> DataFrame:
        """(segment, term, field, block, best, entries) of the segments in use."""
        schema = f"term string, field int, block int, best int, entries array<struct<id: {self.id_type}, places: array<int>>>, segment int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("segment").isin(list(self.segments)))

    @property
    def dead(self) -> DataFrame:
        """(id, segment): what the postings of a segment no longer count for."""
        return self.spark.read.schema(f"id {self.id_type}, segment int, written int").parquet(f"{self.path}/dead").where(F.col("segment").isin(list(self.segments))).select("id", "segment")


def _inverted(block: int, batch: pa.RecordBatch, fields: int) -> Iterator[pa.RecordBatch]:
    """The postings of some texts of a block, in order of ids: columns id, block, then the lexemes of each field, then whether
    each field is empty. A record batch for each field that has any."""
    ids, before = batch.column(0), np.zeros(batch.num_rows, np.int64)
    one = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # rows that repeat an id are one text
    first = np.searchsorted(one, one)
    for n in range(fields):
        own, void = batch.column(2 + n), np.flatnonzero(batch.column(2 + fields + n).to_numpy(zero_copy_only=False))
        sizes = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = own.flatten().dictionary_encode()
        code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary.cast(pa.string())
        text = np.repeat(first, sizes)
        place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes - before, sizes) + 1
        before = before + sizes
        order = np.lexsort((place, text, code))
        code, text, place = code[order], text[order], place[order]
        entry = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])]) if len(code) else np.zeros(0, np.int64)
        term = np.searchsorted(code[entry], np.arange(len(names)))  # the first entry of each term
        count = np.diff(np.r_[entry, len(code)])
        best = np.maximum.reduceat(count, term) if len(term) else np.zeros(0, np.int64)
        of, holds = text[entry], np.r_[term, len(entry)]
        if len(void):  # the term '' of empty texts, at no place
            names, of, count = pa.concat_arrays([names, pa.array([""])]), np.r_[of, void], np.r_[count, np.zeros(len(void), np.int64)]
            best, holds = np.r_[best, 0], np.r_[holds, len(of)]
        if len(names):
            offsets = np.r_[0, np.cumsum(count)]
            starts = offsets[:-1] - np.repeat(offsets[holds[:-1]], np.diff(holds))
            ints = lambda values: pa.array(values.astype(np.int32))
            lists = lambda bounds, values: pa.ListArray.from_arrays(ints(bounds), values)
            columns = [names, ints(np.full(len(names), n)), ints(np.full(len(names), block)), ints(best), lists(holds, ids.take(pa.array(of))), lists(holds, ints(starts)), lists(holds, ints(count)), lists(offsets[holds], ints(place))]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "field", "block", "best", "ids", "starts", "sizes", "places"])


def _dealt(index: TextIndex, rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(index.blocks)).cast("int"))


def _postings(index: TextIndex, texts: DataFrame, id_col: str, tasks: int) -> DataFrame:
    """(term, field, block, best, entries) of texts. A field's places begin after those of the fields before it, as if the
    fields were one text. An empty or null text has the term '' at no place. A block of more than HELD_WORDS words has several
    rows for a term, of different ids; entries are in order of ids."""
    fields = len(index.fields)
    bound_arrow_batches(index.spark)
    named = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *(F.col(f).alias(f"f{n}") for n, f in enumerate(index.fields)))
    placed = _dealt(index, named).repartition(tasks, "block").sortWithinPartitions("block", "id")
    empty = [(F.coalesce(f"f{n}", F.lit("")) == "").alias(f"e{n}") for n in range(fields)]
    read = placed.select("id", "block", *(lexemes(F.col(f"f{n}")).alias(f"t{n}") for n in range(fields)), *empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words, now = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _inverted(now, pa.Table.from_batches(held).combine_chunks().to_batches()[0], fields)

        for batch in batches:
            blocks = batch.column(1).to_numpy()
            sizes = sum(batch.column(2 + n).value_lengths().to_numpy(zero_copy_only=False) for n in range(fields))
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for start, end in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(blocks)].tolist(), strict=True):
                if start == end:
                    continue
                own = int(sizes[start:end].sum())
                if now != blocks[start] or words + own > HELD_WORDS:
                    yield from close()
                    held, words, now = [], 0, int(blocks[start])
                held.append(batch.slice(start, end - start))
                words += own
        yield from close()

    flat = read.mapInArrow(run, f"term string, field int, block int, best int, ids array<{index.id_type}>, starts array<int>, sizes array<int>, places array<int>").sortWithinPartitions("term", "field", "block")
    entry = lambda x, i: F.struct(x.alias("id"), F.slice("places", F.get("starts", i) + 1, F.get("sizes", i)).alias("places"))
    return flat.select("term", "field", "block", "best", F.transform("ids", entry).alias("entries"))


def _tasks(index: TextIndex, size: int) -> int:
    """How many tasks invert texts of so many bytes."""
    return max(1, min(index.blocks, max(index.spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def _size(texts: DataFrame, fields: tuple[str, ...]) -> tuple[int, int]:
    """(rows, bytes of the fields)."""
    row = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in fields), F.lit(0))).alias("size")).first()
    return row["n"], row["size"] or 0


def _store(index: TextIndex, postings: DataFrame, segment: int) -> None:
    postings.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).mode("overwrite").parquet(f"{index.path}/postings/segment={segment}")


def _note(index: TextIndex) -> TextIndex:
    row = (index.id_type, list(index.fields), index.blocks, list(index.segments))
    meta = index.spark.createDataFrame([row], "id_type string, fields array<string>, blocks int, segments array<int>")
    meta.write.mode("overwrite").parquet(f"{index.path}/meta/version={index.version}")
    return index


def build(texts: DataFrame, fields: tuple[str, ...] = ("content",), id_col: str = "chunk_id", path: str | None = None) -> TextIndex:
    """Index the columns ``fields`` of texts whose ids are given and different, at ``path`` or in the shared folder. An empty
    table gives an empty index."""
    spark = texts.sparkSession
    count, size = _size(texts, fields)
    index = TextIndex(spark, path or shared_path(spark, "text-index"), texts.schema[id_col].dataType.simpleString(), tuple(fields), max(1, -(-count // BLOCK_IDS)), (1,), 1)
    spark.createDataFrame([], f"id {index.id_type}, segment int, written int").write.mode("overwrite").parquet(f"{index.path}/dead/version=0")
    _store(index, _postings(index, texts, id_col, _tasks(index, size)), 1)
    return _note(index)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    """The index at a path, as it was last written."""
    last = spark.read.parquet(f"{path}/meta").orderBy(F.col("version").desc()).first()
    return TextIndex(spark, path, last["id_type"], tuple(last["fields"]), last["blocks"], tuple(last["segments"]), last["version"])


def _bury(index: TextIndex, ids: DataFrame, segment: int) -> None:
    """Earlier segments no longer speak for these ids."""
    before = F.explode(F.array(*map(F.lit, index.segments)))
    ids.select(F.col("id").cast(index.id_type).alias("id")).where("id IS NOT NULL").distinct().select("id", before.alias("segment"), F.lit(segment).alias("written")).write.mode("overwrite").parquet(f"{index.path}/dead/version={segment}")


def upsert(index: TextIndex, texts: DataFrame, id_col: str = "chunk_id") -> TextIndex:
    """Texts, new or written again, as a segment of their own. A write that breaks off changes nothing that is seen: the
    version that says so is written last."""
    new = max(index.segments) + 1
    _store(index, _postings(index, texts, id_col, _tasks(index, _size(texts, index.fields)[1])), new)
    _bury(index, texts.select(F.col(id_col).alias("id")), new)
    return _note(replace(index, segments=(*index.segments, new), version=index.version + 1))


def delete(index: TextIndex, ids: DataFrame, id_col: str = "chunk_id") -> TextIndex:
    """An index without these ids: an empty segment that takes their place."""
    new = max(index.segments) + 1
    _bury(index, ids.select(F.col(id_col).alias("id")), new)
    return _note(replace(index, segments=(*index.segments, new), version=index.version + 1))


def merge(index: TextIndex) -> TextIndex:
    """One segment of all that counts."""
    new = max(index.segments) + 1
    rows = _dealt(index, live(index, F.lit(True))).repartition("block")
    merged = rows.groupBy("term", "field", "block").agg(F.max(F.size("places")).alias("best"), F.array_sort(F.collect_list(F.struct("id", "places"))).alias("entries"))
    _store(index, merged.sortWithinPartitions("term", "field", "block"), new)
    return _note(replace(index, segments=(new,), version=index.version + 1))


def live(index: TextIndex, wanted: Column, blocks: DataFrame | None = None) -> DataFrame:
    """(id, term, field, places) of the terms for which ``wanted`` holds, without what is dead; ``blocks``: of these only."""
    found = index.postings.where(wanted)
    if blocks is not None:
        found = found.join(blocks, "block", "left_semi")
    rows = found.select("segment", "term", "field", F.inline("entries"))
    if len(index.segments) > 1:
        rows = rows.join(index.dead, ["id", "segment"], "left_anti")
    return rows.select("id", "term", "field", "places")


def _scored(index: TextIndex, wanted: Column, score: Column, bound: Column, extra: float, k: int | None) -> DataFrame:
    """(id, score) of the k best: ``score`` over the rows of an id, null where it isn't found; ``bound`` over the rows of a
    block; ``extra``: what a score can have beside."""
    best = lambda rows: rows.groupBy("id").agg(score.alias("score")).where("score IS NOT NULL").orderBy(F.col("score").desc(), "id")
    if k is None:
        return best(live(index, wanted))
    sums = shared_table(index.postings.where(wanted).groupBy("segment", "block").agg(bound.alias("most")).groupBy("block").agg(F.sum("most").alias("most")), "block-bounds")
    first = sums.orderBy(F.col("most").desc(), "block").limit(FIRST_BLOCKS)
    found = best(live(index, wanted, first)).limit(k).collect()  # k rows
    if len(found) < k:
        return best(live(index, wanted)).limit(k)
    reach = sums.where(F.col("most") + extra >= found[-1]["score"])
    return best(live(index, wanted, reach)).limit(k)


def lexical_top_k(index: TextIndex, question: str, id_col: str = "chunk_id", k: int | None = CANDIDATES) -> DataFrame:
    """retrieval.lexical_top_k from an index of one field."""
    wanted = starts_with_any(F.col("term"), query_prefixes(question))
    hits = F.sum(F.size("places"))
    return _scored(index, wanted, hits * F.lit(WEIGHT_D), F.sum("best") * F.lit(WEIGHT_D), 0.0, k).withColumnRenamed("id", id_col)


def _holds(patterns: list[str]) -> Column:
    """Whether a term holds one of some substring patterns: a substring of letters and digits stands within a lexeme."""
    parts = [p.strip("%") for p in patterns]
    return reduce(lambda a, b: a | b, (F.col("term").contains(p) for p in parts if p), F.lit(False))


def weighted_top_k(index: TextIndex, question: str, id_col: str = "page_id", k: int | None = CANDIDATES) -> DataFrame:
    """retrieval.weighted_top_k from an index of title and content: hits of prefixes, bonuses for substrings of lexemes."""
    wide, focus = like_patterns(question)
    starts, inside, title = starts_with_any(F.col("term"), query_prefixes(question)), _holds(focus), F.col("field") == 0
    places = F.size("places")
    count = lambda test: F.sum(F.when(test, places).otherwise(0))
    some = lambda test: F.max(F.when(test, 1).otherwise(0)) == 1
    hits = count(starts & title) * F.lit(WEIGHT_A) + count(starts & ~title) * F.lit(WEIGHT_B)
    bonus = F.when(some(inside & title), TITLE_BONUS).otherwise(0.0) + F.when(some(inside & ~title), CONTENT_BONUS).otherwise(0.0)
    matches = starts | (_holds(wide) if any(wide) else F.col("term") == "")  # without a long term, what is empty matches
    found = some(matches)
    bound = F.sum(F.when(starts, F.col("best") * F.when(title, F.lit(WEIGHT_A)).otherwise(F.lit(WEIGHT_B))).otherwise(0.0))
    return _scored(index, matches | inside, F.when(found, hits + bonus), bound, TITLE_BONUS + CONTENT_BONUS, k).withColumnRenamed("id", id_col)
