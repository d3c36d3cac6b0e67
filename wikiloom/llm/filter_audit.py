"""Filter interaction audit (operator 12): what each filter removes, in every order of the filters.

Duplicates are found by sorting: documents are dealt over ranges of their text's fingerprint and doc_id, and sorted in each
range by fingerprint, full text and doc_id. One pass compares every row with its predecessor, so a text's other filters are
read once for all its copies. A group of copies may go on over the bounds of ranges: the rows that lead such a group in
their range stay open, carry their text, and are settled by the least doc_id among the open rows of that text.

Ranges are cut by fingerprint and doc_id without the text, as Spark's sample of the keys goes through the driver. Texts
with one fingerprint may then alternate at the bounds; so every text with a range's first or last fingerprint counts as
one that may go on.

What a row fails is a mask of five bits. Counts of rows by part and mask are additive; all 120 orders and their steps
follow from the 32 counts of a part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.token_counts import slices
from wikiloom.plans.session import bound_arrow_batches
from wikiloom.plans.shared import shared_table

FILTERS = "ABCDE"
SHORT, MANY_REPEATS, SHOUTING, SIGNS, COPY = (1 << i for i in range(5))
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 50, 65, 5
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGN_BYTES = b"#$%&*|"


def text_mask(text: str) -> int:
    """The filters A to D that a text fails. Words are runs of bytes other than the six ASCII blanks, as bytes.split has
    them."""
    raw = text.encode()
    words = raw.split()
    mask = SHORT if len(words) < LEAST_WORDS else 0
    if 100 * len(set(words)) < DISTINCT_SHARE * len(words):
        mask |= MANY_REPEATS
    if 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_SHARE * len(text):
        mask |= SHOUTING
    if len(raw.translate(None, SIGN_BYTES)) < len(raw):
        mask |= SIGNS
    return mask


@dataclass
class Group:
    """The copies of a text in one range: their mask, the least id, and its rows by part."""

    text: str
    mask: int
    least: int | None
    leaders: dict[str, int] = field(default_factory=dict)


def marked(rows: Iterator[tuple[int, str, int | None, str]]) -> Iterator[tuple[int | None, str, int, int, int | None, str | None]]:
    """(doc_id, part, mask, rows, fingerprint, text) of one range's sorted (fingerprint, text, doc_id, part).

    Rows after the first of their text in this range fail E for certain. Those of the least id are held until the
    fingerprint changes; with the range's first or last fingerprint they are open, and have fingerprint and text.
    A row without a doc_id is neither smaller nor larger than another, so that it never fails E.
    """
    held: list[Group] = []
    first = now = None

    def leave(is_open: bool) -> Iterator[tuple]:
        for g in held:
            for part, n in g.leaders.items():
                yield g.least, part, g.mask, n, *((now, g.text) if is_open else (None, None))

    for fingerprint, text, doc_id, part in rows:
        if now is None:
            first = now = fingerprint
        elif fingerprint != now:
            yield from leave(now == first)
            held.clear()
            now = fingerprint
        if not held or held[-1].text != text:
            held.append(Group(text, text_mask(text), doc_id))
        group = held[-1]
        if doc_id is None and group.least is not None:
            yield None, part, group.mask, 1, None, None
        elif doc_id == group.least:
            group.leaders[part] = group.leaders.get(part, 0) + 1
        else:
            yield doc_id, part, group.mask | COPY, 1, None, None
    yield from leave(True)


def failure_masks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail which filters, bit i for the i-th of ABCDE.

    Null texts are empty texts, null parts the empty string; rows without an id can't be copies of another; repeated rows
    count each, and as they have no smaller id among them aren't copies of each other. Other columns aren't read.
    """
    spark = documents.sparkSession
    bound_arrow_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = documents.select(F.xxhash64(text).alias("f"), text.alias("t"), F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("p"))
    ranged = keyed.repartitionByRange("f", F.col("i").asc_nulls_last()).sortWithinPartitions("f", "t", F.col("i").asc_nulls_last())
    names = ["doc_id", "part", "mask", "n", "f", "t"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for whole in batches for b in slices(whole, 1) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = marked(rows)
        while some := list(itertools.islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)

    passed = shared_table(ranged.mapInArrow(run, "doc_id long, part string, mask int, n long, f long, t string"), "filter-masks")
    settled = passed.where("f IS NULL").select(*names[:4])
    leading = passed.where("f IS NOT NULL")
    least = leading.groupBy("f", "t").agg(F.min("doc_id").alias("least"))
    closed = leading.join(least, ["f", "t"]).withColumn("mask", F.when(F.col("doc_id") > F.col("least"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")))
    return settled.unionByName(closed.select(*names[:4]))


def counters(masks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): rows, those of quality 1 and those that are toxic, by labels (doc_id, quality, toxic).

    An id with several labels is good, or toxic, if one of them says so. Labels without an id, and ids without a label,
    count nowhere. Rows are summed by id before they meet the labels.
    """
    plain = masks.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    if labels is not None:
        one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
        known = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic"))
        none = masks.where("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)})
        each = masks.where("doc_id IS NOT NULL").groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(known, "doc_id", "left")
        plain = each.select("doc_id", "part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).unionByName(none)
    return plain.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def steps_of_masks(spark) -> DataFrame:
    """For each order, step and mask (120 x 5 x 32 rows, whatever the data): which counts a row of that mask adds to."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, own in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, 1 << own, sum(1 << i for i in order[: step - 1])))
    steps = spark.createDataFrame(rows, "filter_order string, step int, own int, before int").coalesce(1)
    mask = F.col("mask")
    fails, earlier = mask.bitwiseAND(F.col("own")) != 0, mask.bitwiseAND(F.col("before")) != 0
    return steps.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(31)))).select(
        "filter_order", "step", "mask",
        (~fails & ~earlier).alias("stays"), (fails & ~earlier).alias("goes"), (fails & earlier).alias("again"), (mask == F.col("own")).alias("alone"),
        F.when(fails, (F.lit(120) / F.bit_count(mask)).cast("long")).otherwise(F.lit(0)).alias("turns"),
    )


def audit(documents: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step of it: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.

    A filter's removals summed over all orders (shapley) are those of each mask, divided evenly among the filters it
    fails: of 120 orders each of them comes first in 120 / bits. An empty table gives no rows; for nulls and repeated rows
    see failure_masks and counters.
    """
    counts = counters(failure_masks(documents, id_col, text_col, part_col), labels)
    every = counts.join(F.broadcast(steps_of_masks(documents.sparkSession)), "mask")
    total = lambda flag, count="n": F.sum(F.when(F.col(flag), F.col(count)).otherwise(0)).alias
    return every.groupBy("part", "filter_order", "step").agg(
        total("stays")("kept"), total("goes")("removed"), total("again")("redundant"), total("alone")("unique_fails"),
        total("goes", "good")("good_lost"), total("goes", "toxic")("toxic_lost"), F.sum(F.col("n") * F.col("turns")).alias("shapley"),
    )
