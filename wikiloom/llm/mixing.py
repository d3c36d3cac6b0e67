"""Mixing sources to target weights (operator 8): pivotal dependent rounding of fractional copies.

A source's target over its size is the number of copies each of its documents should get; its whole part is given to
all, the fraction is settled by pivotal rounding: two documents exchange expected words, in a random direction chosen
so that the expectation of both stays, until one of them has 0 or 1 further copy; the other meets the next document.
The exchange keeps the source's expected words exactly. Buckets of documents settle on their own and leave one
unsettled document for each source; those meet in a tree of groups until one is left for each source, of which the
remaining words are taken as a partial copy. All random numbers are hashes of the row's values: reruns agree, however
the input is partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.plans.shared import shared_table

WORD = "[^\\x20\\x09-\\x0D]+"
BUCKET_ROWS = 8192
FAN_IN = 64
KEYS = ["id", "source", "size", "fingerprint"]


def word_count(text: Column) -> Column:
    """Number of words of a text, null as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), max_repeat: float = 2.0) -> DataFrame:
    """Targets for (source, source_size), one row a source.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all sizes. A target stops
    at max_repeat times its source's size and the excess goes to the others by weight: the level, words for each unit
    of weight, at which the capped ones are those whose cap lies below it, comes from running sums in order of cap by
    weight. These windows see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = totals.withColumn("weight", weight.cast("double")).withColumn("cap", max_repeat * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - below) / above
    leveled = capped.withColumn("level", level)
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap")))
    return leveled.select("source", "source_size", target.alias("target"))


def settle(sizes: np.ndarray, probs: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pivotal rounding in the order given: each one's 0 or 1 (-1: unsettled, one at most), and the probabilities left."""
    extra = np.full(len(sizes), -1, np.int64)
    p = probs.astype(float).tolist()
    a = sizes.astype(float).tolist()
    u = draws.tolist()
    held = -1
    for i in range(len(p)):
        if a[i] == 0:  # no words to exchange
            extra[i] = u[i] < p[i]
            continue
        if p[i] <= 0 or p[i] >= 1:
            extra[i] = p[i] >= 1
            continue
        if held < 0:
            held = i
            continue
        j = held
        to_j = min(a[j] * (1 - p[j]), a[i] * p[i])
        to_i = min(a[i] * (1 - p[i]), a[j] * p[j])
        moved = to_j if u[i] * (to_i + to_j) < to_i else -to_i
        p[j] += moved / a[j]
        p[i] -= moved / a[i]
        for k in (i, j):
            if p[k] < 1e-9 or p[k] > 1 - 1e-9:
                extra[k] = p[k] > 0.5
        held = j if extra[j] < 0 else i if extra[i] < 0 else -1
    return extra, np.asarray(p)


def _round(items: DataFrame, by: list[Column]) -> DataFrame:
    """Settle the items of each group, source by source."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "id", "size", "fingerprint"], na_position="last").reset_index(drop=True)
        pdf["extra"] = -1
        for rows in pdf.groupby("source", dropna=False, sort=False).indices.values():
            extra, left = settle(pdf["size"].to_numpy()[rows], pdf["prob"].to_numpy()[rows], pdf["draw"].to_numpy()[rows])
            pdf.loc[rows, "extra"] = extra
            pdf.loc[rows, "prob"] = left
        return pdf

    return items.groupBy(*by).applyInPandas(run, items.withColumn("extra", F.lit(0).cast("long")).schema)


def row_mark(df: DataFrame) -> Column:
    """A hash of all columns of a row."""
    own = [F.col(f"`{c}`") for c in df.columns]
    plain = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(own, df.schema, strict=True)]
    return F.xxhash64(*plain, *(c.isNull() for c in own))


def _counted(df: DataFrame, id_col: str, text_col: str, source_col: str, fingerprint: bool) -> DataFrame:
    text = F.col(text_col).cast("string")
    mark = row_mark(df) if fingerprint else F.lit(0).cast("long")
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), mark.alias("fingerprint"))


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), max_repeat: float = 2.0, seed: int = 8, fingerprint: bool = False) -> DataFrame:
    """For each set of rows with equal (id, source, size), with ``fingerprint`` equal in all columns: n rows, whole copies for all, ``more`` of them get one more,
    and the next one ``partial`` words; with the source's size and target."""
    spark = df.sparkSession
    rows = shared_table(_counted(df, id_col, text_col, source_col, fingerprint).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = shared_table(source_targets(totals, share, weights, max_repeat), "mix-targets")
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("id", "source", "size", "fingerprint", F.lit(seed))
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) * F.lit(2.0**-53)
    named = targets.withColumnRenamed("source", "named")
    wanted = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named").withColumn("whole", F.floor(rate + 1e-12)).withColumn("share", F.greatest(F.lit(0.0), rate - F.col("whole")) * F.col("n"))
    items = wanted.withColumn("more", F.floor("share")).withColumn("prob", F.col("share") - F.col("more")).drop("share").withColumn("draw", draw).withColumn("bucket", F.pmod(key, F.lit(buckets)))
    done = shared_table(_round(items, [F.col("bucket")]), "mix-settled")
    settled = [done.where("extra >= 0")]
    left = done.where("extra < 0").drop("extra")
    while buckets > 1:
        buckets = math.ceil(buckets / FAN_IN)
        level = left.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).withColumn("draw", F.shiftrightunsigned(F.xxhash64("draw", F.lit(buckets)), 11) * F.lit(2.0**-53))
        done = shared_table(_round(level, [F.col("source"), F.col("bucket")]), "mix-settled")
        settled.append(done.where("extra >= 0"))
        left = done.where("extra < 0").drop("extra")
    last = left.withColumn("partial", F.floor(F.col("prob") * F.col("size") + 0.5)).withColumn("extra", F.lit(0).cast("long"))
    out = last
    for part in settled:
        out = out.unionByName(part.withColumn("partial", F.lit(0).cast("long")))
    return out.select(*KEYS, "n", "source_size", "target", F.col("whole").cast("long").alias("whole"), (F.col("more") + F.col("extra")).cast("long").alias("more"), F.col("partial").cast("long").alias("partial"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """How many words of each row the mix takes: id_col, source, size, source_size, target, copies, partial_words, taken.

    A null text has size 0 and gives no words; rows with a null id or source take part (null is a source of its own,
    last in order); of repeated rows each gets its own copies, as even as can be; an empty table gives no rows. Extra
    columns are not read. A source's taken words differ from its target by rounding to whole words only.
    """
    sets = copies(df, id_col, text_col, source_col, **settings)
    each = sets.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    number = F.col("whole") + (F.col("row") < F.col("more")).cast("long")
    rest = F.when(F.col("row") == F.col("more"), F.col("partial")).otherwise(F.lit(0).cast("long"))
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", number.alias("copies"), rest.alias("partial_words"), (number * F.col("size") + rest).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8, **settings) -> DataFrame:
    """The rows of the mix, with the columns of ``df``: each row, whole, as often as it is taken.

    The one document of a source that is left with a part of a copy is taken once more, or not, by a draw of that
    probability: so a source's words miss its target by less than that document's. Rows that are equal in all columns
    share their copies; nulls and repeats count as in ``mix``; an empty table gives no rows. Columns of any name pass as
    they are.
    """
    sets = copies(df, id_col, text_col, source_col, seed=seed, fingerprint=True, **settings)
    draw = F.shiftrightunsigned(F.xxhash64(*KEYS, F.lit(seed + 1)), 11) * F.lit(2.0**-53)
    last = (draw * F.col("size") < F.col("partial")).cast("long")
    taken = sets.select(F.struct(*KEYS).alias("key"), "n", (F.col("n") * F.col("whole") + F.col("more") + last).cast("int").alias("taken")).where("taken > 0")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    text = F.col(text_col).cast("string")
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), row_mark(df).alias("fingerprint"))
    joined = df.select(row.alias("row"), key.alias("key")).join(taken, "key")
    out = joined.where("n = 1").select("row", "taken")
    if not sets.where("n > 1").isEmpty():  # of equal rows one stands for all
        out = out.unionByName(joined.where("n > 1").groupBy("key").agg(F.first("row").alias("row"), F.first("taken").alias("taken")).select("row", "taken"))
    return out.select("row", F.explode(F.sequence(F.lit(1), "taken"))).select("row.*")
