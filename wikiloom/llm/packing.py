"""Packing (operator 2): vector bin packing of examples into training sequences.

An example takes up several resources of a sequence at once: tokens, one of the allowed segments, and loss-bearing
tokens. Bins are filled one at a time: of the examples that fit, the one with the largest dot product of its (relative)
sizes with the bin's (relative) free room goes in, until none fits. Examples are dealt over tasks evenly; a task works
through them in blocks of bounded size, and the examples of bins left loose go on to the next block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.pieces import piece_encoder
from wikiloom.llm.token_counts import slices
from wikiloom.plans.shared import shared_table

SEQUENCE = 2048
SEGMENTS = 256
#: Loss-bearing tokens of a sequence of instruction data.
INSTRUCTION_LOSS = 1536
#: Examples that a task places against each other at once.
BLOCK = 4096
#: A bin with at least this share of its tokens filled is not opened again.
TIGHT = 0.97
END_OF_TEXT = 1

PIECES = "start long, length long, ids_crc32 long, doc_tokens long, loss long"


def document_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Cut the ids of each document (its text's ids, then END_OF_TEXT) into pieces of ``size`` and a rest.

    A null text counts as empty and gives the one id END_OF_TEXT. loss: the ids of a piece that follow another one in
    it. deal: evenly spread numbers, by which pieces can be dealt over tasks whatever their ids.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "loss", "deal"]
    end = np.asarray([END_OF_TEXT], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        row = TaskContext.get().partitionId() * 0x9E3779B1
        for whole in batches:
            for batch in slices(whole, 1):
                out: list[list] = [[] for _ in names]
                take = []
                encoded, ends = encoder.encode_column(batch.column(1))
                for i, (first, last) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
                    ids = encoded[first:last].tobytes() + end
                    for start in range(0, len(ids), 4 * size):
                        part = ids[start : start + 4 * size]
                        n = len(part) // 4
                        row += 1
                        take.append(i)
                        for column, x in zip(out[1:], (start // 4, n, zlib.crc32(part), len(ids) // 4, n - 1, row), strict=True):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), *(pa.array(c, pa.int64()) for c in out[1:])], names=names)

    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return source.mapInArrow(cut, f"`{id_col}` {kind}, {PIECES}, deal long")


def fill_bins(sizes: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place every row of ``sizes`` (n x d, each within ``caps``) in a bin; the bins' numbers and the place inside."""
    n = len(sizes)
    relative = sizes / caps
    bins, place = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    full = (sizes[:, :-1] >= caps[:-1]).any(axis=1)  # nothing can join these
    bins[full] = np.arange(full.sum())
    left = np.flatnonzero(~full)
    current = int(full.sum())
    while len(left):
        room, at = np.ones(len(caps)), 0
        inside = sizes[left]
        free = caps.astype(np.int64).copy()
        alive = relative[left]
        open_ = np.ones(len(left), bool)
        while True:
            fits = open_ & (inside <= free).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, alive @ room, -1.0)
            best = int(score.argmax())
            bins[left[best]], place[left[best]] = current, at
            open_[best] = False
            at += 1
            free -= inside[best]
            room = free / caps
            if not free.all():
                break
        left = left[open_]
        current += 1
    return bins, place


def pack(examples: DataFrame, caps: dict[str, int], length_col: str, max_segments: int = SEGMENTS, deal_col: str = "deal") -> DataFrame:
    """Pack examples into sequences: adds sequence_id and offset to the columns of ``examples`` (without deal_col).

    caps: the limits by name of the columns that hold an example's use of each; length_col: the one that counts
    tokens. Null uses count as 0; an example beyond a limit gets a sequence of its own. deal_col deals the examples
    over tasks; equal examples are told apart by it alone, so repeated rows are packed one by one. An empty table
    gives no rows.
    """
    uses = list(caps)
    limits = np.asarray([*caps.values(), max_segments], dtype=np.int64)
    tokens = uses.index(length_col)
    kept = [c for c in examples.columns if c != deal_col]
    schema = ", ".join(f"`{c}` {examples.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []
        waiting = 0

        def emit(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            nonlocal number
            sizes = np.column_stack([rows[c].fillna(0).to_numpy(np.int64) for c in uses] + [np.ones(len(rows), np.int64)])
            bins, place = fill_bins(np.minimum(sizes, limits), limits)
            filled = np.bincount(bins, weights=sizes[:, tokens])
            ready = np.ones(len(rows), bool) if last else (filled >= TIGHT * limits[tokens])[bins]
            done = rows[ready].copy()
            order = np.lexsort((place[ready], bins[ready]))
            done, b, n = done.iloc[order], bins[ready][order], sizes[ready, tokens][order]
            before = np.cumsum(n) - n
            first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
            group = np.cumsum(first) - 1
            done["offset"] = before - before[first][group] if len(b) else before
            done["sequence_id"] = number + group
            number += int(first.sum())
            return done[[*kept, "sequence_id", "offset"]], rows[~ready]

        for pdf in batches:
            for start in range(0, len(pdf), BLOCK):
                held.append(pdf.iloc[start : start + BLOCK])
                waiting += len(held[-1])
                if waiting >= BLOCK:
                    done, rest = emit(pd.concat(held), False)
                    if len(done):
                        yield done
                    if len(rest) >= BLOCK:  # nothing closes tightly; loose bins must go
                        done, rest = emit(rest, True)
                        yield done
                    held, waiting = [rest], len(rest)
        if waiting:
            yield emit(pd.concat(held), True)[0]

    dealt = examples.repartition(F.xxhash64(deal_col)).sortWithinPartitions(F.xxhash64(deal_col), deal_col)
    return dealt.mapInPandas(run, schema)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE, max_segments: int = SEGMENTS) -> DataFrame:
    """Tokenize, cut and pack whole documents. Nulls, repeats and empty tables: as in the two steps."""
    pieces = document_pieces(df, path, id_col, text_col, size)
    return pack(pieces, {"length": size, "loss": size}, "length", max_segments).drop("loss")


def conversation_examples(turns: DataFrame, path: str, size: int, max_loss: int, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Instruction examples of a table (conv_id, turn, role, text): conv_id, part, length (tokens) and loss (tokens of turns of
    ``roles``), within both limits.

    A conversation within the limits is one example, part 0. Another is cut into parts: runs of its turns in order, and
    turns of more than a quarter of the smaller limit may be cut inside, at multiples of it. A null text is empty, a null
    role bears no loss; every turn ends with END_OF_TEXT. A null conv_id is a conversation; repeated turns count each,
    null turns come first; an empty table gives no rows; other columns are not read.
    """
    cut = max(1, min(size, max_loss) // 4)
    pieces = document_pieces(turns.select(F.struct("conv_id", "role", "turn").alias("key"), "text"), path, "key", "text", cut)
    loss = F.when(F.col("key.role").isin(*roles), F.col("length")).otherwise(0)
    counted = shared_table(pieces.select(F.col("key.conv_id").alias("conv_id"), F.col("key.turn").alias("turn"), "length", loss.alias("loss"), "deal"), "turn-pieces")
    summed = counted.groupBy("conv_id").agg(F.sum("length").alias("length"), F.sum("loss").alias("loss"))
    fits = (F.col("length") <= size) & (F.col("loss") <= max_loss)
    whole = summed.where(fits).select("conv_id", F.lit(0).alias("part"), "length", "loss")
    long = summed.where(~fits).select(F.col("conv_id").alias("long_id"))
    before = Window.partitionBy("conv_id").orderBy("turn", "deal").rowsBetween(Window.unboundedPreceding, -1)
    # What starts in one stretch of size - cut tokens ends within size: and so for loss.
    at = lambda c, limit: F.floor(F.coalesce(F.sum(c).over(before), F.lit(0)) / (limit - cut))
    placed = counted.join(long, F.col("conv_id").eqNullSafe(F.col("long_id"))).select("conv_id", "length", "loss", F.struct(at("length", size), at("loss", max_loss)).alias("at"))
    runs = placed.groupBy("conv_id", "at").agg(F.sum("length").alias("length"), F.sum("loss").alias("loss"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("at")) - 1
    parts = runs.select("conv_id", number.alias("part"), "length", "loss")
    return whole.unionByName(parts).withColumn("deal", F.xxhash64("conv_id", "part"))


def pack_conversations(turns: DataFrame, path: str, size: int = SEQUENCE, max_loss: int = INSTRUCTION_LOSS, max_segments: int = SEGMENTS) -> DataFrame:
    """Pack conversations under all three limits: conv_id, part, length, loss, sequence_id, offset. Every sequence keeps
    them; for conversations beyond a limit, nulls and repeats see conversation_examples."""
    return pack(conversation_examples(turns, path, size, max_loss), {"length": size, "loss": max_loss}, "length", max_segments)
