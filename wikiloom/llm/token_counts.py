"""Token counts (operator 1): lengths only, by batch encoding in an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.pieces import piece_encoder

#: A slice of an Arrow batch holds about so many bytes of text.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about equal bytes in ``column``; one longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Count the tokens of every whole text.

    path: a ``tokenizers`` file. Returns id_col, n_bytes, n_tokens and over_limit (n_tokens > limit), one row for each
    row of ``df``. A null text counts as empty: 0 bytes, 0 tokens. Rows with a null or repeated id stay, each with its
    own counts; an empty table gives no rows; other columns of ``df`` are not read, whatever their names.
    """
    kind = df.schema[id_col].dataType
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for whole in batches:
            for batch in slices(whole, 1):
                n = np.diff(encoder.encode_column(batch.column(1))[1], prepend=0) // 4
                size = pc.fill_null(pc.binary_length(batch.column(1)), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), size.cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return source.mapInArrow(count, f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
