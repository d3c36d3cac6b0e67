"""Exact top-k by inner product (operator 10) on a bit-sliced index.

Each attribute (vector component, quantised to an integer) is stored as bit slices: one bitmap over the rows of a block
for each binary digit. A query's scores are added up slice by slice with bitmap arithmetic (AND, XOR, OR on 64 rows at
a time, carries and all), for all queries of a block at once; a negative weight takes the complement of the slices.
The top rows are then selected from the most significant slice of the sums downward; rows that tie at the boundary
are resolved exactly, by smaller id.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.blocks import best_of_pairs, index_blocks, query_blocks, usable

SCALE = 1024
#: Integers of smaller size are kept as 64-bit numbers, larger ones as Python's.
SMALL = 1 << 62


def quantise(matrix: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as integers, whatever their size."""
    values = np.floor(scale * matrix)
    if values.size and np.abs(values).max() >= SMALL:
        return np.array([[int(x) for x in row] for row in values], dtype=object)
    return values.astype(np.int64)


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Zeros and ones, padded to whole words, as 64-bit words."""
    return np.packbits(np.pad(bits.astype(np.uint8), (0, -len(bits) % 64)), bitorder="little").view(np.uint64)


def build_slices(ids: np.ndarray, matrix: np.ndarray, scale: int = SCALE) -> bytes:
    """The bit-sliced form of a block: ids in order, the least value of each attribute, and the slices above it."""
    values = quantise(matrix, scale)
    low = values.min(axis=0)
    above = values - low  # below 2**63, or Python's integers
    digits = np.array([int(x).bit_length() for x in above.max(axis=0)])
    slices = [bitmap((above[:, d] >> j) & 1) for d, n in enumerate(digits) for j in range(n)]
    out = io.BytesIO()
    low_bytes = np.array([str(x) for x in low])  # any size
    np.savez(out, ids=ids, low=low_bytes, digits=digits, slices=np.array(slices, np.uint64).reshape(len(slices), -(-len(ids) // 64)))
    return out.getvalue()


def _add(total: list[np.ndarray], slices: list[np.ndarray], shift: int) -> None:
    """total += slices << shift, by full adders on bitmaps; total grows as carries need."""
    carry = None
    at = shift
    for x in slices:
        while len(total) <= at:
            total.append(np.zeros_like(x))
        t = total[at]
        if carry is None:
            total[at], carry = t ^ x, t & x
        else:
            half = t ^ x
            total[at], carry = half ^ carry, (t & x) | (half & carry)
        at += 1
    while carry is not None and carry.any():
        if len(total) <= at:
            total.append(carry)
            return
        t = total[at]
        total[at], carry = t ^ carry, t & carry
        at += 1


def best_in_block(body: bytes, ids: np.ndarray, matrix: np.ndarray, k: int, scale: int = SCALE) -> list[tuple[int, int, int]]:
    """The k best rows of the block for each query: (query, row's id, score)."""
    held = np.load(io.BytesIO(body))
    rows, low, digits, slices = held["ids"], [int(x) for x in held["low"]], held["digits"], held["slices"]
    weights = quantise(matrix, scale)
    size, negative = np.abs(weights), weights < 0
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    total: list[np.ndarray] = []
    at = 0
    for d, n in enumerate(digits):
        if n:
            flip = np.where(negative[:, d], every, np.uint64(0))[:, None]
            own = [slices[at + j][None, :] ^ flip for j in range(n)]
            for bit in range(int(size[:, d].max()).bit_length()):
                on = np.where(((size[:, d] >> bit) & 1).astype(bool), every, np.uint64(0))[:, None]
                if on.any():
                    _add(total, [x & on for x in own], bit)
            at += n
    # A negative weight took the complement: what the slices' sum lacks or has too much is the same for all rows.
    full = [(1 << int(n)) - 1 for n in digits]
    base = [sum(w * x - (abs(w) * t if w < 0 else 0) for w, x, t in zip(own, low, full, strict=True)) for own in weights.tolist()]
    words = -(-len(rows) // 64)
    here = np.tile(bitmap(np.ones(len(rows))), (len(ids), 1))
    for q, own_id in enumerate(ids):  # a query's own rows take no part
        for r in range(*np.searchsorted(rows, [own_id, own_id + 1])):
            here[q, r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
    sure, maybe = np.zeros((len(ids), words), np.uint64), here
    for s in reversed(total):
        both = maybe & s
        count = np.bitwise_count(sure | both).sum(axis=1)
        sure = np.where((count < k)[:, None], sure | both, sure)
        maybe = np.where((count >= k)[:, None], both, maybe & ~s)
    out = []
    for q, own_id in enumerate(ids):
        unpack = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        first = unpack(sure[q])
        tied = unpack(maybe[q])[: k - len(first)]  # rows are in order of id
        chosen = np.r_[first, tied]
        bits = np.array([(s[q, chosen // 64] >> (chosen % 64).astype(np.uint64)) & np.uint64(1) for s in total], np.uint8).reshape(len(total), len(chosen))
        for r, digits_of in zip(chosen, np.packbits(bits, axis=0, bitorder="little").T, strict=True):
            score = base[q] + int.from_bytes(digits_of.tobytes(), "little")
            if not -(1 << 63) <= score < 1 << 63:
                raise OverflowError(f"the score of query {own_id} and vector {rows[r]} is beyond 64 bits: {score}")
            out.append((int(own_id), int(rows[r]), score))
    return out


def exact_top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = SCALE) -> DataFrame:
    """The k rows with the highest integer inner product for each query: query_id, rank, vec_id, score.

    Queries: rows whose id is divisible by ``every``; candidates: all rows with another id. Components are
    floor(scale * x), of any size; sums are exact, and a best score beyond 64 bits is an error. Rows with a null id, or
    a vector that is null, empty or holds components that are null, or not finite once scaled, take no part; vectors meet only those of their own length. Ties go to smaller ids. Repeated
    rows are candidates each; of queries with one id the least vector asks. An empty table gives no rows.
    """
    vectors = usable(df, id_col, vector_col, scale)
    index = index_blocks(vectors, lambda ids, m: build_slices(ids, m, scale), "bit-slices")
    asked = query_blocks(vectors.where(F.col("vec_id") % every == 0), "topk-queries")
    return best_of_pairs(index, asked, lambda body, ids, m: best_in_block(body, ids, m, k, scale), "long", k, ascending=False)
