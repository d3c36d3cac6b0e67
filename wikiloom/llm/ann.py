"""Approximate nearest neighbours (operator 3) by a permutation index.

Pivots are a bounded, documented sample of the vectors. A vector is represented by its nearest pivots in order; the
inverted file of a pivot posts the vectors that have it, with its place there. A query walks the files of its own
nearest pivots and adds up the footrule: the differences of places, where a pivot missing on one side counts as if at
the place after the last. The vectors with the least footrule are reranked by exact distance. The index is kept in
blocks, each with its own inverted files and all its vectors; equal vectors of a block are posted once, with the
smallest ids that any query could need.

How far the order by footrule can be trusted depends on the vectors: little where they have many dimensions and no
clusters. So the share of a block that is reranked is fitted on a bounded sample, against brute force, for a wanted
recall; at worst it is all of the block.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.blocks import best_of_pairs, index_blocks, query_blocks, usable

#: Vectors, and bytes of their components, of the sample: those with the smallest hashes.
SAMPLE, SAMPLE_BYTES = 4096, 16 << 20
#: Pivots: so many vectors of the sample, the first ones.
PIVOTS = 256
#: Places kept of a permutation.
PREFIX = 64
#: The share reranked is the least at which so many of the sample's queries' neighbours are found, and a tenth more.
RECALL, PROBES = 0.97, 128
#: Of a block's distinct vectors, the least number reranked for each query.
RERANK_LEAST = 128


def permutations(matrix: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, in order."""
    distance = (pivots**2).sum(axis=1)[None, :] - 2 * matrix @ pivots.T
    return np.argsort(distance, axis=1, kind="stable")[:, : min(prefix, len(pivots))].astype(np.int16)


@dataclass(frozen=True)
class Plan:
    """What the index needs to know for vectors of one length."""

    pivots: np.ndarray
    share: float


def vector_sample(vectors: DataFrame, count: int = SAMPLE, limit: int = SAMPLE_BYTES, seed: int = 3) -> dict[int, np.ndarray]:
    """Vectors by length: those with the smallest hashes (equal ones count once), ``count`` or ``limit`` bytes at most."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 1
    some = vectors.select("vector", F.xxhash64("vector", F.lit(seed)).alias("h")).groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").limit(max(2, min(count, limit // (8 * longest))))
    found: dict[int, list[list[float]]] = {}
    for row in some.collect():
        found.setdefault(len(row["vector"]), []).append(row["vector"])
    return {n: np.asarray(v, float) for n, v in found.items()}


def footrules(asked: np.ndarray, posted: np.ndarray, place: np.ndarray, files: np.ndarray, rows: int) -> np.ndarray:
    """The footrule of one query's permutation to those of all rows: everything missing at first, then what each posting saves."""
    length = len(asked)
    out = np.zeros(rows, np.int32)
    for at, pivot in enumerate(asked):
        own = place[files[pivot] : files[pivot + 1]]
        out[posted[files[pivot] : files[pivot + 1]]] += np.abs(own - at) - (length - at) - (length - own)
    return out


def inverted_files(places: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pivot the rows that have it, and at which place: (rows, places, where each pivot's file starts)."""
    rows = np.repeat(np.arange(len(places), dtype=np.int32), places.shape[1])
    at = np.tile(np.arange(places.shape[1], dtype=np.int16), len(places))
    order = np.argsort(places.ravel(), kind="stable")
    return rows[order], at[order], np.searchsorted(places.ravel()[order], np.arange(pivots + 1))


def fitted_share(sample: np.ndarray, pivots: np.ndarray, prefix: int, k: int, recall: float) -> float:
    """The share of the nearest by footrule that must be reranked for ``recall`` of the k nearest of the sample's probes.

    A block of an index holds fewer of a query's nearest than a sample of its size that is searched alone, and the
    nearer ones of them: so the fit errs to the safe side.
    """
    probes = min(PROBES, len(sample) // 4)
    if not probes or len(sample) - probes <= RERANK_LEAST:
        return 1.0
    queries, rows = sample[-probes:], sample[:-probes]
    posted, place, files = inverted_files(permutations(rows, pivots, prefix), len(pivots))
    worst = []
    for query, asked in zip(queries, permutations(queries, pivots, prefix), strict=True):
        found = footrules(asked, posted, place, files, len(rows))
        order = np.sort(found)
        near = np.argsort(((rows - query) ** 2).sum(axis=1), kind="stable")[:k]
        worst += np.searchsorted(order, found[near], side="right").tolist()  # how many must be reranked to reach each
    return min(1.0, 1.1 * float(np.quantile(worst, recall)) / len(rows))


def plans(vectors: DataFrame, pivots: int, prefix: int, k: int, recall: float) -> dict[int, Plan]:
    """The plan for each length of vectors that the sample holds."""
    found = {}
    for n, sample in vector_sample(vectors).items():
        own = sample[:pivots]
        found[n] = Plan(own, fitted_share(sample, own, prefix, k, recall))
    return found


def plan_of(known: dict[int, Plan], distinct: np.ndarray) -> Plan:
    """The plan of a block's vectors; lengths that the sample lacks are searched in full."""
    return known.get(distinct.shape[1]) or Plan(distinct[:1], 1.0)


def build_block(ids: np.ndarray, matrix: np.ndarray, known: dict[int, Plan], prefix: int, k: int) -> bytes:
    """A block's distinct vectors, the smallest ids of each, and its inverted files.

    A query never finds its own id: of equal vectors the k smallest other ids are kept beside all rows of the least.
    """
    distinct, which = np.unique(matrix, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")  # ids are in order
    starts = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
    keep = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        own = order[a:b]
        first = int(np.searchsorted(ids[own], ids[own[0]], side="right"))
        keep.append(own[: first + k])
    pivots = plan_of(known, distinct).pivots
    posted, place, files = inverted_files(permutations(distinct, pivots, prefix), len(pivots))
    out = io.BytesIO()
    np.savez(out, vectors=distinct, ids=ids[np.concatenate(keep)], ends=np.cumsum([len(x) for x in keep]), posted=posted, place=place, files=files)
    return out.getvalue()


def search_block(body: bytes, ids: np.ndarray, matrix: np.ndarray, known: dict[int, Plan], prefix: int, k: int, least: int) -> list[tuple[int, int, float]]:
    """The k nearest of the block's candidates for each query."""
    held = np.load(io.BytesIO(body))
    vectors, own_ids, ends, posted, place, files = (held[x] for x in ("vectors", "ids", "ends", "posted", "place", "files"))
    plan = plan_of(known, vectors)
    wanted = min(len(vectors), max(least, math.ceil(plan.share * len(vectors))))
    starts = np.r_[0, ends[:-1]]
    asked = permutations(matrix, plan.pivots, prefix) if wanted < len(vectors) else [None] * len(matrix)
    out = []
    for own, query, order in zip(ids, matrix, asked, strict=True):
        near = np.arange(len(vectors))
        if order is not None:
            footrule = footrules(order, posted, place, files, len(vectors))
            near = np.flatnonzero(footrule <= np.partition(footrule, wanted - 1)[wanted - 1])
        distance = np.sqrt(((vectors[near] - query) ** 2).sum(axis=1))
        closest = np.lexsort((own_ids[starts[near]], distance))[: k + 1]
        found = [(float(distance[c]), int(i)) for c in closest for i in own_ids[starts[near[c]] : ends[near[c]]] if i != own]
        out += [(int(own), i, d) for d, i in sorted(found)[:k]]
    return out


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, pivots: int = PIVOTS, prefix: int = PREFIX, recall: float = RECALL, least: int = RERANK_LEAST) -> DataFrame:
    """The k nearest found for each query by Euclidean distance: query_id, rank, vec_id, score (the distance).

    Queries: rows whose id is divisible by ``every``; candidates: all rows with another id. Rows with a null id, or a
    vector that is null, empty, zero or holds null or non-finite components, take no part; vectors meet only those of
    their own length. Ties go to smaller ids. Repeated rows are candidates each; of queries with one id the least
    vector asks. An empty table gives no rows. Pivots and the share reranked come from a sample of SAMPLE vectors at
    most; every row is indexed.
    """
    vectors = usable(df, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    known = plans(vectors, pivots, prefix, k, recall)
    index = index_blocks(vectors, lambda ids, m: build_block(ids, m, known, prefix, k), "permutations")
    asked = query_blocks(vectors.where(F.col("vec_id") % every == 0), "ann-queries")
    return best_of_pairs(index, asked, lambda body, ids, m: search_block(body, ids, m, known, prefix, k, least), "double", k, ascending=True)
