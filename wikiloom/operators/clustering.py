"""Clusters of vectors: Lloyd's iteration whose sums are made where the vectors are.

A round assigns each vector to its nearest centre in Arrow batches and adds up a task's vectors by centre; only these sums
are shuffled, and the centres, whose number is a parameter, are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors, and bytes of their components, from which the first centres are drawn: those with the smallest hashes.
SAMPLE, SAMPLE_BYTES = 16384, 16 << 20
#: Distances that a task computes at once.
DISTANCES = 4 << 20


@dataclass(frozen=True)
class Clusters:
    """Centres, the rows of each, and the distance of its farthest row; rounds that were run, and whether they settled."""

    centres: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    rounds: int
    settled: bool


def of_length(vectors: DataFrame, dims: int, vector_col: str = "embedding") -> DataFrame:
    """(vector): the vectors of a length without components that are null, NaN or infinite."""
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(v.alias("vector")).where((F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    norm = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    """A column of vectors of one length, without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def sample_of(vectors: DataFrame, dims: int, count: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Distinct vectors of a length: those with the smallest hashes, bounded by ``count`` and SAMPLE_BYTES.

    On a large table only hashes below a threshold are told apart, so that the table isn't shuffled; where copies leave too
    few of these, all are.
    """
    wanted = max(1, min(count, SAMPLE_BYTES // (8 * dims)))
    hashed = of_length(vectors, dims).select("vector", F.xxhash64("vector", F.lit(seed)).alias("h"))
    some = lambda rows: [r[0] for r in rows.groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").limit(wanted).select("vector").collect()]
    total, found = vectors.count(), []
    times = 2  # tasks send what they find to the driver: little more than wanted, unless copies leave too few
    while len(found) < wanted and total > 2 * times * wanted:
        found = some(hashed.where(F.col("h") < -(1 << 63) + (1 << 64) * times * wanted // total))
        times *= 4
    if len(found) < wanted:
        found = some(hashed)
    return np.array(found, float).reshape(-1, dims)


def spread_centres(sample: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """k first centres, each drawn with a chance by its squared distance to those before it; all of a smaller sample."""
    if len(sample) <= k:
        return sample.copy()
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    distance = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = distance.sum()
        at = int(rng.choice(len(sample), p=distance / total)) if total > 0 else int(np.setdiff1d(np.arange(len(sample)), chosen)[0])
        chosen.append(at)
        distance = np.minimum(distance, ((sample - sample[at]) ** 2).sum(axis=1))
    return sample[chosen]


def nearest_centre(matrix: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, the first of equals, and the distance to it; so many rows at once that their distances to
    all centres have DISTANCES numbers at most."""
    own, step = np.zeros(len(matrix), np.int64), max(1, DISTANCES // len(centres))
    squares = (centres**2).sum(axis=1)[None, :]
    for start in range(0, len(matrix), step):
        own[start : start + step] = (squares - 2 * matrix[start : start + step] @ centres.T).argmin(axis=1)
    return own, np.sqrt(np.maximum(0.0, ((matrix - centres[own]) ** 2).sum(axis=1)))


def measured(vectors: DataFrame, centres: np.ndarray, unit: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, sums, radius, farthest vector) of each centre."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, far, most = np.zeros(k, np.int64), np.zeros((k, dims)), np.full(k, -1.0), np.zeros((k, dims))
        for batch in batches:
            if batch.num_rows:
                rows = matrix_of(batch.column(0), dims)
                rows = unit_rows(rows) if unit else rows
                own, distance = nearest_centre(rows, centres)
                count += np.bincount(own, minlength=k)
                np.add.at(total, own, rows)
                for c in np.unique(own):
                    at = np.flatnonzero(own == c)
                    best = at[distance[at].argmax()]
                    if distance[best] > far[c]:
                        far[c], most[c] = distance[best], rows[best]
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.float64())), pa.array(far[held]), pa.array(list(most[held]), pa.list_(pa.float64()))],
            names=["centre", "n", "total", "far", "most"],
        )

    parts = of_length(vectors, dims).mapInArrow(run, "centre int, n long, total array<double>, far double, most array<double>")
    zero = F.array_repeat(F.lit(0.0), dims)
    added = F.aggregate(F.collect_list("total"), zero, lambda a, x: F.zip_with(a, x, lambda s, y: s + y))
    found = parts.groupBy("centre").agg(F.sum("n").alias("n"), added.alias("total"), F.max("far").alias("far"), F.max_by("most", "far").alias("most"))
    rows, sums, radius, most = np.zeros(k, np.int64), np.zeros((k, dims)), np.zeros(k), np.zeros((k, dims))
    for r in found.collect():  # a row a centre
        rows[r["centre"]], sums[r["centre"]], radius[r["centre"]], most[r["centre"]] = r["n"], r["total"], r["far"], r["most"]
    return rows, sums, radius, most


def kmeans(vectors: DataFrame, k: int, dims: int, rounds: int = 25, tolerance: float = 1e-9, unit: bool = False, start: np.ndarray | None = None) -> Clusters:
    """Lloyd's iteration over (embedding) until no centre moves by more than ``tolerance``, or for ``rounds``.

    Vectors of other lengths, and those with components that are null or not finite, take no part. A centre without rows
    moves to the row that is farthest from its centre (the n-th such centre to the row of the n-th farthest cluster). With
    ``unit`` vectors and centres have length one. Without ``start`` the first centres come from a bounded sample; there are
    fewer than k where it has fewer distinct vectors. No vectors give no centres.
    """
    centres = spread_centres(unit_rows(sample_of(vectors, dims)) if unit else sample_of(vectors, dims), k) if start is None else np.asarray(start, float)
    if not len(centres):
        return Clusters(centres, np.zeros(0, np.int64), np.zeros(0), 0, True)
    done, settled = 0, False
    while done < rounds and not settled:
        rows, sums, radius, most = measured(vectors, centres, unit)
        new = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centres)
        if unit:
            new = unit_rows(new)
        spare = [c for c in np.argsort(-radius, kind="stable") if rows[c] > 1 and radius[c] > 0]
        for empty, c in zip(np.flatnonzero(rows == 0), spare, strict=False):
            new[empty] = most[c]
        settled = bool(np.abs(new - centres).max() <= tolerance)
        centres, done = new, done + 1
    rows, _, radius, _ = measured(vectors, centres, unit)
    return Clusters(centres, rows, radius, done, settled)


def assigned(vectors: DataFrame, clusters: Clusters, id_col: str = "id") -> DataFrame:
    """(id, cluster, distance) of the vectors that have the centres' length."""
    centres, dims = clusters.centres, clusters.centres.shape[1]
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col("embedding").cast("array<double>")
    usable = vectors.select(id_col, v.alias("vector")).where((F.size("vector") == dims) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, distance = nearest_centre(matrix_of(batch.column(1), dims), centres) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], names=[id_col, "cluster", "distance"])

    return usable.mapInArrow(run, f"`{id_col}` {kind}, cluster int, distance double")
