"""A stored index of vectors for cosine search: cells around trained centres, and sign codes inside them.

Vectors go to the cell of their nearest centre (k-means over unit vectors); a table is partitioned by cell, and beside each
vector stands its code: on which side of CODE_BITS random planes it lies. A question scans the cells nearest to it, and in
them compares exactly only the vectors whose code differs from its own in few bits. How many cells, and how many bits, are
fitted when the index is built, on a bounded sample against brute force, for a wanted recall; without any clusters in the
vectors that is nearly all cells, and the codes alone choose.

The exact search needs no fit: no vector of a cell is nearer than its centre by more than the cell's radius, so that a cell
is left out if that bound is below the k-th score found.

Centres, radii, lengths and the fit are stored with the cells, in a version for each write: an index is opened again with
its path, and takes more vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.functions.vectors import cosine
from wikiloom.operators.clustering import SAMPLE, kmeans, matrix_of, nearest_centre, sample_of, unit_rows
from wikiloom.operators.retrieval import CANDIDATES, literal_vector, vector_top_k
from wikiloom.plans.shared import shared_path

#: Cells: the square root of the vectors' number, within these bounds; bytes of all centres, which every task holds.
LEAST_CELLS, MOST_CELLS, CENTRE_BYTES = 16, 4096, 16 << 20
CODE_BITS, CODE_WORDS = 256, 4
#: What the fit asks for, of how many neighbours, and with how many of the sample's vectors as questions.
RECALL, NEIGHBOURS, QUESTIONS = 0.97, 20, 256
#: Rows of a file; a cell with more has several.
FILE_ROWS = 1_000_000
#: The cell of vectors that no centre has: of lengths that the sample lacked, or with components that are null or not finite.
OTHER = -1
META = "dims int, cell int, centre array<double>, radius double, rows long, seed long, share double, bits int"


@dataclass(frozen=True)
class Space:
    """The cells of vectors of one length; ``share``: of the rows, those in the cells to scan; ``bits``: codes that differ in
    more aren't compared."""

    cells: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    seed: int
    share: float
    bits: int

    @property
    def planes(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(self.centres.shape[1], CODE_BITS))

    def near(self, query: np.ndarray) -> list[int]:
        """The cells to scan: the nearest ones, until they have the fitted share of the rows."""
        order = np.argsort(-(self.centres @ query), kind="stable")
        before = np.cumsum(self.rows[order]) - self.rows[order]
        return self.cells[order[before < self.share * self.rows.sum()]].tolist()


@dataclass(frozen=True)
class VectorIndex:
    """The table (cell, id, embedding, code) at a path, and what is known of its cells by length of vectors."""

    spark: SparkSession
    path: str
    id_type: str
    spaces: dict[int, Space]
    version: int

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, embedding array<double>, code array<bigint>, cell int").parquet(f"{self.path}/cells")


def codes_of(matrix: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sign codes as 64-bit words."""
    return np.packbits(matrix @ planes > 0, axis=1, bitorder="little").view(np.int64)


def fitted(sample: np.ndarray, centres: np.ndarray, planes: np.ndarray, recall: float, k: int = NEIGHBOURS) -> tuple[float, int]:
    """(share of the rows to scan, bits that codes may differ) of the least cost that find ``recall`` of the k nearest.

    The sample's first QUESTIONS vectors are asked for among all others. Cost: a code's bytes for each row of the cells
    scanned, and a vector's for each that is compared.
    """
    questions = min(QUESTIONS, len(sample) // 2)
    if questions < 1 or len(sample) < 4 * k:
        return 1.0, CODE_BITS
    own, _ = nearest_centre(sample, centres)
    codes = codes_of(sample, planes)
    sizes = np.bincount(own, minlength=len(centres))
    shares, bits, passed = [], [], []
    for q in range(questions):
        score = sample @ sample[q]
        score[q] = -2
        top = np.argpartition(-score, k)[:k]
        order = np.argsort(-(centres @ sample[q]), kind="stable")
        before = np.empty(len(centres))
        before[order] = (np.cumsum(sizes[order]) - sizes[order]) / len(sample)
        differ = np.bitwise_count((codes ^ codes[q]).view(np.uint64)).sum(axis=1)
        shares.append(before[own[top]])
        bits.append(differ[top])
        passed.append(np.bincount(differ, minlength=CODE_BITS + 1).cumsum() / len(sample))
    reach, differ, passing = np.concatenate(shares), np.concatenate(bits), np.mean(passed, axis=0)
    best = (float("inf"), 1.0, CODE_BITS)
    for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0):
        inside = reach < share
        if inside.mean() < recall:
            continue
        limit = int(np.quantile(differ[inside], min(1.0, recall / inside.mean()), method="higher"))
        cost = share * (CODE_BITS // 8 + passing[limit] * 8 * sample.shape[1])
        best = min(best, (cost, share, limit))
    return best[1], best[2]


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, recall: float = RECALL, rounds: int = 10, seed: int = 11) -> VectorIndex:
    """Index (id, embedding) at ``path``, or else in the shared folder for this session.

    Vectors and ids that are null aren't indexed. Lengths of vectors that are rarer than one in SAMPLE have no cells of
    their own: such vectors, and those with components that are null or not finite, are in one cell that every question
    scans. An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    known = vectors.where("embedding IS NOT NULL AND id IS NOT NULL")
    lengths = known.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.col("count").desc()).limit(64).collect()
    total = sum(r["count"] for r in lengths)
    spaces: dict[int, Space] = {}
    for r in lengths:
        dims, count = r["dims"], r["count"]
        if dims < 1 or count * SAMPLE < total:
            continue
        wanted = cells or min(MOST_CELLS, max(LEAST_CELLS, int(count**0.5)), max(1, CENTRE_BYTES // (8 * dims)))
        found = kmeans(known, wanted, dims, rounds, 1e-4, unit=True)
        if len(found.centres):
            first = 1 + max((s.cells.max() for s in spaces.values()), default=-1)
            space = Space(first + np.arange(len(found.centres)), found.centres, found.radius, found.rows, seed, 1.0, CODE_BITS)
            share, bits = fitted(unit_rows(sample_of(known, dims, seed=seed)), space.centres, space.planes, recall)
            spaces[dims] = replace(space, share=share, bits=bits)
    index = VectorIndex(spark, path or shared_path(spark, "vector-index"), vectors.schema["id"].dataType.simpleString(), spaces, 0)
    return _write(index, known, "overwrite")


def append(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """Add (id, embedding) to an index, by the centres and the fit that it has. Ids that it holds already are held twice."""
    return _write(index, vectors.where("embedding IS NOT NULL AND id IS NOT NULL"), "append")


def _write(index: VectorIndex, known: DataFrame, mode: str) -> VectorIndex:
    """Place the vectors, write them with a file a cell, then what is known of the cells now: readers that opened the index
    before find the version before."""
    spaces = index.spaces
    planes = {n: s.planes for n, s in spaces.items()}
    files = {int(c): max(1, -(-int(n) // FILE_ROWS)) for s in spaces.values() for c, n in zip(s.cells, s.rows, strict=True)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, code, far = np.full(batch.num_rows, OTHER, np.int32), np.zeros((batch.num_rows, CODE_WORDS), np.int64), np.zeros(batch.num_rows)
            sizes, odd = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for n, space in spaces.items():
                own = np.flatnonzero((sizes == n) & ~odd)
                if len(own):
                    rows = unit_rows(matrix_of(batch.column(1).take(pa.array(own)), n))
                    at, far[own] = nearest_centre(rows, space.centres)
                    cell[own], code[own] = space.cells[at], codes_of(rows, planes[n])
            part = np.arange(batch.num_rows) % np.array([files.get(int(c), 1) for c in cell], int)
            columns = [batch.column(0), batch.column(1), pa.array(list(code), pa.list_(pa.int64())), pa.array(cell), pa.array(part.astype(np.int32)), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "embedding", "code", "cell", "part", "far"])

    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    placed = known.select("id", vector.alias("embedding"), F.size("embedding").alias("size"), odd.alias("odd")).mapInArrow(place, f"id {index.id_type}, embedding array<double>, code array<bigint>, cell int, part int, far double")
    ready = placed.repartition("cell", "part")
    if mode == "append":  # what the cells gain is measured on the way
        gained = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"))
        more = {r["cell"]: r for r in gained.collect()}  # a row a cell
        add = lambda s: replace(s, rows=np.array([n + (more[c]["n"] if c in more else 0) for c, n in zip(s.cells, s.rows, strict=True)]), radius=np.array([max(x, more[c]["far"] if c in more else 0.0) for c, x in zip(s.cells, s.radius, strict=True)]))
        spaces = {n: add(s) for n, s in spaces.items()}
    ready.select("id", "embedding", "code", "cell").write.mode(mode).partitionBy("cell").parquet(f"{index.path}/cells")
    new = replace(index, spaces=spaces, version=index.version + 1)
    rows = [(n, int(c), centre.tolist(), float(x), int(m), s.seed, s.share, s.bits) for n, s in spaces.items() for c, centre, x, m in zip(s.cells, s.centres, s.radius, s.rows, strict=True)]
    meta = index.spark.createDataFrame(rows, META).withColumn("id_type", F.lit(index.id_type))
    (meta if rows else index.spark.createDataFrame([(None,) * 8], META).withColumn("id_type", F.lit(index.id_type))).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/meta/version={new.version}")
    return new


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that was written to a path, in its last version."""
    meta = spark.read.parquet(f"{path}/meta")
    version = meta.agg(F.max("version")).first()[0]
    rows = meta.where(F.col("version") == version).orderBy("cell").collect()  # a row a cell
    spaces = {}
    for n in sorted({r["dims"] for r in rows if r["dims"] is not None}):
        own = [r for r in rows if r["dims"] == n]
        spaces[n] = Space(np.array([r["cell"] for r in own]), np.array([r["centre"] for r in own]), np.array([r["radius"] for r in own]), np.array([r["rows"] for r in own]), own[0]["seed"], own[0]["share"], own[0]["bits"])
    return VectorIndex(spark, path, rows[0]["id_type"], spaces, version)


def differing_bits(code: Column, own: list[int]) -> Column:
    """In how many bits a code differs from another one."""
    return sum((F.bit_count(F.get(code, F.lit(i)).bitwiseXOR(F.lit(w))) for i, w in enumerate(own)), F.lit(0))


def candidates(index: VectorIndex, query: list[float]) -> DataFrame:
    """(id, embedding) of the vectors that a question compares exactly: they can stand for all embeddings in a search."""
    asked = np.asarray(query, float)
    space = index.spaces.get(len(query))
    if space is None or not np.isfinite(asked).all() or not asked.any():
        return index.cells.select("id", "embedding")
    own = unit_rows(asked[None, :])
    alike = differing_bits(F.col("code"), codes_of(own, space.planes)[0].tolist()) <= space.bits
    return index.cells.where(F.col("cell").isin([OTHER, *space.near(own[0])])).where((F.col("cell") == OTHER) | alike).select("id", "embedding")


def top_k(index: VectorIndex, query: list[float], k: int = CANDIDATES, known: DataFrame | None = None) -> DataFrame:
    """(id, score): the k vectors most like the query of those compared, ties to smaller ids; with ``known`` (ids, each once),
    of these. A query of another length than all vectors, a zero one, or one that isn't finite is compared with every vector."""
    return vector_top_k(candidates(index, query), query, "id", k=k, known=known)


def exact_top_k(index: VectorIndex, query: list[float], k: int = CANDIDATES) -> DataFrame:
    """(id, score): the k vectors most like the query of all. First the cells that a search by fit scans give a k-th score,
    then every cell that may hold a better one is scanned in full."""
    space = index.spaces.get(len(query))
    asked = np.asarray(query, float)
    if space is None or not np.isfinite(asked).all() or not asked.any():
        return vector_top_k(index.cells, query, "id", k=k)
    unit = unit_rows(asked[None, :])[0]
    found = [r["score"] for r in top_k(index, query, k).collect()]  # k rows
    least = found[-1] if len(found) == k else -1.0
    bound = space.centres @ unit + space.radius + 1e-9
    scanned = index.cells.where(F.col("cell").isin([OTHER, *space.cells[bound >= least].tolist()]))
    scored = scanned.select("id", cosine(F.col("embedding"), literal_vector(query)).alias("score")).where(~F.isnan("score"))
    return scored.orderBy(F.col("score").desc(), "id").limit(k)
