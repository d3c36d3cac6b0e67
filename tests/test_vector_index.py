from glob import glob

import numpy as np
import pytest

from wikiloom.operators import clustering, retrieval, vector_index
from wikiloom.operators.clustering import kmeans


def lloyd(rows, start, rounds, tolerance):
    """Lloyd's iteration in one place, with the same rule for centres without rows."""
    centres = start.copy()
    for _ in range(rounds):
        distance = np.sqrt(((rows[:, None, :] - centres[None]) ** 2).sum(axis=2))
        own = distance.argmin(axis=1)
        far = np.array([distance[own == c, c].max() if (own == c).any() else 0.0 for c in range(len(centres))])
        new = np.array([rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        spare = [c for c in np.argsort(-far, kind="stable") if (own == c).sum() > 1 and far[c] > 0]
        for empty, c in zip([c for c in range(len(centres)) if not (own == c).any()], spare, strict=False):
            mine = np.flatnonzero(own == c)
            new[empty] = rows[mine[distance[mine, c].argmax()]]
        moved = np.abs(new - centres).max()
        centres = new
        if moved <= tolerance:
            break
    return centres


@pytest.mark.parametrize("far", [0.0, 50.0])
def test_kmeans_equals_lloyd(spark, far):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(5, 6))[rng.integers(0, 5, 400)] * 3 + rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6)], "id int, embedding array<double>").repartition(3)
    start = rows[:7].copy()
    start[3] += far  # a centre that gets no rows
    found = kmeans(df, 7, 6, rounds=40, start=start)
    assert found.settled and np.allclose(found.centres, lloyd(rows, start, 40, 1e-9), atol=1e-9)
    assert found.rows.sum() == 400 and (found.rows > 0).all()
    own = {r["id"]: (r["cluster"], r["distance"]) for r in clustering.assigned(df, found).collect()}
    distance = np.sqrt(((rows[:, None, :] - found.centres[None]) ** 2).sum(axis=2))
    assert len(own) == 400 and all(own[i][0] == distance[i].argmin() and abs(own[i][1] - distance[i].min()) < 1e-9 for i in own)


def test_kmeans_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id int, embedding array<double>")
    found = kmeans(df, 5, 2)
    assert sorted(found.centres.tolist()) == [[0.0, 1.0], [1.0, 0.0]] and found.settled
    assert len(kmeans(df.where("false"), 5, 2).centres) == 0


def nearest(m, q, k=20):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    return set(np.argsort(-(unit @ unit[q]), kind="stable")[:k].tolist())


def test_recall_on_the_table(spark):
    """No clusters in these vectors: the codes choose, under a quarter of the vectors is compared, 0.9 are found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id id", "embedding")
    rows = df.orderBy("id").collect()
    ids, m = [r["id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    index = vector_index.build(df)
    hits = compared = 0
    for q in range(0, 2000, 100):
        got = {ids.index(r["id"]) for r in vector_index.top_k(index, m[q].tolist()).collect()}
        hits += len(got & nearest(m, q))
        compared += vector_index.candidates(index, m[q].tolist()).count()
    assert hits >= 0.9 * 400 and compared <= 0.25 * 20 * 2000
    found = vector_index.exact_top_k(index, m[7].tolist())
    assert {ids.index(r["id"]) for r in found.collect()} == nearest(m, 7)


def clustered(spark, n=3000, dims=24):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(20, dims))[rng.integers(0, 20, n)] + 0.2 * rng.normal(size=(n, dims))
    odd = [(9000, None), (9001, [1.0, 2.0]), (9002, [0.0] * dims), (9003, [float("nan")] * dims), (9004, [None] + [1.0] * (dims - 1)), (None, [1.0] * dims)]
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + odd, "id int, embedding array<double>").repartition(8)


def test_index_is_kept(spark, tmp_path):
    m, df = clustered(spark)
    path = f"{tmp_path}/index"
    index = vector_index.build(df, path)
    assert index.cells.count() == 3004
    files = glob(f"{path}/cells/cell=*")
    assert len(files) > 10 and all(len(glob(f"{f}/*.parquet")) == 1 for f in files)
    hits = 0
    for q in range(10):
        hits += len({r["id"] for r in vector_index.top_k(index, m[q].tolist()).collect()} & nearest(m, q))
    assert hits >= 0.9 * 200
    # Few cells are read.
    space = index.spaces[24]
    unit = m[0] / np.linalg.norm(m[0])
    assert len(space.near(unit)) < len(space.cells) / 2
    read = vector_index.top_k(index, m[0].tolist())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and "cell#" in read.split("PartitionFilters: [")[1].split("]")[0]
    # Opened again, in another session.
    again = vector_index.open_index(spark.newSession(), path)
    for q in range(3):
        assert vector_index.top_k(again, m[q].tolist()).collect() == vector_index.top_k(index, m[q].tolist()).collect()
    # Exact results, with cells left out by their bounds.
    want = retrieval.vector_top_k(df.where("id IS NOT NULL"), m[5].tolist(), "id").collect()
    exact = vector_index.exact_top_k(index, m[5].tolist())
    assert [r["id"] for r in exact.collect()] == [r["id"] for r in want]
    bound = space.centres @ (m[5] / np.linalg.norm(m[5])) + space.radius
    assert (bound >= want[-1]["score"]).sum() < len(space.cells)


def test_append(spark, tmp_path):
    m, df = clustered(spark)
    path = f"{tmp_path}/index"
    index = vector_index.build(df.where("id < 2000"), path)
    more = vector_index.append(index, df.where("id >= 2000"))
    assert (index.version, more.version) == (1, 2)
    again = vector_index.open_index(spark, path)
    assert again.version == 2 and again.cells.count() == 3004 and again.spaces[24].rows.sum() == 3001
    hits = sum(len({r["id"] for r in vector_index.top_k(again, m[q].tolist()).collect()} & nearest(m, q)) for q in range(1995, 2005))
    assert hits >= 0.9 * 200
    assert [r["id"] for r in vector_index.exact_top_k(again, m[2500].tolist()).collect()] == [r["id"] for r in retrieval.vector_top_k(df.where("id IS NOT NULL"), m[2500].tolist(), "id").collect()]


def test_odd_questions_and_empty(spark, tmp_path):
    _, df = clustered(spark, 200)
    index = vector_index.build(df)
    assert [r["id"] for r in vector_index.top_k(index, [1.0, 2.0], k=1).collect()] == [9001]
    assert vector_index.top_k(index, [0.0] * 24).count() == 20
    assert vector_index.exact_top_k(index, [0.0] * 24).count() == 20
    none = vector_index.build(df.where("false"), f"{tmp_path}/none")
    assert vector_index.top_k(none, [1.0] * 24).count() == 0
    assert vector_index.top_k(vector_index.open_index(spark, f"{tmp_path}/none"), [1.0] * 24).count() == 0
    assert vector_index.append(vector_index.open_index(spark, f"{tmp_path}/none"), df).cells.count() == 204


def test_hybrid_search_from_the_index(spark):
    m, df = clustered(spark)
    chunks = df.where("id IS NOT NULL AND id < 3000").selectExpr("id chunk_id", "id page_id", "concat('word', id) content")
    pages = chunks.selectExpr("page_id", "'T' title")
    found = lambda e: [r["chunk_id"] for r in retrieval.hybrid_chunks(chunks, e, pages, "word7", m[4].tolist()).orderBy("rrf").collect()]
    index = vector_index.build(df)
    assert found(vector_index.candidates(index, m[4].tolist()).withColumnRenamed("id", "chunk_id")) == found(df.withColumnRenamed("id", "chunk_id"))


def test_sample_is_of_the_smallest_hashes(spark):
    """Whatever share of the hashes is looked at first, copies or not."""
    from pyspark.sql import functions as F

    from wikiloom.operators.clustering import sample_of

    kept = 4000 * 8 * 2
    for copies in (1, 5):
        df = spark.range(kept).select(F.array((F.floor(F.col("id") / copies)).cast("double"), F.lit(1.0)).alias("embedding"))
        hashed = df.distinct().select("embedding", F.xxhash64("embedding", F.lit(5)).alias("h")).orderBy("h").limit(1000)
        assert sample_of(df, 2, 1000).tolist() == [r["embedding"] for r in hashed.collect()]
