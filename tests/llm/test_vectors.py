import math

import numpy as np
import pytest

from wikiloom.llm import ann
from wikiloom.llm.ann import nearest
from wikiloom.llm.topk import best_in_block, build_slices, exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def rows(n=900, dims=16, seed=0, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = (centres[rng.integers(0, 6, n)] + 0.5 * rng.normal(size=(n, dims))).astype(np.float32)
    if hot:
        x[rng.choice(n, hot, replace=False)] = x[0]
    return [(i, v.tolist(), "clash", 1) for i, v in enumerate(x)]


BAD = [(None, [1.0] * 16, "", 0), (5000, None, "", 0), (5100, [float("nan")] * 16, "", 0), (5200, [float("inf")] + [0.0] * 15, "", 0), (5300, [None] + [1.0] * 15, "", 0), (5400, [], "", 0)]


def brute(data, score, k=10, zero_ok=True):
    good = [(i, np.asarray(v, float)) for i, v, *_ in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v))]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            out[q] = sorted((score(v, w), i) for i, w in good if i != q and len(w) == len(v))[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("hot", [0, 300])
def test_top_k_equals_brute_force(spark, hot):
    data = rows(hot=hot) + BAD + [(5500, [0.0] * 16, "", 0), (5600, [1.0, -2.0], "", 0), (5601, [3.0, 4.5], "", 0), (7, [9.0] * 16, "", 0)]
    got = answers(exact_top_k(spark.createDataFrame(data, SCHEMA).repartition(3)))
    quantised = lambda v: np.floor(1024 * v).astype(np.int64)
    want = brute(data, lambda v, w: -int(quantised(v) @ quantised(w)))
    want = {q: [(n + 1, i, -s) for n, (s, i) in enumerate(v)] for q, v in want.items() if v}
    assert got == want


@pytest.mark.parametrize(("size", "asked"), [(0.3, 1), (2e4, 1), (3e7, 1e-4), (1e13, 1e-9)])
def test_top_k_of_large_components(size, asked):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(130, 6)) * size
    m[rng.random(m.shape) < 0.1] = 0
    m[3] = m[4]
    m[7, 0] = 1e-9
    q, ids = np.r_[rng.normal(size=(5, 6)) * asked * 100, m[:1] * asked / size], np.r_[0, 100, 7, 8, 9, 10]
    if size > 1e9:
        m[:, 5] *= 1e7  # beyond 64 bits; no query weighs it
        q[:, 5] = 1e-5
    whole = lambda row: [math.floor(1024 * float(x)) for x in row]
    want = []
    for i, w in zip(ids, q, strict=True):
        scored = sorted((-sum(a * b for a, b in zip(whole(w), whole(v), strict=True)), 2 * j) for j, v in enumerate(m) if 2 * j != i)
        want += [(int(i), j, -x) for x, j in scored[:7]]
    assert sorted(best_in_block(build_slices(np.arange(130) * 2, m), ids, q, 7)) == sorted(want)


def test_top_k_beyond_64_bits():
    m = np.array([[3e7, 1.0], [1.0, 1.0]])
    with pytest.raises(OverflowError):
        best_in_block(build_slices(np.arange(2), m), np.array([9]), m[:1], 2)


def test_top_k_keeps_large_components_apart(spark):
    data = [(100, [1.0, 1.0], "", 0), (1, [20000.0, 1.0], "", 0), (2, [30000.0, 1.0], "", 0), (3, [1e308, 1.0], "", 0)]
    found = exact_top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>, score string, rank int"))
    assert answers(found)[100] == [(1, 2, 31458328576), (2, 1, 20972568576)]


@pytest.mark.parametrize("dims", [64, 256, 768])
@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_whatever_the_dimension(dims, clusters):
    rng = np.random.default_rng(dims)
    m = rng.normal(size=(5000, dims))
    if clusters:
        m += 2 * rng.normal(size=(clusters, dims))[rng.integers(0, clusters, 5000)]
    share = ann.fitted_share(m[:2000], m[:256], ann.PREFIX, 10, ann.RECALL)
    known, ids, asked = {dims: ann.Plan(m[:256], share)}, np.arange(5000), np.arange(2001, 5000, 100)
    found = ann.search_block(ann.build_block(ids, m, known, ann.PREFIX, 10), asked, m[asked], known, ann.PREFIX, 10, ann.RERANK_LEAST)
    hits = 0
    for q in asked:
        distance = ((m - m[q]) ** 2).sum(axis=1)
        distance[q] = np.inf
        hits += len(set(np.argsort(distance)[:10].tolist()) & {i for own, i, _ in found if own == q})
    assert hits >= 9 * len(asked) and (share < 0.2 or not clusters)


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    got = answers(nearest(df))
    rows_ = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    ids, m = np.array([i for i, _ in rows_]), np.array([v for _, v in rows_], float)
    hits = total = 0
    for q in got:
        distance = ((m - m[ids == q][0]) ** 2).sum(axis=1)
        distance[ids == q] = np.inf
        hits += len({int(ids[n]) for n in np.lexsort((ids, distance))[:10]} & {i for _, i, _ in got[q]})
        total += 10
    assert hits >= 0.9 * total


def test_repeated_rows_of_a_query(spark):
    data = [(100, [1.0, 2.0], "", 0)] * 12 + [(101, [1.0, 2.0], "", 0), (102, [1.0, 2.5], "", 0)]
    assert answers(nearest(spark.createDataFrame(data, SCHEMA)))[100] == [(1, 101, 0.0), (2, 102, 0.5)]


@pytest.mark.parametrize("hot", [0, 300])
def test_nearest_recall_and_scores(spark, hot):
    data = rows(3000, hot=hot) + BAD + [(5500, [0.0] * 16, "", 0)]
    got = answers(nearest(spark.createDataFrame(data, SCHEMA).repartition(3)))
    want = brute(data, lambda v, w: float(np.sqrt(((v - w) ** 2).sum())), zero_ok=False)
    exact = {i: np.asarray(v, float) for i, v, *_ in data if i is not None and v and None not in v}
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, *_ in found] == list(range(1, 11))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        assert all(abs(s - np.sqrt(((exact[q] - exact[i]) ** 2).sum())) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("search", [exact_top_k, nearest])
def test_small_and_empty(spark, search):
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(spark.createDataFrame([(100, [1.0, 2.0], "", 0)], SCHEMA)).count() == 0
    got = answers(search(spark.createDataFrame([(100, [1.0, 2.0], "", 0), (3, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], SCHEMA)))
    assert [i for _, i, _ in got[100]] == [2, 2, 3]
