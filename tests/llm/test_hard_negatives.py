import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikiloom.llm import hard_negatives as hn
from wikiloom.llm.hard_negatives import Tree, Walk, build_tree, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, rank int, anchor_id int"


def brute(data, low=80, high=100, k=5):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label, *_ in data if i is not None and label is not None and v and all(x is not None and math.isfinite(256 * x) for x in v)]
    anchors = {}
    for i, label, v in good:
        if i % 100 == 0:
            raw = min((x[2], x[1]) for x in data if x[0] == i and x[2] is not None and x[1])
            anchors[i] = (raw[0], [math.floor(256 * x) for x in raw[1]])
    out = []
    for a, (label, q) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), i, own == label) for i, own, v in good if i != a and len(v) == len(q)]
        first = sorted((s, i) for s, i, same in scored if same)[:k]
        for s, i in sorted(set(first)):
            inside = sorted((t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= high * -s)[:k]
            out += [(a, i, rank, j, -s, -t) for rank, (t, j) in enumerate(inside, 1)]
    return sorted(out)


def rows(n=700, dims=3, seed=0, hot=0, labels=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * rng.lognormal(size=(n, 1)) * 0.3
    if hot:
        x[rng.choice(n, hot, replace=False)] = x[1]
    return [(i, v.tolist(), int(label), "s", 9, 9) for i, (v, label) in enumerate(zip(x, rng.integers(0, labels, n), strict=True))]


BAD = [(None, [1.0] * 3, 1, "", 0, 0), (5000, None, 1, "", 0, 0), (5100, [math.nan] * 3, 1, "", 0, 0), (5200, [math.inf, 0.0, 0.0], 1, "", 0, 0), (5300, [None, 1.0, 1.0], 1, "", 0, 0), (5400, [], 1, "", 0, 0), (5500, [1.0] * 3, None, "", 0, 0), (5600, [1.0, 2.0], 1, "", 0, 0), (5700, [0.0] * 3, 2, "", 0, 0), (5701, [0.0] * 3, 2, "", 0, 0)]


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize(("hot", "seed"), [(0, 0), (250, 1)])
def test_equals_brute_force(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 100)
    data = rows(hot=hot, seed=seed) + BAD
    data += [data[7]] * 3 + [data[100]] * 2 + [(200, [0.5, 0.5, 0.5], 1, "", 0, 0), (300, data[300][1], 0, "", 0, 0), (3, data[4][1], 2, "", 0, 0)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = brute(data)
    assert found(hard_negatives(df)) == want
    assert len(want) > 50


def test_other_label_column(spark):
    data = rows(300, seed=5)
    moved = [(*x[:2], (x[2] + 1) % 10 if x[0] % 7 == 0 else x[2], *x[3:]) for x in data]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert found(hard_negatives(spark.createDataFrame(data, SCHEMA), label)) == brute(moved)


def test_small_and_empty(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = [(0, [1.0, 2.0], 1, "", 0, 0)]
    assert hard_negatives(spark.createDataFrame(alone, SCHEMA)).count() == 0
    few = [(0, [1.0, 2.0], 1, "", 0, 0), (1, [1.0, 2.0], 1, "", 0, 0), (2, [0.9, 1.9], 2, "", 0, 0), (3, [-1.0, -2.0], 3, "", 0, 0)]
    assert found(hard_negatives(spark.createDataFrame(few, SCHEMA))) == brute(few) == [(0, 1, 1, 2, 256 * 256 + 512 * 512, 256 * 230 + 512 * 486)]


@pytest.mark.parametrize("size", [1.0, 1e6, 1e12, 1e140])
def test_scores_of_any_size(size):
    """Beyond the integers of doubles, and beyond 64 bits, scores stay exact."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 4)) * size
    ids, labels = np.arange(200), rng.integers(0, 3, 200)
    values = [[math.floor(256 * x) for x in row] for row in m.tolist()]
    asked = list(range(0, 200, 20))
    walks = [Walk(n, i, int(labels[i]), True) for n, i in enumerate(asked)]
    Tree(build_tree(ids, labels, m, 5)).walk(hn.quantise(m[asked], 256), walks, 5)
    for w, i in zip(walks, asked, strict=True):
        want = sorted((-sum(x * y for x, y in zip(values[i], values[j], strict=True)), j) for j in range(200) if j != i and labels[j] == labels[i])[:5]
        assert w.found == want


def test_tree_leaves_out_most_of_a_clustered_block():
    """Bounds do leave leaves out: an anchor looks at few of the rows where they lie in clusters."""
    rng = np.random.default_rng(0)
    m = np.repeat(rng.normal(size=(16, 8)), 128, axis=0) + 0.01 * rng.normal(size=(2048, 8))
    tree = Tree(build_tree(np.arange(2048), np.zeros(2048, int), m, 5))
    looked = []
    plain = tree.scorer

    def counted(queries):
        kind, products = plain(queries)
        return kind, lambda a, b, some: looked.append((b - a) * len(some)) or products(a, b, some)

    tree.scorer = counted
    tree.walk(hn.quantise(m[::100], 256), [Walk(n, i, 0, True) for n, i in enumerate(range(0, 2048, 100))], 5)
    assert sum(looked) < 0.5 * 2048 * 21
