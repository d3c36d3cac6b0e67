import math
import random
from collections import Counter

import numpy as np
import pytest

from wikiloom.llm import mixing
from wikiloom.llm.mixing import mix, mixed_documents, settle

SCHEMA = "doc_id long, text string, source string, target string, size string"


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 300]) + "end", rng.choice(["a", "a", "a", "b", "é", "z", None]), "c", "c") for i in range(n)]
    return rows + [(9000, None, "b", "", ""), (9001, "", "only-empty", "", ""), (None, "no id here", "z", "", "")] + [(9002, "same row of five", "b", "", "")] * 30


def targets(sizes, share=1.5, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("bucket", [8192, 25])
def test_targets_and_taken(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix(df.repartition(3)).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    for source, part in got.groupby("source", dropna=False):
        source = None if source is None or source != source else source
        assert (part.source_size == sizes[source]).all()
        assert np.allclose(part.target, want[source])
        assert abs(part.taken.sum() - want[source]) <= 1
    assert (got.taken <= 2 * got["size"]).all()
    again = mix(df.repartition(7)).toPandas()
    key = lambda t: sorted(map(str, t[["doc_id", "source", "size", "taken"]].to_numpy().tolist()))
    assert key(got) == key(again)


def test_settle_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 50, 200)
    probs = rng.random(200)
    total = np.zeros(200)
    for _ in range(400):
        extra, left = settle(sizes, probs, rng.random(200))
        kept = np.where(extra >= 0, extra, left)
        assert abs((kept * sizes).sum() - (probs * sizes).sum()) < 1e-6 and (extra < 0).sum() <= 1
        total += kept
    assert np.abs(total / 400 - probs).max() < 0.12


def test_documents_carry_their_copies(spark):
    rows = corpus(120)
    rows += [(9003, "same words here", "b", "x", ""), (9003, "same words here", "b", "y", "")]  # equal but for another column
    schema = "doc_id long, text string, source string, `__key` string, `row` string"
    df = spark.createDataFrame(rows, schema)
    out = mixed_documents(df.repartition(3))
    assert out.columns == df.columns
    count = lambda found: Counter(map(tuple, found))
    taken = count(out.collect())
    assert taken == count(mixed_documents(df.repartition(7)).collect()) and set(taken) <= set(rows)
    given, words = count(rows), lambda t: len((t or "").split())
    sizes, mass, longest = {}, {}, {}
    for row in rows:
        sizes[row[2]] = sizes.get(row[2], 0) + words(row[1])
        longest[row[2]] = max(longest.get(row[2], 0), words(row[1]))
    want = targets(sizes)
    for row, n in given.items():
        rate = want[row[2]] / sizes[row[2]] if sizes[row[2]] else 0
        assert math.floor(rate * n) <= taken[row] <= math.ceil(rate * n) + 1 and taken[row] <= 2 * n
        mass[row[2]] = mass.get(row[2], 0) + taken[row] * words(row[1])
    assert all(abs(mass[s] - want[s]) <= longest[s] for s in sizes)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix(spark.createDataFrame([(1, "", "a", "", ""), (2, None, None, "", "")], SCHEMA)).agg({"taken": "sum"}).first()[0] == 0
