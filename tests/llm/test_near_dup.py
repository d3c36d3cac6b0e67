import random
import re

import numpy as np
import pytest

from wikiloom.llm import near_dup
from wikiloom.llm.components import components
from wikiloom.llm.near_dup import BINS, links_between, near_duplicates, shingles, signature

SCHEMA = "doc_id long, text string, kept string, component_id string"


def sets(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, numerator):
    found = {i: sets(t) for i, t, *_ in rows if i is not None}
    above = {i: i for i in found}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(found)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(found[a] & found[b])
            if common and 100 * common >= numerator * (len(found[a]) + len(found[b]) - common):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(found[i]), top(i)) for i in ids}


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(3, 300))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 3 + len(copy) // 60)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(30)]
    chain = [word() for _ in range(100)]
    for step in range(12):  # each like the one before, the ends unlike
        rows.append(" ".join(chain[step * 4 : step * 4 + 60]))
    rows += ["one two", "One  TWO", "one two three four five", "É x", "é x", "same"] + ["same words over and over again"] * 20
    rng.shuffle(rows)
    return [(i + 10, t, "c", "c") for i, t in enumerate(rows)] + [(1, None, "", ""), (2, "", "", ""), (3, " \t\x0b\n", "", ""), (4, " ", "", ""), (5, " ", "", "")]


def test_equals_brute_force(spark):
    rows = corpus()
    for numerator, bands in ((85, 24), (80, 36)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), numerator=numerator, bands=bands).collect()}
        assert got == brute(rows, numerator)


def test_large_mixed_buckets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", 2)
    monkeypatch.setattr(near_dup, "BLOCKS_A_PART", 1)
    rows = corpus(9)  # buckets of one value each: those of the common passage hold many components
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), bands=60, rows=1).collect()}
    assert got == brute(rows, 85)


def test_large_mixed_buckets_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 3)
    for seed, numerator in ((9, 85), (10, 80)):
        rows = corpus(seed)
        rows += [(rows[i][0], rows[i + 1][1], "", "") for i in range(0, 20, 5)]  # ids of two texts
        once = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), numerator=numerator, bands=60, rows=1).select("doc_id", "component_id").distinct().collect()
        monkeypatch.setattr(near_dup, "LARGE_BUCKET", 1 << 40)
        whole = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), numerator=numerator, bands=60, rows=1).select("doc_id", "component_id").distinct().collect()
        monkeypatch.setattr(near_dup, "LARGE_BUCKET", 3)
        assert sorted(once) == sorted(whole)
        plain = corpus(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(plain, SCHEMA).repartition(3), numerator=numerator, bands=60, rows=1).collect()}
        assert got == brute(plain, numerator)


def test_rare_keys_split_a_common_passage(spark):
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**63, 60).astype(np.uint64)
    held = [np.unique(np.r_[passage, rng.integers(0, 2**63, 40).astype(np.uint64)]) for _ in range(80)]
    held[7] = np.unique(np.r_[held[6][:97], held[6][97:] + np.uint64(1)])
    rows = [(i, bytearray(x.tobytes())) for i, x in enumerate(held)]
    members = spark.createDataFrame([(i, i) for i in range(80)], "id long, component long")
    got = near_dup.rare_keys(members, spark.createDataFrame(rows, "id long, shingles binary"), 85).collect()
    assert {r["id"] for r in got} == {6, 7}  # the others share the passage alone, which is frequent


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e f", "", ""), (7, "x y", "", ""), (7, "x y", "", ""), (6, "x y", "", ""), (8, None, "", "")]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, -1, True), (6, 6, True), (7, 6, False), (7, 6, False), (8, 8, True)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
    got = near_duplicates(spark.createDataFrame([(1, text, "", ""), (2, text + " end", "", "")], SCHEMA)).collect()
    assert {r["component_id"] for r in got} == {1} and {r["n_shingles"] for r in got} == {59_996, 59_997}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (7, 60, 2000):
        agree = []
        for _ in range(60):
            x = rng.integers(0, 2**63, n + n // 4 + 1).astype(np.uint64)
            a, b = np.unique(x[:n]), np.unique(x[n // 4 :])
            agree.append((signature(a) == signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agree)) < 0.05
    assert len(signature(shingles("one"))) == BINS


def test_blocks_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**40, 300).astype(np.uint64)
    docs = [np.unique(np.r_[base[: 300 - k], rng.integers(0, 2**40, k).astype(np.uint64)]) for k in range(0, 60, 3)]
    ids = list(range(len(docs)))
    got = links_between(ids, ids, docs, ids, ids, docs, 85)
    linked = [(a, b) for a in ids for b in ids if a < b and 100 * len(np.intersect1d(docs[a], docs[b])) >= 85 * len(np.union1d(docs[a], docs[b]))]

    def groups(edges):
        above = {i: i for i in ids}

        def top(x):
            while above[x] != x:
                x = above[x]
            return x

        for a, b in edges:
            x, y = top(a), top(b)
            above[max(x, y)] = min(x, y)
        return [top(i) for i in ids]

    assert groups(got) == groups(linked)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    names = rng.sample(range(10_000), 300)
    edges = list(zip(names[:99], names[1:100], strict=True)) + [(names[100], n) for n in names[101:200]] + [(names[200], names[201]), (names[201], names[202]), (names[202], names[200])]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    for part in (names[:100], names[100:200], names[200:203]):
        assert {got[n] for n in part} == {min(part)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("most", [1 << 23, 4])
def test_filter_of_ids_keeps_all(spark, monkeypatch, most):
    monkeypatch.setattr(near_dup, "MOST_BITS", most)
    docs = spark.range(3000).selectExpr("id", "cast(id as string) text")
    ids = spark.range(0, 3000, 7)
    got = {r["id"] for r in near_dup.likely_among(docs, ids).collect()}
    assert got >= set(range(0, 3000, 7)) and (len(got) == 3000) == (most == 4)


def test_open_buckets_send_each_set_once(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdef", k=6))
    rows = []
    for f in range(3):
        base = [word() for _ in range(200)]
        for v in range(8):  # unlike enough to be no links, like enough to meet in many bands
            copy = list(base)
            for at in rng.sample(range(200), 4):
                copy[at] = word()
            rows.append((10 * f + v, " ".join(copy), "", ""))
    sent, plain = [], near_dup.block_links

    def seen(open_, *args):
        sent.append((open_.count(), open_.select("id").distinct().count()))
        return plain(open_, *args)

    monkeypatch.setattr(near_dup, "block_links", seen)
    for large in (256, 3):  # buckets of more members aren't gathered
        monkeypatch.setattr(near_dup, "LARGE_BUCKET", large)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert got == brute(rows, 85)
    assert sent[0][0] == sent[0][1] > 10  # before: a row for each band in which an id met others


def test_gathered_buckets_stay_together(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "LARGE_BUCKET", 4)
    small, large = [(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (3, 10)], [(7, i) for i in range(20, 24)] + [(8, 23), (8, 24)]
    got = near_dup.gathered(spark.createDataFrame([(k, i, i) for k, i in small + large], "key long, id long, component long")).collect()
    assert sorted((r["key"], r["id"]) for r in got) == sorted(large + [(10, i) for i in (10, 11, 12)])
