"""Each stage of the pipeline on its own input, and the whole."""

import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
import pytest
from tests.llm.test_near_dup import brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "near_dedup", "pii", "mixing", "packing"]
    kept = stages["quality"](spark, docs, FOLDER).cache()
    assert kept.columns == COLUMNS
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert all(i in ids for i, q in labels.items() if q == 1)
    assert sum(i in ids for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values()) + 1

    once = stages["near_dedup"](spark, kept, FOLDER).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert once.columns == COLUMNS
    assert {r["doc_id"] for r in once.collect()} == {i for i, (_, top) in brute(rows, 80).items() if i == top}

    private = stages["pii"](spark, once, FOLDER).cache()
    assert private.columns == COLUMNS and private.count() == once.count()
    old, new = ({r["doc_id"]: r["text"] for r in t.collect()} for t in (once, private))
    assert any(old[i] != new[i] for i in old) and all(r["n_chars"] == len(r["text"]) for r in private.collect())

    mixed = stages["mixing"](spark, private, FOLDER).cache()
    assert mixed.columns == COLUMNS
    words = lambda t: sum(len((r["text"] or "").split()) for r in t.collect())
    longest = private.groupBy("source").agg({"text": "max"}).count() * max(len(t.split()) for t in new.values())
    assert abs(words(mixed) - 1.5 * words(private)) <= longest and {r["text"] for r in mixed.collect()} <= set(new.values())

    packed = stages["packing"](spark, mixed, FOLDER)
    library = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    tokens = sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert packed.agg({"length": "sum"}).first()[0] == tokens


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the river and the tree.", None, None, 5), (3, "a b c", "en", None, 5), (3, "a b c", "en", None, 5), (4, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        stage(spark, docs, FOLDER).collect()
        stage(spark, docs.where("false"), FOLDER).collect()
    once = cp.near_dedup(spark, docs, FOLDER).collect()
    assert sorted((r["doc_id"] or -1) for r in once) == [-1, 1, 2, 3]


CLASHING = "score double, predicted int, held_out string, pii_spans string, `__row` int, `__key` string, row string, id int, mark string"


def test_extra_columns_pass(spark):
    extra = (0.5, 7, "h", "p", 1, "k", "r", 3, "m")
    rows = [(i, f"the river number {i} runs under the old bridge, call 555-123-45{i:02d} for more.", "en", "s", 1, *extra) for i in range(12)]
    rows += [(20, "w " * 300_000 + "end.", "en", "s", 1, *extra), (21, None, None, None, None, *[None] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns, name
        assert {tuple(r)[5:] for r in got.collect()} <= {extra, (None,) * 9}, name
    assert cp.packing(spark, docs, FOLDER).agg({"doc_id": "max"}).first()[0] == 21


def test_texts_that_share_an_id(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None), (4, ""), (5, "o p q r s"), (5, "o p q r s")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs.repartition(4), FOLDER).collect() if r["text"])
    assert got == [(1, "a b c d e f g"), (1, "h i j k l m n"), (5, "o p q r s")]


@pytest.mark.parametrize("ends", [(-(1 << 63), 5), (-(1 << 63), (1 << 63) - 1), (-(1 << 63) + 10, 0)])
def test_texts_that_share_the_least_id(spark, ends):
    low, high = ends
    rows = [(low, "a b c d e f g"), (low, "h i j k l m n"), (high, "h i j k l m n"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "o p q r s"), (high, "o p q r s")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs.repartition(4), FOLDER).collect())
    assert len(got) == 3 and {t for _, t in got} == {t for _, t in rows} and got[0][0] == low


def test_run(spark):
    """The whole run gives the rows of its stages, one after another; every document's ids are covered as often as the mix
    takes it, and every sequence is gapless and within its size."""
    found = cp.run(spark, FOLDER)
    assert found.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and cp.ORACLE_SQL is None
    rows = found.collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
    library = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    wanted, sizes = Counter(), {}
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        sizes[r["doc_id"]] = len(ids)
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            wanted[r["doc_id"], start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == wanted
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    ids = {r["doc_id"] for r in rows}
    assert {i: sum(r["length"] for r in rows if r["doc_id"] == i) % sizes[i] for i in ids} == dict.fromkeys(ids, 0)
