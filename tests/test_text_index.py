import itertools
import random
import re

import pytest

from wikiloom.functions.lexemes import query_prefixes
from wikiloom.operators import retrieval, text_index, text_query
from wikiloom.operators.text_query import Every, Phrase, Some, Without, cover_density, cover_ranked, covers, every, matching, phrase, prefix, some, web_condition, without, word

from .measures import shuffled

VOCABULARY = ["löner", "lön", "semester", "semesterdagar", "the", "other", "of", "is", "a1", "dag", "mail", "info"]


def texts(spark, seed=1, n=60, first=0):
    rnd = random.Random(seed)
    make = lambda m: " ".join(rnd.choice(VOCABULARY) + rnd.choice(("", ",", ".", "-x")) for _ in range(rnd.randrange(m)))
    rows = [(first + i, rnd.choice((None, "", make(4))), rnd.choice((None, "", *(make(40) for _ in range(8))))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "page_id long, title string, content string")


def scores(df, id_col="page_id"):
    return [(r[id_col], round(r["score"], 6)) for r in df.collect()]


def test_ranks_equal_those_of_texts(spark, monkeypatch):
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(text_index, "BLOCK_IDS", 5)
    _, df = texts(spark)
    pages = text_index.build(df, ("title", "content"), "page_id")
    chunks = text_index.build(df, ("content",), "page_id")
    assert pages.blocks == 12
    for question in ("löner semester", "the dag", "kontaktinfo", "Semesterdagar?"):
        assert query_prefixes(question)
        for k in (None, 1, 5, 100):
            assert scores(text_index.weighted_top_k(pages, question, k=k)) == scores(retrieval.weighted_top_k(df, question, k=k)), (question, k)
            assert scores(text_index.lexical_top_k(chunks, question, "page_id", k)) == scores(retrieval.lexical_top_k(df, question, "page_id", k=k or 1000)), (question, k)


def test_prefix_prunes_row_groups(spark):
    _, df = texts(spark)
    index = text_index.build(df, ("content",), "page_id")
    plan = text_index.live(index, text_index.starts_with_any(text_index.F.col("term"), ["sem"]))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,sem)" in plan and "PartitionFilters" in plan


def test_segments(spark, tmp_path):
    rows, df = texts(spark)
    new, changed = texts(spark, 2, 30, 45)  # some are written again, some are new
    path = f"{tmp_path}/index"
    index = text_index.upsert(text_index.build(df, ("title", "content"), "page_id", path), changed, "page_id")
    gone = spark.createDataFrame([(3,), (50,), (999,), (None,)], "page_id long")
    index = text_index.delete(index, gone, "page_id")
    now = {r[0]: r for r in rows} | {r[0]: r for r in new}
    now = [r for i, r in now.items() if i not in (3, 50)]
    want = scores(retrieval.weighted_top_k(spark.createDataFrame(now, df.schema), "semester the", k=None))
    again = text_index.open_index(spark.newSession(), path)
    assert again == index or (again.segments, again.version) == ((1, 2, 3), 3)
    for at in (index, again):
        assert scores(text_index.weighted_top_k(at, "semester the", k=None)) == want
        assert scores(text_index.weighted_top_k(at, "semester the", k=7)) == want[:7]
    merged = text_index.merge(again)
    assert merged.segments == (4,) and scores(text_index.weighted_top_k(text_index.open_index(spark, path), "semester the", k=None)) == want
    back = text_index.upsert(merged, spark.createDataFrame([(3, "the", "the the")], df.schema), "page_id")
    assert dict(scores(text_index.weighted_top_k(back, "the", k=None)))[3] == round(1 + 0.8 + 0.7, 6)
    assert text_index.build(df.where("false"), ("content",), "page_id").postings.count() == 0


def lexemes(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def holds(tokens, part):
    if isinstance(part, Every):
        return all(holds(tokens, p) for p in part.parts)
    if isinstance(part, Some):
        return any(holds(tokens, p) for p in part.parts)
    if isinstance(part, Without):
        return not holds(tokens, part.part)
    return bool(places(tokens, part))


def places(tokens, part):
    if isinstance(part, Phrase):
        n = len(part.words)
        return [i + 1 for i in range(len(tokens) - n + 1) if all(tokens[i + j] == w.text for j, w in enumerate(part.words))]
    return [i + 1 for i, t in enumerate(tokens) if (t.startswith(part.text) if part.open else t == part.text)]


def brute_covers(groups):
    """Stretches that hold a place of each group, and no smaller such stretch."""
    all_ = sorted({x for g in groups for x in g})
    full = [(a, b) for a in all_ for b in all_ if a <= b and all(any(a <= x <= b for x in g) for g in groups)]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return [(a, b, sum(a <= x <= b for x in all_)) for a, b in sorted(least)]


@pytest.mark.parametrize("seed", range(30))
def test_covers_are_the_smallest(seed):
    rnd = random.Random(seed)
    groups = [sorted(rnd.sample(range(1, 30), rnd.randrange(0, 8))) for _ in range(rnd.randrange(1, 4))]
    assert list(covers(groups)) == brute_covers(groups)


def test_density_of_one_word_counts_it():
    assert round(cover_density([[1, 5, 9]]), 9) == 0.3
    assert round(cover_density([[1], [2]]), 9) == 0.1 and round(cover_density([[1], [4]]), 9) == round(0.1 / 3, 9)


CONDITIONS = [
    every(word("The"), word("dag")), every(prefix("sem"), some(word("mail"), phrase("of the")), without(word("is"))), some(word("löner"), every(word("a1"), word("info"))), phrase("the the of"), phrase("of the"),
    every(word("the"), without(some(word("of"), prefix("s")))), some(phrase("x of"), word("none")), every(phrase("a1 x"), word("x")),
]


def test_conditions_equal_brute_force(spark):
    rows, df = texts(spark, 4, 120)
    index = text_index.build(df, ("content",), "page_id")
    for condition in CONDITIONS:
        assert {r["id"] for r in matching(index, condition).collect()} == {i for i, _, t in rows if holds(lexemes(t), condition)}, condition
    for condition in CONDITIONS[:2] + CONDITIONS[3:5] + CONDITIONS[7:]:
        parts = [p for p in (condition.parts if isinstance(condition, Every) else (condition,)) if not isinstance(p, Without)]
        groups = lambda tokens, parts=parts: [sorted(set(itertools.chain(*(places(tokens, p) for p in (g.parts if isinstance(g, Some) else (g,)))))) for g in parts]
        want = {i: round(sum(0.1 / (1 + b - a - (n - 1)) for a, b, n in brute_covers(groups(lexemes(t)))), 9) for i, _, t in rows if holds(lexemes(t), condition)}
        assert {r["id"]: round(r["rank"], 9) for r in cover_ranked(index, condition).collect()} == want, condition
    for refused in (without(word("a")), every(), some(word("a"), without(word("b")))):
        with pytest.raises(ValueError, match="condition"):
            matching(index, refused)
    with pytest.raises(ValueError, match="conjunctions"):
        cover_ranked(index, CONDITIONS[2])


def test_what_people_write():
    assert web_condition('lön "days off" -utkast mail or Post') == every(word("lön"), phrase("days off"), without(word("utkast")), some(word("mail"), word("post")))
    assert web_condition("or a or b or c") == every(word("or"), some(word("a"), word("b"), word("c")))
    assert web_condition('e-mail -"x y"') == every(phrase("e mail"), without(phrase("x y")))
    assert web_condition("?? -") == every()


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Postings are made where their block is; parts of a block, and rows of one id, change no rank."""
    rnd = random.Random(5)
    made = [(i, "", " ".join(f"w{rnd.randrange(3000)}" for _ in range(200))) for i in range(1500)]
    df = spark.createDataFrame(made, "page_id long, title string, content string").localCheckpoint()
    before = shuffled(spark)
    text_index.build(df, ("content",), "page_id")
    assert shuffled(spark) - before < 1.5 * sum(len(r[2]) for r in made)
    monkeypatch.setattr(text_index, "HELD_WORDS", 30)
    monkeypatch.setattr(text_index, "BLOCK_IDS", 20)
    _, few = texts(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        index = text_index.build(few, ("title", "content"), "page_id")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert index.postings.groupBy("term", "field", "block").count().where("count > 1").count()
    for k in (None, 4):
        assert scores(text_index.weighted_top_k(index, "löner semester", k=k)) == scores(retrieval.weighted_top_k(few, "löner semester", k=k))
    twice = spark.createDataFrame([(1, "", "the other"), (1, "", "the"), (2, "", "other"), (2, "", "")], few.schema)
    assert [(r["id"], sorted(r["places"])) for r in text_index.live(text_index.build(twice, ("content",), "page_id"), text_index.F.col("term") == "the").collect()] == [(1, [1, 1])]
