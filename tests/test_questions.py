import numpy as np
import pytest
from pyspark.sql import functions as F

from wikiloom.operators import questions, retrieval
from wikiloom.sources import canonical, keyed

from .measures import shuffled

FOLDER = "/root/testdata/sf0.001"


def table(spark, n=500, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    m = np.round(rng.normal(size=(n, dims)), 1)  # ties
    m[7] = 0
    m[20:40] = m[19]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [float("nan")] * dims), (903, []), (None, [1.0] * dims), (904, [None] + [1.0] * (dims - 1))]
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + odd, "chunk_id long, embedding array<double>").repartition(5)


def test_vectors_of_many_questions(spark, monkeypatch):
    monkeypatch.setattr(questions, "VECTOR_ROWS", 64)
    monkeypatch.setattr(questions, "QUESTION_ROWS", 16)
    m, df = table(spark)
    asked = df.where("chunk_id % 3 = 0 OR chunk_id >= 900 OR chunk_id IS NULL").withColumnRenamed("chunk_id", "question_id")
    got = {}
    for r in questions.vectors_top_k(df, asked, k=7).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    assert set(got) == {*range(0, 500, 3), 901} and got[901] == [(901, 1.0)]
    for q in range(0, 500, 3):
        score = unit @ unit[q]
        want = sorted(((-round(s, 9), i) for i, s in enumerate(score)))[:7]
        assert [(-s, i) for i, s in got[q]] == want, q
    assert questions.vectors_top_k(df, asked.where("false")).count() == 0 and questions.vectors_top_k(df.where("false"), asked).count() == 0


def test_thousand_questions_are_one_plan(spark):
    _, df = table(spark)
    asked = spark.range(1000).select(F.col("id").alias("question_id"), F.array(*(F.rand(i) - 0.5 for i in range(6))).alias("embedding"))
    found = questions.vectors_top_k(df, asked, k=3)
    assert found.count() == 3000


def test_words_of_many_questions(spark):
    texts = spark.createDataFrame([(1, "Löner och lön, semester"), (2, "semesterdagar semester the"), (3, None), (4, "lönen lön löner"), (5, "kontaktinfo: mail")], "chunk_id int, content string")
    asked = ["löner semester", "kontaktuppgifter", "om vi", "", None, "the lön lön"]
    got = {}
    for r in questions.lexical_top_k(texts, spark.createDataFrame(list(enumerate(asked)), "question_id int, question string"), k=3).orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    for i, q in enumerate(asked):
        want = [(r["chunk_id"], round(r["score"], 9)) for r in retrieval.lexical_top_k(texts, q or "", "chunk_id", k=3).collect()]
        assert got.get(i, []) == want, q


def test_hybrid_of_many_questions(spark):
    chunks, embeddings, pages = (f(spark, FOLDER) for f in (canonical.chunks, canonical.embeddings, canonical.pages))
    vectors = {r["chunk_id"]: r["embedding"] for r in embeddings.where("chunk_id IN (3, 8)").collect()}
    asked = [(1, "the and", vectors[3]), (2, "of", vectors[8]), (3, "other these", None)]
    found = questions.hybrid_chunks(chunks, embeddings, pages, spark.createDataFrame(asked, "question_id int, question string, embedding array<double>"))
    got = {}
    for r in found.orderBy("question_id", "rank").collect():
        got.setdefault(r["question_id"], []).append((r["chunk_id"], round(r["rrf"], 9)))
    for i, q, v in asked:
        want = retrieval.hybrid_chunks(chunks, embeddings, pages, q, v).orderBy(F.col("rrf").desc(), F.col("vector_rank").asc_nulls_last(), "lexical_rank", "chunk_id")
        assert got.get(i, []) == [(r["chunk_id"], round(r["rrf"], 9)) for r in want.collect()], q


@pytest.mark.parametrize(("name", "value"), [("id", 70_001), ("slug", "slug-4242")])
def test_lookups_leave_row_groups_out(spark, tmp_path, name, value):
    df = spark.range(100_000).select("id", F.concat(F.lit("slug-"), F.col("id").cast("string")).alias("slug"), F.repeat(F.lit("x"), 200).alias("text"))
    table_ = keyed.write_keyed(df, f"{tmp_path}/t", "id", ("slug",), distinct=20_000, row_group=1 << 18)
    found = keyed.lookup(keyed.open_keyed(spark, f"{tmp_path}/t"), **{name: value})
    assert [r["id"] for r in found.collect()] == [int(str(value).removeprefix("slug-"))] and table_.count() == 100_000
    found = keyed.lookup(table_, **{name: value})
    found.write.format("noop").mode("overwrite").save()
    rows = []
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collect()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        rows.append(leaves.apply(i).metrics().apply("numOutputRows").value())
    assert 0 < sum(rows) < 50_000


def test_words_meet_in_blocks(spark, monkeypatch):
    """No row for each word is shuffled; blocks of any size, and rows of one id, give what one question gives."""
    rng = np.random.default_rng(3)
    made = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 200)) for _ in range(1500)]
    texts = spark.createDataFrame(list(enumerate(made)), "chunk_id long, content string").localCheckpoint()
    asked = spark.createDataFrame([(i, f"w{i} w{i}1 w{i}2") for i in range(100, 160)], "question_id int, question string")
    before = shuffled(spark)
    whole = sorted(map(tuple, questions.lexical_top_k(texts, asked, k=5).collect()))
    assert len(whole) == 300 and shuffled(spark) - before < 1.5 * sum(map(len, made))
    monkeypatch.setattr(questions, "TEXT_ROWS", 7)
    monkeypatch.setattr(questions, "QUESTION_ROWS", 9)
    monkeypatch.setattr(questions, "KEPT_COUNTS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert sorted(map(tuple, questions.lexical_top_k(texts, asked, k=5).collect())) == whole
        halves = texts.selectExpr("chunk_id", "explode(array(substring(content, 1, 300), substring(content, 301, 9999))) AS content")
        joined = halves.groupBy("chunk_id").agg(F.array_join(F.collect_list("content"), " ").alias("content"))
        assert sorted(map(tuple, questions.lexical_top_k(halves, asked, k=5).collect())) == sorted(map(tuple, questions.lexical_top_k(joined, asked, k=5).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
