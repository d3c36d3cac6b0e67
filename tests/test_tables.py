
from pyspark.sql import functions as F

from wikiloom.operators import context, links, retrieval, tables
from wikiloom.sources import wiki


def test_upsert_keeps_id_and_creation(spark):
    old = spark.createDataFrame([(1, "a", 1, "x"), (2, "b", 5, "y")], "id int, key string, version int, body string")
    new = spark.createDataFrame([(9, "a", 2, "new"), (8, "b", 4, "stale"), (7, "c", 1, "added")], old.schema)
    got = {r["key"]: (r["id"], r["body"]) for r in tables.upsert_latest(old, new, ["key"], F.col("version"), ("id",)).collect()}
    assert got == {"a": (1, "new"), "b": (2, "y"), "c": (7, "added")}


def test_replace_children_twice_is_the_same(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "page_id int, chunk_index int, content string")
    new = spark.createDataFrame([(1, 5, "n")], old.schema)
    once = tables.replace_children(old, new, "page_id", "chunk_index")
    rows = sorted(map(tuple, once.collect()))
    assert rows == [(1, 0, "n"), (2, 0, "c")]
    assert sorted(map(tuple, tables.replace_children(once, new, "page_id", "chunk_index").collect())) == rows


def test_delete_stale_cascade_bytes_edges_log(spark):
    have = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "page_id int, key string")
    keep = spark.createDataFrame([(1, "y")], have.schema)
    assert tables.delete_stale(have, keep, "page_id", "key").collect() == [(1, "y")]
    assert tables.stale(have, keep, "page_id", "key").count() == 2
    assert tables.cascade(have, spark.createDataFrame([(2,)], "page_id int"), "page_id", "page_id").collect() == [(2, "z")]
    stored = spark.createDataFrame([("a", b"old"), ("b", b"b")], "key string, file_data binary")
    fresh = spark.createDataFrame([("a", b"new"), ("b", None)], stored.schema)
    assert {r["key"]: bytes(r["file_data"]) for r in tables.set_bytes(stored, fresh, "key").collect()} == {"a": b"new", "b": b"b"}
    edges = spark.createDataFrame([(1, 2, "references")], "source_page_id int, target_page_id int, relationship_type string")
    assert tables.add_edges(edges, edges.drop("relationship_type")).count() == 1
    assert tables.sync_log(spark, "full", "ok", 3, 0).first()["items_processed"] == 3


def test_backfill_leaves_nothing(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "chunk_id int, content string")
    have = spark.createDataFrame([(1, [1.0], "m")], "chunk_id int, embedding array<double>, model string")
    added = tables.backfill(chunks, have, F.array(F.length("content").cast("double")), "m")
    assert added.count() == 1
    assert tables.pending_embeddings(chunks, have.unionByName(added)).count() == 0


def test_fusion_scores_and_tie(spark):
    vector = spark.createDataFrame([(i, float(100 - i)) for i in range(1, 21)], "id int, score double")
    lexical = spark.createDataFrame([(101, 9.0), (102, 8.0), (103, 7.0), (104, 6.0), (1, 5.0)], "id int, score double")
    got = {r["id"]: (i, r["rrf"]) for i, r in enumerate(retrieval.fuse(vector, lexical, "id", 50).collect())}
    assert abs(got[1][1] - (1 / 61 + 0.8 / 65)) < 1e-12 and got[1][0] == 0
    assert abs(got[20][1] - got[104][1]) < 1e-15 and got[20][0] < got[104][0]
    assert max(x for _, x in got.values()) <= 1.8 / 61
    assert retrieval.fuse(None, None, "id", 8) is None
    assert retrieval.fuse(None, lexical, "id", 3).count() == 3


def test_context_window_stops(spark):
    chunks = spark.createDataFrame([(1, 0, 100), (1, 1, 250), (1, 2, 50), (2, 0, 900)], "page_id int, chunk_index int, token_count int")
    assert [r["chunk_index"] for r in context.context_window(chunks, 300).collect()] == [0]
    totals = {r["page_id"]: (r["tokens_used"], r["chunks_included"]) for r in context.window_totals(chunks, 300).collect()}
    assert totals == {1: (100, 1), 2: (0, 0)}


def test_links(spark):
    html = "<a href='/pages/12/x?pageId=7'>a</a> <a class=x href=\"/v?a=1&pageId=8\">b</a><a href='/pages/12'>c</a><a href=''>d</a><ri:page ri:content-title=\"Home\" /><ri:page ri:space-key=\"OPS\" ri:content-title=\"Home\"/><ri:page ri:content-title=\"HOME\"/><ri:page/>"
    df = spark.createDataFrame([(html,), (None,)], "html string")
    got = df.select(links.linked_ids(F.col("html")).alias("ids"), links.linked_titles(F.col("html"), F.lit("DEF")).alias("t")).collect()
    assert got[0]["ids"] == ["12", "8"]
    assert [tuple(x) for x in got[0]["t"]] == [("DEF", "Home"), ("OPS", "Home")]
    assert got[1]["ids"] == [] and got[1]["t"] == []
    refs = spark.createDataFrame([(1, "A", "home"), (1, "A", "gone")], "source_id int, space string, title string")
    pages = spark.createDataFrame([(5, "A", "Home"), (6, "A", "HOME"), (7, "B", "Home")], "page_id int, space string, title string")
    assert links.resolve_titles(refs, pages).collect() == [(1, 5)]


def test_source_links(spark):
    found = spark.createDataFrame([(1, "Löner", "1", 0.9), (2, "File", "att:a b", 0.8), (3, "---", "3", 0.7), (4, None, "4", 0.6), (5, "x", "5", 0.5)], "page_id int, title string, external_id string, relevance double")
    assert [r["href"] for r in retrieval.source_links(found).collect()] == ["/doc/loner", "/attachment/a+b/raw?download=1", "/doc/dokument"]


def test_media_and_extraction(spark, tmp_path):
    files = spark.createDataFrame([("application/pdf", "a", b"x"), (None, "b.MD", "hé".encode()), ("text/html", "c", b"<p>"), ("image/png", "d.png", b"z"), (None, "e.html", b"q")], "media_type string, file_name string, content binary")
    got = wiki.extract_text(files, {"html": lambda b: "page", "pdf": lambda b: 1 / 0}).collect()
    assert [(r["kind"], r["text"]) for r in got] == [("pdf", ""), ("text", "hé"), ("html", "page"), ("unsupported", ""), ("unsupported", "")]
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert bytes(wiki.read_files(spark, f"file://{tmp_path}").first()["content"]) == b"abc"


def test_wiki_source(spark):
    df = wiki.read_wiki(spark, "tests.wiki_stub:fetch", total=120, limit=50)
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 120 and df.where("external_id = '7'").count() == 1


def test_wiki_that_grew(spark):
    assert wiki.read_wiki(spark, "tests.wiki_stub:fetch", total=60, limit=25).count() == 120
    assert wiki.read_wiki(spark, "tests.wiki_stub:fetch", limit=40).count() == 120


def test_attachment_listing(spark):
    pages = spark.createDataFrame([("1",), ("2",), ("3",), (None,)], "external_id string")
    got = wiki.list_attachments(pages, "tests.wiki_stub:attachments")
    assert {r["page_external_id"]: r["count"] for r in got.groupBy("page_external_id").count().collect()} == {"1": 250, "3": 100}
    assert got.select("external_id").distinct().count() == 350


def test_markup_without_a_reader(spark):
    files = spark.createDataFrame([("text/html", "c", "<p>é <b>x</b></p><script>no</script>".encode()), ("text/html", "n", None), ("application/pdf", "a", b"x")], "media_type string, file_name string, content binary")
    assert [r["text"] for r in wiki.extract_text(files).collect()] == ["é x", "", ""]


def test_embeddings_are_upserted(spark):
    old = spark.createDataFrame([(1, [1.0], "m"), (2, [2.0], "m")], "chunk_id int, embedding array<double>, model string").withColumn("created_at", F.to_timestamp(F.lit("2020-01-01")))
    new = spark.createDataFrame([(2, [5.0], "n"), (3, [3.0], "n"), (3, [4.0], "n")], "chunk_id int, embedding array<double>, model string")
    got = {r["chunk_id"]: r for r in tables.upsert_embeddings(old, new).collect()}
    assert {k: (r["embedding"], r["model"]) for k, r in got.items()} == {1: ([1.0], "m"), 2: ([5.0], "n"), 3: ([4.0], "n")}
    assert got[1]["created_at"].year == 2020 and got[2]["created_at"].year > 2020
    pages = spark.createDataFrame([(1, None), (2, [1.0])], "page_id int, embedding array<float>")
    set_ = tables.set_page_embeddings(pages, spark.createDataFrame([(1, [7.0])], "page_id int, embedding array<double>"))
    assert {r["page_id"]: r["embedding"] for r in set_.collect()} == {1: [7.0], 2: [1.0]}


def test_reprocessed_pages(spark):
    from wikiloom.operators.chunker import chunks

    pages = spark.createDataFrame([(1, "A", "new text"), (2, "B", "")], "id int, title string, text string")
    stored = chunks(spark.createDataFrame([(1, "A", "old"), (2, "B", "gone"), (3, "C", "kept")], "id int, title string, text string"))
    got = tables.reprocess(pages, stored, chunks).collect()
    assert sorted((r["id"], r["content"]) for r in got) == [(1, "[A]\nnew text"), (3, "[C]\nkept")]


def test_hybrid_search_leaves_orphans_out(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(60)], "chunk_id int, embedding array<double>")
    chunks = spark.createDataFrame([(i, i // 2, "lönen betalas" if i % 5 else "annat") for i in range(40, 60)], "chunk_id int, page_id int, content string")
    pages = spark.createDataFrame([(i, f"t{i}") for i in range(22, 40)], "page_id int, title string")
    got = retrieval.hybrid_chunks(chunks, vectors, pages, "lönen", [1.0, 0.0])
    assert got.count() == 8 and {r["page_id"] for r in got.collect()} <= set(range(22, 30))
    assert {r["chunk_id"]: r["vector_rank"] for r in got.collect()}[44] == 1
    none = retrieval.hybrid_chunks(chunks, vectors, pages, "och", None)
    assert none.columns == got.columns and none.count() == 0


def test_a_failing_branch_leaves_the_other(spark):
    import pytest

    chunks = spark.createDataFrame([(1, 1, "lönen betalas")], "chunk_id int, page_id int, content string")
    pages = spark.createDataFrame([(1, "t")], "page_id int, title string")
    broken = spark.createDataFrame([(1, [1.0])], "chunk_id int, embedding array<double>").withColumn("embedding", F.when(F.col("chunk_id") > 0, F.raise_error(F.lit("no index")).cast("array<double>")))
    with pytest.warns(UserWarning, match="vector branch"):
        got = retrieval.hybrid_chunks(chunks, broken, pages, "lönen", [1.0], isolated=True).collect()
    assert [(r["chunk_id"], r["vector_rank"], r["lexical_rank"]) for r in got] == [(1, None, 1)]


def test_prompt_with_history(spark):
    found = spark.createDataFrame([(1, "T", "c one", 0.5), (2, "U", "c two", 0.9)], "chunk_id int, title string, content string, rrf double")
    context_ = "[1] U\nc two\n\n---\n\n[2] T\nc one"
    assert retrieval.prompt(found).first().asDict() == {"context": context_}
    turns = [("system", "s"), ("user", "hej"), ("assistant", ""), ("assistant", "svar")]
    assert retrieval.prompt(found, "och sen?", turns).first()["prompt"] == f"Tidigare konversation (för att förstå följdfrågor):\nAnvändare: hej\nAssistent: svar\n\nFråga: och sen?\n\nUnderlag:\n{context_}"
    assert retrieval.prompt(found, "q").first()["prompt"].startswith("Fråga: q\n\nUnderlag:")



def test_statistics_tell_the_last_sync(spark):
    pages = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "page_id int, last_synced string")
    row = context.ai_statistics(pages, spark.createDataFrame([(5,)], "token_count int"), spark.createDataFrame([([1.0],), (None,)], "embedding array<double>")).first()
    assert (row["pages"], row["chunks"], row["tokens"], row["embeddings"], row["last_sync"]) == (2, 1, 5, 1, "2024-02-01")


def test_small_functions(spark):
    from wikiloom.functions import text as tx

    row = spark.range(1).select(tx.without_nul(F.lit("a\0b")).alias("nul"), tx.ascii_file_name(F.lit("lön 1.txt")).alias("name"), wiki.is_extractable(F.lit(None).cast("string"), F.lit("a.MD")).alias("md"), wiki.is_extractable(F.lit("image/png"), F.lit("a.png")).alias("png")).first()
    assert row["nul"] == "ab" and row["name"] == "l_n 1.txt" and row["md"] and not row["png"]
    files = spark.createDataFrame([("a", b"x", "t", None, "/w"), ("b", None, "t", None, "/w")], "external_id string, file_data binary, media_type string, download_url string, web_url string")
    assert wiki.stored_bytes(files, "a").first()["redirect"] is None and wiki.stored_bytes(files, "b").first()["redirect"] == "/w"


def test_history(spark):
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", ""), *[("user", str(i)) for i in range(6)]])], "conv_id int, turn int, role string, text string")
    assert sorted(r["turn"] for r in context.last_turns(turns).collect()) == [4, 5, 6, 7, 8, 9]


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, title string, last_synced timestamp_ntz")
    row = pages.agg(F.count(F.lit(1)).alias("n"), F.max("last_synced").alias("m")).first()
    assert row["n"] == 0 and row["m"] is None


def test_embedding_batches_and_failures(spark):
    from wikiloom.operators.embedding import embed_chunks, run_counters

    chunks = spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(250)], "chunk_id int, content string").coalesce(1)

    def flaky(texts):
        if "text 120" in texts:
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    got = embed_chunks(chunks, flaky, "m").collect()
    assert sum(r["status"] == "failed" for r in got) == 100 and len(got) == 250
    assert {r["chunk_id"]: r["embedding"] for r in got}[3] == [0.0, 1.0]
    counted = {r["status"]: r["chunks"] for r in run_counters(embed_chunks(chunks, flaky, "m", fall_back=True)).collect()}
    assert counted == {"ok": 150, "dummy": 100}
    assert len(embed_chunks(chunks.limit(1)).first()["embedding"]) == 768


def test_answers_fall_back(spark):
    import pytest

    pages = spark.createDataFrame([(1, "Löner", "Allt om lönen.")], "page_id int, title string, content string")
    chunks = spark.createDataFrame([(1, 1, "Lönen betalas den 25.")], "chunk_id int, page_id int, content string")
    none = spark.createDataFrame([], "chunk_id int, embedding array<double>")
    first = retrieval.answer(chunks, none, pages, "När kommer lönen?", None).first()
    assert first["answer"] == "Baserat på dokumentationen: Lönen betalas den 25...." and first["grounded"] and first["confidence"] == 0.4
    assert "Allt om lönen" in retrieval.answer(chunks.where("false"), none, pages, "När kommer lönen?", None).first()["answer"]
    assert not retrieval.answer(chunks, none, pages, "zzz qqq", None).first()["grounded"]
    with pytest.raises(ValueError):
        retrieval.answer(chunks, none, pages, "  ", None)


def test_plain_text(spark):
    from wikiloom.operators.blocks import plain_text

    df = spark.createDataFrame([(1, "<title>T</title><script>x</script><p>a&nbsp;b\n <b>c</b></p>"), (2, None)], "id int, text string")
    assert sorted(map(tuple, plain_text(df).collect())) == [(1, "Ta b c"), (2, None)]
