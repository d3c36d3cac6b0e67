from pyspark.sql import functions as F

from wikiloom.operators.blocks import blocks, page_blocks
from wikiloom.operators.chunker import ChunkOptions, chunks


def of(spark, text, title="T", **options):
    df = spark.createDataFrame([(1, title, text)], "id long, title string, text string")
    return chunks(df, ChunkOptions(**options)).orderBy("chunk_index").collect()


def kinds(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return [(r["type"], r["level"], r["content"]) for r in blocks(df).orderBy("block").collect()]


def test_page_blocks():
    page = "<div>bare</div><h2>A</h2><p>x <code>y</code><p>open<ul><li>a<ul><li>b</li></ul><li>c</ul><pre>1\n 2</pre><blockquote><p>q</p></blockquote><table><tr><td>1<td>2<tr><th>3</table><p> </p><h1></h1>"
    assert page_blocks(page) == [
        ("heading", 2, "A"), ("paragraph", None, "x y"), ("code", None, "y"), ("paragraph", None, "open"),
        ("list", None, "• ab\n• b\n• c"), ("code", None, "1\n 2"), ("quote", None, "q"), ("table", None, "1 | 2\n3"),
    ]


def test_markdown_blocks(spark):
    text = "# One\r\nline a\n- taken in\n\n- x\n2. y\nplain\n```\ncode # no\n\n```\n```\n```\n####### seven\n## \n```\nopen"
    assert kinds(spark, text) == [
        ("heading", 1, "One"), ("paragraph", None, "line a - taken in"), ("list", None, "• x\n• y"), ("paragraph", None, "plain"),
        ("code", None, "code # no\n"), ("paragraph", None, "####### seven"), ("heading", 2, ""), ("code", None, "open"),
    ]


def test_heading_paths_and_header(spark):
    got = of(spark, "first\n\n# A\n\na\n\n## B\n\nb\n\n### C\n\nc\n\n## D\n\nd", min_tokens=0)
    assert [r["heading_path"] for r in got] == ["", "A", "A > B", "A > B > C", "A > D"]
    assert [r["content"] for r in got][:2] == ["[T]\nfirst", "[T > A]\n# A\n\na"]
    assert [r["start_position"] for r in got] == [0] + [sum(len(x["content"]) for x in got[: i + 1]) for i in range(len(got) - 1)]
    assert {r["split_strategy"] for r in got} == {"section"}


def test_no_title_no_header(spark):
    assert of(spark, "just text", title=None)[0]["content"] == "just text"


def test_hard_split_strategy_and_overlap(spark):
    got = of(spark, " ".join(f"w{i}" for i in range(301)), overlap_tokens=0, max_characters=10_000, min_tokens=0)
    assert [len(r["content"].split("\n", 1)[1].split()) for r in got] == [150, 150, 1]
    assert {r["split_strategy"] for r in got} == {"hard"}
    with_overlap = of(spark, " ".join(f"w{i}" for i in range(301)), max_characters=10_000, min_tokens=0)
    assert with_overlap[1]["content"].split("\n\n")[0].split()[-1] == "w149"
    assert len(with_overlap[1]["content"].split("\n", 1)[1].split("\n\n")[0].split()) == 38


def test_paragraphs_pack_within_budget(spark):
    parts = [" ".join(f"p{k}w{i}" for i in range(60)) + "." for k in range(6)]
    got = of(spark, "\n\n".join(parts), overlap_tokens=0, min_tokens=0)
    assert {r["split_strategy"] for r in got} == {"paragraph"}
    assert all(r["token_count"] <= 302 and len(r["content"].split("\n", 1)[1]) <= 1000 for r in got)
    assert " ".join(r["content"].split("\n", 1)[1] for r in got).split() == " ".join(parts).split()


def test_sentence_overlap_takes_last_sentence(spark):
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(120))
    got = of(spark, text, min_tokens=0)
    assert {r["split_strategy"] for r in got} == {"sentence"}
    last = got[0]["content"].split("\n\n")[-1]
    assert last in got[1]["content"].split("\n\n")[0]


def test_tiny_chunks_merge(spark):
    long = " ".join(f"w{i}" for i in range(100)) + "."
    got = of(spark, "\n\n".join([long, long, "Short end."]), overlap_tokens=0)
    assert got[-1]["content"].endswith("\n\n[T]\nShort end.") or "Short end." in got[-1]["content"]
    assert [r["chunk_index"] for r in got] == list(range(len(got)))


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "t", None), (2, None, ""), (3, "t", " \n ")], "id long, title string, text string")
    assert chunks(df).count() == 0
    assert chunks(df.where(F.lit(False))).count() == 0


def test_few_pages_are_held_at_once(monkeypatch):
    """A tree goes with its page, without waiting for the collector; blocks go back for a few pages at a time."""
    import gc

    import pyarrow as pa

    from wikiloom.operators import blocks as module

    gc.collect()
    gc.disable()
    try:
        before = sum(isinstance(x, module.Node) for x in gc.get_objects())
        assert module.page_blocks("<div><p>a</p><ul><li>b</ul></div>" * 50)
        assert sum(isinstance(x, module.Node) for x in gc.get_objects()) == before
    finally:
        gc.enable()
    monkeypatch.setattr(module, "PAGES_CHARS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["x" * 6, None, "y" * 6, "z"])], names=["id", "text"])
    assert [(i.to_pylist(), p) for i, p in module._few(batch)] == [([1, 2, 3], ["x" * 6, None, "y" * 6]), ([4], ["z"])]


def test_words_of_a_piece_are_counted_once(spark):
    from pyspark.sql import functions as F

    from wikiloom.operators.chunker import ChunkOptions, pack

    found = spark.createDataFrame([(["a b", "c d", "", "e"],)], "p array<string>").select(pack(F.col("p"), ChunkOptions(max_tokens=6)).alias("c"))
    assert found.first()["c"] == ["a b\n\nc d", "e"]
    assert found._jdf.queryExecution().analyzed().toString().count("\\S+") == 1
