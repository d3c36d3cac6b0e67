import math

from pyspark.sql import functions as F

from wikiloom.functions import english, lexemes, text, vectors
from wikiloom.operators import retrieval


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_token_estimate(spark):
    assert [one(spark, text.token_estimate, v) for v in (None, "", "   ", "one", "one two three", "a " * 10)] == [0, 0, 0, 2, 4, 13]


def test_sentences_keep_abbreviations(spark):
    assert one(spark, text.sentences, "Se t.ex. Dr. Ek. Han kom. \"Ja!\" Nej? 3 st.") == ["Se t.ex. Dr. Ek.", "Han kom.", "\"Ja!\" Nej?", "3 st."]
    assert one(spark, text.sentences, "Kom över bev. Sen hem.") == ["Kom över bev. Sen hem."]
    assert one(spark, text.sentences, "  ") == []


def test_paragraphs_and_hard_pieces(spark):
    assert one(spark, text.paragraphs, "a\n \nb\n\n\n c \n\n") == ["a", "b", "c"]
    assert [len(p.split()) for p in one(spark, lambda c: text.hard_pieces(c, 300), "w " * 301)] == [150, 150, 1]
    assert one(spark, lambda c: text.hard_pieces(c, 300), "") == []


def test_slug(spark):
    assert one(spark, text.slugify, "Löner & Förmåner") == "loner-formaner"
    assert one(spark, text.slugify, "---") == ""
    assert len(one(spark, text.slugify, "x" * 130)) == 120


def test_excerpt_escape_citations(spark):
    assert one(spark, text.excerpt, "x" * 201) == "x" * 200 + "..."
    assert one(spark, text.excerpt, "x" * 200) == "x" * 200
    assert one(spark, text.html_escape, "<a href=\"x\">&'") == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"
    assert one(spark, text.without_citations, "Ja [1], nej [2, 3].") == "Ja, nej."
    assert one(spark, text.answer_fields, "```json\n{\"grounded\": true, \"answer\": \"x\"}\n```").asDict() == {"grounded": True, "answer": "x"}
    assert one(spark, text.kilobytes, 1536, "long") == "1.5 kB"
    assert one(spark, text.capped_page, "y" * 120_001).endswith("…(avkortat)")


def test_vectors(spark):
    def pair(f, a, b):
        v = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(f(F.col("a"), F.col("b")).alias("y")).first()["y"]
        return None if v is None else round(v, 9)

    assert pair(vectors.cosine, [1.0, 0.0], [2.0, 0.0]) == 1
    assert pair(vectors.cosine, [1.0, 0.0], [-2.0, 0.0]) == -1
    assert pair(vectors.cosine, [0.0, 0.0], [1.0, 0.0]) == 0
    assert pair(vectors.cosine, None, [1.0]) == 0
    assert pair(vectors.cosine, [1.0], [1.0, 0.0]) == 0
    assert pair(vectors.sql_cosine, None, [1.0]) is None
    assert pair(vectors.sql_cosine, [1.0], [1.0, 1.0]) == round(1 / math.sqrt(2), 9)
    assert math.isnan(pair(vectors.strict_cosine, [0.0], [1.0]))
    assert pair(vectors.l2_distance, [0.0, 3.0], [4.0, 0.0]) == 5
    assert one(spark, vectors.l2_normalize, [3.0, 4.0], "array<double>") == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize, [0.0], "array<double>") == [0.0]


def test_string_hash_and_dummy_embedding(spark):
    def java_hash(s):
        h = 0
        raw = s.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (31 * h + int.from_bytes(raw[i : i + 2], "little")) & 0xFFFFFFFF
        return abs(h - (1 << 32) if h >= 1 << 31 else h)

    for s in ("", "a", "Löner", "smile 😀 here", "polygenelubricants" * 3):
        assert one(spark, vectors.string_hash, s) == java_hash(s)
    e = one(spark, vectors.dummy_embedding, "abc")
    assert len(e) == 768 and abs(sum(x * x for x in e) - 1) < 1e-9 and e == one(spark, vectors.dummy_embedding, "abc")


def test_question_terms():
    assert lexemes.focus_terms("Hur är det med löner, och den?") == ["hur", "löner"]
    assert lexemes.expand_terms("epost") == ["epost", "mail", "e post"]
    assert lexemes.query_prefixes("epost") == ["epost", "mail", "post"]
    assert lexemes.like_patterns("och") == ([""], [""])
    assert lexemes.query_prefixes("och att") == []


def test_ranks(spark):
    tokens = lexemes.lexemes(F.col("x"))
    df = spark.createDataFrame([("The then other THE",), (None,)], "x string")
    assert [r["n"] for r in df.select(lexemes.hits(tokens, ["the"]).alias("n")).collect()] == [3, 0]
    rank = df.select(lexemes.frequency_rank(tokens, "the").alias("r")).first()["r"]
    assert abs(rank - 0.1 * (1 + 1 / 4) / 1.64493406685) < 1e-12


def test_counts_in_the_text_equal_those_of_lexemes(spark):
    texts = ["The theory; other the_the, l\u00f6nen L\u00d6NER!", "x2the the2", "", None, "the", "\u00f6the the\u00e9"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    tokens = lexemes.lexemes(F.col("x"))
    for prefixes in (["the"], ["the", "theo", "l\u00f6n"], []):
        rows = df.select(lexemes.hits(tokens, prefixes).alias("a"), lexemes.text_hits(lexemes.lowered(F.col("x")), prefixes).alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows]
    rows = df.select(lexemes.frequency_rank(tokens, "the").alias("a"), lexemes.rank_of_count(lexemes.term_count(F.col("x"), "the")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_letters_beyond_ffff_stand_before_a_prefix(spark):
    df = spark.createDataFrame([("\U0001d400the \U00010428and \u00e4the",), ("\U0001f600the the\U0001d400 (and \U0001f600\U0001d400the",)], "x string")
    rows = df.select(lexemes.text_hits(lexemes.lowered(F.col("x")), ["the", "and"]), lexemes.hits(lexemes.lexemes(F.col("x")), ["the", "and"]), lexemes.term_count(F.col("x"), "the")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0), (3, 3, 1)]


def test_hard_split_of_a_long_text(spark):
    import time

    start = time.time()
    assert len(one(spark, lambda c: text.hard_pieces(c, 300), "word " * 80_000)) == 534
    assert time.time() - start < 10


STEMS = """consigned consign consistency consist consolatory consolatori consolingly consol conspicuously conspicu
conspirators conspir constables constabl knackeries knackeri kneaded knead knightly knight knitting knit knives knive
generously generous generate generat communication communic ties tie cries cri gas gas this this kiwis kiwi hoping hope
hopping hop luxuriated luxuri say say happy happi rational ration relational relat agreed agre feed feed skies sky
proceeds proceed inning inning controlled control geology geolog dying die by by youth youth a a""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    df = spark.createDataFrame([*pairs, (None, None)], "word string, want string")
    assert [r["word"] for r in df.where(~english.stems("word").eqNullSafe(F.col("want"))).collect()] == []
    assert english.question_stems("Do the Knights' knives knit, knitting?") == ["knight", "knive", "knit"]


def test_search_by_stems(spark):
    texts = ["The knights hoped; a KNIGHT hopes", "knight", "hoping knights, hopping", None, "", "the of and"]
    pages = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, None, "x")], "page_id long, content string, stem string")
    rank = lambda n: sum(0.1 / j**2 for j in range(1, n + 1)) / 1.64493406685
    got = [(r["page_id"], round(r["rank"], 9)) for r in retrieval.search_english(pages, "the hope of knights").collect()]
    assert got == [(0, round(2 * rank(2), 9)), (2, round(2 * rank(1), 9))]
    for nothing in ("of the", ""):
        assert retrieval.search_english(pages, nothing).count() == 0
    assert retrieval.search_english(pages.limit(0), "knights").count() == 0
