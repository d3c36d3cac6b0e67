"""Retrieval: lexical and vector branches, their fusion, sources and answers.

Ranks are taken on the few rows that a branch keeps, after its limit; page texts are joined last.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.functions.english import meaningful, question_stems, stems
from wikiloom.functions.lexemes import WEIGHT_A, WEIGHT_B, WEIGHT_D, holds_any, lexemes, like_patterns, lowered, query_prefixes, rank_of_count, term_count, text_hits
from wikiloom.functions.text import excerpt, slugify
from wikiloom.functions.vectors import cosine

# Results depend on them.
CANDIDATES, RRF_K, VECTOR_WEIGHT, LEXICAL_WEIGHT = 20, 60, 1.0, 0.8
FINAL_CHUNKS, FINAL_PAGES, SEARCH_PAGES, FOOTER_LINKS = 8, 3, 10, 3
TITLE_BONUS, CONTENT_BONUS, FALLBACK_SCORE = 0.50, 0.20, 0.1
SPEAKERS = {"user": "Användare", "assistant": "Assistent"}
HISTORY_HEAD, QUESTION_HEAD, CONTEXT_HEAD = "Tidigare konversation (för att förstå följdfrågor):", "Fråga: ", "Underlag:"
NO_ANSWER = ("Jag hittar inget om det i dokumentationen.", "Det finns inget svar i dokumentationen.", "Dokumentationen säger inget om det.")
ANSWER_PREFIX, ANSWER_LENGTH, ANSWER_CONFIDENCE = "Baserat på dokumentationen: ", 400, 0.4


def literal_vector(values: list[float]) -> Column:
    """A question's vector as a constant of the plan."""
    return F.array(*(F.lit(float(x)) for x in values))


def once(df: DataFrame, keep: tuple[str, ...], **values: Column) -> DataFrame:
    """The columns ``keep`` and ``values``, each computed once: a filter on one of them doesn't compute it again."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in values.items())))))


def vector_top_k(vectors: DataFrame, query: list[float], id_col: str, vector_col: str = "embedding", k: int = CANDIDATES, least: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """(id, score): the k rows most like the query by cosine; vectors that are null or give no number take no part, nor, with ``known`` (ids, each
    once), vectors of other ids. Scores are joined with the ids, not vectors."""
    scored = vectors.where(F.col(vector_col).isNotNull()).select(id_col, cosine(F.col(vector_col).cast("array<double>"), literal_vector(query)).alias("score")).where(~F.isnan("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    if known is not None:
        scored = scored.join(known, id_col)
    return scored.orderBy(F.col("score").desc(), id_col).limit(k)


def lexical_top_k(texts: DataFrame, question: str, id_col: str, text_col: str = "content", k: int = CANDIDATES) -> DataFrame:
    """(id, score): the k texts of the highest cover rank among those that match."""
    scored = once(texts, (id_col,), hits=text_hits(lowered(F.col(text_col)), query_prefixes(question))).where("hits > 0")
    return scored.select(id_col, (F.col("hits") * F.lit(WEIGHT_D)).alias("score")).orderBy(F.col("score").desc(), id_col).limit(k)


def weighted_top_k(pages: DataFrame, question: str, id_col: str = "page_id", k: int | None = CANDIDATES) -> DataFrame:
    """(id, score): pages by title (weight A) and content (weight B) hits, with bonuses for focus terms as substrings."""
    prefixes = query_prefixes(question)
    wide, focus = like_patterns(question)
    low = once(pages, (id_col,), title=lowered(F.col("title")), content=lowered(F.col("content")))
    tests = {"in_title": text_hits(F.col("title"), prefixes), "in_content": text_hits(F.col("content"), prefixes), "wide": holds_any(F.col("title"), wide) | holds_any(F.col("content"), wide)}
    bonus = F.when(holds_any(F.col("title"), focus), TITLE_BONUS).otherwise(0.0) + F.when(holds_any(F.col("content"), focus), CONTENT_BONUS).otherwise(0.0)
    found = once(low, (id_col,), **tests, bonus=bonus).where("in_title > 0 OR in_content > 0 OR wide")
    scored = found.select(id_col, (F.col("in_title") * F.lit(WEIGHT_A) + F.col("in_content") * F.lit(WEIGHT_B) + F.col("bonus")).alias("score"))
    ordered = scored.orderBy(F.col("score").desc(), id_col)
    return ordered.limit(k) if k else ordered


def substring_fallback(pages: DataFrame, question: str, id_col: str = "page_id", k: int = CANDIDATES) -> DataFrame:
    """(id, score) for a question without a usable term: pages that hold it as it is, newest first, one score for all."""
    pattern = f"%{question}%"
    return pages.where(F.col("title").ilike(pattern) | F.col("content").ilike(pattern)).select(id_col, F.lit(FALLBACK_SCORE).alias("score")).orderBy(F.col(id_col).desc()).limit(k)


def search_pages(pages: DataFrame, question: str, id_col: str = "page_id") -> DataFrame:
    """Pages whose title or content holds every term of the question, by frequency rank; the whole question as a
    substring will do too."""
    terms = question.lower().split()
    both = F.concat_ws(" ", "title", "content")
    held = F.coalesce(F.col("title").ilike(f"%{question}%"), F.lit(False)) | F.coalesce(F.col("content").ilike(f"%{question}%"), F.lit(False))
    counted = once(pages, (id_col, "title"), held=held, counts=F.array(*(term_count(both, t) for t in terms)).cast("array<int>"))
    every = F.lit(bool(terms)) & F.forall("counts", lambda n: n > 0)
    rank = sum((rank_of_count(F.col("counts")[i]) for i in range(len(terms))), F.lit(0.0))
    return counted.where(every | F.col("held")).select(id_col, "title", rank.alias("rank")).orderBy(F.col("rank").desc(), id_col)


def search_english(pages: DataFrame, question: str, id_col: str = "page_id", text_col: str = "content") -> DataFrame:
    """(id, rank): pages that hold the stem of every word of the question, stop words aside, by frequency rank.

    Only lexemes that begin like one of the stems are kept, and each is stemmed once for a page. A question of stop words
    finds nothing; null texts hold no words.
    """
    wanted = question_stems(question)
    first = sorted({w[0] for w in wanted})
    words = pages.select(id_col, F.explode(lexemes(F.col(text_col))).alias("word")).where(F.substring("word", 1, 1).isin(*first) & meaningful(F.col("word")))
    counted = once(words.groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n")), (id_col, "n"), stem=stems(F.col("word")))
    held = counted.where(F.col("stem").isin(*wanted)).groupBy(id_col, "stem").agg(F.sum("n").cast("int").alias("n"))
    ranked = held.groupBy(id_col).agg(F.count(F.lit(1)).alias("stems"), F.sum(rank_of_count(F.col("n"))).alias("rank"))
    return ranked.where(F.col("stems") == len(wanted)).select(id_col, "rank").orderBy(F.col("rank").desc(), id_col)


def _ranked(branch: DataFrame, id_col: str, weight: float, name: str) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), id_col))
    ranked = branch.withColumn(name, rank)  # the branch has its limit: these are CANDIDATES rows
    return ranked.select(id_col, (F.lit(weight) / (RRF_K + F.col(name))).alias("part"), F.col(name))


def fuse(vector: DataFrame | None, lexical: DataFrame | None, id_col: str, k: int) -> DataFrame | None:
    """Reciprocal rank fusion of two branches (id, score); a missing branch leaves the other. None if both are missing."""
    sides = [_ranked(b, id_col, w, n) for b, w, n in ((vector, VECTOR_WEIGHT, "vector_rank"), (lexical, LEXICAL_WEIGHT, "lexical_rank")) if b is not None]
    if not sides:
        return None
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
    for name in ("vector_rank", "lexical_rank"):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast("int"))
    fused = both.groupBy(id_col).agg(F.sum("part").alias("rrf"), F.min("vector_rank").alias("vector_rank"), F.min("lexical_rank").alias("lexical_rank"))
    return fused.orderBy(F.col("rrf").desc(), F.col("vector_rank").asc_nulls_last(), "lexical_rank", id_col).limit(k)


def branch(found: DataFrame | None, name: str, isolated: bool) -> DataFrame | None:
    """A branch of a hybrid search. ``isolated``: its CANDIDATES rows are fetched now, and one that fails is left out with a
    warning, so that the other branch still answers."""
    if found is None or not isolated:
        return found
    try:
        return found.sparkSession.createDataFrame(found.collect(), found.schema)
    except Exception as e:  # whatever the source or the index of this branch raises
        warnings.warn(f"the {name} branch failed, the other one answers alone: {e}", stacklevel=3)
        return None


def hybrid_chunks(chunks: DataFrame, embeddings: DataFrame, pages: DataFrame, question: str, query: list[float] | None, k: int = FINAL_CHUNKS, isolated: bool = False) -> DataFrame:
    """The best chunks of both branches, with their pages. Only vectors with a chunk and chunks with a page take part."""
    placed = chunks.join(pages.select("page_id"), "page_id", "left_semi")
    vector = vector_top_k(embeddings, query, "chunk_id", known=placed.select("chunk_id")) if query else None
    lexical = lexical_top_k(placed, question, "chunk_id") if query_prefixes(question) else None
    best = fuse(branch(vector, "vector", isolated), branch(lexical, "lexical", isolated), "chunk_id", k)
    if best is None:
        best = chunks.limit(0).select("chunk_id", F.lit(0.0).alias("rrf"), F.lit(None).cast("int").alias("vector_rank"), F.lit(None).cast("int").alias("lexical_rank"))
    return best.join(chunks.select("chunk_id", "page_id", "content"), "chunk_id").join(pages.select("page_id", "title"), "page_id").select("chunk_id", "page_id", "title", "content", "rrf", "vector_rank", "lexical_rank")


def hybrid_pages(pages: DataFrame, question: str, query: list[float] | None, k: int = FINAL_PAGES, isolated: bool = False) -> DataFrame:
    """The best pages of both branches; pages without vectors are found by their words alone."""
    vector = vector_top_k(pages, query, "page_id") if query and "embedding" in pages.columns else None
    lexical = weighted_top_k(pages, question) if query_prefixes(question) else substring_fallback(pages, question)
    best = fuse(branch(vector, "vector", isolated), branch(lexical, "lexical", isolated), "page_id", k)
    if best is None:
        best = pages.limit(0).select("page_id", F.lit(0.0).alias("rrf"), F.lit(None).cast("int").alias("vector_rank"), F.lit(None).cast("int").alias("lexical_rank"))
    return best.join(pages.select("page_id", "title", "content"), "page_id")


def best_per_page(found: DataFrame) -> DataFrame:
    """The best chunk of each page, the first of equals, as a source."""
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("rrf").desc(), "chunk_id"))
    return found.withColumn("rank", rank).where("rank = 1").select("page_id", "title", "chunk_id", excerpt(F.col("content")).alias("excerpt"), F.col("rrf").alias("relevance"))


def source_links(sources: DataFrame, k: int = FOOTER_LINKS) -> DataFrame:
    """The first links of a footer: pages by slug, attachments by id; pages without a slug have none."""
    title = F.when(F.coalesce("title", F.lit("")) == "", "Dokument").otherwise(F.col("title"))
    slug = slugify(title)
    href = F.when(F.col("external_id").startswith("att:"), F.concat(F.lit("/attachment/"), F.url_encode(F.substring("external_id", 5, 1 << 20)), F.lit("/raw?download=1"))).when(slug != "", F.concat(F.lit("/doc/"), slug))
    linked = sources.select("page_id", title.alias("title"), href.alias("href"), "relevance").where("href IS NOT NULL")
    return linked.orderBy(F.col("relevance").desc(), "page_id").limit(k)


def answer_without_model(found: DataFrame) -> DataFrame:
    """One row (answer, grounded, confidence, relevance): the found chunks' text, cut, where no model is at hand."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rrf")).alias("o"), F.col("chunk_id").alias("i"), F.col("content").alias("c")))), lambda x: x["c"])
    context = F.array_join(ordered, "\n\n")
    gathered = found.agg(context.alias("context"), F.count(F.lit(1)).alias("n"), F.max("rrf").alias("top")).where("n > 0")
    return gathered.select(F.concat(F.lit(ANSWER_PREFIX), F.substring("context", 1, ANSWER_LENGTH), F.lit("...")).alias("answer"), F.lit(True).alias("grounded"), F.lit(ANSWER_CONFIDENCE).alias("confidence"), F.least(F.lit(1.0), "top").alias("relevance"))


def usable_question(question: str | None) -> str:
    """The question, trimmed; an empty one is refused before any plan is made."""
    if not isinstance(question, str) or not question.strip():
        raise ValueError("a question is needed")
    return question.strip()


def answer(chunks: DataFrame, embeddings: DataFrame, pages: DataFrame, question: str, query: list[float] | None, no_answer: tuple[str, ...] = NO_ANSWER) -> DataFrame:
    """One row (answer, grounded, confidence, relevance): from chunks, else from pages, else a phrase that says so, which
    the question's hash picks."""
    question = usable_question(question)
    found = hybrid_chunks(chunks, embeddings, pages, question, query, isolated=True)
    if not found.isEmpty():
        return answer_without_model(found)
    by_page = hybrid_pages(pages, question, query, isolated=True).select(F.col("page_id").alias("chunk_id"), "page_id", "title", "content", "rrf")
    if not by_page.isEmpty():
        return answer_without_model(by_page)
    phrase = F.get(F.array(*map(F.lit, no_answer)), F.pmod(F.xxhash64(F.lit(question)), F.lit(len(no_answer))).cast("int"))
    return pages.sparkSession.range(1).select(phrase.alias("answer"), F.lit(False).alias("grounded"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("relevance"))


def history_section(turns: list[tuple[str, str]]) -> str:
    """Earlier turns (role, text) for a prompt, those of a person or the assistant that say something."""
    said = [f"{SPEAKERS[role]}: {text}" for role, text in turns if role in SPEAKERS and text]
    return f"{HISTORY_HEAD}\n" + "\n".join(said) + "\n\n" if said else ""


def prompt(found: DataFrame, question: str | None = None, history: list[tuple[str, str]] = ()) -> DataFrame:
    """One row: the numbered context of a model's prompt and, with a question, the prompt's sections (history, question,
    context) without instructions. It is built here and never sent."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("rrf")).alias("o"), F.col("chunk_id").alias("i"), F.col("title").alias("t"), F.col("content").alias("c"))))
    numbered = F.transform(ordered, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"], F.lit("\n"), x["c"]))
    out = found.agg(F.array_join(numbered, "\n\n---\n\n").alias("context"))
    if question is None:
        return out
    return out.withColumn("prompt", F.concat(F.lit(f"{history_section(list(history))}{QUESTION_HEAD}{question}\n\n{CONTEXT_HEAD}\n"), F.col("context")))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(term, id, tf): the inverted file; written sorted by term, a filter on a prefix prunes its row groups."""
    return chunks.select(id_col, F.explode(lexemes(F.col(text_col))).alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))


def postings_top_k(index: DataFrame, question: str, id_col: str = "chunk_id", k: int = CANDIDATES) -> DataFrame:
    """lexical_top_k from the inverted file."""
    prefixes = query_prefixes(question)
    test = F.lit(False)
    for p in prefixes:
        test = test | F.col("term").startswith(p)
    return index.where(test).groupBy(id_col).agg((F.sum("tf") * F.lit(WEIGHT_D)).alias("score")).orderBy(F.col("score").desc(), id_col).limit(k)


