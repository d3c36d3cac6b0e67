"""The registered queries of this subpackage, one thin query for each operator, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wikiloom.llm.ann import nearest
from wikiloom.llm.filter_audit import audit
from wikiloom.llm.hard_negatives import hard_negatives
from wikiloom.llm.html_main import extract_main
from wikiloom.llm.mixing import mix
from wikiloom.llm.near_dup import near_duplicates
from wikiloom.llm.packing import pack_conversations, pack_documents
from wikiloom.llm.pii import KINDS as PII_KINDS
from wikiloom.llm.pii import pii_counts, pseudonymous
from wikiloom.llm.quality import score_quality
from wikiloom.llm.secret_scan import BASE_KINDS, listed, reported, scan_secrets
from wikiloom.llm.token_counts import token_counts
from wikiloom.llm.topk import exact_top_k
from wikiloom.llm.warc import archive
from wikiloom.sources.tables import read_table

TOKENIZER = "byte_bpe_50k.json"
#: The key of the registered query; real runs bring their own.
PII_KEY = "wikiloom-demonstration-key"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 on instruction data, where the limit of loss-bearing tokens binds."""
    return pack_conversations(read_table(spark, sf_dir, "conversations"), public_tokenizers.path(TOKENIZER))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(read_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("shared", "repeated")]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(reported()).alias("spans"), listed(F.col("repeated")).alias("repeated"), "base_live", "base_random", *sizes)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_counts(pseudonymous(read_table(spark, sf_dir, "documents"), PII_KEY))
    return found.withColumn("n_found", sum(F.col(f"n_{k}") for k in PII_KINDS))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has a wrong label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), moved)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_nearest": op3_nearest,
    "op4_main_text": op4_main_text,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_top_k": op10_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
    "packing_conversations": packing_conversations,
}

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"

#: The five filters as bits, the orders of filters with their steps, and what a row of a mask adds at each.
_AUDIT = r"""
WITH w AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT part, doc_id, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM m GROUP BY ALL),
f AS (SELECT chr(65 + i::INT) AS f, (1 << i)::INT AS bit FROM range(5) AS r(i)),
o AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(list_slice(bits, 1, k - 1)), 0)::INT AS before FROM o, range(1, 6) AS r(k))
SELECT part, filter_order, step, sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN mask & own > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY ALL"""

#: Tokens, cuts, minimum cuts, networks, spans, Feistel permutations, pivotal rounding, an approximate index and digests in
#: base32 are beyond SQL; tests/llm holds them against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op7_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS node, u AS top FROM e UNION SELECT e.v, r.top FROM r JOIN e ON e.u = r.node),
t AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(top, d.doc_id) AS component_id, coalesce(top, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.node = d.doc_id""",
    "op10_top_k": f"""
WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id AND len(e.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    "op11_hard_negatives": f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id % 100 = 0 AND e.vec_id <> a.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5""",
    "op12_filter_audit": _AUDIT,
}
