import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from wikiloom.llm.filter_audit import COPY, audit, failure_masks, marked, text_mask
from wikiloom.llm.queries import op12_filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, mask string, t int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def mask_of(text):
    words = WORD.findall(text)
    return (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + 8 * bool(re.search("[#$%&*|]", text))


def masks_of(data):
    least = {}
    for i, text, *_ in data:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    return [mask_of(x[1] or "") + COPY * (x[0] is not None and x[0] > least[x[1] or ""]) for x in data]


def brute(data, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[at] == 1} for at in (0, 1))
    rows = [(x[3] or "", m, x[0]) for x, m in zip(data, masks_of(data), strict=True)]
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                gone = [r for r in left if r[1] & bit]
                stay = [r for r in left if not r[1] & bit]
                earlier = len([r for r in own if r[1] & bit]) - len(gone)
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [len(stay), len(gone), earlier, sum(r[1] == bit for r in own), sum(r[2] in good for r in gone), sum(r[2] in toxic for r in gone)]
                left = stay
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def documents(seed=0, n=150):
    rnd = random.Random(seed)
    words = ["the", "and", "of", "HTML", "a#b", "x y", "straße", "E", "w1", "w2", "w3"] + [f"word{i}" for i in range(90)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((3, 49, 50, 80)))) for _ in range(40)] + ["", None, "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "long " * 40000]
    rows = [(rnd.randrange(n), rnd.choice(texts), "en", rnd.choice(("s1", "s2", None, "")), 0, "f", "m", 1) for _ in range(n)]
    hot = [(1000 + i, "one text that many documents share", "en", "s1", 0, "f", "m", 1) for i in range(120)]
    return rows + hot + hot[:3] + [rows[0]] * 4 + [(None, "one text that many documents share", None, "s2", 0, "", "", 0), (None, None, None, None, None, None, None, None)]


def test_masks():
    for text in ("", "a", "a b " * 25, "A" * 5 + "b" * 95, "A" * 6 + "b" * 94, "x y " * 60, "a|b", "ÄÖ", "w\x1cx " * 50):
        assert text_mask(text) == mask_of(text), text


@pytest.mark.parametrize("seed", range(40))
def test_ranges_cut_anywhere(seed):
    """The least ids of open rows settle every copy, whatever bounds ranges have and however fingerprints collide."""
    rnd = random.Random(seed)
    data = [(rnd.choice((None, *range(30))), rnd.choice("abcd"), "p") for _ in range(60)]
    key = {"a": 1, "b": 1, "c": 2, "d": 3}
    rows = sorted(((key[t], t, i, p) for i, t, p in data), key=lambda r: (r[0], r[2] is None, r[2] or 0))
    cuts = sorted(rnd.sample(range(1, 60), rnd.randrange(1, 12)))
    found = []
    for a, b in itertools.pairwise((0, *cuts, 60)):
        found += marked(iter(sorted(rows[a:b], key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))))
    least = {}
    for i, *_, text in found:
        if text is not None and i is not None:
            least[text] = min(i, least.get(text, i))
    got = sorted(("" if i is None else str(i), bool(m & COPY) or (text is not None and i is not None and i > least[text])) for i, _, m, n, _, text in found for _ in range(n))
    first = {t: min((i for i, x, _ in data if x == t and i is not None), default=None) for t in "abcd"}
    assert got == sorted(("" if i is None else str(i), i is not None and i > first[t]) for i, t, _ in data)


def test_equals_brute_force(spark):
    data = documents()
    labels = [(i, i % 3 % 2, i % 5 == 0) for i in range(0, 1100, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (6, None, 1)]
    got = audit(spark.createDataFrame(data, SCHEMA).repartition(3), spark.createDataFrame([(i, q, None if t is None else int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, part string"))
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got.collect()}
    assert rows == brute(data, [(i, q, None if t is None else int(t)) for i, q, t in labels])


def test_hot_text_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = [(i, "the same text", "", f"s{i % 3}", 0, "", "", 0) for i in range(3000)] + [(i, f"text {i}", "", "s0", 0, "", "", 0) for i in range(3000, 3300)]
        got = failure_masks(spark.createDataFrame(data, SCHEMA).repartition(8))
        copies = got.where(F.col("mask").bitwiseAND(COPY) != 0).agg(F.sum("n")).first()[0]
        assert copies == 2999
        assert got.agg(F.sum("n")).first()[0] == 3300
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_query(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert audit(none).count() == 0
    assert audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    spark.createDataFrame(documents(3), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op12_filter_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.count() == 600 * 3
