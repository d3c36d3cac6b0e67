"""Quality classifier (operator 5): random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of letters, runs of digits, single signs; a capital form is a word of its own) fall by hash into a fixed
number of slots, so every table here has a fixed size. A slot has a sparse random index vector; its word vector is the
sum, over the whole corpus, of the index vectors of its neighbours. A document pools the vectors of its words: their
mean, and the mean product of neighbours. A small network, trained on labelled documents, gives a logit; its
temperature is fitted on documents that it was not trained on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.caches import own_cache
from wikiloom.llm.token_counts import slices
from wikiloom.plans.session import bound_arrow_batches
from wikiloom.plans.shared import shared_table

SLOTS = 1 << 14
DIMS = 32
#: Nonzero components of an index vector.
SPARSE = 4
#: Words to each side that count as neighbours.
WINDOW = 2
HIDDEN = 32
#: The network learns from so many labelled documents at most, those with the smallest hashes.
TRAIN_ROWS = 20_000
#: Documents of this score or more are predicted to be of quality 1.
THRESHOLD = 0.3
#: Words at once in the statistics. A longer document goes in parts; pairs of words on both sides of a cut count too.
CHUNK = 1 << 17
WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
#: Words whose slots a Python worker keeps.
WORD_CACHE = 100_000
_slots: dict[str, int] = {}


def slots(text: str) -> np.ndarray:
    """The slots of a text's words, in order."""
    words = WORDS.findall(text)
    known = own_cache(_slots, WORD_CACHE)
    out = list(map(known.get, words))
    if None in out:
        for i, w in enumerate(words):
            if out[i] is None:
                out[i] = known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS
    return np.asarray(out, np.int64)


def sparse_index(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The index vectors of all slots: the places of their SPARSE components, and these, +1 or -1."""
    rng = np.random.default_rng(seed)
    at = rng.random((SLOTS, DIMS)).argsort(axis=1)[:, :SPARSE]
    return at, rng.choice([-1.0, 1.0], (SLOTS, SPARSE))


def context_sums(df: DataFrame, text_col: str, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(slot, seen, context): over all documents, how often each slot occurs and the sum of its neighbours' index vectors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = sparse_index(seed)
        apart = np.full(WINDOW, -1, np.int64)
        total, seen = np.zeros(SLOTS * DIMS), np.zeros(SLOTS, np.int64)  # sums of +-1: whole numbers, exact
        parts, held = [], 0

        def add() -> None:
            flat = np.concatenate(parts)
            np.add(seen, np.bincount(flat[flat >= 0], minlength=SLOTS), out=seen)
            for gap in range(1, WINDOW + 1):
                ok = (flat[:-gap] >= 0) & (flat[gap:] >= 0)
                a, b = flat[:-gap][ok], flat[gap:][ok]
                to, of = np.concatenate([a, b]) * DIMS, np.concatenate([b, a])
                for k in range(SPARSE):
                    np.add(total, np.bincount(to + at[of, k], weights=sign[of, k], minlength=SLOTS * DIMS), out=total)

        def bridge(own: np.ndarray, cut: int) -> None:
            """The pairs across a cut of a document."""
            for i in range(max(0, cut - WINDOW), cut):
                for j in range(cut, min(len(own), i + WINDOW + 1)):
                    for a, b in ((own[i], own[j]), (own[j], own[i])):
                        np.add.at(total, a * DIMS + at[b], sign[b])

        for whole in batches:
            for batch in slices(whole, 0):
                for text in batch.column(0).to_pylist():
                    own = slots(text or "")
                    for start in range(0, len(own), chunk):
                        if start:
                            bridge(own, start)
                        parts += [own[start : start + chunk], apart]
                        held += min(chunk, len(own) - start)
                        if held >= chunk:
                            add()
                            parts, held = [], 0
        if parts:
            add()
        used = np.flatnonzero(seen)
        sums = total.reshape(SLOTS, DIMS)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used]), pa.FixedSizeListArray.from_arrays(sums.ravel(), DIMS).cast(pa.list_(pa.int64()))], names=["slot", "seen", "context"])
    partial = df.select(F.col(text_col).cast("string").alias("__text")).mapInArrow(count, "slot long, seen long, context array<long>")
    sums = [F.sum(F.col("context")[d]).alias(f"c{d}") for d in range(DIMS)]
    return partial.groupBy("slot").agg(F.sum("seen").alias("seen"), *sums).select("slot", "seen", F.array(*(f"c{d}" for d in range(DIMS))).alias("context"))


def word_vectors(df: DataFrame, text_col: str = "text", seed: int = 5) -> np.ndarray:
    """SLOTS x DIMS float32 (2 MB, whatever the corpus): unit vectors of the contexts, zero for unseen slots."""
    out = np.zeros((SLOTS, DIMS), np.float32)
    for row in context_sums(df, text_col, seed).collect():  # SLOTS rows at most
        v = np.asarray(row["context"], float)
        norm = np.sqrt((v**2).sum())
        out[row["slot"]] = v / norm if norm else v
    return out


def pool(text: str, vectors: np.ndarray) -> np.ndarray:
    """A document's features: mean word vector, mean product of neighbours' vectors, share of slots that are new, log length."""
    own = slots(text)
    out = np.zeros(2 * DIMS + 3, np.float32)
    if len(own):
        v = vectors[own]
        out[:DIMS] = v.mean(axis=0)
        if len(own) > 1:
            out[DIMS : 2 * DIMS] = np.einsum("ij,ij->j", v[1:], v[:-1]) / (len(own) - 1)
            out[-3] = (own[1:] == own[:-1]).mean()
        out[-2] = len(np.unique(own)) / np.sqrt(len(own)) / 10
        out[-1] = np.log1p(len(own)) / 10
    return out


class Network:
    """Two layers: rectified, then one logit. Inputs are standardised with the training rows' figures."""

    def __init__(self, inputs: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w1, self.b1 = rng.normal(0, np.sqrt(2 / inputs), (inputs, HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-4) -> None:
        """Adam on the logistic loss, then the temperature on the rows (one in five) that were left out of it."""
        if not len(x):
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        out, own = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        weights = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            rng.shuffle(own)
            for start in range(0, len(own), 128):
                b = own[start : start + 128]
                h = np.maximum(z[b] @ self.w1 + self.b1, 0)
                g = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30))) - y[b]) / len(b)
                gh = np.outer(g, self.w2) * (h > 0)
                step += 1
                for w, d, m, v in zip(weights, (z[b].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(keepdims=True)), first, second, strict=True):
                    d = d + decay * w
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if len(out):
            logit, grid = self.logits(x[out]), np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.logaddexp(0, -np.where(y[out] > 0, 1, -1) * logit / t).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])


def held_out(id_col: Column) -> Column:
    """The fold that learning never sees: crc32 of the id as text, divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(True))


def quality_scorer(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 5, train_rows: int = TRAIN_ROWS) -> Callable[[Column], Column]:
    """Learn from ``df`` and its labels; the result gives the score (0 to 1) of a column of texts.

    Word vectors come from all texts. Labels are learnt from rows outside the held-out fold only, up to ``train_rows``
    of them by hash; null labels don't count, of several labels of a document the smallest counts. Neither labels nor
    columns other than the text enter a score. A null text counts as empty and has the score of the empty pool. Without
    labels, or over an empty table, all scores are those of an untrained network.
    """
    bound_arrow_batches(df.sparkSession)
    vectors = word_vectors(df, text_col, seed)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                pooled = [pool(t or "", vectors) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pooled, pa.list_(pa.float32()))], names=["y", "x"])

    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))
    chosen = shared_table(marks.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(train_rows), "quality-labels")
    learning = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("y", "text")
    taught = learning.mapInArrow(features, "y int, x array<float>").orderBy(F.xxhash64("x")).limit(train_rows).toPandas()  # bounded by train_rows
    network = Network(2 * DIMS + 3, seed)
    if len(taught):
        network.fit(np.stack(taught["x"]).astype(float), taught["y"].to_numpy(float), seed)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            found = [np.zeros(0)]
            for batch in slices(pa.RecordBatch.from_arrays([whole], names=["text"]), 0):
                x = np.stack([pool(t or "", vectors) for t in batch.column(0).to_pylist()]).astype(float)
                found.append(np.round(network.probabilities(x), 9))  # sums may differ in the last digits with the size of a batch
            yield pa.array(np.concatenate(found))

    return lambda text: score(text.cast("string"))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (1 from ``threshold`` up) for every row; see ``quality_scorer``.

    Repeated rows each get their row and equal scores; a null id is held out; columns of ``df`` other than the two named
    are not read, whatever their names; an empty table gives no rows.
    """
    scorer = quality_scorer(df, labels, id_col, text_col, **settings)
    scored = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), scorer(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def of_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows of ``df`` that score ``threshold`` or more, with all their columns as they are."""
    scorer = quality_scorer(df, labels, id_col, text_col, **settings)
    return df.where(scorer(F.col(text_col)) >= threshold)
