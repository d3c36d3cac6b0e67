"""Hard-negative mining (operator 11) on vantage-point trees over norm-augmented vectors.

A row's score is its integer inner product with an anchor. Divided by the largest norm M of its block and given one more
component, sqrt(1 - |x|^2 / M^2), every vector lies on the unit sphere; an anchor, scaled to length one, has 0 there. Then
distance^2 = 2 - 2 score / (|anchor| M): the highest score is the nearest vector, and a window of scores is an annulus of
distances. Each block of rows has its own tree, so no number of the whole table is needed.

A tree's nodes hold the range of distances of their vectors to a vantage point, their labels and their least id. The
triangle inequality bounds the distances of a node to the anchor from both sides: nodes inside or outside the annulus, or
without a label that is wanted, are left out, and the rest is walked, the nearest leaves first, until the k best rows are
closer than all that is left. The anchors of a block walk together, a few leaves at first, then more, so that a leaf's rows
are multiplied with all anchors that look at it. Bounds only choose what is looked at; what is found is compared by exact
integer scores.

Two passes over the trees: an anchor's positives (nearest rows of its label), then, for each positive, the annulus.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wikiloom.llm.blocks import BLOCK_BYTES, BLOCK_ROWS, QUERY_BYTES, QUERY_ROWS, rows_of
from wikiloom.llm.topk import quantise
from wikiloom.plans.session import bound_arrow_batches
from wikiloom.plans.shared import shared_table

SCALE = 256
#: Vectors of a leaf.
LEAF = 64
#: Leaves that a walk takes at once, the nearest first; then all that may still hold one of the k best rows.
STRIDES = (4, 16)
#: Bounds are widened by this much of the sphere's radius; all arithmetic on the sphere is far more exact.
SLACK = 1e-9
#: Sums of products below this are exact in doubles.
EXACT = 1 << 53


def unit(vector: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(vector / length, largest component, length / largest component): no square overflows. Zero stays zero."""
    largest = float(np.abs(vector).max(initial=0))
    if not largest:
        return vector.astype(float), 0.0, 0.0
    small = vector.astype(float) / largest
    length = float(np.sqrt((small**2).sum()))
    return small / length, largest, length


def on_sphere(values: np.ndarray) -> tuple[np.ndarray, float]:
    """The rows on the unit sphere with one more component, and the logarithm of the largest norm (-inf: all are zero)."""
    largest = float(np.abs(values).max(initial=0))
    if not largest:
        return np.hstack([np.zeros(values.shape), np.ones((len(values), 1))]), -math.inf
    small = values.astype(float) / largest
    squares = (small**2).sum(axis=1)
    top = squares.max()
    return np.hstack([small / math.sqrt(top), np.sqrt(np.maximum(0.0, 1 - squares / top))[:, None]]), math.log(largest) + math.log(top) / 2


def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int, float, float]]]:
    """(order of the rows, nodes): a node is (start, stop, parent, vantage row, least and greatest distance to it).

    A node's vantage point is its row farthest from its first one; the nearer half and the farther half are its children,
    with the distances that they really have, so that ties and equal rows do no harm. Parents come before children.
    """
    order = np.arange(len(points))
    nodes = [(0, len(points), -1, -1, 0.0, 2.0)]
    at = 0
    while at < len(nodes):
        start, stop = nodes[at][:2]
        own = order[start:stop]
        if stop - start > leaf:
            vantage = own[int(np.argmax(((points[own] - points[own[0]]) ** 2).sum(axis=1)))]
            distance = np.sqrt(((points[own] - points[vantage]) ** 2).sum(axis=1))
            if distance.max() > 0:
                by = np.argsort(distance, kind="stable")
                order[start:stop], distance = own[by], distance[by]
                half = (stop - start) // 2
                for a, b in ((0, half), (half, stop - start)):
                    nodes.append((start + a, start + b, at, int(vantage), float(distance[a]), float(distance[b - 1])))
        at += 1
    return order, nodes


def build_tree(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, k: int, scale: int = SCALE) -> bytes:
    """A block's tree: its distinct pairs of vector and label, each with the rows that any anchor could need.

    An anchor's own rows never count: of equal rows k of the least id and k more are kept.
    """
    values = quantise(matrix, scale)
    by = np.lexsort((ids,))
    seen: dict[tuple, list[int]] = {}
    for r in by:
        seen.setdefault((values[r].tobytes() if values.dtype != object else tuple(values[r]), int(labels[r])), []).append(r)
    keep = []
    for own in seen.values():
        first = int(np.searchsorted(ids[own], ids[own[0]], side="right"))
        keep.append(own[: min(first, k)] + own[first : first + k])
    distinct = values[[own[0] for own in keep]]
    points, size = on_sphere(distinct)
    order, nodes = grow(points)
    keep = [keep[i] for i in order]
    label, least = np.array([labels[o[0]] for o in keep]), np.array([ids[o[0]] for o in keep])
    inner = {n[2] for n in nodes}
    starts, stops, parents, vantages, low, high = (np.array(x) for x in zip(*nodes, strict=True))
    pure = np.array([(label[a:b] == label[a]).all() for a, b in zip(starts, stops, strict=True)])
    held = np.array([np.bitwise_or.reduce(np.uint64(1) << (label[a:b] % 64).astype(np.uint64)) for a, b in zip(starts, stops, strict=True)])
    known = np.unique(vantages[1:])
    out = io.BytesIO()
    np.savez(
        out, values=distinct[order] if distinct.dtype != object else np.array([[str(x) for x in row] for row in distinct[order]]), label=label,
        ids=ids[np.concatenate(keep)], ends=np.cumsum([len(o) for o in keep]), size=size, starts=starts, stops=stops, parents=parents,
        place=np.searchsorted(known, vantages), vantage=points[known], low=low, high=high, pure=pure, held=held,
        least_id=least, leaf=np.array([i not in inner for i in range(len(nodes))]),
    )
    return out.getvalue()


@dataclass
class Walk:
    """What an anchor looks for in a tree: rows of its label (``same``) or of others, with scores from lowest to highest."""

    anchor: int  # its place among the anchors that ask
    own: int
    label: int
    same: bool
    asked: int = 0
    lowest: int | None = None
    highest: int | None = None
    found: list[tuple[int, int]] = field(default_factory=list)  # (-score, id), the best first


class Tree:
    """A block's tree as it is asked."""

    def __init__(self, body: bytes):
        held = np.load(io.BytesIO(body))
        for name in held.files:
            setattr(self, name, held[name])
        if self.values.dtype.kind == "U":
            self.values = np.array([[int(x) for x in row] for row in self.values], dtype=object)
        self.size, self.leaves = float(self.size), np.flatnonzero(self.leaf)
        self.first = np.r_[0, self.ends]
        self.largest = int(np.abs(self.values).max(initial=0))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query on the sphere and each leaf, the least and the greatest distance that its rows can have."""
        nearest, farthest = np.zeros((len(self.starts), len(queries))), np.full((len(self.starts), len(queries)), 2.0)
        if len(self.starts) > 1:
            to = np.sqrt(np.maximum(0.0, (queries**2).sum(axis=1)[None, :] + 1 - 2 * self.vantage[:, :-1] @ queries.T))
            for n in range(1, len(self.starts)):  # parents come first
                above, own = self.parents[n], to[self.place[n]]
                nearest[n] = np.maximum(nearest[above], np.maximum(own - self.high[n], self.low[n] - own))
                farthest[n] = np.minimum(farthest[above], own + self.high[n])
        return nearest[self.leaves].T, farthest[self.leaves].T

    def may_hold(self, label: int, same: bool) -> np.ndarray:
        """The leaves that can have rows of a label, or of others."""
        if same:
            return (self.held[self.leaves] >> np.uint64(label % 64)) & np.uint64(1) > 0
        return ~(self.pure[self.leaves] & (self.label[self.starts[self.leaves]] == label))

    def scorer(self, queries: np.ndarray) -> tuple[type, Callable[[int, int, np.ndarray], np.ndarray]]:
        """Exact inner products of some queries and a run of rows: by doubles where no partial sum leaves their integers,
        else by Python's."""
        if self.largest * int(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < EXACT:
            rows, asked = self.values.astype(float), queries.astype(float)
            return np.int64, lambda a, b, some: (asked[some] @ rows[a:b].T).astype(np.int64)
        values, wide = self.values.astype(object), queries.astype(object)
        return object, lambda a, b, some: wide[some] @ values[a:b].T

    def walk(self, queries: np.ndarray, walks: list[Walk], k: int) -> None:
        """Fill each walk's ``found`` with its first k rows: the highest scores, of equal ones the least ids."""
        lengths = [unit(q) for q in queries]
        nearest, farthest = self.bounds(np.array([x[0] for x in lengths]))
        sizes = [self.size + math.log(largest) + math.log(length) if largest else -math.inf for _, largest, length in lengths]
        scales = [math.exp(x) if -700 < x < 700 else None for x in sizes]  # without one nothing is left out by distance
        kind, products = self.scorer(queries)
        scores, known = np.zeros((len(queries), self.stops[0]), kind), np.zeros((len(queries), len(self.leaves)), bool)
        leaf_of = np.repeat(np.arange(len(self.leaves)), (self.stops - self.starts)[self.leaves])
        radius = lambda w, score: math.sqrt(max(0.0, 2 - 2 * (score / scales[w.anchor])))
        left: list[tuple[Walk, np.ndarray]] = []
        for w in walks:
            within = self.may_hold(w.label, w.same)
            if scales[w.anchor] and w.lowest is not None:
                within &= (farthest[w.anchor] >= radius(w, w.highest) - SLACK) & (nearest[w.anchor] <= radius(w, w.lowest) + SLACK)
            leaves = np.flatnonzero(within)
            left.append((w, leaves[np.argsort(nearest[w.anchor][leaves], kind="stable")]))
        for stride in (*STRIDES, len(self.leaves)):
            now = []
            for w, leaves in left:
                if len(w.found) == k and scales[w.anchor]:
                    leaves = leaves[nearest[w.anchor][leaves] <= radius(w, -w.found[-1][0]) + SLACK]
                if len(leaves):
                    now.append((w, leaves[:stride], leaves[stride:]))
            wanted = np.zeros(known.shape, bool)
            for w, leaves, _ in now:
                wanted[w.anchor, leaves] = True
            wanted &= ~known
            for leaf in np.flatnonzero(wanted.any(axis=0)):
                some, node = np.flatnonzero(wanted[:, leaf]), self.leaves[leaf]
                a, b = self.starts[node], self.stops[node]
                scores[some, a:b] = products(a, b, some)
            known |= wanted
            left = []
            for w, leaves, later in now:
                taken = np.zeros(len(self.leaves), bool)
                taken[leaves] = True
                self._merge(w, scores[w.anchor], taken[leaf_of], k)
                left.append((w, later))

    def _merge(self, w: Walk, scores: np.ndarray, looked: np.ndarray, k: int) -> None:
        """The rows looked at go into a walk's first k."""
        fits = looked & ((self.label == w.label) == w.same)
        if w.lowest is not None:
            fits &= ((scores >= w.lowest) & (scores <= w.highest)).astype(bool)
        if len(w.found) == k:
            fits &= (scores >= -w.found[-1][0]).astype(bool)
        rows = np.flatnonzero(fits)
        order = np.lexsort((self.least_id[rows], -scores[rows])) if scores.dtype != object else sorted(range(len(rows)), key=lambda r: (-scores[rows[r]], self.least_id[rows[r]]))
        for r in rows[order]:
            score = -int(scores[r])
            if len(w.found) == k and (score, self.least_id[r]) > w.found[-1]:
                break
            ids = self.ids[self.first[r] : self.first[r + 1]]
            w.found = sorted([*w.found, *((score, int(i)) for i in ids[ids != w.own][:k])])[:k]


def tree_blocks(rows: DataFrame, k: int, scale: int) -> DataFrame:
    """One row (dims, first, body) for each run of vectors of equal length: its tree. Every row is in one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, int, np.ndarray]]] = {}

        def close(dims: int) -> pd.DataFrame:
            block = sorted(held.pop(dims), key=lambda x: x[0])
            ids, labels = (np.array([x[i] for x in block], np.int64) for i in (0, 1))
            return pd.DataFrame({"dims": [dims], "first": [ids[0]], "body": [build_tree(ids, labels, np.stack([v for *_, v in block]), k, scale)]})

        for frame in batches:
            for i, label, v in zip(frame["vec_id"], frame["label"], frame["vector"], strict=True):
                block = held.setdefault(len(v), [])
                block.append((i, label, np.asarray(v, float)))
                if len(block) >= rows_of(len(v), BLOCK_ROWS, BLOCK_BYTES):
                    yield close(len(v))
        for dims in list(held):
            yield close(dims)

    return shared_table(rows.select("vec_id", "label", "vector").mapInPandas(run, "dims int, first long, body binary"), "vantage-trees")


def _asked(index: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Trees beside the blocks of anchors that ask them: every tree meets every anchor of its length once."""
    count, longest = anchors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, math.ceil(count / rows_of(longest or 1, QUERY_ROWS, QUERY_BYTES)))
    keyed = anchors.groupBy(F.size("vector").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("part"))
    asked = keyed.agg(F.collect_list(F.struct(*anchors.columns)).alias("asked")).drop("part")
    everywhere = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    return index.withColumn("shard", F.pmod(F.xxhash64("dims", "first"), F.lit(shards))).join(everywhere, ["shard", "dims"]).select("body", "asked")


def _first(found: DataFrame, keys: list[str], k: int, id_col: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def labelled(df: DataFrame, label: Column, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part: those with an id, a label and a usable vector."""
    vector = F.col("vector")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == float("inf")))
    found = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return found.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where((F.size(vector) > 0) & finite)


def _ask(pairs: DataFrame, walks_of: Callable[[int, dict], list[Walk]], k: int, scale: int, name: str) -> DataFrame:
    """(anchor_id, asked, vec_id, score): the first k rows of every tree for each walk of each anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for body, asked in zip(frame["body"], frame["asked"], strict=True):
                queries = quantise(np.array([np.asarray(a["vector"], float) for a in asked]), scale)
                walks = [w for n, a in enumerate(asked) for w in walks_of(n, a)]
                Tree(body).walk(queries, walks, k)
                out = [(w.own, w.asked, i, -minus) for w in walks for minus, i in w.found]
                for *_, score in out:
                    if not -(1 << 63) <= score < 1 << 63:
                        raise OverflowError(f"a score is beyond 64 bits: {score}")
                yield pd.DataFrame(out, columns=["anchor_id", "asked", "vec_id", "score"]).astype("int64")

    return shared_table(pairs.mapInPandas(run, "anchor_id long, asked long, vec_id long, score long"), name)


def hard_negatives(df: DataFrame, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor's positives, the first
    rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.

    Anchors: rows whose id is divisible by ``every``; positives: an anchor's best rows of its label. Components are
    floor(scale * x) and sums are exact; a score beyond 64 bits is an error. Rows with a null id or label, or a vector that
    is null, empty or holds null or non-finite components, take no part; vectors meet only those of their own length. Ties
    go to smaller ids. Of rows with one anchor's id the least label and vector asks, and none of them is its positive or
    negative; other repeated rows are candidates each, but a positive with one id and score counts once. A window below
    zero, where ``low`` percent is more than ``high`` percent, holds nothing. An empty table gives no rows.
    """
    spark = df.sparkSession
    bound_arrow_batches(spark)
    rows = labelled(df, F.col("label") if label is None else label, id_col, vector_col, scale)
    index = tree_blocks(rows, max(positives, negatives), scale)
    least = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a"))
    anchors = shared_table(least.select("vec_id", "a.label", "a.vector"), "anchors")
    shards = max(1, min(index.count(), 4 * spark.sparkContext.defaultParallelism))

    first = _ask(_asked(index, anchors, shards), lambda n, a: [Walk(n, a["vec_id"], a["label"], True)], positives, scale, "anchor-nearest")
    best = shared_table(_first(first, ["anchor_id"], positives, "vec_id").select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).distinct(), "positives")

    def windows(n: int, a: dict) -> list[Walk]:
        every = [Walk(n, a["vec_id"], a["label"], False, p, -(-low * p // 100), high * p // 100) for p in map(int, a["scores"])]
        return [w for w in every if w.lowest <= w.highest]

    scores = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))
    second = _ask(_asked(index, anchors.join(scores, "vec_id"), shards), windows, negatives, scale, "annulus-nearest")
    ranked = _first(second.withColumnRenamed("asked", "positive_score"), ["anchor_id", "positive_score"], negatives, "vec_id")
    return best.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
