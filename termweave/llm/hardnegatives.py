"""Operator 11: hard-negative mining by inner product, with vantage-point trees over norm-augmented vectors.

With one component more, sqrt(M^2 - |x|^2), all rows of a block have the norm M; an anchor q gets a zero there and is
brought to that norm too, which ranks rows alike. Then d^2 = 2 M^2 - 2 <q, x> M / |q|: the highest inner product is the
nearest row, and a window of scores is an annulus of distances. Each block of the index is a forest of vantage-point trees, one for each label that fills a leaf
and one for all rarer ones, so that a search for positives looks into the anchor's own label's tree and one for
negatives into all others. A search takes nodes in the order of the nearest distance inside the annulus that the
triangle inequality leaves them, and ends when no node left can better the k rows it has. Scores are exact integers;
distances decide only where to look.

Blocks of anchors meet blocks of the index in tasks; a task hands on at most k rows for each window it was asked for.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import table, written
from termweave.operators import products

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these shares, in percent, of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows of a leaf, and numbers of the index in a block.
LEAF, BLOCK_NUMBERS = 256, 1_280_000
#: Scores are given as 64-bit integers; larger ones are ordered as they are and given as these.
LEAST, MOST = -(2**63), 2**63 - 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part: an id, a label, and finite components."""
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return v.filter(F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def floored(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers: int64 where sums of up to 8,192 products stay in 64 bits, else Python's."""
    if not x.size or np.abs(x).max() < 2.0**17:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        out[at] = int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE)
    return out


def rows_of(column) -> np.ndarray:
    """A column of lists as a matrix; shorter rows end in zeros, which no inner product sees."""
    at, numbers = products.lists(column)
    size = np.diff(at)
    width = int(size.max(initial=0))
    if (size == width).all():
        return numbers.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), products.ranges(np.zeros(len(size), np.int64), size)] = numbers
    return out


class Forest:
    """Vantage-point trees over the rows of a block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        # Distances are taken on doubles; larger integers lose their last bits first, so that no square leaves a double
        self.shift = max(0, max((int(v).bit_length() for v in x.flat), default=0) - 400) if x.dtype == object else 0
        f = self.doubles(x)
        norm = (f**2).sum(1)
        self.square = float(norm.max(initial=0.0))
        self.space = np.concatenate([f, np.sqrt(np.maximum(self.square - norm, 0.0))[:, None]], axis=1)
        self.nodes: list[tuple] = []  # (rows, None) of a leaf, or (row of the vantage point, [(child, least, most distance)])
        order = np.lexsort((ids, labels))
        edges = np.flatnonzero(np.r_[True, labels[order][1:] != labels[order][:-1], True]) if len(ids) else np.zeros(1, np.int64)
        self.roots: dict[int | None, int] = {}
        rare = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a >= leaf:
                self.roots[int(labels[order[a]])] = self.grown(order[a:b], leaf)
            else:
                rare.append(order[a:b])
        if rare:
            self.roots[None] = self.grown(np.concatenate(rare), leaf)

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return np.array([float(int(v) >> self.shift) for v in x.flat], np.float64).reshape(x.shape) if x.dtype == object else x.astype(np.float64)

    def grown(self, rows: np.ndarray, leaf: int) -> int:
        """The root of a tree over the rows: a vantage point, and the nearer and the farther half of its rows."""
        root = len(self.nodes)
        self.nodes.append(())
        todo = [(root, rows)]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= leaf:
                self.nodes[at] = (rows, None)
                continue
            # The row farthest from the first one sees the others at the most different distances
            point = rows[np.argmax(((self.space[rows] - self.space[rows[0]]) ** 2).sum(1))]
            far = np.sqrt(((self.space[rows] - self.space[point]) ** 2).sum(1))
            order = np.argsort(far, kind="stable")
            half, children = len(rows) // 2, []
            for part in (order[:half], order[half:]):
                children.append((len(self.nodes), float(far[part[0]]), float(far[part[-1]])))
                todo.append((len(self.nodes), rows[part]))
                self.nodes.append(())
            self.nodes[at] = (point, children)
        return root

    def search(self, q: np.ndarray, label: int, own: int, same: bool, windows: list[tuple[int | None, int | None]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (least, greatest score; None: open), its first k rows as (score, id): highest scores first, ties by smaller ids.

        same: rows of the anchor's label, without rows of its own id; else rows of other labels.
        """
        f = np.zeros(self.space.shape[1])
        f[: len(q)] = self.doubles(q)
        # A longer or shorter anchor ranks rows alike; one as long as they are lies where distances differ most
        mine = float((f**2).sum())
        ratio = math.sqrt(self.square / mine) if mine and self.square else 1.0
        f *= ratio
        mine = float((f**2).sum())
        whole = mine + self.square
        slack = 1e-9 * whole + 1e-300
        roots = [self.roots[x] for x in (label, None) if x in self.roots] if same else [at for x, at in self.roots.items() if x != label]
        scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seen: dict[int, float] = {}

        def leaf(at: int) -> tuple[np.ndarray, np.ndarray]:
            if at not in scored:
                rows = self.nodes[at][0]
                rows = rows[(self.labels[rows] == label) & (self.ids[rows] != own) if same else self.labels[rows] != label]
                scored[at] = self.x[rows] @ q, self.ids[rows]
            return scored[at]

        def distance(row: int) -> float:
            if row not in seen:
                seen[row] = math.sqrt(max(whole - 2 * float(self.space[row] @ f), 0.0))
            return seen[row]

        def scaled(score: int) -> float:
            return float(int(score) >> 2 * self.shift) * ratio

        out = []
        for low, high in windows:
            inner = 0.0 if high is None else math.sqrt(max(whole - 2 * scaled(high) - slack, 0.0))
            outer = math.inf if low is None else math.sqrt(max(whole - 2 * scaled(low) + slack, 0.0))
            best: list[tuple[int, int]] = []  # (-score, id) in order
            heap = [(inner, at, 0.0, math.inf) for at in roots]
            heapq.heapify(heap)
            while heap:
                near, at, least, most = heapq.heappop(heap)
                if len(best) == k and whole - near * near + slack < 2 * scaled(-best[-1][0]):
                    break  # no row of this node or of a later one scores as much as the last one kept
                value, children = self.nodes[at]
                if children is None:
                    score, ids = leaf(at)
                    ok = np.ones(len(ids), bool)
                    if low is not None:
                        ok &= np.asarray(score >= low, bool)
                    if high is not None:
                        ok &= np.asarray(score <= high, bool)
                    if len(best) == k:
                        ok &= np.asarray(score >= -best[-1][0], bool)
                    where = np.flatnonzero(ok)
                    if len(where) > 4 * k and score.dtype != object:
                        part = score[where]
                        where = where[part >= np.partition(part, len(part) - k)[len(part) - k]]
                    best = sorted([*best, *zip((-score[where]).tolist(), ids[where].tolist(), strict=True)])[:k]
                    continue
                d = distance(value)
                for child, a, b in children:
                    # |d - distance to the point| <= distance to the row <= d + distance to the point
                    closest, farthest = max(least, d - b, a - d), min(most, d + b)
                    tolerance = 1e-9 * (d + b) + 1e-150
                    if farthest + tolerance >= inner and closest - tolerance <= outer:
                        heapq.heappush(heap, (max(inner, closest - tolerance), child, closest, farthest))
            out.append([(-s, i) for s, i in best])
        return out


def asked(anchors: DataFrame, rows: DataFrame, n: int, width: int, k: int, same: bool, most: int) -> DataFrame:
    """(anchor_id, nth, vec_id, score): what each block of the index finds in each window `nth` of the anchors (anchor_id, label, embedding, low, high)."""
    kind = products.kind_of("anchor_id long, nth int, vec_id long, score long")
    schema = kind[1]

    def load(block: pa.Table) -> Forest:
        return Forest(block["vec_id"].to_numpy(), block["label"].to_numpy(), floored(rows_of(block["embedding"])))

    def answer(forest: Forest, batch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        q = floored(rows_of(batch.column("embedding")))
        wide = forest.x.shape[1]
        q = q[:, :wide] if q.shape[1] >= wide else np.concatenate([q, np.zeros((len(q), wide - q.shape[1]), q.dtype)], axis=1)
        lows, highs = batch.column("low").to_pylist(), batch.column("high").to_pylist()
        for i, (own, label) in enumerate(zip(batch.column("anchor_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
            windows = [(None if a is None else int(a), None if b is None else int(b)) for a, b in zip(lows[i], highs[i], strict=True)]
            for nth, found in enumerate(forest.search(q[i], label, own, same, windows, k)):
                for score, key in found:
                    for c, v in zip(out, (own, nth, key, min(max(score, LEAST), MOST)), strict=True):
                        c.append(v)
        return products.made(schema, [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)])

    return products.against(anchors.withColumn("key", F.col("anchor_id")), rows.withColumn("key", F.col("vec_id")), n * max(width, 1), load, answer, kind, most, k * POSITIVES)


def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, most: int = BLOCK_NUMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows (vec_id, label, embedding).

    An anchor's positives are its first rows of the same label, those of its own id left out; a positive's negatives the
    first rows of other labels whose score is between low and high percent of its own. Components count as floor(256 x).
    Rows with a null id, label, vector or component, or one that is not finite, take no part; zero vectors do. Of
    vectors of different lengths the shorter counts as if zeros followed. Rows that repeat an id are candidates each;
    as anchors they are one, the least (label, vector). Ties go to the smaller vec_id. No positives or no negatives: no
    rows, nor for empty tables. Scores beyond 64 bits are ordered exactly between themselves within a block, and given
    as the largest or smallest long. Columns other than the three are not looked at.
    """
    # Read twice, and laid out once: an id and a vector in each row
    rows = written(usable(vectors), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    one = usable(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a"))
    one = written(one.select(F.col("vec_id").alias("anchor_id"), "a.label", "a.embedding"), "anchors")
    open_ = F.array(F.lit(None).cast("long"))
    found = asked(one.withColumn("low", open_).withColumn("high", open_), rows, size["n"], size["d"] or 0, positives, True, most)
    pos = first(found, ["anchor_id"], positives).select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pos = written(pos, "positives")
    # 100 s >= low p, 100 s <= high p, for whole s
    bounds = F.transform("p", lambda x: F.struct((-F.floor(-x["score"] * low / F.lit(100).cast("decimal(20,0)"))).cast("long").alias("low"), F.floor(x["score"] * high / F.lit(100).cast("decimal(20,0)")).cast("long").alias("high")))
    own = pos.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("positive_score").cast("decimal(20,0)").alias("score")))).alias("p"))  # `positives` rows at most
    wanted = one.join(own.withColumn("b", bounds), "anchor_id").select("anchor_id", "label", "embedding", F.col("b.low").alias("low"), F.col("b.high").alias("high"))
    neg = first(asked(wanted, rows, size["n"], size["d"] or 0, negatives, False, most), ["anchor_id", "nth"], negatives)
    neg = neg.select("anchor_id", (F.col("nth") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return neg.join(pos, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all; labels of every seventh are moved on by one first."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mined(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
