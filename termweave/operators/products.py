"""Products of every query vector with every item vector, block by block: no row per pair of grams is ever made.

Items are laid out once per block as arrays. Up to `MOST` stored numbers they are one block that every task is handed;
beyond that items and queries are dealt into blocks, and every two blocks meet in one task. A task adds up all products
of a query at once and hands on what is asked for: every product, the best item of each group, or the nearest few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers stored in the items of a block; one block of this size (16 bytes a number) is sent to every executor.
MOST = 4_000_000
#: Queries of a block where the items are more than one.
QUERIES = 20_000
#: Rows that a task hands on in one batch; where every product is asked for, queries are cut into parts of so many.
ROWS = 1_000_000


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], ..., begin[0] + size[0] - 1, begin[1], ..."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Sparse:
    """A block's vectors as postings: for each gram id the items that have it, and their weights."""

    def __init__(self, ids, weights) -> None:
        (at, gid), (_, w) = lists(ids), lists(weights)
        length = np.diff(at)
        order = np.argsort(gid, kind="stable")
        gid = gid[order]
        first = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]]) if len(gid) else np.empty(0, np.int64)
        self.n, self.keys, self.at = len(length), gid[first], np.append(first, len(gid))
        self.owner, self.w = np.repeat(np.arange(self.n), length)[order], w[order]
        # The same numbers item by item: where each item's begin, the place of its gram among the keys, its weight
        self.row, self.flat = at, w
        self.gram = np.empty(len(gid), np.int64)
        self.gram[order] = np.repeat(np.arange(len(first)), np.diff(self.at))
        self.most = np.maximum.reduceat(self.w, first) if len(first) else np.empty(0)

    def scores(self, gid: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The product of one query with every item of the block."""
        if not len(self.keys) or not len(gid):
            return np.zeros(self.n)
        place = np.minimum(np.searchsorted(self.keys, gid), len(self.keys) - 1)
        known = self.keys[place] == gid
        place, w = place[known], w[known]
        size = self.at[place + 1] - self.at[place]
        rows = ranges(self.at[place], size)
        return np.bincount(self.owner[rows], weights=self.w[rows] * np.repeat(w, size), minlength=self.n)


    def known(self, gid: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The grams of a query that the block has: their places among the keys, and their weights."""
        if not len(self.keys) or not len(gid):
            return np.empty(0, np.int64), np.empty(0)
        place = np.minimum(np.searchsorted(self.keys, gid), len(self.keys) - 1)
        there = self.keys[place] == gid
        return place[there], w[there]

    def added(self, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What these grams add to the product of every item."""
        size = self.at[place + 1] - self.at[place]
        rows = ranges(self.at[place], size)
        return np.bincount(self.owner[rows], weights=self.w[rows] * np.repeat(w, size), minlength=self.n)

    def exact(self, items: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The whole products of some items alone, out of their own numbers."""
        dense = np.zeros(len(self.keys))
        dense[place] = w
        size = self.row[items + 1] - self.row[items]
        at = ranges(self.row[items], size)
        return np.bincount(np.repeat(np.arange(len(items)), size), weights=self.flat[at] * dense[self.gram[at]], minlength=len(items))


class Side:
    """Items of a block that stand for its codes, in one or several spaces whose products are fused by weights."""

    def __init__(self, code: np.ndarray, place: np.ndarray, vectors: list[tuple], weights: list[float]) -> None:
        self.order = np.lexsort((place, code))
        self.code = code[self.order]
        self.first = np.flatnonzero(np.r_[True, self.code[1:] != self.code[:-1]]) if len(code) else np.empty(0, np.int64)
        take = pa.array(self.order)
        self.spaces = [Sparse(ids.take(take), ws.take(take)) for ids, ws in vectors]
        self.weights = weights

    def by_code(self, value: np.ndarray, n: int) -> np.ndarray:
        """The greatest value of each code's items, 0 for codes without any."""
        out = np.zeros(n)
        if len(self.first):
            out[self.code[self.first]] = np.maximum.reduceat(value, self.first)
        return out


class Asked:
    """One query's grams on a side, those that can add most first, and the products that they have added up to so far."""

    def __init__(self, side: Side, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.side, self.known = side, [s.known(*v) for s, v in zip(side.spaces, vectors, strict=True)]
        space = np.repeat(np.arange(len(self.known)), [len(p) for p, _ in self.known])
        place = np.concatenate([p for p, _ in self.known])
        value = np.concatenate([w * f for (_, w), f in zip(self.known, side.weights, strict=True)])
        bound = np.concatenate([w * f * s.most[p] for (p, w), f, s in zip(self.known, side.weights, side.spaces, strict=True)])
        order = np.argsort(-bound, kind="stable")
        self.space, self.place, self.value = space[order], place[order], value[order]
        self.rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)  # what the grams from each one on can add at most
        self.done, self.partial = 0, np.zeros(len(side.code))

    def go_on(self, most: float) -> None:
        """Add grams until the others can add `most` at most."""
        to = max(self.done, int(np.searchsorted(-self.rest, -most)))
        for i, s in enumerate(self.side.spaces):
            own = np.flatnonzero(self.space[self.done : to] == i) + self.done
            if len(own):
                self.partial += s.added(self.place[own], self.value[own])
        self.done = to

    @property
    def left(self) -> float:
        return float(self.rest[self.done])

    def exact(self, items: np.ndarray) -> list[np.ndarray]:
        """The products of some items in each space."""
        return [s.exact(items, p, w) for s, (p, w) in zip(self.side.spaces, self.known, strict=True)]


#: Grams are added until the others can add so much; then what cannot be among the best any more is left out.
CUTS = (0.3, 0.1, 0.0)


def best_codes(sides: list[Side], shares: list[float], queries: list[list], n: int, seq: np.ndarray, k: int, tie: bool, allowed: list | None = None):
    """The k best codes of one query: (codes, scores, [score on a side], [item on a side or -1], [products of that item]).

    A code's score is the sum of its sides' best items' fused products, weighed by `shares`; zeros are left out, equal
    scores (to 12 decimals) go by the first side's score if `tie`, then by `seq`. Bounds of the grams not yet added
    rule codes and items out, so that most products are never finished. allowed: for each side None, or which of its
    items may be looked at.
    """
    asked = [Asked(side, q) for side, q in zip(sides, queries, strict=True)]
    allowed = allowed or [None] * len(sides)
    some = [np.arange(len(side.code)) if ok is None else np.flatnonzero(ok) for side, ok in zip(sides, allowed, strict=True)]
    for cut in CUTS:
        for a in asked:
            a.go_on(cut)
        if not cut and not any(a.left for a in asked):
            break
        held = [a.partial if ok is None else np.where(ok, a.partial, 0.0) for a, ok in zip(asked, allowed, strict=True)]
        top = [side.by_code(p, n) for side, p in zip(sides, held, strict=True)]
        low = sum(f * t for f, t in zip(shares, top, strict=True))
        least = np.partition(low, n - k)[n - k] if n > k else 0.0
        alive = low + sum(f * a.left for f, a in zip(shares, asked, strict=True)) >= least - 1e-9
        some = [np.flatnonzero(alive[side.code] & (p + a.left >= t[side.code] - 1e-9) & (True if ok is None else ok)) for side, a, p, t, ok in zip(sides, asked, held, top, allowed, strict=True)]
        if sum(map(len, some)) * 8 <= sum(len(side.code) for side in sides):
            break
    score, found, products = [], [], []
    for side, a, items in zip(sides, asked, some, strict=True):
        own = a.exact(items)
        fused = sum(w * x for w, x in zip(side.weights, own, strict=True)) if len(items) else np.zeros(0)
        value, item = np.zeros(n), np.full(n, -1)
        if len(items):
            r = np.round(fused, 12)
            code = side.code[items]
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            peak = np.flatnonzero(r == np.repeat(np.maximum.reduceat(r, first), np.diff(np.append(first, len(r)))))
            peak = peak[np.searchsorted(peak, first)]  # of a code's equal items the first by place
            peak = peak[sum(own)[peak] > 0]
            value[code[peak]], item[code[peak]] = fused[peak], items[peak]
            at = np.full(n, -1)
            at[code[peak]] = peak
            own = [np.append(x, 0.0)[at] for x in own]
        else:
            own = [np.zeros(n) for _ in side.spaces]
        score.append(value)
        found.append(item)
        products.append(own)
    whole = sum(f * s for f, s in zip(shares, score, strict=True))
    at = np.flatnonzero((whole > 0) | (score[0] > 0) if tie else whole > 0)
    keys = [seq[at], -np.round(whole[at], 12)]
    if tie:
        keys.insert(1, -np.round(score[0][at], 12))
    at = at[np.lexsort(keys)[:k]]
    return at, whole[at], [s[at] for s in score], [i[at] for i in found], [[x[at] for x in own] for own in products]


def one(column) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of a column begins and the last one ends, and the numbers of all of them."""
    column = one(column)
    at = np.asarray(column.offsets) if len(column) else np.zeros(1, np.int64)
    return at - at[0], column.flatten().to_numpy(zero_copy_only=False)


def each(queries: pa.Table | pa.RecordBatch, ids: str, weights: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The gram ids and weights of each query."""
    (at, gid), (_, w) = lists(queries.column(ids)), lists(queries.column(weights))
    for i in range(len(at) - 1):
        yield gid[at[i] : at[i + 1]], w[at[i] : at[i + 1]]


def against(queries: DataFrame, items: DataFrame, numbers: int, load: Callable, answer: Callable, kind, most: int | None = None, per_query: int = 1) -> DataFrame:
    """`answer(block, queries)` for every block of items and every batch of queries.

    load(table of items) makes a block, answer(block, batch) a record batch of `kind` (of kind_of), a row for
    what it finds. numbers: how many numbers the items store, which decides the number of blocks. per_query: the most
    rows that all items together give a query; no batch has more than ROWS rows, or those of one query. Both sides need
    a column `key` to be dealt by. With more than one block the caller merges what the blocks found.
    """
    spark, most = queries.sparkSession, MOST if most is None else most
    blocks, parallel = max(1, -(-numbers // most)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, ROWS // max(1, per_query))
    if blocks == 1:
        table = items.toArrow()  # at most `most` numbers
        told = spark.sparkContext.broadcast(table.combine_chunks())

        def alone(batches) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    block = load(told.value) if block is None else block
                    yield answer(block, batch.slice(at, step))

        # Query vectors are small and what is done with them is not: they are dealt to all cores, by a hash, as
        # repartition() by a column that they are dealt by already would be left out
        return queries.repartition(parallel, F.xxhash64("key")).mapInArrow(alone, kind[0])
    parts = max(1, -(-parallel // blocks), -(-queries.count() // min(QUERIES, max(1, ROWS * blocks // max(1, per_query)))))
    block = lambda key, n: F.pmod(F.xxhash64(F.lit(n), key), F.lit(n)).cast("int")
    left = queries.withColumn("_q", block("key", parts)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = items.withColumn("_i", block("key", blocks)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    schema = kind[1]

    def met(own: pa.Table, other: pa.Table) -> pa.Table:
        if not own.num_rows or not other.num_rows:
            return schema.empty_table()
        return pa.Table.from_batches([answer(load(other.combine_chunks()), own.combine_chunks())], schema)

    return left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInArrow(met, kind[0])


def kind_of(ddl: str):
    """The Spark and the Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(ddl.replace(" long", " bigint"))
    return kind, to_arrow_schema(kind)


def made(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch out of Arrow or numpy columns."""
    arrays = [one(c) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
