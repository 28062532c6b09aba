"""Operator 6: approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each of several codebooks. The codebooks are
fitted on a bounded sample: k-means on residuals, then least squares over all codebooks at once. Every vector is
encoded by a beam search over the codebooks and stored with its codes, the norm of its approximation and its distance
from it. A query makes a table of its products with all codewords; an approximate distance is then a sum of table
entries and the stored norm. Blocks of queries meet blocks of the index in tasks of their own, so that neither is ever
held whole. The best by the approximation are compared exactly, and after them every row whose approximation is not
farther than the best so far by more than the row's own distance from it: by the triangle inequality no nearer row is
left out, whatever the vectors are like. Where codebooks fit the vectors badly more rows are compared, not fewer found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm.common import arrow_batch, table, written
from termweave.operators import products

#: Vectors that the codebooks are fitted on, about, by a hash of their ids.
SAMPLE = 20_000
BOOKS, WORDS, BEAM, ROUNDS = 32, 128, 4, 4
#: Candidates that each query compares exactly in a block before the bound of the others is known.
RERANK = 200
#: Rows that are compared at once.
AT_ONCE = 8192
#: Pairs of one row of the index that meet in one task of the rerank; a row found more often is dealt out in copies.
HUB = 2000


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    centre = np.concatenate([centre, np.zeros((k - len(centre), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = np.argmin((centre**2).sum(1) - 2 * x @ centre.T, axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre).astype(x.dtype)
    return centre


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books) by beam search: after each codebook, the best few sums of codewords of each row go on."""
    m, k, d = books.shape
    left, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8 if k <= 256 else np.int32)
    rows = np.arange(len(x))[:, None]
    for book in books:
        cost = (left**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * left @ book.T
        flat = cost.reshape(len(x), -1)
        b = min(beam, flat.shape[1])
        best = np.argpartition(flat, b - 1, axis=1)[:, :b]
        best = best[rows, np.argsort(flat[rows, best], axis=1, kind="stable")]
        parent, word = best // k, best % k
        left = left[rows, parent] - book[word]
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(codes.dtype)], axis=2)
    return codes[:, 0]


def fit(x: np.ndarray, m: int = BOOKS, k: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (m, k, dimensions) for the rows of x."""
    rng, left, books = np.random.default_rng(7), x.astype(np.float32), []
    if not len(x):
        return np.zeros((m, k, x.shape[1]), np.float32)
    for _ in range(m):
        book = kmeans(left, k, rounds, rng)
        books.append(book)
        left = left - book[np.argmin((book**2).sum(1) - 2 * left @ book.T, axis=1)]
    books = np.stack(books)
    # All codebooks anew, given the codes: a ridge regression on which codewords each row uses
    codes = np.concatenate([encode(part, books) for part in np.array_split(x.astype(np.float32), -(-len(x) // 4096))]).astype(np.int64)
    at = codes + np.arange(m) * k
    gram, right = np.zeros((m * k, m * k)), np.zeros((m * k, x.shape[1]))
    for i in range(m):
        np.add.at(right, at[:, i], x)
        for j in range(m):
            np.add.at(gram, (at[:, i], at[:, j]), 1.0)
    start = books.reshape(m * k, -1).astype(np.float64)
    return (start + np.linalg.solve(gram + np.eye(m * k), right - gram @ start)).reshape(m, k, -1).astype(np.float32)


def usable(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, and finite components, not all zero, of the length `size`, or else the most frequent one."""
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.filter(F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    if size is not None:
        return v.filter(F.size("embedding") == size)
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.filter(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as a matrix."""
    at, numbers = products.lists(column)
    return numbers.reshape(len(at) - 1, -1) if len(at) > 1 else np.zeros((0, 1))


def centred(x: np.ndarray, scale: float, centre: np.ndarray | float) -> np.ndarray:
    """Scaled by a power of two under which the table's largest component is below 1, less the centre of the scaled vectors: no square overflows, and the order of distances stays."""
    return x * scale - centre


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in doubles; where the squares would overflow or vanish, of the differences over the largest of them."""
    gap = x - q
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((gap**2).sum(1))
    odd = np.flatnonzero(~((out > 1e-140) & (out < 1e150)))
    if len(odd):
        largest = np.abs(gap[odd]).max(1, initial=0.0)
        part = np.divide(gap[odd], largest[:, None], out=np.zeros_like(gap[odd]), where=largest[:, None] > 0)
        out[odd] = largest * np.sqrt((part**2).sum(1))
    return out


def index(vectors: DataFrame, books: np.ndarray, scale: float = 1.0, centre: np.ndarray | float = 0.0) -> DataFrame:
    """(vec_id, codes, norm, off, embedding) for every row; off: the distance between the approximation and the vector, scaled."""
    told = vectors.sparkSession.sparkContext.broadcast(books)
    ddl = "vec_id long, codes binary, norm double, off double, embedding array<double>"

    def run(batches) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = centred(matrix(part.column("embedding")), scale, centre)
                codes = encode(x.astype(np.float32), told.value)
                near = told.value[np.arange(codes.shape[1]), codes.astype(np.int64)].sum(1, dtype=np.float64)
                columns = [part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near**2).sum(1)), pa.array(distances(near, x)), part.column("embedding")]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "codes", "norm", "off", "embedding"])

    return vectors.mapInArrow(run, ddl)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to smaller ids, in order."""
    if len(score) > k:
        at = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], score[at]))[:k]]


def search(stored: DataFrame, n: int, books: np.ndarray, asked: DataFrame, k: int, rerank: int = RERANK, most: int | None = None, scale: float = 1.0, centre: np.ndarray | float = 0.0) -> DataFrame:
    """(query_id, vec_id): the k rows of the index (of n rows) that are nearest, for every query (vec_id, embedding).

    `rerank` rows of a block, those nearest by the approximation, give a distance within which the k nearest lie; a row
    is compared too unless its approximation is farther than that by more than `off`.
    """
    m, _, d = books.shape
    told = stored.sparkSession.sparkContext.broadcast(books)
    kind = products.kind_of("query_id long, vec_id long, score double")
    schema = kind[1]

    def load(table: pa.Table):
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(table.num_rows, m)
        return np.ascontiguousarray(codes.T), table["norm"].to_numpy(), table["off"].to_numpy(), table["vec_id"].to_numpy(), matrix(table["embedding"])

    def answer(block, batch):
        codes, norm, off, ids, x = block
        own, which, found, scores = batch.column("query_id").to_numpy(), [], [], []
        words, size = told.value.astype(np.float64), np.sqrt(norm)
        compared = lambda at, q: np.concatenate([np.empty(0), *(distances(x[at[i : i + AT_ONCE]], q) for i in range(0, len(at), AT_ONCE))])
        for i, q in enumerate(matrix(batch.column("embedding"))):
            c = centred(q, scale, centre)
            look = 2 * (words @ c)  # a row of products for each codebook
            square = norm + c @ c
            for j in range(m):
                square -= look[j][codes[j]]
            others = np.flatnonzero(ids != own[i])
            near = np.sqrt(np.maximum(square[others], 0.0))
            first = np.arange(len(others))
            if len(others) > rerank:
                first = np.argpartition(near**2 - off[others] ** 2, rerank - 1)[:rerank]
            at, score = others[first], compared(others[first], q)
            if len(others) > rerank:
                within = np.partition(score, k - 1)[k - 1] * scale
                # Sums of products are good to some 1e-14 of the squares
                open_ = near - off[others] <= within * (1 + 1e-9) + 1e-7 * (np.sqrt(c @ c) + size[others]) + 1e-9 * off[others]
                open_[first] = False
                more = others[open_]
                at, score = np.concatenate([at, more]), np.concatenate([score, compared(more, q)])
            best = best_of(score, ids[at], k)
            which.append(np.full(len(best), own[i]))
            found.append(ids[at[best]])
            scores.append(score[best])
        joined = lambda x, of: np.concatenate([np.empty(0, of), *x])
        return products.made(schema, [joined(which, np.int64), joined(found, np.int64), joined(scores, np.float64)])

    items = stored.withColumn("key", F.col("vec_id"))
    queries = asked.select(F.col("vec_id").alias("query_id"), "embedding", F.col("vec_id").alias("key"))
    out = products.against(queries, items, n * (d + m // 8 + 3), load, answer, kind, most, k)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("nth", nth).filter(F.col("nth") <= k).select("query_id", "vec_id").distinct()


def exact(found: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): the distances of the pairs (query_id, vec_id) on the original vectors.

    A row that many queries have found (a common vector, say) is copied, and its pairs are dealt out among the copies.
    """
    hubs = found.groupBy("vec_id").count().filter(F.col("count") > HUB).select("vec_id", F.ceil(F.col("count") / HUB).cast("int").alias("copies"))
    own = rows.join(hubs, "vec_id", "left").select("vec_id", F.col("embedding").alias("x"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    dealt = found.join(hubs, "vec_id", "left").select("vec_id", "query_id", F.pmod(F.xxhash64("query_id"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    pairs = dealt.join(own, ["vec_id", "copy"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")

    def run(batches) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                yield arrow_batch("query_id long, vec_id long, score double", part.column("query_id"), part.column("vec_id"), distances(matrix(part.column("x")), matrix(part.column("q"))))

    return pairs.select("query_id", "vec_id", "x", "q").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, rerank: int = RERANK, most: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, by Euclidean distance on the vectors.

    A query's own id is no candidate. Vectors that are null or zero, that hold null or non-finite components, or whose
    length is not the most frequent one of `vectors` take no part, nor do rows without an id; of equal distances the
    smaller vec_id comes first; rows that repeat an id are candidates each, and as queries they are one, the least
    vector. Fewer candidates than k: all of them. An empty table gives no rows. Columns other than vec_id and
    embedding are not looked at.
    """
    rows = usable(vectors)
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("embedding", F.abs))).alias("largest"), F.first(F.size("embedding")).alias("d")).first()
    n, scale = told["n"], math.ldexp(1.0, -max(-1000, min(1000, math.frexp(told["largest"] or 1.0)[1])))
    part = min(1.0, sample / max(n, 1))
    some = rows.filter(F.xxhash64("vec_id").bitwiseAND(F.lit((1 << 40) - 1)) < part * float(1 << 40)).select("embedding").toArrow()
    x = matrix(some["embedding"]) * scale
    centre = x.mean(0) if len(x) else 0.0
    books = fit((x - centre).astype(np.float32))
    stored = written(index(rows, books, scale, centre), "index")
    asked = usable(queries, told["d"] or 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    near = written(search(stored, n, books, asked, k, max(rerank, k), most, scale, centre), "found")
    found = exact(near, rows, asked)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
