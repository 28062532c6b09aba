"""Ranked candidates by TF-IDF similarity, and their fusion.

A space is fitted once: a table of grams with their inverse document frequencies, and a vector of unit length for each
item. Texts are scored once each, however many records share them, by blocked products (see products.py): a row comes
out for each query and code, none for a pair of grams. Weights only enter in fuse functions, so a grid of weights costs
no second product.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.functions.text import EMPTY, char_grams, nonempty, word_grams, words
from termweave.operators import products
from termweave.sources.records import alias_rows, require_columns, row_keys, with_row_id

#: A dictionary of at most this many grams is broadcast to the texts; a larger one is joined by a shuffle on the gram.
BROADCAST_ROWS = 500_000
#: Cosines that a task holds at once.
COSINES = 2_000_000
#: Texts of a partition in which their grams are made.
TEXTS = 5_000
#: Words of texts that are counted at once, and weights that are added up at once.
WORDS = 150_000
#: Grams whose counts a task holds before it hands them on, and sums of codes' weights likewise.
HELD, SUMS = 400_000, 2_000_000
#: Characters of texts for each partition in which the counts of their grams meet.
CHARS = 4_000_000
#: Grams of such a partition that are handed on at least.
FIRST = 1_000
#: What is kept for reuse, so that it can be given back.
KEPT: list[DataFrame] = []


def char_3_5(c) -> Column:
    return char_grams(c, 3, 5)


def char_2_5(c) -> Column:
    return char_grams(c, 2, 5)


def kept(df: DataFrame) -> DataFrame:
    """Cached until release(); what still needs it after that is computed anew."""
    KEPT.append(df.cache())
    return df


def release() -> None:
    """Give back the storage of everything that was kept."""
    while KEPT:
        KEPT.pop().unpersist()


@dataclass(frozen=True)
class Space:
    """A fitted space. sublinear: term frequencies count as 1 + ln(tf). idf: (gram, gid, idf); numbers: weights stored in the items' vectors; items: how many there are."""

    grams: Callable[[Column | str], Column]
    sublinear: bool
    idf: DataFrame
    postings: DataFrame
    numbers: int
    small: bool
    items: int = 1

    @property
    def vectors(self) -> DataFrame:
        """(item, ids, ws)"""
        return as_vectors(self.postings)


def counted(items: DataFrame, grams: Callable) -> DataFrame:
    """(item, gram, tf). Rows of an item stay where the item is, so nothing is shuffled twice."""
    return items.select("item", F.explode(grams(nonempty("text"))).alias("gram")).groupBy("item", "gram").agg(F.count(F.lit(1)).alias("tf"))


def apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the others, or None if there are no others. Nulls are one key."""
    many = rows.groupBy(F.col(key).alias("_many")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_many")
    if many.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("_many"))
    return rows.join(many, same, "left_anti"), rows.join(many, same, "left_semi")


def worded(rows: DataFrame, *keep: str) -> DataFrame:
    """(words, ...) of (item, text, ...): the words that word_grams() makes its grams of, in as many partitions as there are cores at least."""
    spark = rows.sparkSession
    if rows.select(F.spark_partition_id().alias("p")).distinct().count() < spark.sparkContext.defaultParallelism:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        rows = rows.select("item", "text", *keep).repartition(parts, F.xxhash64("item"))
    # White space at the ends of a text is no part of its words
    body = F.when(F.coalesce("text", F.lit("")).rlike(r"(?U)\S"), F.col("text")).otherwise(EMPTY)
    return rows.select(words(body).alias("words"), *keep)


def coded(batch: pa.RecordBatch, code: Callable[[list[str]], np.ndarray], most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of parts of a batch of worded(), of `most` words or one row: (first row, row behind the last one, and for each gram its row in the part and its key).

    code: the numbers of distinct words, -1 for those that are none of the grams' words. A word's key is its number, a
    pair's the first one's plus 1 in the upper half, and the second one's in the lower half.
    """
    column = batch.column("words")
    at, begin = np.asarray(column.offsets).astype(np.int64), 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        told = column.slice(begin, end - begin).flatten().dictionary_encode()
        word = code(told.dictionary.to_pylist())[told.indices.to_numpy()]
        row = np.repeat(np.arange(end - begin), np.diff(at[begin : end + 1]))
        pair = np.flatnonzero((row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0))
        some = np.flatnonzero(word >= 0)
        yield begin, end, np.concatenate([row[some], row[pair]]), np.concatenate([word[some], ((word[pair] + 1) << 32) | word[pair + 1]])
        begin = end


def added(key: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """The distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return [key[first], *[np.add.reduceat(n[order], first) if len(first) else n for n in numbers]]


class Held:
    """Sums by keys, at most so many of them and one part's more."""

    def __init__(self, most: int) -> None:
        self.most, self.parts, self.size = most, [], 0

    def add(self, *part: np.ndarray) -> bool:
        """Whether the sums should be taken now."""
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.most:
            self.parts = [added(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
        return self.size > self.most // 2 and len(self.parts) == 1

    def take(self) -> list[np.ndarray] | None:
        parts, self.parts, self.size = self.parts, [], 0
        return added(*map(np.concatenate, zip(*parts, strict=True))) if parts else None


def bucket(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Which of n buckets grams lie in, by the CRCs of their words; the second one of a word alone is 0."""
    with np.errstate(over="ignore"):
        x = (first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def packed(grams: pa.Array, df: np.ndarray, total: np.ndarray, to: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row (bucket, counts) for each bucket: Spark deals these, and no row for a gram."""
    order = np.argsort(to, kind="stable")
    own = pa.record_batch([grams.take(pa.array(order)), pa.array(df[order]), pa.array(total[order])], COUNTS)
    first = np.flatnonzero(np.diff(to[order], prepend=-1))
    for begin, end in zip(first, np.append(first, len(order))[1:], strict=True):
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, COUNTS) as stream:
            stream.write_batch(own.slice(begin, end - begin))
        yield products.made(schema, [pa.array([to[order[begin]]]), pa.array([out.getvalue().to_pybytes()], pa.binary())])


#: Counts of grams as tasks hand them on.
COUNTS = pa.schema([("gram", pa.string()), ("df", pa.int64()), ("total", pa.int64())])


def totals(items: DataFrame, n: int) -> DataFrame:
    """(bucket, counts), of n buckets: how often word_grams() of rows that are an item each occur, counted where the texts lie."""
    kind, schema = products.kind_of("bucket int, counts binary")

    def run(batches) -> Iterator[pa.RecordBatch]:
        number, held = defaultdict(), Held(HELD)
        number.default_factory = number.__len__

        def rows() -> Iterator[pa.RecordBatch]:
            names = list(number)
            crc = np.fromiter((crc32(w.encode()) for w in names), np.int64, len(names))
            key, df, total = held.take() or [np.empty(0, np.int64)] * 3
            names = pa.array(names, pa.string())
            for at in range(0, len(key), HELD):
                k = key[at : at + HELD]
                one, two = k[k >> 32 == 0], k[k >> 32 > 0]
                left, right = (two >> 32) - 1, two & 0xFFFFFFFF
                both = pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right)), " ")
                to = np.concatenate([bucket(crc[one], np.zeros(len(one)), n), bucket(crc[left], crc[right], n)])
                yield from packed(pa.concat_arrays([names.take(pa.array(one)), both]), df[at : at + HELD], total[at : at + HELD], to, schema)
            number.clear()

        code = lambda ws: np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
        for batch in batches:
            for begin, end, row, key in coded(batch, code, WORDS):
                own = pa.array(key).dictionary_encode()
                gram = own.indices.to_numpy().astype(np.int64)
                place = np.sort(gram * (end - begin) + row)
                size = len(own.dictionary)
                df = np.bincount(place[np.r_[True, place[1:] != place[:-1]]] // (end - begin), minlength=size) if len(place) else np.zeros(0, np.int64)
                if held.add(own.dictionary.to_numpy(), df, np.bincount(gram, minlength=size)):
                    yield from rows()
        yield from rows()

    return worded(items).mapInArrow(run, kind)


def as_totals(counts: DataFrame, n: int) -> DataFrame:
    """Rows (gram, df, total) as totals() gives them."""
    kind, schema = products.kind_of("bucket int, counts binary")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [[crc32(w.encode()) for w in g.split(" ")] for g in batch.column("gram").to_pylist()]
            to = bucket(np.array([e[0] for e in ends], np.int64), np.array([e[1] if len(e) > 1 else 0 for e in ends], np.int64), n)
            yield from packed(batch.column("gram"), batch.column("df").to_numpy(), batch.column("total").to_numpy(), to, schema)

    return counts.select("gram", "df", "total").mapInArrow(run, kind)


def met(counts: DataFrame, n: int, min_df: int, most: int) -> DataFrame:
    """(gram, df, total) of totals(): of each bucket the `most` grams of at least `min_df` and the largest totals, ties to the smaller gram; the next one has -1 as its df."""
    kind, _ = products.kind_of("gram string, df long, total long")

    def added_up(tables: list[pa.Table]) -> pa.Table:
        got = pa.concat_tables(tables).group_by("gram", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
        return pa.table([got["gram"], got["df_sum"], got["total_sum"]], COUNTS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, 0
        for batch in batches:
            for blob in batch.column("counts"):
                held.append(pa.ipc.open_stream(blob.as_py()).read_all())
                size += held[-1].num_rows
                if size > products.ROWS + 2 * whole:
                    held = [added_up(held)]
                    size = whole = held[0].num_rows
        if held:
            table = added_up(held)
            table = table.filter(pc.greater_equal(table["df"], min_df))
            if table.num_rows > most:
                least = np.partition(table["total"].to_numpy(), table.num_rows - most - 1)[table.num_rows - most - 1]
                table = table.filter(pc.greater_equal(table["total"], least)).sort_by([("total", "descending"), ("gram", "ascending")]).slice(0, most + 1)
                table = table.set_column(1, "df", pa.array(np.append(table["df"].to_numpy()[:-1], -1)))
            yield from table.to_batches()

    return counts.repartitionById(n, "bucket").mapInArrow(run, kind)


def label_sums(items: DataFrame, idf: DataFrame) -> DataFrame:
    """(code, gid, w): the sums of the unit vectors (word_grams(), sublinear) of each code's rows, for rows (item, text, codes) that are an item each.

    idf: a dictionary of BROADCAST_ROWS rows at most. The sums are made where the texts lie.
    """
    told = items.sparkSession.sparkContext.broadcast(idf.select("gram", "gid", "idf").toArrow().combine_chunks())
    kind, schema = products.kind_of("code string, gid long, w double")

    def run(batches) -> Iterator[pa.RecordBatch]:
        space, number, codes, held = told.value, {}, {}, Held(SUMS)
        names = [g.split(" ") for g in space["gram"].to_pylist()]
        for ws in names:
            for w in ws:
                number.setdefault(w, len(number))
        keys = np.array([number[ws[0]] if len(ws) == 1 else ((number[ws[0]] + 1) << 32) | number[ws[1]] for ws in names], np.int64)
        order = np.argsort(keys)
        keys, gid, weight = keys[order], space["gid"].to_numpy()[order], space["idf"].to_numpy()[order]
        del names
        code = lambda ws: np.fromiter(map(number.get, ws, repeat(-1)), np.int64, len(ws))

        def rows() -> Iterator[pa.RecordBatch]:
            known = pa.array(list(codes), pa.string())
            key, w = held.take() or [np.empty(0, np.int64)] * 2
            for at in range(0, len(key), products.ROWS):
                k = key[at : at + products.ROWS]
                yield products.made(schema, [known.take(pa.array(k // len(gid))), gid[k % len(gid)], w[at : at + products.ROWS]])
            codes.clear()

        for batch in batches if len(keys) else ():
            labels = batch.column("codes")
            own, of = labels.flatten().to_pylist(), np.asarray(labels.offsets).astype(np.int64)
            of -= of[0]
            for begin, end, row, key in coded(batch, code, WORDS):
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                some = keys[place] == key
                pair, tf = np.unique(row[some] * len(keys) + place[some], return_counts=True)
                row, place = np.divmod(pair, len(keys))
                w = (1.0 + np.log(tf)) * weight[place]
                w /= np.sqrt(np.bincount(row, w * w, end - begin))[row]
                first = np.searchsorted(row, np.arange(end - begin + 1))
                # A label of a row takes all weights of the row
                label = np.arange(of[begin], of[end])
                whose = np.repeat(np.arange(end - begin), np.diff(of[begin : end + 1]))
                size = np.diff(first)[whose]
                ends, at = np.cumsum(size), 0
                while at < len(label):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
                    take = products.ranges(first[whose[at:to]], size[at:to])
                    which = np.array([codes.setdefault(own[i], len(codes)) for i in label[at:to]], np.int64)
                    if held.add(*added(np.repeat(which, size[at:to]) * len(keys) + place[take], w[take])):
                        yield from rows()
                    at = to
        yield from rows()

    return worded(items, "codes").mapInArrow(run, kind).groupBy("code", "gid").agg(F.sum("w").alias("w"))


def frequencies(corpus: DataFrame, grams: Callable, min_df: int = 1, most: int | None = None) -> DataFrame:
    """(gram, df, total) of (item, text), of at least `min_df`. most: how many of the largest totals are asked for; texts are long then."""
    counts = lambda rows: counted(rows, grams).groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if most is None or grams is not word_grams:
        return counts(corpus).filter(F.col("df") >= min_df)
    chars = corpus.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // CHARS))
    lone, rest = apart(corpus, "item")
    rows = totals(lone, n)
    rows = rows if rest is None else rows.unionByName(as_totals(counts(rest), n))
    # Buckets are alike, as a hash makes them; where one has more of the first grams than it handed on, all hand on more
    own = 8 * -(-most // n) + FIRST
    while True:
        first = kept(met(rows, n, min_df, min(own, most)).orderBy(F.desc("total"), "gram").limit(most))
        if first.filter("df < 0").isEmpty():
            return first
        own *= 8


def weighted(tf: DataFrame, idf: DataFrame, sublinear: bool) -> DataFrame:
    """(item, gram, gid, w) of unit length; grams that the space does not know are dropped before."""
    w = tf.join(idf, "gram").withColumn("w", (F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("item")))
    return w.select("item", "gram", "gid", (F.col("w") / norm).alias("w"))


def as_vectors(postings: DataFrame) -> DataFrame:
    """(item, ids, ws): a row per item, its grams' ids ascending."""
    pairs = F.array_sort(F.collect_list(F.struct("gid", "w")))
    return postings.groupBy("item").agg(pairs.alias("v")).select("item", F.transform("v", lambda x: x["gid"]).alias("ids"), F.transform("v", lambda x: x["w"]).alias("ws"))


def numbered(df: DataFrame) -> DataFrame:
    """Grams with ids of 64 bits, by a hash whose seed is one under which no two of them meet."""
    seed = 0
    while True:
        rows = df.withColumn("gid", F.xxhash64(F.lit(seed), "gram"))
        if rows.groupBy("gid").count().filter("count > 1").isEmpty():
            return rows
        seed += 1


def fit(corpus: DataFrame, grams: Callable, sublinear: bool = False, min_df: int = 1, max_features: int | None = None, items: DataFrame | None = None) -> Space:
    """Fit a space on (item, text): idf = ln((1 + N) / (1 + df)) + 1. Blank text counts as `__empty__`.

    With `max_features` the grams of the largest total frequency stay, ties to the smaller gram. items: (item, text)
    that get vectors, where these are not the corpus that grams are weighed by.
    """
    corpus = require_columns(corpus, {"item", "text"}).select("item", "text")
    tf = counted(corpus, grams)
    df = frequencies(corpus, grams, min_df, max_features)
    if max_features is not None:
        df = df.orderBy(F.desc("total"), "gram").limit(max_features)
    n = corpus.agg(F.count_distinct("item").alias("n"))
    idf = kept(df.crossJoin(F.broadcast(n)).select("gram", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf")))
    size = idf.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("numbers")).crossJoin(n.withColumnRenamed("n", "items")).first()
    idf = numbered(idf).select("gram", "gid", "idf")
    if items is not None:
        tf = counted(items.select("item", "text"), grams)
        size = tf.join(idf, "gram", "left_semi").agg(F.count(F.lit(1)).alias("numbers"), F.count_distinct("item").alias("items")).first().asDict() | {"n": size["n"]}
    small = size["n"] <= BROADCAST_ROWS
    return Space(grams, sublinear, idf, weighted(tf, F.broadcast(idf) if small else idf, sublinear), size["numbers"], small, size["items"])


def query_vectors(queries: DataFrame, space: Space) -> DataFrame:
    """(query, ids, ws) of (query, text); queries without a known gram give no row."""
    own = counted(queries.select(F.col("query").alias("item"), "text"), space.grams)
    return as_vectors(weighted(own, F.broadcast(space.idf) if space.small else space.idf, space.sublinear)).withColumnRenamed("item", "query")


def similarities(queries: DataFrame, space: Space, top: int | None = None, place: DataFrame | None = None) -> DataFrame:
    """(query, item, sim): the cosine of every query and item that share a gram; queries are (query, text).

    With `top` only the first so many of each query, by the cosine to 9 decimals and then by `place` (item, place).
    """
    asked, items = query_vectors(queries, space), space.vectors
    kinds = f"query {dict(asked.dtypes)['query']}, item {dict(items.dtypes)['item']}, sim double"
    kind = products.kind_of(kinds)
    schema = kind[1]
    if top is not None:
        items = items.join(place.select("item", F.col("place").cast("long").alias("place")), "item")

    def load(table: pa.Table):
        return products.Sparse(table["ids"], table["ws"]), table["item"], table["place"].to_numpy() if top is not None else None

    def answer(block, batch):
        index, names, order = block
        which, found, sims = [], [], []
        for i, (ids, ws) in enumerate(products.each(batch, "ids", "ws")):
            s = index.scores(ids, ws)
            at = np.flatnonzero(s)
            if top is not None and len(at):
                r = np.round(s[at], 9)
                if len(at) > top:
                    near = r >= np.partition(r, len(r) - top)[len(r) - top]
                    at, r = at[near], r[near]
                at = at[np.lexsort((order[at], -r))[:top]]
            which.append(np.full(len(at), i))
            found.append(at)
            sims.append(s[at])
        joined = lambda x, of: np.concatenate([np.empty(0, of), *x])
        return products.made(schema, [batch.column("query").take(pa.array(joined(which, np.int64))), names.take(pa.array(joined(found, np.int64))), joined(sims, np.float64)])

    return products.against(asked.withColumn("key", F.col("query")), items.withColumn("key", F.col("item")), space.numbers, load, answer, kind, per_query=top or space.items).select("query", "item", "sim")


def best_by_code(queries: DataFrame, spaces: list[tuple[str, Space, float]], owners: DataFrame) -> DataFrame:
    """(query, code, fused, a score for each space, item): the best item of each code that shares a gram with the query.

    spaces: (name, space, weight) over the same items, fused by their weights. owners: (item, code, place); of items
    whose fused scores are equal to 12 decimals, the smallest place stands for its code.
    """
    asked, items = None, owners.select("item", F.col("code"), F.col("place").cast("long").alias("place"))
    for i, (_, space, _) in enumerate(spaces):
        q = query_vectors(queries, space).withColumnsRenamed({"ids": f"ids{i}", "ws": f"ws{i}"})
        asked = q if asked is None else asked.join(q, "query", "full_outer")
        items = items.join(space.vectors.withColumnsRenamed({"ids": f"ids{i}", "ws": f"ws{i}"}), "item", "left")
    none = lambda name: F.coalesce(name, F.array().cast("array<bigint>" if name.startswith("ids") else "array<double>")).alias(name)
    fields = [f"{c}{i}" for i in range(len(spaces)) for c in ("ids", "ws")]
    asked, items = asked.select("query", *map(none, fields)), items.select("item", "code", "place", *map(none, fields))
    names, weights = [n for n, _, _ in spaces], [w for _, _, w in spaces]
    kinds = f"query {dict(asked.dtypes)['query']}, code {dict(items.dtypes)['code']}, fused double, {', '.join(f'{n} double' for n in names)}, item {dict(items.dtypes)['item']}, place long"
    kind = products.kind_of(kinds)
    schema = kind[1]

    def load(table: pa.Table):
        group = products.one(table["code"]).dictionary_encode().indices.to_numpy()
        order = np.lexsort((table["place"].to_numpy(), group))
        table, group = table.take(pa.array(order)), group[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        return [products.Sparse(table[f"ids{i}"], table[f"ws{i}"]) for i in range(len(names))], table, first

    def answer(block, batch):
        indexes, table, first = block
        parts = [products.each(batch, f"ids{i}", f"ws{i}") for i in range(len(names))]
        which, found, values = [], [], [[] for _ in range(1 + len(names))]
        for i in range(batch.num_rows if len(first) else 0):
            own = [index.scores(*next(part)) for index, part in zip(indexes, parts, strict=True)]
            fused = sum(w * s for w, s in zip(weights, own, strict=True))
            some = np.flatnonzero(np.maximum.reduceat(sum(own), first))
            r = np.round(fused, 12)
            best = np.maximum.reduceat(r, first)
            at = np.flatnonzero(r == np.repeat(best, np.diff(np.append(first, len(r)))))  # in the order of the places inside a code
            at = at[np.searchsorted(at, first)][some]
            which.append(np.full(len(at), i))
            found.append(at)
            for v, x in zip(values, (fused, *own), strict=True):
                v.append(x[at])
        joined = lambda x, of: np.concatenate([np.empty(0, of), *x])
        rows = table.take(pa.array(joined(found, np.int64)))
        return products.made(schema, [batch.column("query").take(pa.array(joined(which, np.int64))), rows["code"], *(joined(v, np.float64) for v in values), rows["item"], rows["place"]])

    numbers = sum(space.numbers for _, space, _ in spaces)
    out = products.against(asked.withColumn("key", F.col("query")), items.withColumn("key", F.col("item")), numbers, load, answer, kind, per_query=owners.count())
    # Items of a code may lie in several blocks: the best of the blocks' best
    best = F.max_by(F.struct("fused", *names, "item"), F.struct(F.round("fused", 12), -F.col("place"))).alias("b")
    return out.groupBy("query", "code").agg(best).select("query", "code", "b.*")


def top_codes(queries: DataFrame, sides: list[tuple[list[tuple[str, Space, float]], DataFrame, float]], codes: DataFrame, k: int, tie: bool = False, most: int | None = None) -> DataFrame:
    """(query, code, score, a score for each space, item0, item1, ...): what the k best codes of each query can be, k of each block of items.

    sides: (spaces with names and weights, owners (item, code, place), share); a code's score is the sum over the sides
    of the share times its best item's fused cosine. codes: (code, row_seq). Items are dealt into blocks by their code;
    a code of more than half a block is cut into parts, each with the code's items of all other sides. A code's score
    is then reached in the part that has its best item, so the k best of every block hold the k best of all. Where
    queries have a column `at` and owners too, an item counts only for queries later than it.
    """
    timed = "at" in queries.columns
    most = products.MOST if most is None else most
    numbers = sum(space.numbers for spaces, _, _ in sides for _, space, _ in spaces)
    asked, rows, fields = None, None, []
    wide = max(len(spaces) for spaces, _, _ in sides)
    none = lambda c, of: F.coalesce(c, F.array().cast(of))
    for i, (spaces, own, _) in enumerate(sides):
        when = (F.col("at").cast("long") if timed and "at" in own.columns else F.lit(None).cast("long")).alias("at")
        items = own.select("item", "code", F.col("place").cast("long").alias("place"), when).join(codes.select("code", "row_seq"), "code")
        for j, (_, space, _) in enumerate(spaces):
            q = query_vectors(queries, space).withColumnsRenamed({"ids": f"ids{i}_{j}", "ws": f"ws{i}_{j}"})
            asked = q if asked is None else asked.join(q, "query", "full_outer")
            items = items.join(space.vectors.withColumnsRenamed({"ids": f"ids{j}", "ws": f"ws{j}"}), "item", "left")
            fields.append((f"{i}_{j}", "array<bigint>", "array<double>"))
        ready = [none(F.col(f"ids{j}") if j < len(spaces) else F.lit(None).cast("array<bigint>"), "array<bigint>").alias(f"ids{j}") for j in range(wide)]
        ready += [none(F.col(f"ws{j}") if j < len(spaces) else F.lit(None).cast("array<double>"), "array<double>").alias(f"ws{j}") for j in range(wide)]
        items = items.select(F.lit(i).alias("side"), F.col("item").cast("binary").alias("item"), "code", "place", "row_seq", "at", *ready)
        rows = items if rows is None else rows.unionByName(items)
    if timed:
        asked = asked.join(queries.select("query", F.col("at").cast("long").alias("at")), "query")
    asked = asked.select("query", *(["at"] if timed else []), *[none(F.col(f"ids{n}"), a).alias(f"ids{n}") for n, a, _ in fields], *[none(F.col(f"ws{n}"), b).alias(f"ws{n}") for n, _, b in fields])
    if numbers > most:
        size = sum(F.size(f"ids{j}") for j in range(wide))
        # At most 2 * numbers / most codes are that large
        large = rows.groupBy("code", "side").agg(F.sum(size).alias("n")).filter(F.col("n") > most // 2).groupBy("code").agg(F.max_by(F.struct("side", "n"), "n").alias("l"))
        large = large.select("code", F.col("l.side").alias("_side"), F.ceil(F.col("l.n") / (most // 2)).cast("int").alias("_parts"))
        rows = rows.join(F.broadcast(large), "code", "left")
        part = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(F.col("side") == F.col("_side"), F.array(F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        rows = rows.withColumn("_part", F.explode(part)).withColumn("key", F.xxhash64("code", "_part")).drop("_side", "_parts", "_part")
    else:
        rows = rows.withColumn("key", F.lit(0))
    names = [n for spaces, _, _ in sides for n, _, _ in spaces]
    counts, weights, shares = [len(s) for s, _, _ in sides], [[w for _, _, w in s] for s, _, _ in sides], [f for _, _, f in sides]
    found = [f"item{i}" for i in range(len(sides))]
    kind = products.kind_of(f"query {dict(asked.dtypes)['query']}, code {dict(rows.dtypes)['code']}, score double, {', '.join(f'side{i} double' for i in range(len(sides)))}, {', '.join(f'{n} double' for n in names)}, {', '.join(f'{f} binary' for f in found)}")
    schema = kind[1]

    def load(table: pa.Table):
        code = products.one(table["code"]).dictionary_encode()
        index, side, place = code.indices.to_numpy(), table["side"].to_numpy(), table["place"].to_numpy()
        seq = np.zeros(len(code.dictionary), np.int64)
        seq[index] = table["row_seq"].to_numpy()
        own, items, times = [], [], []
        for i, n in enumerate(counts):
            at = np.flatnonzero(side == i)
            mine = table.take(pa.array(at))
            s = products.Side(index[at], place[at], [(products.one(mine[f"ids{j}"]), products.one(mine[f"ws{j}"])) for j in range(n)], weights[i])
            own.append(s)
            items.append(products.one(mine["item"]).take(pa.array(s.order)))
            seen = products.one(mine["at"]).take(pa.array(s.order))
            times.append(None if seen.null_count == len(seen) else seen.fill_null(np.iinfo(np.int64).max).to_numpy())
        return own, items, code.dictionary, seq, times

    def answer(block, batch):
        own, items, names_, seq, times = block
        now = batch.column("at").to_numpy(zero_copy_only=False) if timed else None
        parts = [[products.each(batch, f"ids{i}_{j}", f"ws{i}_{j}") for j in range(n)] for i, n in enumerate(counts)]
        which, code, score = [], [], []
        side, item, product = [[] for _ in counts], [[] for _ in counts], [[] for _ in names]
        for q in range(batch.num_rows):
            at, whole, by_side, of_side, by_space = products.best_codes(own, shares, [[next(p) for p in ps] for ps in parts], len(seq), seq, k, tie, [None if t is None else t < now[q] for t in times] if timed else None)
            which.append(np.full(len(at), q))
            code.append(at)
            score.append(whole)
            for i in range(len(counts)):
                side[i].append(by_side[i])
                item[i].append(of_side[i])
            for out, x in zip(product, [x for xs in by_space for x in xs], strict=True):
                out.append(x)
        flat = lambda x, of: np.concatenate([np.empty(0, of), *x])
        taken = [items[i].take(pa.array(np.maximum(a := flat(item[i], np.int64), 0), mask=a < 0)) if len(items[i]) else pa.nulls(len(flat(item[i], np.int64)), pa.binary()) for i in range(len(counts))]
        return products.made(schema, [batch.column("query").take(pa.array(flat(which, np.int64))), names_.take(pa.array(flat(code, np.int64))), flat(score, np.float64), *(flat(s, np.float64) for s in side), *(flat(p, np.float64) for p in product), *taken])

    return products.against(asked.withColumn("key", F.col("query")), rows, numbers, load, answer, kind, most, k)


def best_of_parts(top: DataFrame, sides: list) -> DataFrame:
    """One row for each query and code of top_codes(): the highest score, and on each side the best item of all parts of the code."""
    best = [F.max_by(F.struct(f"side{i}", *[n for n, _, _ in spaces], f"item{i}"), f"side{i}").alias(f"b{i}") for i, (spaces, _, _) in enumerate(sides)]
    return top.groupBy("query", "code").agg(F.max("score").alias("score"), *best).select("query", "code", "score", *[f"b{i}.*" for i in range(len(sides))])


def dealt(texts: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """Dealt by a key into partitions of at most about TEXTS of `rows` texts, and into one for each shuffle partition at least.

    Spark merges partitions by their bytes, and a text takes a hundred times its bytes as grams.
    """
    return texts.repartition(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TEXTS)), key)


def by_text(records: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score each distinct query text once and give the scores to all rows with it. Records are (record_id, query_text) and row_id, where there is one."""
    named = records.withColumn("query", text_key("query_text"))
    texts = dealt(named.groupBy("query").agg(F.min("query_text").alias("text")), "query")
    return named.select(*row_keys(named), "query").join(score(texts), "query")


def text_key(c: Column | str) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.col(c) if isinstance(c, str) else c))


def query_text(df: DataFrame) -> DataFrame:
    """(record_id, query_text), and row_id where there is one: the mention, or the text where it has no characters."""
    return df.select(*row_keys(df), F.when(F.length("mention") > 0, F.col("mention")).otherwise(F.col("text")).alias("query_text"))


def history_text(df: DataFrame) -> DataFrame:
    """History rows with `item` and `text`: the mention where it is not blank, else the text."""
    if "mention" not in df.columns:
        return df
    return df.withColumn("text", F.when(F.trim("mention") != "", F.col("mention")).otherwise(F.col("text")))


def ranked(scores: DataFrame, codes: DataFrame, queries: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """(query, rank, code, ...): the k best codes of every query.

    The order is that over all codes: best score first, ties by the terminology's row_seq, then by the code. Codes that share nothing
    with the query have score 0; the first 2k codes suffice to fill up with them, as at most k - 1 of these matched.
    """
    extra = [c for c in scores.columns if c not in ("query", "code")]
    order = order or [F.desc(F.round("score", 12)), F.col("row_seq"), F.col("code")]  # sums may differ in their last bits from run to run
    top = scores.join(codes.select("code", "row_seq"), "code").withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    item = F.struct("rank", "code", *extra)
    lists = queries.select("query").distinct().join(top.groupBy("query").agg(F.array_sort(F.collect_list(item)).alias("own")), "query", "left")
    first = codes.orderBy("row_seq", "code").limit(2 * k).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_seq", "code"))), lambda x: x["code"]).alias("first"))
    kinds = dict(scores.dtypes)
    zero = lambda c: F.lit(0.0) if kinds[c] == "double" else F.lit(None).cast(kinds[c])
    own = F.coalesce("own", F.array().cast(top.select(F.array(item).alias("a")).schema["a"].dataType))
    free = F.array_except("first", F.transform("own", lambda x: x["code"]))
    filled = F.transform(F.slice(free, F.lit(1), k - F.size("own")), lambda c, i: F.struct((F.size("own") + i + 1).cast("int").alias("rank"), c.alias("code"), *[zero(e).alias(e) for e in extra]))
    lists = lists.crossJoin(F.broadcast(first)).withColumn("own", own).select("query", F.explode(F.concat("own", filled)).alias("x"))
    return lists.select("query", "x.*")


def history_items(history: DataFrame) -> DataFrame:
    """(gold_code, text, seq, copies, item): history rows of equal text and code stand as one."""
    rows = history_text(history).groupBy("gold_code", "text").agg(F.min("row_seq").alias("seq"), F.count(F.lit(1)).alias("copies"))
    return rows.withColumn("item", text_key(F.concat_ws("\u0001", "gold_code", "text")))


def owners(history: DataFrame) -> DataFrame:
    return history.select("item", F.col("gold_code").alias("code"), F.col("seq").alias("place"))


def confidence(best: Column, second: Column) -> Column:
    """Half the best score and half its lead over the second, between 0 and 1."""
    b = F.coalesce(best, F.lit(0.0))
    return F.least(F.greatest(0.5 * b + 0.5 * F.greatest(b - F.coalesce(second, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def identified(records: DataFrame) -> DataFrame:
    """The records, with row_ids if they have none and an id repeats."""
    if "row_id" in records.columns or records.groupBy("record_id").count().filter("count > 1").isEmpty():
        return records
    return with_row_id(records)


def predictions(top: DataFrame, key: str | None = None) -> DataFrame:
    """A row per record, or per row_id where there is one: predicted_code, confidence and the candidates in order."""
    by = row_keys(top) if key is None else [key]
    score = lambda i: F.max(F.when(F.col("rank") == i, F.col("score")))
    item = F.array_sort(F.collect_list(F.struct("rank", "code", "score")))
    return top.groupBy(*by).agg(F.max(F.when(F.col("rank") == 1, F.col("code"))).alias("predicted_code"), confidence(score(1), score(2)).alias("confidence"), item.alias("candidates"))


class HistoricalCoder:
    """Terminology and history in two spaces of character grams (3 to 5): (1 - w) * term score + w * best history score of the code."""

    def __init__(self, history_weight: float = 0.5, top_k: int = 10) -> None:
        if not 0 <= history_weight <= 1 or top_k < 1:
            raise ValueError("history_weight must be in [0, 1] and top_k at least 1")
        self.weight, self.k = history_weight, top_k

    def fit(self, history: DataFrame, terms: DataFrame) -> HistoricalCoder:
        require_columns(history, {"text", "gold_code"})
        require_columns(terms, {"code", "term", "row_seq"})
        self.codes = kept(terms.select("code", "row_seq", "term"))
        body = "search_text" if "search_text" in terms.columns else "term"
        self.terms = fit(terms.select(F.col("code").alias("item"), F.col(body).alias("text")), char_3_5)
        # Rows of equal text and code score alike: one item for them, the first row
        self.history = kept(history_items(history))
        self.memory = fit(self.history.select("item", "text"), char_3_5)
        return self

    def components(self, texts: DataFrame) -> DataFrame:
        """(query, code, terminology_score, history_score) of what shares a gram with the query; texts are (query, text)."""
        term = similarities(texts, self.terms).select("query", F.col("item").alias("code"), F.col("sim").alias("terminology_score"))
        past = best_by_code(texts, [("history_score", self.memory, 1.0)], owners(self.history)).select("query", "code", "history_score")
        both = term.join(past, ["query", "code"], "full_outer").fillna(0.0)
        return both.join(self.codes.select("code"), "code", "left_semi")

    def fused(self, parts: DataFrame, weight: float | None = None) -> DataFrame:
        w = self.weight if weight is None else weight
        return parts.withColumn("score", (1 - w) * F.col("terminology_score") + w * F.col("history_score")).filter("score > 0")

    def predict(self, records: DataFrame) -> DataFrame:
        """(record_id, rank, code, score, terminology_score, history_score) for records with record_id, text and mention; with row_id where records have one or repeat."""
        return by_text(query_text(identified(records)), lambda t: ranked(self.top(t), self.codes, t, self.k)).drop("query")

    def top(self, texts: DataFrame, most: int | None = None) -> DataFrame:
        """(query, code, score, terminology_score, history_score) of the best codes alone, k at most from each block."""
        own = self.codes.select(F.col("code").alias("item"), "code", F.lit(0).alias("place"))
        sides = [([("terminology_score", self.terms, 1.0)], own, 1 - self.weight), ([("history_score", self.memory, 1.0)], owners(self.history), self.weight)]
        return best_of_parts(top_codes(texts, sides, self.codes, self.k, most=most), sides).select("query", "code", "score", "terminology_score", "history_score")

    def cases(self, records: DataFrame, n: int = 5) -> DataFrame:
        """(record_id, rank, code, text, similarity): the nearest history rows; equal rows stand as one."""
        def nearest(t: DataFrame) -> DataFrame:
            s = similarities(t, self.memory, n, self.history.select("item", F.col("seq").alias("place"))).join(self.history, "item")
            s = s.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("sim", 9)), "seq"))).filter(F.col("rank") <= n)
            return s.select("query", "rank", F.col("gold_code").alias("code"), F.col("text").alias("case_text"), F.col("sim").alias("similarity"))

        return by_text(query_text(identified(records)), nearest).drop("query")

    def score_code(self, pairs: DataFrame, weight: float | None = None) -> DataFrame:
        """(key, score) for (key, text, code): the score of one code for a text; unknown codes and blank texts have 0."""
        w = self.weight if weight is None else weight
        texts = pairs.select(text_key("text").alias("query"), "text").distinct()
        parts = self.components(texts).withColumn("score", (1 - w) * F.col("terminology_score") + w * F.col("history_score"))
        named = pairs.withColumn("query", text_key("text")).join(parts.select("query", "code", "score"), ["query", "code"], "left")
        return named.select("key", F.when(F.trim("text") == "", 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


class AliasCoder:
    """Each alias is an item of its own: character grams (2 to 5) and words are fused per alias, the best alias stands for its code."""

    def __init__(self, history_weight: float = 0.5, word_weight: float = 0.2, top_k: int = 50) -> None:
        if not (0 <= history_weight <= 1 and 0 <= word_weight <= 1 and top_k >= 1):
            raise ValueError("weights must be in [0, 1] and top_k at least 1")
        self.hw, self.ww, self.k = history_weight, word_weight, top_k

    def fit(self, history: DataFrame, terms: DataFrame) -> AliasCoder:
        self.codes = kept(require_columns(terms, {"code", "term", "row_seq"}).select("code", "row_seq"))
        self.aliases = kept(alias_rows(terms).withColumn("item", text_key(F.concat_ws("\u0001", "code", "alias_idx"))))
        self.char = fit(self.aliases.select("item", F.col("alias").alias("text")), char_2_5, sublinear=True)
        self.word = fit(self.aliases.select("item", F.col("alias").alias("text")), word_grams, sublinear=True)
        self.history = kept(history_items(history))
        self.memory = fit(self.history.select("item", "text"), char_2_5, sublinear=True)
        return self

    def components(self, texts: DataFrame, word_weight: float | None = None) -> DataFrame:
        """(query, code, terminology_score, history_score, char_score, word_score, matched_alias)."""
        w = self.ww if word_weight is None else word_weight
        best = best_by_code(texts, [("char_score", self.char, 1 - w), ("word_score", self.word, w)], self.aliases.select("item", "code", F.col("alias_idx").alias("place")))
        term = best.join(self.aliases.select("item", F.col("alias").alias("matched_alias")), "item").select("query", "code", F.col("fused").alias("terminology_score"), "char_score", "word_score", "matched_alias")
        past = best_by_code(texts, [("history_score", self.memory, 1.0)], owners(self.history)).select("query", "code", "history_score")
        return term.join(past, ["query", "code"], "full_outer").fillna(0.0).join(self.codes.select("code"), "code", "left_semi")

    def fused(self, parts: DataFrame, weight: float | None = None) -> DataFrame:
        w = self.hw if weight is None else weight
        rows = parts.withColumn("score", (1 - w) * F.col("terminology_score") + w * F.col("history_score"))
        return rows.filter("score > 0 or terminology_score > 0")

    def predict(self, records: DataFrame) -> DataFrame:
        order = [F.desc(F.round("score", 12)), F.desc(F.round("terminology_score", 12)), F.col("row_seq")]
        return by_text(query_text(identified(records)), lambda t: ranked(self.top(t), self.codes, t, self.k, order)).drop("query")

    def top(self, texts: DataFrame, most: int | None = None) -> DataFrame:
        """(query, code, score, terminology_score, history_score, char_score, word_score, matched_alias) of the best codes alone, k at most from each block."""
        alias = [("char_score", self.char, 1 - self.ww), ("word_score", self.word, self.ww)]
        sides = [(alias, self.aliases.select("item", "code", F.col("alias_idx").alias("place")), 1 - self.hw), ([("history_score", self.memory, 1.0)], owners(self.history), self.hw)]
        best = best_of_parts(top_codes(texts, sides, self.codes, self.k, True, most), sides)
        best = best.join(self.aliases.select(F.col("item").alias("item0"), F.col("alias").alias("matched_alias")), "item0", "left")
        return best.select("query", "code", "score", F.col("side0").alias("terminology_score"), "history_score", "char_score", "word_score", "matched_alias")


def unit_rows(column) -> np.ndarray:
    """A list column of one length as a matrix whose rows have unit length; a zero vector stays zero."""
    at, numbers = products.lists(column)
    x = numbers.reshape(len(at) - 1, -1) if len(at) > 1 else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def dense_scores(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query, code, dense_score): the largest cosine of each code's vectors. queries: (query, vector); items: (code, vector), all of one length.

    Blocks of queries are multiplied with blocks of items; a block hands on a row for each query and code.
    """
    items = items.select("code", F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("code", "vector").alias("key"))
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"), F.col("query").alias("key"))
    numbers = items.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()["n"]
    kinds = f"query {dict(asked.dtypes)['query']}, code {dict(items.dtypes)['code']}, dense_score double"
    kind = products.kind_of(kinds)
    schema = kind[1]

    def load(table: pa.Table):
        table = table.sort_by("code")
        codes = products.one(table["code"])
        own = codes.to_pylist()
        first = np.array([i for i in range(len(own)) if i == 0 or own[i] != own[i - 1]], np.int64)
        return unit_rows(table["vector"]), codes.take(pa.array(first)), first

    def answer(block, batch):
        x, codes, first = block
        if not len(first):
            return products.made(schema, [batch.column("query").slice(0, 0), codes, np.empty(0)])
        q, n, out = unit_rows(batch.column("vector")), len(first), []
        step = max(1, COSINES // len(x))
        for at in range(0, len(q), step):
            out.append(np.maximum.reduceat(q[at : at + step] @ x.T, first, axis=1).ravel())
        which, code = np.repeat(np.arange(len(q)), n), np.tile(np.arange(n), len(q))
        return products.made(schema, [batch.column("query").take(pa.array(which)), codes.take(pa.array(code)), np.concatenate([np.empty(0), *out])])

    out = products.against(asked, items, numbers, load, answer, kind, per_query=items.select("code").distinct().count())
    return out.groupBy("query", "code").agg(F.max("dense_score").alias("dense_score"))


def dense_pool(queries: DataFrame, terms: DataFrame, history: DataFrame, share: float, pool: int, wanted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(query, code, dense_score, low, high): of each query the `pool` best codes and those in `wanted`, and the least and greatest score over all codes.

    queries: (query, vector); terms and history: (code, vector), all of one length; wanted: (query, code). A code's
    score is (1 - share) times its terms' best cosine plus share times its history's, 0 without any; ties go to the
    smaller code. A code's vectors lie in one block. One that fills more than half a block is cut into parts; its score
    leaves every part, so that least and greatest stay exact. A block hands on the pool, what is wanted, such codes
    and one row more for each query.
    """
    most = products.MOST if most is None else most
    own = terms.select("code").distinct()
    side = lambda df, i: df.join(own, "code", "left_semi").select(F.lit(i).alias("side"), "code", F.col("vector").cast("array<double>").alias("vector"))
    rows = side(terms, 0).unionByName(side(history, 1))
    sizes = rows.groupBy("code", "side").agg(F.sum(F.size("vector")).alias("n"))
    numbers = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    rows = rows.withColumn("split", F.lit(False)).withColumn("key", F.xxhash64("code"))
    if numbers > most:
        # At most 2 * numbers / most codes are that large
        large = sizes.filter(F.col("n") > most // 2).groupBy("code").agg(F.max_by(F.struct("side", "n"), "n").alias("l"))
        large = large.select("code", F.col("l.side").alias("_side"), F.ceil(F.col("l.n") / (most // 2)).cast("int").alias("_parts"))
        rows = rows.join(F.broadcast(large), "code", "left")
        part = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(F.col("side") == F.col("_side"), F.array(F.pmod(F.xxhash64("vector"), F.col("_parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        rows = rows.withColumn("split", F.col("_parts").isNotNull()).withColumn("_whole", F.coalesce("_side", F.lit(-1))).withColumn("_part", F.explode(part)).withColumn("key", F.xxhash64("code", "_part")).drop("_side", "_parts", "_part")
    else:
        rows = rows.withColumn("_whole", F.lit(-1))
    asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector"))
    none = F.array().cast(f"array<{dict(rows.dtypes)['code']}>")
    if wanted is not None:
        asked = asked.join(wanted.groupBy("query").agg(F.collect_set("code").alias("wanted")), "query", "left")
    asked = asked.select("query", "vector", (F.coalesce("wanted", none) if wanted is not None else none).alias("wanted"))
    kind = products.kind_of(f"query {dict(asked.dtypes)['query']}, code {dict(rows.dtypes)['code']}, dense_score double, split boolean, low double, high double")
    schema = kind[1]

    def load(table: pa.Table):
        table = table.sort_by("code")
        code = products.one(table["code"]).dictionary_encode()
        index, kind_, n = code.indices.to_numpy(), table["side"].to_numpy(), len(code.dictionary)
        split, whole = np.zeros(n, bool), np.full(n, -1)
        split[index] = table["split"].to_numpy()
        whole[index] = table["_whole"].to_numpy()
        x = unit_rows(table["vector"])
        parts = []
        for i in (0, 1):
            at = np.flatnonzero(kind_ == i)
            first = np.flatnonzero(np.r_[True, index[at][1:] != index[at][:-1]]) if len(at) else np.empty(0, np.int64)
            parts.append((x[at], first, index[at][first]))
        names = code.dictionary
        return parts, names, {v: j for j, v in enumerate(names.to_pylist())}, split, whole

    def answer(block, batch):
        parts, names, place, split, whole = block
        q, n = unit_rows(batch.column("vector")), len(names)
        which, code, score, ends = [], [], [], []
        lists = batch.column("wanted").to_pylist()
        for at in range(0, len(q), 256):
            best = []
            for x, first, of in parts:
                s = np.zeros((len(q[at : at + 256]), n))
                if len(first):
                    s[:, of] = np.maximum.reduceat(q[at : at + 256] @ x.T, first, axis=1)
                best.append(s)
            fused = (1 - share) * best[0] + share * best[1]
            # A part of a code without a vector of the side that was cut knows nothing of the code
            for i, (_, _, of) in enumerate(parts):
                blind = np.flatnonzero(split & (whole == i))
                fused[:, np.setdiff1d(blind, of)] = -np.inf
            for i, row in enumerate(fused):
                some = np.flatnonzero(row >= np.partition(row, n - pool)[n - pool]) if n > pool else np.arange(n)
                some = some[np.lexsort((some, -row[some]))[:pool]]
                extra = [place[c] for c in lists[at + i] if c in place]
                some = np.unique(np.concatenate([some, np.flatnonzero(split), np.array(extra, np.int64)])).astype(np.int64)
                some = some[np.isfinite(row[some])]
                which.append(np.full(len(some), at + i))
                code.append(some)
                score.append(row[some])
                plain = row[~split]
                ends.append((plain.min(), plain.max()) if len(plain) else (None, None))
        flat = lambda x, of: np.concatenate([np.empty(0, of), *x])
        w, c, k = flat(which, np.int64), flat(code, np.int64), len(ends)
        column = lambda a, b, of: pa.concat_arrays([a.cast(of), b.cast(of)])
        # The last rows have no code: they tell the least and greatest scores of the block
        return products.made(schema, [
            pa.concat_arrays([products.one(batch.column("query").take(pa.array(w))), products.one(batch.column("query"))]), column(names.take(pa.array(c)), pa.nulls(k), schema.field("code").type),
            column(pa.array(flat(score, np.float64)), pa.nulls(k), pa.float64()), column(pa.array(split[c]), pa.nulls(k), pa.bool_()),
            column(pa.nulls(len(c)), pa.array([a for a, _ in ends], pa.float64()), pa.float64()), column(pa.nulls(len(c)), pa.array([b for _, b in ends], pa.float64()), pa.float64()),
        ])

    out = products.against(asked.withColumn("key", F.col("query")), rows, numbers, load, answer, kind, most, pool + 1)
    scores = out.filter("code is not null").groupBy("query", "code").agg(F.max("dense_score").alias("dense_score"), F.first("split").alias("split"))
    cut = scores.filter("split").select("query", F.col("dense_score").alias("low"), F.col("dense_score").alias("high"))
    ends = out.filter("code is null").select("query", "low", "high").unionByName(cut).groupBy("query").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return scores.drop("split").join(ends, "query")


def min_max(value: Column | str, *by: str) -> Column:
    """Scaled to [0, 1] within each group; 0 where all are equal."""
    v = F.col(value) if isinstance(value, str) else value
    w = W.partitionBy(*by)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high <= low, 0.0).otherwise((v - low) / (high - low))


def advanced(lexical: DataFrame, dense: DataFrame, pool: int = 50, top_k: int = 10, dense_weight: float = 0.5, reranker: Callable[[DataFrame], DataFrame] | None = None, rerank_weight: float = 0.0) -> DataFrame:
    """Pools the best lexical and dense candidates and fuses them; a reranker may score the pool.

    lexical: (query, code, score); dense: (query, code, dense_score) of every code, scaled over all of them before the
    pools are made, or what dense_pool() gives, which brings the ends of the scale along. A code from the dense pool
    alone has lexical score 0. Ties go to the smaller code.
    """
    place = lambda c: F.row_number().over(W.partitionBy("query").orderBy(F.desc(c), "code"))
    first = lambda df, c: df.withColumn("_n", place(c)).filter(F.col("_n") <= pool).drop("_n")
    lex = first(lexical.select("query", "code", F.col("score").alias("lexical_score")), "lexical_score").withColumn("_lexical", F.lit(True))
    if dense_weight > 0:
        within = F.when(F.col("high") <= F.col("low"), 0.0).otherwise((F.col("dense_score") - F.col("low")) / (F.col("high") - F.col("low"))) if "low" in dense.columns else min_max("dense_score", "query")
        scaled = dense.withColumn("_dense", place("dense_score") <= pool).withColumn("dense_scaled", within)
    else:
        scaled = dense.withColumn("_dense", F.lit(False)).withColumn("dense_scaled", F.lit(0.0))
    # Sides that are dealt by query meet as groups without another shuffle; as joins on query and code they would be dealt anew
    both = lex.unionByName(scaled, allowMissingColumns=True)
    values = [c for c in both.columns if c not in ("query", "code")]
    rows = both.groupBy("query", "code").agg(*[F.max(c).alias(c) for c in values])
    rows = rows.filter(F.col("_lexical") | F.col("_dense")).fillna(0.0, values).drop("_lexical", "_dense")
    rows = rows.withColumn("retrieval_score", (1 - dense_weight) * F.col("lexical_score") + dense_weight * F.col("dense_scaled"))
    rows = first(rows, "retrieval_score").withColumn("score", F.col("retrieval_score"))
    if reranker is not None and rerank_weight > 0:
        rows = rows.join(reranker(rows), ["query", "code"], "left").fillna(0.0, ["reranker_score"])
        rows = rows.withColumn("score", (1 - rerank_weight) * F.col("retrieval_score") + rerank_weight * min_max("reranker_score", "query"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "code"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top_k)


class MultiLabelCoder:
    """Codes of long notes: terminology score in character grams (3 to 5), and the cosine to the mean of a code's training notes in word grams."""

    def __init__(self, history_weight: float = 0.5, top_k: int = 100, max_history_features: int = 100_000) -> None:
        self.weight, self.k, self.most = history_weight, top_k, max_history_features

    def fit(self, history: DataFrame, terms: DataFrame) -> MultiLabelCoder:
        """history: (record_id, text, gold_codes array); terms: (code, term, row_seq)."""
        self.codes = kept(terms.select("code", "row_seq"))
        body = "search_text" if "search_text" in terms.columns else "term"
        self.terms = fit(terms.select(F.col("code").alias("item"), F.col(body).alias("text")), char_3_5)
        n = history.count()
        self.notes = fit(history.select(F.col("record_id").alias("item"), "text"), word_grams, True, 1 if n < 50 else 2, self.most)
        self.labels = history.select(F.col("record_id").alias("item"), F.explode(F.array_distinct("gold_codes")).alias("code")).join(self.codes.select("code"), "code", "left_semi")
        # The mean of a code's rows, again of unit length; the number of rows cancels out
        mean = self.sums(history).join(self.codes.select("code"), "code", "left_semi")
        mean = mean.join(F.broadcast(self.notes.idf) if self.notes.small else self.notes.idf, "gid").select(F.col("code").alias("item"), "gram", "gid", "w")
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("item")))
        centroids = kept(mean.select("item", "gram", "gid", (F.col("w") / norm).alias("w")))
        self.centroids = Space(word_grams, True, self.notes.idf, centroids, centroids.count(), self.notes.small, self.codes.count())
        return self

    def sums(self, history: DataFrame) -> DataFrame:
        """(code, gid, w): the sums of the vectors of each code's notes. Notes of several rows are put together first; of others only sums leave the tasks."""
        none = F.array().cast("array<string>")
        notes = history.filter("record_id is not null").select(F.col("record_id").alias("item"), "text", F.coalesce(F.array_distinct(F.array_compact("gold_codes")), none).alias("codes"))
        lone, rest = apart(notes, "item") if self.notes.small else (None, notes)
        own = None if lone is None else label_sums(lone, self.notes.idf)
        if rest is None:
            return own
        vectors = weighted(counted(rest, word_grams), F.broadcast(self.notes.idf) if self.notes.small else self.notes.idf, True)
        labels = rest.select("item", F.explode("codes").alias("code")).distinct()
        rows = vectors.join(labels, "item").select("code", "gid", "w")
        return (rows if own is None else own.unionByName(rows)).groupBy("code", "gid").agg(F.sum("w").alias("w"))

    def scores(self, texts: DataFrame) -> DataFrame:
        term = similarities(texts, self.terms).select("query", F.col("item").alias("code"), F.col("sim").alias("terminology_score"))
        past = similarities(texts, self.centroids).select("query", F.col("item").alias("code"), F.col("sim").alias("history_score"))
        both = term.join(past, ["query", "code"], "full_outer").fillna(0.0)
        return both.withColumn("score", (1 - self.weight) * F.col("terminology_score") + self.weight * F.col("history_score")).filter("score > 0")

    def rank(self, notes: DataFrame) -> DataFrame:
        """(record_id, rank, code, score, ...) for notes with record_id and text."""
        q = notes.select("record_id", F.col("text").alias("query_text"))
        return by_text(q, lambda t: ranked(self.scores(t), self.codes, t, self.k)).drop("query")

    def support(self, proposals: DataFrame, limit: int = 2) -> DataFrame:
        """(record_id, code, rank, item, similarity): for (record_id, text, code), the nearest training notes with that code."""
        texts = proposals.select(F.col("record_id").alias("query"), "text").dropDuplicates(["query"])
        near = similarities(texts, self.notes).join(self.labels, "item").withColumnRenamed("query", "record_id")
        near = near.join(proposals.select("record_id", "code").distinct(), ["record_id", "code"])
        rank = F.row_number().over(W.partitionBy("record_id", "code").orderBy(F.desc(F.round("sim", 9)), "item"))
        return near.withColumn("rank", rank).filter(F.col("rank") <= limit).select("record_id", "code", "rank", "item", F.col("sim").alias("similarity"))


def with_scorer(pairs: DataFrame, score: Callable, schema: str = "query long, code string, reranker_score double") -> DataFrame:
    """Scores of an external model, in Arrow batches: `score(pandas frame) -> list of scores`; the model loads once in a worker."""

    def run(batches):
        for pdf in batches:
            yield pdf[["query", "code"]].assign(reranker_score=[float(s) for s in score(pdf)])

    return pairs.mapInPandas(run, schema)
