"""Pruned top-k retrieval equals ranking every product, in one block and in many, with a code that holds most items; batches stay bounded."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termweave.operators import products, retrieval


def data(spark, n=240, seed=4):
    rng = random.Random(seed)
    words = ["muscle", "pain", "ache", "rash", "skin", "red", "itchy", "nausea", "sick", "vomit", "cough", "fever", "chill", "sleep", "tired", "eye", "ear", "tooth", "hand", "foot"]
    phrase = lambda: " ".join(rng.sample(words, rng.randint(1, 5)))
    codes = [f"C{i:02d}" for i in range(40)]
    terms = [(c, phrase(), "|".join(phrase() for _ in range(rng.randint(0, 3))), i) for i, c in enumerate(codes)]
    # One code has half of all history
    history = [(phrase(), codes[7] if rng.random() < 0.5 else rng.choice(codes), i) for i in range(n)] + [("unknown code", "ZZ", n)]
    history += history[:20]  # repeated rows
    t = spark.createDataFrame(terms, "code string, term string, synonyms string, row_seq long")
    h = spark.createDataFrame(history, "text string, gold_code string, row_seq long")
    q = spark.createDataFrame([(str(i), phrase(), "") for i in range(60)] + [("none", "zzzz", ""), ("blank", "", ""), ("long", " ".join(words * 3), "")], "record_id string, text string, mention string")
    return h, t, q


def same(a, b, *columns):
    key = lambda df: {(r["record_id"], r["rank"]): [r["code"], *(None if r[c] is None else round(r[c], 9) if isinstance(r[c], float) else r[c] for c in columns)] for r in df.collect()}
    x, y = key(a), key(b)
    assert x == y and x


@pytest.mark.parametrize("weight", [0.0, 0.25, 1.0])
def test_historical_rankings_are_unchanged(spark, weight):
    h, t, q = data(spark)
    c = retrieval.HistoricalCoder(weight, 5).fit(h, t)
    every = retrieval.by_text(retrieval.query_text(q), lambda x: retrieval.ranked(c.fused(c.components(x)), c.codes, x, 5))
    same(c.predict(q), every, "score", "terminology_score", "history_score")
    texts = q.select(F.col("record_id").alias("query"), "text")
    for most in (600, 2500):  # blocks of few numbers: the large code is cut into parts
        top = c.top(texts, most)
        assert top.groupBy("query", "code").count().filter("count > 1").isEmpty()
        same(retrieval.ranked(top, c.codes, texts, 5).withColumnRenamed("query", "record_id"), retrieval.ranked(c.fused(c.components(texts)), c.codes, texts, 5).withColumnRenamed("query", "record_id"), "score", "terminology_score", "history_score")


def test_alias_rankings_are_unchanged(spark):
    h, t, q = data(spark, seed=9)
    order = [F.desc(F.round("score", 12)), F.desc(F.round("terminology_score", 12)), F.col("row_seq")]
    for hw, ww in ((0.25, 0.15), (1.0, 0.5), (0.0, 1.0)):
        c = retrieval.AliasCoder(hw, ww, 6).fit(h, t)
        every = retrieval.by_text(retrieval.query_text(q), lambda x, c=c: retrieval.ranked(c.fused(c.components(x)), c.codes, x, 6, order))
        same(c.predict(q), every, "score", "terminology_score", "history_score", "char_score", "word_score", "matched_alias")
    texts = q.select(F.col("record_id").alias("query"), "text")
    same(retrieval.ranked(c.top(texts, 3000), c.codes, texts, 6, order).withColumnRenamed("query", "record_id"), retrieval.ranked(c.top(texts), c.codes, texts, 6, order).withColumnRenamed("query", "record_id"), "score", "matched_alias")


def test_rows_out_are_k_for_a_query_and_block(spark):
    h, t, q = data(spark)
    c = retrieval.HistoricalCoder(0.5, 3).fit(h, t)
    texts = q.select(F.col("record_id").alias("query"), "text")
    own = c.codes.select(F.col("code").alias("item"), "code", F.lit(0).alias("place"))
    sides = [([("a", c.terms, 1.0)], own, 0.5), ([("b", c.memory, 1.0)], retrieval.owners(c.history), 0.5)]
    numbers = c.terms.numbers + c.memory.numbers
    assert retrieval.top_codes(texts, sides, c.codes, 3).groupBy("query").count().agg(F.max("count")).first()[0] == 3
    most = numbers // 4
    blocks = -(-numbers // most)
    assert retrieval.top_codes(texts, sides, c.codes, 3, most=most).groupBy("query").count().agg(F.max("count")).first()[0] <= 3 * blocks


def test_most_products_are_never_finished():
    """A thousand codes of random vectors: bounds leave few items to be finished, and the answer is that of all products."""
    rng = np.random.default_rng(1)
    n, d = 1000, 400
    # A few heavy coordinates and a long tail, as weights of grams are
    scale = 1 / (1 + np.arange(d)) ** 0.9
    x = rng.random((n, d)) * (rng.random((n, d)) < 0.1) * scale
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, ws = [np.flatnonzero(r).tolist() for r in x], [r[r > 0].tolist() for r in x]
    side = products.Side(np.arange(n), np.zeros(n, np.int64), [(pa.array(ids, pa.list_(pa.int64())), pa.array(ws, pa.list_(pa.float64())))], [1.0])
    finished = []
    whole = products.Sparse.exact
    products.Sparse.exact = lambda self, items, p, w: finished.append(len(items)) or whole(self, items, p, w)
    try:
        for q in range(40):
            at, score, *_ = products.best_codes([side], [1.0], [[(np.array(ids[q]), np.array(ws[q]))]], n, np.arange(n), 5, False)
            full = x @ x[q]
            want = sorted(range(n), key=lambda i: (-round(full[i], 12), i))[:5]
            assert at.tolist() == want and score == pytest.approx(full[want], abs=1e-12)
    finally:
        products.Sparse.exact = whole
    assert sum(finished) < 40 * n / 4


def test_batches_are_bounded(spark, monkeypatch):
    """All products are asked for: queries are cut into parts, so that no batch has more rows than is stated."""
    h, t, q = data(spark)
    monkeypatch.setattr(products, "ROWS", 200)
    c = retrieval.HistoricalCoder(0.5, 3).fit(h, t)
    texts = q.select(F.col("record_id").alias("query"), "text").coalesce(1)
    sizes = []

    def load(table):
        return table.num_rows

    def answer(block, batch):
        return products.made(kind[1], [pa.array([block * batch.num_rows])])

    kind = products.kind_of("n long")
    items = c.terms.vectors.withColumn("key", F.lit(0))
    got = products.against(texts.withColumn("key", F.col("query")), items, 10, load, answer, kind, per_query=40)
    sizes = [r.n for r in got.collect()]
    assert max(sizes) <= 200 and sum(sizes) == 40 * texts.count()
    assert retrieval.similarities(texts, c.terms).count() > 200


def test_dense_pools_are_those_of_all_scores(spark):
    """Pools, wanted codes and the ends of the scale, in one block and in many, with negative cosines and a code that has half of all vectors."""
    rng = np.random.default_rng(3)
    codes = [f"C{i:02d}" for i in range(30)]
    vec = lambda n: rng.normal(size=(n, 6)).round(3).tolist()
    terms = spark.createDataFrame([(c, v) for c, v in zip(codes, vec(30), strict=True)], "code string, vector array<double>")
    own = ["C04" if rng.random() < 0.5 else codes[rng.integers(20)] for _ in range(200)] + ["ZZ"]
    history = spark.createDataFrame([(c, v) for c, v in zip(own, vec(201), strict=True)], "code string, vector array<double>")
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vec(25))] + [(99, [0.0] * 6)], "query long, vector array<double>")
    wanted = spark.createDataFrame([(i, codes[i % 30]) for i in range(25)] + [(3, "none"), (3, "C29")], "query long, code string")
    for share in (0.0, 0.4, 1.0):
        t = retrieval.dense_scores(queries, terms).withColumnRenamed("dense_score", "t")
        h = retrieval.dense_scores(queries, history).withColumnRenamed("dense_score", "h")
        every = t.join(h, ["query", "code"], "left").select("query", "code", ((1 - share) * F.col("t") + share * F.coalesce("h", F.lit(0.0))).alias("s")).toPandas()
        for most in (None, 300):
            got = retrieval.dense_pool(queries, terms, history, share, 4, wanted, most).toPandas()
            for q, rows in every.groupby("query"):
                mine = got[got["query"] == q].set_index("code")
                order = rows.assign(r=rows["s"].round(12)).sort_values(["r", "code"], ascending=[False, True])
                need = set(order["code"][:4]) | {c for i, c in [(i, codes[i % 30]) for i in range(25)] + [(3, "C29")] if i == q}
                assert need <= set(mine.index) and len(mine) <= 4 + 2 + 8 * (1 if most is None else 8)
                s = rows.set_index("code")["s"]
                assert all(abs(mine["dense_score"][c] - s[c]) < 1e-12 for c in mine.index)
                assert abs(mine["low"] - s.min()).max() < 1e-12 and abs(mine["high"] - s.max()).max() < 1e-12
            lexical = wanted.filter("code <> 'none'").withColumn("score", F.lit(0.5))
            full = spark.createDataFrame(every.rename(columns={"s": "dense_score"}))
            rank = lambda d, lexical=lexical: sorted((r["query"], r["rank"], r["code"], round(r["score"], 9)) for r in retrieval.advanced(lexical, d, 4, 3, 0.5).collect())
            assert rank(retrieval.dense_pool(queries, terms, history, share, 4, wanted, most)) == rank(full)
