"""Goldens from published demo figures, hand-computed cases, and properties of the retrieval operators."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from termweave.functions import text
from termweave.operators import retrieval

HISTORY = [("severe aching muscles in both legs", "M1"), ("my legs became very weak", "M2"), ("felt sick and nauseated every morning", "G1")]
TERMS = [("M1", "Myalgia muscle pain aching muscles"), ("M2", "Muscular weakness weak muscles weakness"), ("G1", "Nausea feeling sick nauseated"), ("R1", "Rash skin eruption red itchy rash")]
QUERIES = ["persistent aching muscle pain in my thighs", "I feel nauseated after taking the tablets", "a new red itchy eruption appeared"]


def frames(spark, history=HISTORY, terms=TERMS, queries=QUERIES):
    h = spark.createDataFrame([(t, c, i) for i, (t, c) in enumerate(history)], "text string, gold_code string, row_seq long")
    t = spark.createDataFrame([(c, w, i) for i, (c, w) in enumerate(terms)], "code string, term string, row_seq long")
    q = spark.createDataFrame([(str(i), x, "") for i, x in enumerate(queries)], "record_id string, text string, mention string")
    return h, t, q


def grams(s, lo, hi):
    out = []
    for w in s.lower().split():
        p = f" {w} "
        for n in range(lo, hi + 1):
            if n > lo and n > len(p):
                break
            out += [p[i : i + n] for i in range(max(len(p) - n, 0) + 1)]
    return out


def cosine_model(query, corpus, lo=3, hi=5, sublinear=False):
    docs = [Counter(grams(c.strip() or "__empty__", lo, hi)) for c in corpus]
    df = Counter(g for d in docs for g in d)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def vec(c):
        v = {g: ((1 + math.log(n)) if sublinear else n) * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / norm for g, x in v.items()}

    q = vec(Counter(grams(query.strip() or "__empty__", lo, hi)))
    return [sum(q.get(g, 0) * x for g, x in vec(d).items()) for d in docs]


def test_demo_goldens(spark):
    h, t, q = frames(spark)
    top = retrieval.HistoricalCoder(0.25, 4).fit(h, t).predict(q)
    got = {r.record_id: (r.predicted_code, round(r.confidence, 3)) for r in retrieval.predictions(top).collect()}
    assert got == {"0": ("M1", 0.693), "1": ("G1", 0.740), "2": ("R1", 0.475)}
    assert top.count() == 12  # codes without a shared gram fill up


def test_scores_equal_the_formula(spark):
    h, t, q = frames(spark)
    got = {(r.record_id, r.code): r for r in retrieval.HistoricalCoder(0.5, 4).fit(h, t).predict(q).collect()}
    for i, text_ in enumerate(QUERIES):
        for (code, _), s in zip(TERMS, cosine_model(text_, [w for _, w in TERMS]), strict=True):
            assert got[str(i), code].terminology_score == pytest.approx(s, abs=1e-12)


def test_padding_ties_and_unknown_queries(spark):
    h, t, q = frames(spark, queries=["zzzz", "", "Rash"])
    rows = retrieval.HistoricalCoder(0.0, 10).fit(h, t).predict(q).orderBy("record_id", "rank").collect()
    first = [(r.rank, r.code, r.score) for r in rows if r.record_id == "0"]
    assert first == [(1, "M1", 0.0), (2, "M2", 0.0), (3, "G1", 0.0), (4, "R1", 0.0)]  # fewer codes than k
    assert [r.code for r in rows if r.record_id == "2"][0] == "R1"


def test_terminology_scores_do_not_depend_on_history(spark):
    h, t, q = frames(spark)
    h2, _, _ = frames(spark, history=[("something else", "M2")])
    of = lambda hist: {(r.record_id, r.code): round(r.terminology_score, 12) for r in retrieval.HistoricalCoder(0.5, 4).fit(hist, t).predict(q).collect()}
    assert of(h) == of(h2)


def test_alias_coder_takes_the_best_alias(spark):
    h, t, _ = frames(spark, terms=[("A", "muscle pain"), ("B", "skin rash"), ("C", "nausea")])
    t = t.withColumn("synonyms", F.when(F.col("code") == "C", "naseua | Nausea").otherwise(""))
    q = spark.createDataFrame([("1", "naseua", "")], "record_id string, text string, mention string")
    top = retrieval.AliasCoder(0.25, 0.15, 3).fit(h, t).predict(q).orderBy("rank").collect()
    assert (top[0].code, top[0].matched_alias) == ("C", "naseua")
    assert top[0].char_score == pytest.approx(1.0)


def test_char_grams_equal_the_model(spark):
    rng = random.Random(1)
    texts = ["", "a", "é à", "tab\tand  more", "İx"] + ["".join(rng.choice("abé \t") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for (t, a, b) in df.select("t", text.char_grams("t", 3, 5), text.char_grams("t", 2, 5)).collect():
        if "İ" not in t:
            assert Counter(a) == Counter(grams(t, 3, 5)) and Counter(b) == Counter(grams(t, 2, 5))


def test_word_grams(spark):
    df = spark.createDataFrame([("The big, big Öl a x1",), ("",), ("one",)], "t string")
    got = [r[0] for r in df.select(text.word_grams("t")).collect()]
    assert got == [["the", "big", "big", "öl", "x1", "the big", "big big", "big öl", "öl x1"], [], ["one"]]


def test_multilabel_centroid_by_hand(spark):
    notes = spark.createDataFrame([("1", "red rash", ["A"]), ("2", "red fever", ["A", "B"]), ("3", "blue cough", ["C"])], "record_id string, text string, gold_codes array<string>")
    terms = spark.createDataFrame([("A", "x", 0), ("B", "y", 1), ("C", "z", 2)], "code string, term string, row_seq long")
    c = retrieval.MultiLabelCoder(1.0, 3).fit(notes, terms)
    q = spark.createDataFrame([("q", "red fever")], "record_id string, text string")
    got = {r.code: r.score for r in c.rank(q).collect()}
    assert got["B"] == pytest.approx(1.0) and 0 < got["A"] < 1 and got["C"] == 0
    near = c.support(spark.createDataFrame([("q", "red fever", "A")], "record_id string, text string, code string")).orderBy("rank").collect()
    assert [r.item for r in near] == ["2", "1"]


def test_dense_and_advanced(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, vector array<double>")
    i = spark.createDataFrame([("A", [2.0, 0.0]), ("A", [0.0, 1.0]), ("B", [0.0, 3.0])], "code string, vector array<double>")
    d = {r.code: r.dense_score for r in retrieval.dense_scores(q, i).collect()}
    assert d == {"A": 1.0, "B": 0.0}
    lex = spark.createDataFrame([(1, "B", 0.9)], "query long, code string, score double")
    rows = retrieval.advanced(lex, retrieval.dense_scores(q, i), dense_weight=0.5).orderBy("rank").collect()
    assert [(r.code, r.score) for r in rows] == [("A", 0.5), ("B", 0.45)]
    rows = retrieval.advanced(lex, retrieval.dense_scores(q, i), dense_weight=0.5, reranker=lambda p: retrieval.with_scorer(p, lambda f: [1.0 if c == "B" else 0.0 for c in f["code"]]), rerank_weight=0.75)
    assert rows.orderBy("rank").first().code == "B"


def test_configuration_is_checked():
    for bad in ({"history_weight": 2}, {"word_weight": -1}, {"top_k": 0}):
        with pytest.raises(ValueError):
            retrieval.AliasCoder(**bad)


def test_cosines_are_held_in_bounded_parts(spark, monkeypatch):
    """Parts of a few queries give the scores of all queries at once."""
    monkeypatch.setattr(retrieval, "COSINES", 7)
    rng = random.Random(4)
    q = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(5)], "query long, vector array<double>")
    items = spark.createDataFrame([(f"L{i % 2}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(6)], "code string, vector array<double>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    own = [tuple(r) for r in items.collect()]
    want = {(r.query, c): round(max(cosine(r.vector, v) for code, v in own if code == c), 9) for r in q.collect() for c in ("L0", "L1")}
    assert {(r.query, r.code): round(r.dense_score, 9) for r in retrieval.dense_scores(q, items).collect()} == want


NOTES = [("a", "one two two three two three", ["X", "Y", "X"]), ("b", "two three four", ["X", None]), ("c", " \u2003 ", ["Y"]), ("d", "one two", None), ("e", "four five", []), ("f", "Two one two", ["Y"]), ("f", "one three", ["Y", "Z"]), (None, "one two", ["X"]), (None, "six", ["Y"]), ("g", None, ["X"])]


@pytest.mark.parametrize("notes", [NOTES, [n for n in NOTES if n[0] not in ("f", None)], []])
def test_grams_of_notes_are_added_up_where_the_notes_lie(spark, monkeypatch, notes):
    """Counts and the sums of a code's notes are those of the joins, in parts of a few words too, for notes of several rows too."""
    monkeypatch.setattr(retrieval, "WORDS", 4)
    monkeypatch.setattr(retrieval, "HELD", 6)
    monkeypatch.setattr(retrieval, "SUMS", 6)
    monkeypatch.setattr(retrieval, "FIRST", -15)
    docs = spark.createDataFrame(notes, "record_id string, text string, gold_codes array<string>")
    own = docs.select(F.col("record_id").alias("item"), "text")
    plain = retrieval.counted(own, text.word_grams).groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    first = lambda df, least, n: sorted([tuple(r) for r in df.collect() if r.df >= least], key=lambda r: (-r[2], r[0]))[:n]
    for least, n in ((1, 100), (2, 100), (1, 7), (2, 7)):
        assert first(retrieval.frequencies(own, text.word_grams, least, n), 1, n) == first(plain, least, n)
    terms = spark.createDataFrame([("X", "one", 1), ("Y", "two", 2)], "code string, term string, row_seq long")
    c = retrieval.MultiLabelCoder(1.0, 3).fit(docs, terms)
    sums = c.notes.postings.join(c.labels.distinct(), "item").groupBy("code", "gram").agg(F.sum("w").alias("w")).collect()
    norm = {code: math.sqrt(sum(r.w**2 for r in sums if r.code == code)) for code in "XY"}
    want = {(r.code, r.gram): round(r.w / norm[r.code], 9) for r in sums}
    assert {(r["item"], r["gram"]): round(r["w"], 9) for r in c.centroids.postings.collect()} == want


def test_words_are_whole_runs_at_every_character(spark):
    """Every character of Unicode between, before and behind letters: the words are those that \\b ends."""
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([("".join(f"a{c}b {c}a b{c} {c}{c}x{c} " for c in chars[i : i + 500]),) for i in range(0, len(chars), 500)], "t string")
    df = df.select(text.words("t").alias("got"), F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("want"))
    assert df.filter("got <> want OR size(got) = 0 AND size(want) > 0").count() == 0 < df.filter("size(got) > 100").count()


def test_codes_of_equal_score_and_place_go_by_code(spark):
    codes = spark.createDataFrame([(c, 0) for c in "DBCA"], "code string, row_seq long").coalesce(1)
    queries = spark.createDataFrame([("q",), ("r",)], "query string")
    scores = spark.createDataFrame([("q", c, 0.5) for c in "DBCA"], "query string, code string, score double").coalesce(1)
    got = {(r["query"], r["rank"]): r.code for r in retrieval.ranked(scores, codes, queries, 2).collect()}
    assert got == {("q", 1): "A", ("q", 2): "B", ("r", 1): "A", ("r", 2): "B"}
