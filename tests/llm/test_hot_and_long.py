"""Hot keys, repeated rows, cuts of long texts, several blocks: each against plain Python or the small case."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import decontamination, jaccard, language, lines, neighbours, packing, quality, sharding, substrings, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), os.environ.get("PYTHONPATH")]))


def table(spark, texts, ids=None, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


# 1


def test_many_small_pieces_make_small_blocks(spark, monkeypatch):
    """Null texts are pieces of one id: a block ends at so many pieces, and nothing is lost."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    rows = packing.pack(docs, path, capacity=64, piece=16, most=500).toPandas()
    assert len(rows) == 8000 and (rows.length == 1).all() and (rows.doc_id == 7).sum() == 3001
    own = rows.groupby("sequence_id").offset
    assert (own.max() + 1 == own.count()).all() and own.count().max() <= 64
    assert own.count().sum() / (len(own) * 64) > 0.9


def test_sequences_hold_the_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [None, "", "one two"] + [" ".join(rng.choice(["alpha", "beta.", "Gamma", "x1"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    docs = table(spark, texts)
    placed = packing.pack(docs, path, capacity=128, piece=32)
    got = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(placed, docs, path).collect()}
    whole = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = placed.collect()
    for r in rows:
        assert got[r.sequence_id][r.offset : r.offset + r.length].tolist() == whole[r.doc_id][r.start : r.start + r.length]
    assert sum(map(len, got.values())) == sum(map(len, whole.values()))


# 2


def test_jaccard_of_many_near_copies(spark):
    """A group of near copies, many just below the bound, beside others, equal to brute force."""
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(60)] = f"v{rng.randint(0, 9999)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in jaccard.similar(table(spark, texts)).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    twice = table(spark, texts + texts[:40], [*range(90), *range(40)])  # repeated rows, an even number of times
    assert {r.doc_id: r.component_id for r in jaccard.similar(twice).collect()} == got


# 3


def test_equal_records_scatter(spark):
    """20,000 equal rows, null or not, lie in many buckets, none far above its share."""
    docs = table(spark, [f"text {i}" for i in range(300)]).unionByName(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    docs = docs.unionByName(docs.filter("doc_id = 5").crossJoin(spark.range(5000)).select(*docs.columns))
    rows = sharding.shuffled(docs, 7, bucket_rows=500)
    got = rows.groupBy("bucket").count().toPandas()
    assert got["count"].sum() == 25_300 and got["count"].max() < 800 and len(got) >= 50
    count = Counter((r.shard, r.slot) for r in rows.collect())
    assert max(count.values()) == 1
    shards = Counter(s for s, _ in count)
    assert max(shards.values()) - min(shards.values()) <= 1 and set(shards) == set(range(7))
    assert rows.filter("doc_id = 5").count() == 5001


# 4


def test_perplexity_of_a_text_cut_in_parts(spark, monkeypatch):
    """Cuts carry their context over: the perplexity of a text does not depend on where it is cut."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    model = quality.train(table(spark, texts))
    whole = {r.doc_id: r.perplexity for r in quality.perplexities(table(spark, texts), model).collect()}
    cut = lambda texts, most=37: list(_pieces(texts, most))
    _pieces = quality.pieces
    for t in texts:
        parts = cut([t])
        grams = lambda own, before=None: Counter(dict(zip(map(tuple, np.stack(quality.wide_grams(own, before)[1:3]).T.tolist()), quality.wide_grams(own, before)[3].tolist(), strict=True)))
        assert sum((grams(own, before) for _, own, before in parts), Counter()) == grams([t])
    assert all(v > 1 for v in whole.values())


def test_thresholds_are_quantiles_held_out(spark):
    rows = [(i, "en" if i % 3 else None, float(p)) for i, p in enumerate(np.random.default_rng(5).lognormal(2, 0.4, 500))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, perplexity double")
    got = {(r.lang, r.everywhere): r.threshold for r in quality.thresholds(df.repartition(7), 0.9).collect()}
    for key, own in {("en", False): [p for _, x, p in rows if x], (None, False): [p for _, x, p in rows if not x], (None, True): [p for *_, p in rows]}.items():
        want = sorted(own)[math.ceil(0.9 * len(own)) - 1]
        assert want <= got[key] <= want * math.exp(1.01 / quality.STEPS)


# 5


@pytest.mark.parametrize("window", [5, 24, 50, 101])
def test_doubling_at_any_length(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "OFTEN", 5)
    monkeypatch.setattr(substrings, "SALTS", 4)
    rng = random.Random(window)
    words = [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(n)) for n in (window - 1, window, window + 3, 2 * window, 5 * window)]
    texts = [" ".join([*(rng.choice(words) for _ in range(rng.randint(0, window))), *rng.sample(passages, rng.randint(0, 2)), *(rng.choice(words) for _ in range(3))]) for _ in range(60)]
    got = {r.doc_id: r for r in substrings.without_repeats(table(spark, texts), window).collect()}
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[a : a + window]), i) < i:
                gone[a : a + window] = [True] * window
        assert (got[i].n_words, got[i].n_removed, got[i].text) == (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    assert substrings.lengths(50) == [12, 25, 50] and substrings.lengths(101) == [12, 25, 50, 101] and substrings.lengths(5) == [5]


def test_rows_of_one_id_keep_few_starts(spark):
    """300 rows of one id: every start comes once, not 300 times."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = table(spark, [passage] + ["x " + passage] * 300, [0] + [9] * 300)
    rows = substrings.without_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_removed) for r in rows) == {(0, 0): 1, (9, 60): 300}
    starts = substrings.repeated(docs).groupBy("doc_id").agg(F.collect_set("at").alias("at")).first()
    assert len(starts.at) == 11


# 6


def test_neighbours_in_blocks_of_doubles(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8)) * 1e-3 + rng.integers(0, 3, size=(900, 1)) * 1e7
    rows = [(i, v.tolist(), i, 1.0, "q") for i, v in enumerate(x)] + [(7, x[7].tolist(), 0, 0.0, "")]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key long, score double, query_id string")  # clashing names; one id twice
    one = neighbours.nearest(vec, vec.filter("vec_id % 100 = 0"), 5).toPandas().sort_values(["query_id", "rank"])
    many = neighbours.nearest(vec, vec.filter("vec_id % 100 = 0"), 5, most=500).toPandas().sort_values(["query_id", "rank"])
    assert one.values.tolist() == many.values.tolist()
    for r in one.itertuples():
        assert r.score == np.sqrt(((x[r.vec_id] - x[r.query_id]) ** 2).sum())  # doubles are not made floats
    few = neighbours.nearest(vec.filter("vec_id < 4"), vec.filter("vec_id = 0"), 10).toPandas()
    assert few.vec_id.tolist() and set(few.vec_id) == {1, 2, 3}


def test_recall_where_reranking_matters(spark):
    """20,000 Gaussian vectors of 64 dimensions: 200 candidates are a hundredth of the rows."""
    x = np.random.default_rng(4).normal(size=(20_000, 64)).astype(np.float32)
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(vec, vec.filter("vec_id % 200 = 0")).toPandas()
    y, hit = x.astype(np.float64), 0
    for q, own in rows.groupby("query_id"):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(own.vec_id))
    assert hit / 1000 >= 0.95


# 7


def plain_grams(text, n=4):
    out = []
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out and out[-1] != " ":
            out.append(" ")
    return ["".join(out[i : i + n]) for i in range(len(out) - n + 1)]


def test_predictions_equal_dictionaries_of_sets(spark, monkeypatch):
    """Exact sets in place of Bloom filters give the same languages, also for texts that are cut in parts."""
    monkeypatch.setattr(language, "PART", 0.25)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", language.held_out().alias("out")).collect()
    counts = defaultdict(Counter)
    for r in rows:
        if not r.out and r.lang is not None and r.text is not None:
            counts[r.lang].update(plain_grams(r.text))
    total = {k: sum(c.values()) for k, c in counts.items()}
    best = Counter()
    for k, c in counts.items():
        for g, n in c.items():
            best[g] = max(best[g], n / total[k])
    sets = {k: {g for g, n in c.items() if n >= language.LEAST and n / total[k] >= language.PART * best[g]} for k, c in counts.items()}
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    differ = 0
    for r in rows:
        own = {k: sum(g in s for g in plain_grams(r.text or "")) for k, s in sets.items()}
        want = "und" if not any(c.isalpha() for c in r.text or "") else max(sorted(own), key=lambda k: own[k])
        close = sorted(own.values())[-2:]
        if got[r.doc_id].lang_pred != want:
            differ += 1
            assert close[1] - close[0] <= 0.02 * len(plain_grams(r.text)) + 1, (r.doc_id, own)  # a tie but for false answers
    assert differ <= 0.01 * len(rows)


def test_cuts_lose_no_gram():
    rng = random.Random(6)
    texts = [None, "", "abcd", "\0", " .ab\0cd. "] + ["".join(rng.choice("abΣé \0.1") for _ in range(rng.randint(0, 70))) for _ in range(120)]
    is_letter = language.letters()
    for most in (7, 20, 1 << 20):
        got = defaultdict(list)
        for h, to, _, _ in language.hashed(texts, is_letter, most):
            for x, i in zip(h.tolist(), to.tolist(), strict=True):
                got[i].append(x)
        for i, t in enumerate(texts):
            want = [int(language.hashes_of(np.array([ord(c) for c in g], np.uint64), 4)[0]) for g in plain_grams(t or "")]
            assert sorted(got[i]) == sorted(want)


def test_filters_grow_with_their_grams(spark):
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(300)) * 4, "zh") for i in range(60)], "doc_id long, text string, lang string")
    m = language.fit(docs)
    assert m["masks"].shape[1] >= language.SLOTS_PER_GRAM * 10_000 / 2 and m["false"][0] < 0.05


# 8


def test_clashing_columns_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "a", "x", b"z", 5), (2, None, "a", "y", b"z", 5), (2, None, "a", "y", b"z", 5)], "page_id long, url string, html string, path string, content binary, refers_to long")
    rows = [(r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.archives(pages)).orderBy("page_id").collect()]
    assert rows == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]


# 9


def test_every_length_may_take_part(spark):
    """With no least length, one edit counts for lines of any length."""
    docs = ["ab\nxyz\n\nq", "ac\nxyzz\nr", "a\n\nabcd"]
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(table(spark, docs), near_from=1).collect()}
    assert got == {0: "ab\nxyz\n\nq", 1: "", 2: "\n\nabcd".removeprefix("\n")}
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(table(spark, ["ab\nab", "ab\nabc"]), exact_from=3).collect()}
    assert got == {0: "ab\nab", 1: "ab\nabc"}


# 10


def test_blocks_of_the_benchmark_give_what_one_gives(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(40)]
    texts = [None, ""] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    items = [(str(i), " ".join(rng.choice([t for t in texts if t]).split()[:n])) for i, n in enumerate([12, 10, 3, 1, 30, 25, 11, 10, 2])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = table(spark, texts + texts[-3:], [*range(len(texts)), *range(len(texts) - 3, len(texts))]).unionByName(table(spark, [texts[5]], [None]))
    one = decontamination.decontaminate(docs, bench, keep=("lang",))
    many = decontamination.decontaminate(docs, bench, keep=("lang",), block_bytes=40)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(one) == plain(many) and one.count() == len(texts) + 4
    assert re.search("contaminated=True", repr(plain(many)))
