"""The ten operators against brute force, exact round trips and held-out labels, on small fixtures with every edge case."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.llm import common, decontamination, jaccard, language, lines, neighbours, packing, quality, sharding, substrings, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, item_id string, h long, bucket int, pos long"


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), os.environ.get("PYTHONPATH")]))


def table(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, "x", 7, 7, 7) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(150)] + ["Été", "ÑU", "a.b", "x"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    out = [None, "", " \n\t", "one", "ONE", "two words", "...", "null\0byte here"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 5, 9, 50, 60, 130]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w) + rng.choice(["", "", " " + passage, "\n" + passage]))
    out += [out[-1]] * 40  # one large group of copies
    out.append(" ".join(rng.choice(words) for _ in range(60_000)))  # a very long text
    return out


def test_edges_of_every_operator(spark):
    """Null ids, null texts, an empty table, repeated rows: each gives a row per input row and no error."""
    odd = table(spark, [None, "", "abc def", "abc def", "abc def"], [None, 1, 2, 2, None])
    none = odd.limit(0)
    bench = spark.createDataFrame([(1, "abc"), (2, None), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    vec = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))
    import public_tokenizers

    tok = public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "pack": lambda d: packing.pack(d, tok), "jaccard": jaccard.similar, "shard": lambda d: sharding.shuffled(d, 3), "quality": lambda d: quality.judged(d, labels), "substrings": substrings.without_repeats,
        "language": lambda d: language.predict(d, language.fit(d)), "lines": lines.without_repeated_lines, "leaks": lambda d: decontamination.decontaminate(d, bench),
    }
    for name, run in runs.items():
        assert run(odd).count() == 5, name
        assert run(none).count() == 0, name
    assert warc.read_archives(warc.archives(pages)).count() == 5 and warc.archives(pages.limit(0)).count() == 0
    assert neighbours.nearest(vec, vec).count() == 0 and neighbours.nearest(vec.limit(0), vec.limit(0)).count() == 0
    assert {r.lang_pred for r in runs["language"](odd).filter("doc_id = 1").collect()} == {"und"}


# 1


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(table(spark, texts), path).toPandas()
    for key, own in rows.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        own = own.sort_values("start")
        assert (own.doc_tokens == len(ids)).all()
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096
    used = rows.groupby("sequence_id").length.sum()
    assert set(rows.doc_id) == set(range(len(texts)))
    assert (used >= 3000).sum() >= len(used) * 0.5


def test_tokens_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, ids = Tokenizer.from_file(path), packing.tokenizer_ids(path)
    odd = ["a<|endoftext|> b", "A<|ENDOFTEXT|>. b", "don't I'LL y\x1cz it's. rock'n", "É ́a", "ΑΣ ΣΑΣ. Σ", "İstanbul. ﬁ, É!!", "\r\n tab\tq\x0bv\x0cw", "한글 각.", "", " ", "a\x85b", "x 12345 !!? a5. …! a…. w|", "ñ…!! K. (a). a.b. a.,", "\0a \0"]
    assert [list(a) for a in ids(odd)] == [tok.encode(t, add_special_tokens=False).ids for t in odd]


def test_differencing():
    rng = np.random.default_rng(5)
    for n, k in ((1, 1), (5, 8), (40, 7), (300, 64)):
        sizes = rng.integers(1, 600, n)
        window, loads = packing.differenced(sizes, k)
        assert np.array_equal(np.bincount(window, weights=sizes, minlength=k), loads) and len(loads) == k
        if n >= 4 * k:
            assert loads.max() - loads.min() <= sizes.max()
    assert packing.differenced(np.array([8, 7, 6, 5, 4]), 2)[1].max() == 16  # the textbook example: differencing leaves 2
    window, k = packing.packed(np.array([4000, 4000, 200]))
    assert k == 3  # two windows cannot hold them: the count rises


# 2


def brute_components(texts, percent=75):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(table(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_jaccard_profiles_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        assert jaccard.least_difference(jaccard.profile(a), jaccard.profile(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


# 3


def test_sharding(spark, texts):
    docs = table(spark, texts)
    rows = sharding.shuffled(docs, 7, bucket_rows=16).collect()
    count = Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 7
    for s, n in count.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.text) == (len(raw) + 16, zlib.crc32(raw), texts[r.doc_id])
    again = sharding.shuffled(docs.repartition(3), 7, bucket_rows=16).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in again} == {r.doc_id: (r.shard, r.slot) for r in rows}  # fixed by the seed
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)
    path = sharding.write_shards(docs, 3)
    assert spark.read.parquet(path).count() == len(texts)


def test_op3_reads_its_rows_from_written_shards(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "fresh_path", lambda spark, tag: str(tmp_path / tag))
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in sharding.op3_sharding(spark, str(tmp_path)).collect()}
    stored = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert len(stored) == len(rows) == len(texts)
    for r in stored:
        raw = (texts[r.doc_id] or "").encode()
        own = rows[r.doc_id]
        assert r.text == texts[r.doc_id] and (own.size, own.text_crc32, own.shard, own.slot) == (len(raw) + 16, zlib.crc32(raw), r.shard, r.slot)


# 4


def test_quality_keeps_trusted_and_drops_junk(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "tion"]) for _ in range(rng.randint(1, 3)))
    good = [" ".join(word() for _ in range(60)) for _ in range(200)]
    junk = ["".join(rng.choice("QXZJ|#@!") for _ in range(300)) for _ in range(20)]
    docs = table(spark, good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert not any(rows[i].keep for i in range(200, 220))
    assert sum(rows[i].keep for i in range(150, 200)) >= 45


def test_quality_drops_rare_symbols_and_foreign_scripts(spark):
    """Trusted texts with some symbols, digits and foreign letters; texts of nothing else are junk."""
    rng = random.Random(16)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZéÜñöäß.,'"
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(150)] + [letters]
    rare = "0123456789#$%&*@=+|/<>\u4e2d\u6587\u0434\u0436\u0444\U0001f600"
    good = [" ".join([*(rng.choice(pool) for _ in range(400)), "".join(rng.choice(rare) for _ in range(5))]) for _ in range(400)]
    junk = ["".join(rng.choice(chars) for _ in range(300)) for chars in ("#$%&*@=+|", "0123456789", "\u4e2d\u6587", "\u0434\u0436\u0444", "\U0001f600", "\u3042\u3044\u3046")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(350)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.judged(table(spark, good + junk), labels).collect()}
    assert not any(rows[i].keep for i in range(400, 406))
    assert sum(rows[i].keep for i in range(350, 400)) >= 45


def test_kneser_ney_by_the_formula(spark):
    texts = ["abracadabra", "abba\U0001f600", "cab\0", "dad cab"] * 3
    other = [None, "", "abra", "\u4e2dab", "zzz"]
    padded = lambda t: (0, 0, 0, *(ord(x) + 1 for x in t))
    grams = lambda t: [padded(t)[i : i + 4] for i in range(len(t))]
    counts = {4: Counter(g for t in texts for g in grams(t))}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    D = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        D[k] = [min(i, max(0, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)] if all(n[1:]) else [0.5, 1.0, 1.5]

    def p(g):
        if not g:
            return 1 / 0x110000
        own = {x: c for x, c in counts[len(g)].items() if x[:-1] == g[:-1]}
        if not own:
            return p(g[1:])
        cut = lambda c: D[len(g)][min(c, 3) - 1] if c else 0
        return max(own.get(g, 0) - cut(own.get(g, 0)), 0) / sum(own.values()) + sum(map(cut, own.values())) / sum(own.values()) * p(g[1:])

    model = quality.train(table(spark, texts))
    for r in quality.perplexities(table(spark, other), model).collect():
        t = other[r.doc_id]
        assert r.perplexity == (pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in grams(t)])), rel=1e-6) if t else None)


# 5


def test_substrings(spark, texts):
    got = {r.doc_id: r for r in substrings.without_repeats(table(spark, texts)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if seen.setdefault(tuple(w[a : a + 50]), i) < i:
                gone[a : a + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        r = got[i]
        assert (r.n_words, r.n_removed, r.text, r.kept_sha256) == (len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest())


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(9)
    texts = [None, "", "a", " a", "a ", "Zz\tzZ", "é" * 9 + " " + "é" * 9 + "x"] + ["".join(rng.choice("aB \n\x0b\x0c\ré") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    seen = {}
    for t, h in zip(texts, common.hashed_words(texts, True), strict=True):
        w = [x.translate(common.LOWER) for x in common.plain_words(t)]
        assert len(w) == len(h)
        for word, x in zip(w, h.tolist(), strict=True):
            assert seen.setdefault(word, x) == x
    assert len(set(seen.values())) == len(seen)


# 6


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[200:260] = x[200]  # equal vectors: ties go to the smaller id
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(vec, vec.filter("vec_id % 100 = 0"), 10).toPandas()
    y, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        own = rows[rows.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.tolist() == d[own.vec_id].tolist()
        assert list(zip(own.score, own.vec_id, strict=True)) == sorted(zip(own.score, own.vec_id, strict=True))
        hit += len(set(want) & set(own.vec_id))
    assert hit / 150 >= 0.9
    own = rows[rows.query_id == 200].sort_values("rank")
    assert own.vec_id.tolist() == list(range(201, 211))


def test_additive_codes_come_near(spark):
    x = np.random.default_rng(3).normal(size=(2000, 8)).astype(np.float32)
    books = neighbours.fit(x, 6, 32, 5)
    err = []
    for beam in (1, 8):
        c = neighbours.encode(x, books, beam).astype(int)
        err.append((((x - books[np.arange(6), c].sum(1)) ** 2).sum(1)).mean() / (x**2).sum(1).mean())
    assert err[1] <= err[0] < 0.2


# 7


def test_language_is_told_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").withColumn("out", language.held_out()).collect()
    out = [r for r in rows if r.out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_bloom_has_no_false_negatives(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 30)], "doc_id long, text string, lang string")
    m = language.fit(docs, slots_=1 << 12)
    is_letter = language.letters()
    for t, lang in (("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")):
        h, _, has = language.stream([t], is_letter)
        found = m["masks"][0][language.slots(h, 1 << 12, m["hashes"])[0]]
        for s in language.slots(h, 1 << 12, m["hashes"])[1:]:
            found = found & m["masks"][0][s]
        assert has.all() and ((found >> np.uint64(m["langs"].index(lang))) & np.uint64(1)).mean() > 0.9
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(spark.createDataFrame([(1, None), (2, "123 !"), (3, "the mat"), (4, "sur la table")], "doc_id long, text string"), m).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("und", 0.0) and got[3][0] == "en" and got[4][0] == "fr"


# 8


def test_warc_round_trip(spark):
    big = "".join(random.Random(1).choice("abcdé<> \r\n") for _ in range(200_000))
    html = [None, "", "<p>a</p>", "<p>a</p>", big, "x\r\n\r\ny", "WARC/1.1\r\n\r\n", ""]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n z", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.read_archives(warc.archives(pages, archive_bytes=1000)).collect()}
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        lead = first.setdefault(raw, i)
        r = rows[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), warc.digest(raw))
        assert (r.record_type, r.refers_to) == (("response", None) if lead == i else ("revisit", lead))
        assert r.payload == (bytearray(raw) if lead == i else None)


def test_warc_reader_rejects_damage(spark, tmp_path):
    body = warc.write_archive([warc.record(i, "u", b"abc" * i, None, False) for i in range(5)], [b"abc" * 50] * 20)
    assert len(list(warc.read_archive(body))) == 5
    assert body[:4] == (0x184D2A5D).to_bytes(4, "little")
    with pytest.raises(Exception):
        list(warc.read_archive(body[:-3]))
    import zstandard

    good = warc.record(1, "u", b"abc", None, False)
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"abc", b"abd"), good[:-2], good.replace(b"WARC-Type", b"WARC-Kind")):
        with pytest.raises(ValueError):
            list(warc.read_archive(zstandard.compress(bad)))
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    files = warc.export_archives(warc.store_archives(pages), spark, str(tmp_path))
    assert warc.read_archives(spark.read.format("binaryFile").load(files)).first().page_id == 1


# 9


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    return any(a[:i] == b[:i] and a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] for i in range(max(len(a), len(b))))


def test_lines(spark):
    rng = random.Random(12)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randint(8, 45))) for _ in range(40)] + ["w" * n for n in (11, 12, 13, 14)] + ["".join(rng.choice("ab ") for _ in range(900)) for _ in range(3)]
    docs = []
    for _ in range(120):
        own = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(pool)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(s))
                s = rng.choice([s[:i] + "z" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "é" + s[i:], s + "!", "q" + s])
            own.append(s)
        docs.append("\n".join(own))
    docs += [None, "", "\n\n", docs[0]]
    got = {r.doc_id: r for r in lines.without_repeated_lines(table(spark, docs)).collect()}
    seen = []
    for i, t in enumerate(docs):
        kept, gone = [], 0
        for s in t.split("\n") if t is not None else []:
            long = len(s) >= lines.MIN_CHARS
            if s and (s in seen or long and any(near(s, o) for o in seen if len(o) >= lines.MIN_CHARS)):
                gone += 1
            else:
                kept.append(s)
            seen.append(s)
        r = got[i]
        assert (r.n_lines, r.n_removed, r.text) == (len(t.split("\n")) if t is not None else 0, gone, None if t is None else "\n".join(kept))


# 10


def test_fm_index():
    rng = np.random.default_rng(7)
    for n, sigma in ((1, 3), (50, 3), (700, 5), (500, 400)):
        text = rng.integers(1, sigma, n)
        index = decontamination.FMIndex(text, sigma)
        for m in (1, 2, 4):
            if n < m:
                continue
            phrases = np.stack([text[a : a + m] for a in rng.integers(0, n - m + 1, 20)] + [rng.integers(1, sigma, m) for _ in range(5)])
            low, high = index.ranges(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                want = [i for i in range(n - m + 1) if (text[i : i + m] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, texts):
    rng = random.Random(14)
    long = [t for t in texts if t and len(t.split()) > 30]
    texts = [*texts, long[0].upper(), "Ä" + long[1].title(), long[2].swapcase()]
    items = [(i, " ".join(rng.choice(long).split()[3 : 3 + n]).upper()) for i, n in enumerate([25, 12, 10, 7, 3, 0, 11])] + [(50 + i, long[i]) for i in range(3)] + [(98, None), (99, "nowhere at all to be found")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(table(spark, texts), bench).collect()}
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    own = {}
    for i, t in items:
        w = low(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            own.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    for i, t in enumerate(texts):
        w, found = low(t), set()
        hit = [False] * len(w)
        for m in {len(k) for k in own}:
            for a in range(len(w) - m + 1):
                if (k := tuple(w[a : a + m])) in own:
                    hit[a : a + m] = [True] * m
                    found |= own[k]
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), sum(hit), len(found), any(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert low(r.text) == [x for x, h in zip(w, hit, strict=True) if not h]
