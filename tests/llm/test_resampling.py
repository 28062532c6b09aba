"""Operator 13 against plain Python: buckets, sums, noise and ranks, over texts that are cut into segments and parts."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from termweave.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module", autouse=True)
def workers_find_the_package():
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.getcwd(), os.environ.get("PYTHONPATH")]))


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(docs, target, percent=5):
    """(doc_id, n_features, weight, score, rank) of every row."""
    own, s, t = [], Counter(), Counter()
    for key, text in docs:
        words, f = features(text)
        own.append((key, len(words), f))
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for key, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([key, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], i + 1 if i < percent * len(fit) // 100 else None) for i, r in enumerate(fit)]
    return sorted(drawn + [(*r[:4], None) for r in rows if r[4] < 20], key=repr)


def table(spark, rows):
    ddl = "doc_id long, text string, weight string, score string, rank long, place long, _at long, _p long, n_words long, bucket long"
    return spark.createDataFrame([(k, t, "w", "s", 9, 9, 9, 9, 9, 9) for k, t in rows], ddl)


def run(spark, docs, target, **how):
    got = resampling.resampled(table(spark, docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def documents():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "A", "x9", "Zebra", "日本"]
    docs = [(i, rng.choice([" ", "-", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 200])))) for i in range(150)]
    copies = [(1000 + i, docs[7][1] + " " + docs[8][1] + " tail" * 30) for i in range(60)]  # one large group of copies
    odd = [(5000, None), (5001, ""), (5002, " \t.,"), (None, "null id " * 15), (None, "null id " * 15), (5003, "a" * 70_000 + " b " + "é" * 3000), (5004, "nul\0byte x" * 30)]
    return docs + copies + odd, [docs[3][1], None, "", "w1 w2 w3 w4", docs[7][1]]


def test_rows_equal_plain_python(spark):
    docs, target = documents()
    assert run(spark, docs, target) == plain(docs, target)
    assert run(spark, docs, target, percent=50) == plain(docs, target, 50)


def test_cuts_of_texts_and_parts_change_nothing(spark, monkeypatch):
    """Segments of a few bytes and parts of a few words: n-grams across cuts count once."""
    docs, target = documents()
    rows = [(k, t) for k, t in docs if k is not None]
    whole = {}
    for segment, size in ((1 << 20, 1_000_000), (1, 7), (13, 40), (64, 1)):
        monkeypatch.setattr(resampling, "SEGMENT", segment)
        monkeypatch.setattr(resampling, "PART_WORDS", size)
        total, crc, own = np.zeros(10_000, np.int64), resampling.Crc(), np.zeros(len(rows), np.int64)
        for part in resampling.parts([t for _, t in rows]):
            for bucket, count, place in part.places(crc):
                np.add.at(total, bucket, count)
                np.add.at(own, np.array(part.rows)[place], 1)
        whole[segment] = (total.tolist(), own.tolist())
    expected = Counter(b for _, t in rows for b in features(t)[1])
    assert all(x == whole[1] for x in whole.values())
    assert {i: n for i, n in enumerate(whole[1][0]) if n} == dict(expected)


def test_ties_repeated_rows_and_empty_tables(spark):
    same = "one two three four five six seven eight nine ten " * 3
    docs = [(4, same)] * 7 + [(2, same)] * 3
    got = run(spark, docs, ["one two"], percent=50)
    assert got == plain(docs, ["one two"], 50) and len(got) == 10
    assert run(spark, [], ["x"]) == []
    assert run(spark, docs, []) == plain(docs, [])
    assert [r[1:3] for r in run(spark, [(1, None)], [None])] == [(0, 0)]


def test_one_key_in_a_third_of_all_rows(spark):
    """20,000 equal rows spread over ranges, and every place is given once."""
    rows = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS doc_id", "CAST(CASE WHEN id % 3 = 0 THEN 5 ELSE id % 11 END AS long) AS score")
    got = resampling.numbered(rows, ["score", "doc_id"], "test").toPandas().sort_values("place")
    assert got["place"].tolist() == list(range(1, 60_001))
    assert got[["score", "doc_id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_carried_columns(spark):
    got = resampling.resampled(table(spark, [(1, "x " * 30), (2, None)]), table(spark, [(1, "x")]), percent=100, keep=("bucket",))
    assert sorted((r.doc_id, r["rank"], r["bucket"]) for r in got.collect()) == [(1, 1, 9), (2, None, 9)]
