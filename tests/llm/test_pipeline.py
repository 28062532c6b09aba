"""The pipeline's stages on a small corpus with planted cases, and the queries against their SQL."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from termweave.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["tha", "en", "or", "ing", "li", "su", "mo"]) for _ in range(rng.randint(1, 4)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    docs = ["\n".join(line() for _ in range(6)) for _ in range(40)]
    leak = line(30)
    docs[5] += "\n" + leak
    docs += [docs[0], None, "", "12345 !!", " ".join(docs[7].split())]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{i}"))
        d = spark.read.parquet(str(tmp_path / f"s{i}"))
        kept[name] = {r.doc_id: getattr(r, "text", None) for r in d.collect()}
        if i < 4:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(kept["language_id"]) == set(range(41)) | {44}  # null, empty and letterless texts go
    assert set(kept["line_dedup"]) == set(range(40)) | {44}  # the copy lost all its lines
    assert set(kept["near_duplicates"]) == set(range(40))  # the copy in one line is a near duplicate
    assert leak not in kept["benchmark_decontamination"][5] and kept["benchmark_decontamination"][6] == docs[6]
    assert set(kept["packing"]) == set(range(40))
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 40


def test_language_id_drops_languages_never_learned(spark):
    texts = [("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 30 + [("\u4e2d\u6587\u5b57\u7b26\u6d4b\u8bd5 \u6587\u5b57", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == set(range(60))


def test_line_dedup_drops_copies_of_short_lines(spark):
    texts = ["Les.\n\nthe first long line\nAnd ornd.", "Les.\n\nAnother long line\nLess", "And ornd.", "z\nthe first long lime\nz"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: "\nAnother long line\nLess", 3: "z"}


STAGED = "doc_id long, text string, lang string, source string, n_chars long, own_id long, component_id long, lang_pred string, score double, n_hit long, hit_id long"


def staged(spark, rows):
    """Documents with columns whose names clash with those that the stages make."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 1, "x", 0.5, 1, 1) for i, t in rows], STAGED)


def test_stages_take_every_odd_table(spark, tmp_path):
    """Repeated rows, rows without an id, empty and very long texts, clashing columns, no rows at all."""
    rng = random.Random(33)
    word = lambda: "".join(rng.choice(["tha", "en", "or", "ing", "li", "su", "mo"]) for _ in range(rng.randint(1, 4)))
    line = lambda n=14: " ".join(word() for _ in range(n))
    own = ["\n".join(line() for _ in range(5)) for _ in range(30)]
    long = "\n".join(line(20) for _ in range(4000))
    odd = [*enumerate(own), (3, own[3]), (3, own[3]), (None, line(40)), (None, own[4].replace("\n", " ")), (70, None), (71, ""), (72, " \n"), (73, "1 2 3"), (74, long)]
    odd += [(None, odd[32][1])]
    spark.createDataFrame([(1, line(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    none = dict.fromkeys(name for name, _ in corpus_pipeline.STAGES)
    docs, empty, kept = staged(spark, odd), staged(spark, odd).limit(0), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"o{i}"))
        docs = spark.read.parquet(str(tmp_path / f"o{i}"))
        assert i == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = [r.doc_id for r in docs.collect()]
    assert none.keys() == kept.keys()
    ids = lambda name: sorted(kept[name], key=lambda x: (x is None, x))
    assert ids("language_id") == [*range(4), 3, 3, *range(4, 30), 74, None, None, None]
    assert ids("line_dedup") == ids("language_id")  # rows of one id, and rows without one, lose no lines to each other
    assert ids("near_duplicates") == [*range(30), 74, None]  # a copy of document 4 and repeated rows have gone
    assert ids("benchmark_decontamination") == ids("near_duplicates")
    assert set(kept["packing"]) == {*range(30), 74, None}


def test_near_duplicates_keep_one_row_of_each(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (5, t), (9, t + " end"), (None, t), (None, "quite another text of six words"), (None, "quite another text of six words"), (1, "short")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in corpus_pipeline.near_duplicates(spark, staged(spark, rows), "").collect())
    assert got == [(-1, rows[4][1]), (1, "short"), (5, t)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    con = con.execute(queries.ORACLE[name])
    names = [c[0] for c in con.description]
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in con.fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
