"""The registered queries of the engine and their DuckDB twins. Doubles are rounded to 6 decimals on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import hashing, text
from termweave.operators import agreement, audits, evaluation, explain, models, policy, reliability, retrieval, review, temporal
from termweave.operators import spans as intervals
from termweave.plans import frames
from termweave.plans.frames import FEEDBACK, MULTILABEL, PARTS, PREDICTIONS, REVIEW, SPANS, read, rounded
from termweave.sources import records

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- sources, splits


@query(f"SELECT o_orderkey, {frames.split_sql('o_orderkey')} AS split FROM orders")
def split_document(spark, d):
    return read(spark, d, "orders").select("o_orderkey", hashing.split_by_hash(F.col("o_orderkey")).alias("split"))


@query(f"SELECT o_custkey, count(*) AS n_orders, {frames.split_sql('o_custkey', 7)} AS split FROM orders GROUP BY o_custkey")
def split_subject(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return o.withColumn("split", hashing.split_by_hash(F.col("o_custkey"), 7))


@query("SELECT doc_id, CASE WHEN lower(source) = 'src0' THEN 'test' WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967295.0 < 0.15 THEN 'val' ELSE 'train' END AS split FROM documents")
def split_cross_source(spark, d):
    return read(spark, d, "documents").select("doc_id", hashing.cross_source_split(F.col("source"), F.col("doc_id"), "SRC0").alias("split"))


@query(f"WITH s AS (SELECT o_custkey, {frames.split_sql('o_orderkey')} AS split FROM orders) SELECT o_custkey, count(DISTINCT split)::BIGINT AS n_splits FROM s GROUP BY o_custkey HAVING count(DISTINCT split) > 1")
def leakage_check(spark, d):
    o = read(spark, d, "orders").select("o_custkey", hashing.split_by_hash(F.col("o_orderkey")).alias("split"))
    return records.group_leaks(o, "o_custkey")


@query("WITH s AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, sha256(lower(trim(text))) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS text_sha, count(*) AS n_test FROM s WHERE split = 'test' AND h IN (SELECT h FROM s WHERE split = 'train') GROUP BY h")
def text_leakage(spark, d):
    """Texts of the test part that the training part has too."""
    s = read(spark, d, "documents").filter("text is not null").select(F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"), F.sha2(F.lower(F.trim("text")), 256).alias("text_sha"))
    return s.filter("split = 'test'").join(s.filter("split = 'train'").select("text_sha").distinct(), "text_sha", "left_semi").groupBy("text_sha").agg(F.count(F.lit(1)).alias("n_test"))


@query(f"WITH {PARTS} SELECT code, trim(term || ' ' || replace(synonyms, '|', ' ')) AS search_text, len(string_split(synonyms, '|'))::INT AS n_synonyms FROM terms")
def terminology_prepare(spark, d):
    t = records.terminology(frames.part_terms(spark, d), "PARTS")
    return t.select("code", "search_text", F.size(F.split("synonyms", r"\|")).alias("n_synonyms"))


@query(f"WITH {PARTS}, a AS (SELECT code, row_seq, unnest(list_prepend(term, string_split(synonyms, '|'))) AS alias, generate_subscripts(list_prepend(term, string_split(synonyms, '|')), 1) - 1 AS i FROM terms) SELECT code, min(i)::INT AS alias_idx, lower(alias) AS alias FROM a GROUP BY code, lower(alias)")
def alias_table(spark, d):
    return records.alias_rows(frames.part_terms(spark, d)).select("code", "alias_idx", F.lower("alias").alias("alias"))


@query(f"""WITH {PARTS}, m AS (SELECT gold_code, text AS mention, min(row_seq) AS seq FROM recs WHERE split = 'train' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY gold_code ORDER BY seq, mention) AS n FROM m)
SELECT gold_code AS code, max(mention) FILTER (n = 1) AS term, coalesce(string_agg(mention, ' | ' ORDER BY n) FILTER (n BETWEEN 2 AND 20), '') AS synonyms FROM r WHERE n <= 20 GROUP BY gold_code""")
def train_terminology(spark, d):
    rows = frames.part_records(spark, d).filter("split = 'train'").withColumn("mention", F.col("text"))
    return records.train_terminology(rows, 20).select("code", "term", "synonyms")


@query("""WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
dx AS (SELECT l_orderkey, trim(l_partkey::VARCHAR) AS code, l_linenumber, l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F'),
often AS (SELECT code FROM dx GROUP BY code HAVING count(*) >= 3),
f AS (SELECT o_custkey, d.code, min(l_linenumber) AS seq FROM n JOIN dx d ON d.l_orderkey = n.o_orderkey SEMI JOIN often ON often.code = d.code WHERE r = 1 GROUP BY ALL)
SELECT o_custkey::VARCHAR AS record_id, count(*)::INT AS n_gold_codes, string_agg(f.code, ',' ORDER BY seq, f.code) AS codes, string_agg(coalesce(p_name, ''), ',' ORDER BY seq, f.code) AS terms FROM f LEFT JOIN part ON p_partkey::VARCHAR = f.code GROUP BY o_custkey""")
def multilabel_prepare(spark, d):
    """Customers as stays: the latest order is the note, its lines of one status the diagnoses, parts the dictionary."""
    o, li, p = read(spark, d, "orders"), read(spark, d, "lineitem"), read(spark, d, "part")
    notes = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_custkey").cast("string").alias("hadm_id"), F.col("o_orderkey").alias("note_id"), F.col("o_orderdate").alias("charttime"), F.col("o_orderpriority").alias("text"))
    latest = notes.groupBy("hadm_id").agg(F.max_by("note_id", F.struct("charttime", "note_id")).alias("l_orderkey"))
    often = li.filter("l_linestatus = 'F'").groupBy("l_partkey").count().filter("count >= 3").select("l_partkey")
    dx = li.join(often, "l_partkey", "left_semi").join(latest, "l_orderkey").select("hadm_id", F.col("l_partkey").cast("string").alias("icd_code"), F.when(F.col("l_linestatus") == "F", "10").otherwise("9").alias("icd_version"), F.col("l_linenumber").alias("seq_num"))
    names = p.select(F.col("p_partkey").cast("string").alias("icd_code"), F.lit("10").alias("icd_version"), F.col("p_name").alias("long_title"))
    out = records.multilabel_records(notes, dx, names)
    return out.select("record_id", "n_gold_codes", F.array_join("gold_codes", ",").alias("codes"), F.array_join("gold_terms", ",").alias("terms"))


@query("SELECT DISTINCT event_id::VARCHAR AS record_id, trim(event_type) AS mention, regexp_replace(trim(user_id::VARCHAR || '.0'), '\\.0$', '') AS gold_code FROM events WHERE event_type <> 'view'")
def corpus_adapter(spark, d):
    e = read(spark, d, "events").filter("event_type <> 'view'")
    rows = e.select(F.lit("events").alias("original_dataset"), F.col("event_id").alias("instance_id"), F.concat(F.lit(" "), "event_type").alias("phrase"), F.concat(F.col("user_id").cast("string"), F.lit(".0")).alias("single_mapped_meddra_codes"))
    return records.single_code_corpus(rows).select("record_id", "mention", "gold_code")


@query("SELECT c_custkey FROM customer ORDER BY sha256('11:' || c_custkey), c_custkey LIMIT 50")
def seeded_sample(spark, d):
    return hashing.sample(read(spark, d, "customer").select("c_custkey"), 50, F.col("c_custkey"), 11)


@query()
def fingerprint(spark, d):
    return hashing.fingerprint(read(spark, d, "orders"))


# ---- retrieval


def grams_sql(t: str, low: int, high: int) -> str:
    return f"""flatten(list_transform(list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform(list_filter(range({low}, {high + 1}), lambda n: n = {low} OR n <= length(w) + 2),
      lambda n: list_transform(range(1, greatest(length(w) + 2 - n, 0) + 2), lambda i: substring(' ' || w || ' ', i, n))))))"""


def words_sql(t: str) -> str:
    w = f"regexp_extract_all(lower({t}), '[\\pL\\pN_][\\pL\\pN_]+')"
    return f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"


def space_sql(name: str, items: str, grams: str, sublinear: bool) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""{name}_tf AS (SELECT item, gram, count(*) AS tf FROM (SELECT item, unnest({grams}) AS gram FROM ({items})) GROUP BY ALL),
{name}_idf AS (SELECT gram, ln((1.0 + (SELECT count(DISTINCT item) FROM ({items}))) / (1.0 + count(*))) + 1.0 AS idf FROM {name}_tf GROUP BY gram),
{name}_w AS (SELECT item, gram, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w FROM (SELECT item, gram, {tf} * idf AS w FROM {name}_tf JOIN {name}_idf USING (gram)))"""


def sims_sql(name: str, queries: str, grams: str, sublinear: bool) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""{name}_qt AS (SELECT query, gram, count(*) AS tf FROM (SELECT query, unnest({grams}) AS gram FROM ({queries})) GROUP BY ALL),
{name}_q AS (SELECT query, gram, w / sqrt(sum(w * w) OVER (PARTITION BY query)) AS w FROM (SELECT query, gram, {tf} * idf AS w FROM {name}_qt JOIN {name}_idf USING (gram))),
{name}_s AS (SELECT query, item, sum(q.w * c.w) AS sim FROM {name}_q q JOIN {name}_w c USING (gram) GROUP BY ALL)"""


def top_sql(k: int, weight: float) -> str:
    """Scores of all codes, zeros included, as the reference ranks them."""
    return f"""hist AS (SELECT gold_code, text, min(row_seq) AS seq, gold_code || '|' || text AS item FROM recs WHERE split = 'train' GROUP BY gold_code, text),
q AS (SELECT DISTINCT text AS query, text FROM recs WHERE split = 'test'),
{space_sql('t', 'SELECT code AS item, term AS text FROM terms', grams_sql('text', 3, 5), False)},
{sims_sql('t', 'SELECT query, text FROM q', grams_sql('text', 3, 5), False)},
{space_sql('h', 'SELECT item, text FROM hist', grams_sql('text', 3, 5), False)},
{sims_sql('h', 'SELECT query, text FROM q', grams_sql('text', 3, 5), False)},
hs AS (SELECT query, gold_code AS code, max(sim) AS s FROM h_s JOIN hist USING (item) GROUP BY ALL),
allof AS (SELECT q.query, t.code, t.row_seq, coalesce(a.sim, 0) AS terminology_score, coalesce(b.s, 0) AS history_score, {1 - weight} * coalesce(a.sim, 0) + {weight} * coalesce(b.s, 0) AS score
  FROM q CROSS JOIN terms t LEFT JOIN t_s a ON a.query = q.query AND a.item = t.code LEFT JOIN hs b ON b.query = q.query AND b.code = t.code),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, row_seq) AS rank FROM allof QUALIFY rank <= {k})"""


def coder(spark, d, weight: float = 0.25, k: int = 5):
    """A fitted coder and the test records. What earlier queries kept is given back: whatever still needs it is computed anew."""
    retrieval.release()
    r = frames.part_records(spark, d)
    return retrieval.HistoricalCoder(weight, k).fit(r.filter("split = 'train'"), frames.part_terms(spark, d)), r.filter("split = 'test'")


@query(f"WITH {PARTS}, {top_sql(5, 0.25)} SELECT record_id, rank::INT AS rank, code, round(score, 6) AS score, round(terminology_score, 6) AS terminology_score, round(history_score, 6) AS history_score FROM recs r JOIN top ON top.query = r.text WHERE r.split = 'test'")
def retrieve_topk(spark, d):
    """The flagship: terminology and history spaces, fused, the best five codes of every test record."""
    c, test = coder(spark, d)
    return rounded(c.predict(test).select("record_id", "rank", "code", "score", "terminology_score", "history_score"))


@query(f"""WITH {PARTS}, {top_sql(5, 0.25)}, c AS (SELECT query, max(score) FILTER (rank = 1) AS a, max(score) FILTER (rank = 2) AS b, max(code) FILTER (rank = 1) AS predicted_code FROM top GROUP BY query)
SELECT record_id, predicted_code, round(least(greatest(0.5 * a + 0.5 * greatest(a - b, 0), 0), 1), 6) AS confidence, (predicted_code = gold_code)::INT AS correct FROM recs r JOIN c ON c.query = r.text WHERE r.split = 'test'""")
def retrieve_confidence(spark, d):
    c, test = coder(spark, d)
    p = retrieval.predictions(c.predict(test)).join(test.select("record_id", "gold_code"), "record_id")
    return rounded(p.select("record_id", "predicted_code", "confidence", (F.col("predicted_code") == F.col("gold_code")).cast("int").alias("correct")))


@query(f"""WITH {PARTS}, {top_sql(10, 0.25)}, g AS (SELECT r.record_id, r.gold_code, min(rank) FILTER (code = r.gold_code) AS gr FROM recs r JOIN top ON top.query = r.text WHERE r.split = 'test' GROUP BY ALL)
SELECT count(*) AS n, avg((coalesce(gr, 99) <= 1)::INT)::DOUBLE AS acc_at_1, round(avg((coalesce(gr, 99) <= 5)::INT), 6) AS recall_at_5, round(avg((coalesce(gr, 99) <= 10)::INT), 6) AS recall_at_10, sum((coalesce(gr, 99) > 5)::INT)::BIGINT AS failures_at_5, sum((coalesce(gr, 99) > 10)::INT)::BIGINT AS failures_at_10, round(avg(coalesce(1.0 / gr, 0)), 6) AS mrr FROM g""".replace("avg((coalesce(gr, 99) <= 1)::INT)::DOUBLE", "round(avg((coalesce(gr, 99) <= 1)::INT), 6)"))
def retrieval_report(spark, d):
    c, test = coder(spark, d, k=10)
    p = retrieval.predictions(c.predict(test)).join(test.select("record_id", "gold_code"), "record_id")
    return rounded(evaluation.metric_block(p.withColumn("codes", F.transform("candidates", lambda x: x["code"])), ks=(5, 10)))


@query(f"""WITH {PARTS}, {top_sql(1, 0.25)}, n AS (SELECT query, text AS case_text, gold_code AS code, sim, row_number() OVER (PARTITION BY query ORDER BY round(sim, 9) DESC, seq) AS rank FROM h_s JOIN hist USING (item) QUALIFY rank <= 5)
SELECT record_id, rank::INT AS rank, code, case_text, round(sim, 6) AS similarity FROM recs r JOIN n ON n.query = r.text WHERE r.split = 'test'""")
def historical_cases(spark, d):
    c, test = coder(spark, d)
    return rounded(c.cases(test).select("record_id", "rank", "code", "case_text", "similarity"))


@query(f"WITH {PARTS}, {space_sql('t', 'SELECT code AS item, term AS text FROM terms', grams_sql('text', 3, 5), False)} SELECT gram, round(idf, 6) AS idf FROM t_idf")
def tfidf_char_idf(spark, d):
    t = frames.part_terms(spark, d).select(F.col("code").alias("item"), F.col("term").alias("text"))
    return rounded(retrieval.fit(t, retrieval.char_3_5).idf.select("gram", "idf"))


@query(f"WITH {space_sql('t', 'SELECT item_id AS item, text FROM benchmark', words_sql('text'), True)} SELECT item, gram, round(w, 6) AS w FROM t_w")
def tfidf_word_weights(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text")
    return rounded(retrieval.fit(b, text.word_grams, sublinear=True).postings.select("item", "gram", "w"))


ALIAS = f"""a0 AS (SELECT code, row_seq, unnest(list_prepend(term, string_split(synonyms, '|'))) AS alias, generate_subscripts(list_prepend(term, string_split(synonyms, '|')), 1) - 1 AS i FROM terms),
alias AS (SELECT code, row_seq, alias, i, code || '|' || i AS item FROM (SELECT *, row_number() OVER (PARTITION BY code, lower(alias) ORDER BY i) AS n FROM a0) WHERE n = 1),
hist AS (SELECT gold_code, text, gold_code || '|' || text AS item FROM recs WHERE split = 'train' GROUP BY gold_code, text),
q AS (SELECT DISTINCT text AS query, text FROM recs WHERE split = 'test'),
{space_sql('c', 'SELECT item, alias AS text FROM alias', grams_sql('text', 2, 5), True)}, {sims_sql('c', 'SELECT query, text FROM q', grams_sql('text', 2, 5), True)},
{space_sql('w', 'SELECT item, alias AS text FROM alias', words_sql('text'), True)}, {sims_sql('w', 'SELECT query, text FROM q', words_sql('text'), True)},
{space_sql('h', 'SELECT item, text FROM hist', grams_sql('text', 2, 5), True)}, {sims_sql('h', 'SELECT query, text FROM q', grams_sql('text', 2, 5), True)},
f AS (SELECT coalesce(c_s.query, w_s.query) AS query, coalesce(c_s.item, w_s.item) AS item, 0.85 * coalesce(c_s.sim, 0) + 0.15 * coalesce(w_s.sim, 0) AS fused FROM c_s FULL JOIN w_s ON c_s.query = w_s.query AND c_s.item = w_s.item),
b AS (SELECT query, code, fused, alias, row_number() OVER (PARTITION BY query, code ORDER BY round(fused, 12) DESC, i) AS n FROM f JOIN alias USING (item) QUALIFY n = 1),
hs AS (SELECT query, gold_code AS code, max(sim) AS s FROM h_s JOIN hist USING (item) GROUP BY ALL),
allof AS (SELECT q.query, t.code, t.row_seq, b.alias, coalesce(b.fused, 0) AS ts, 0.75 * coalesce(b.fused, 0) + 0.25 * coalesce(hs.s, 0) AS score FROM q CROSS JOIN terms t LEFT JOIN b ON b.query = q.query AND b.code = t.code LEFT JOIN hs ON hs.query = q.query AND hs.code = t.code),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, round(ts, 12) DESC, row_seq) AS rank FROM allof QUALIFY rank <= 5)"""


@query(f"WITH {PARTS}, {ALIAS} SELECT record_id, rank::INT AS rank, code, round(score, 6) AS score, round(ts, 6) AS terminology_score, alias AS matched_alias FROM recs r JOIN top ON top.query = r.text WHERE r.split = 'test'")
def alias_hybrid_topk(spark, d):
    retrieval.release()
    r = frames.part_records(spark, d)
    c = retrieval.AliasCoder(0.25, 0.15, 5).fit(r.filter("split = 'train'"), frames.part_terms(spark, d))
    return rounded(c.predict(r.filter("split = 'test'")).select("record_id", "rank", "code", "score", "terminology_score", "matched_alias"))


def grid_sql() -> str:
    parts = []
    for w in (0.0, 0.25, 0.5, 0.75, 1.0):
        parts.append(f"SELECT {w}::DOUBLE AS history_weight, query, code, row_number() OVER (PARTITION BY query ORDER BY round({1 - w} * terminology_score + {w} * history_score, 12) DESC, row_seq) AS rank FROM allof")
    return " UNION ALL ".join(parts)


@query(f"""WITH {PARTS}, {top_sql(5, 0.25)}, grid AS ({grid_sql()})
SELECT history_weight, round(avg((rank <= 1)::INT), 6) AS acc_at_1, round(avg((rank <= 5)::INT), 6) AS acc_at_5 FROM recs r JOIN grid g ON g.query = r.text AND g.code = r.gold_code WHERE r.split = 'test' GROUP BY history_weight""")
def weight_grid(spark, d):
    """Accuracy for each history weight, from one table of component scores."""
    c, test = coder(spark, d)
    return rounded(weight_accuracy(c, test, (0.0, 0.25, 0.5, 0.75, 1.0)))


def weight_accuracy(c, part, weights):
    """A row per weight: component scores are made once, and all weights are ranked in one window."""
    named = retrieval.query_text(part).withColumn("query", retrieval.text_key("query_text")).join(part.select("record_id", "gold_code"), "record_id")
    texts = named.groupBy("query").agg(F.min("query_text").alias("text"))
    every = F.explode(F.array(*map(F.lit, weights))).alias("w")
    asked = F.struct("w", "query").alias("query")
    scores = c.components(texts).select("*", every)
    scores = scores.select(asked, "code", ((1 - F.col("w")) * F.col("terminology_score") + F.col("w") * F.col("history_score")).alias("score")).filter("score > 0")
    top = retrieval.ranked(scores, c.codes, texts.select("query", every).select(asked), 5).select("query", F.col("code").alias("gold_code"), "rank")
    hit = named.select("gold_code", every, "query").select("gold_code", "w", asked).join(top, ["query", "gold_code"], "left")
    within = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))).alias(f"acc_at_{k}")
    return hit.groupBy(F.col("w").alias("history_weight")).agg(within(1), within(5))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
s AS (SELECT q.vec_id AS query, 'L' || i.label AS code, max(list_dot_product(q.v, i.v)) AS dense_score FROM n q JOIN n i ON q.vec_id % 50 = 0 GROUP BY ALL),
m AS (SELECT *, CASE WHEN max(dense_score) OVER (PARTITION BY query) <= min(dense_score) OVER (PARTITION BY query) THEN 0 ELSE (dense_score - min(dense_score) OVER (PARTITION BY query)) / (max(dense_score) OVER (PARTITION BY query) - min(dense_score) OVER (PARTITION BY query)) END AS scaled FROM s)
SELECT query, code, round(dense_score, 6) AS dense_score, round(scaled, 6) AS scaled FROM m""")
def dense_topk(spark, d):
    """A stated query set against all vectors, coded by their labels: the best cosine of each code, scaled per query."""
    e = read(spark, d, "embeddings")
    q = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    i = e.select(F.concat(F.lit("L"), "label").alias("code"), F.col("embedding").alias("vector"))
    return rounded(retrieval.dense_scores(q, i).withColumn("scaled", retrieval.min_max("dense_score", "query")))


@query(f"""WITH {PREDICTIONS}, base AS (SELECT record_id, codes[i] AS code, scores[i] AS s, scores[i] * (1 + (ascii(substr(codes[i], 3, 1)) - 48)) / 10.0 AS dn FROM (SELECT *, unnest(range(1, len(codes) + 1)) AS i FROM pred)),
d AS (SELECT *, CASE WHEN max(dn) OVER w <= min(dn) OVER w THEN 0 ELSE (dn - min(dn) OVER w) / (max(dn) OVER w - min(dn) OVER w) END AS ds FROM base WINDOW w AS (PARTITION BY record_id)),
lp AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY s DESC, code) AS a, row_number() OVER (PARTITION BY record_id ORDER BY dn DESC, code) AS b FROM d),
r AS (SELECT record_id, code, 0.7 * CASE WHEN a <= 3 THEN s ELSE 0 END + 0.3 * ds AS score FROM lp WHERE a <= 3 OR b <= 3),
p AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY score DESC, code) AS rank FROM r)
SELECT record_id AS query, rank::INT AS rank, code, round(score, 6) AS score FROM p WHERE rank <= 2""")
def pooled_fusion(spark, d):
    """Lexical and dense pools of three, fused."""
    c = frames.candidates(spark, d).withColumnRenamed("record_id", "query").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("query")), "query")
    dense = c.select("query", "code", (F.col("score") * (1 + F.substring("code", 3, 1).cast("int")) / 10.0).alias("dense_score"))
    return rounded(retrieval.advanced(c, dense, pool=3, top_k=2, dense_weight=0.3).select("query", "rank", "code", "score"))


ML_RANK = f"""tr AS (SELECT doc_id, text, 'B' || lang AS lang_code, 'S' || (doc_id % 5) AS s FROM documents WHERE text IS NOT NULL),
lab AS (SELECT doc_id AS item, lang_code AS code FROM tr WHERE lang_code IS NOT NULL UNION SELECT doc_id, s FROM tr),
trm AS (SELECT code, min(item) AS row_seq FROM lab GROUP BY code), q AS (SELECT item_id AS query, text FROM benchmark),
wd AS (SELECT doc_id AS item, regexp_extract_all(lower(CASE WHEN trim(text) = '' THEN '__empty__' ELSE text END), '[\\pL\\pN_][\\pL\\pN_]+') AS w FROM tr),
n_tf AS (SELECT item, gram, count(*) AS tf FROM (SELECT item, unnest(w) AS gram FROM wd UNION ALL SELECT item, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM wd WHERE len(w) > 1) GROUP BY ALL),
n_df AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM n_tf GROUP BY gram HAVING count(*) >= 2 ORDER BY total DESC, gram LIMIT 100000),
n_idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM tr)) / (1.0 + df)) + 1.0 AS idf FROM n_df),
n_w AS (SELECT item, gram, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w FROM (SELECT item, gram, (1 + ln(tf)) * idf AS w FROM n_tf JOIN n_idf USING (gram))),
ctr AS (SELECT code, gram, w / sqrt(sum(w * w) OVER (PARTITION BY code)) AS w FROM (SELECT code, gram, sum(w) AS w FROM n_w JOIN lab USING (item) GROUP BY ALL)),
{sims_sql('n', 'SELECT query, text FROM q', words_sql('text'), True).split('n_s AS')[0]}
sim AS (SELECT query, code, sum(a.w * c.w) AS s FROM n_q a JOIN ctr c USING (gram) GROUP BY ALL),
rk AS (SELECT q.query, trm.code, coalesce(s, 0) AS score, row_number() OVER (PARTITION BY q.query ORDER BY round(coalesce(s, 0), 12) DESC, row_seq, trm.code) AS rank FROM q CROSS JOIN trm LEFT JOIN sim ON sim.query = q.query AND sim.code = trm.code)"""


@query(f"WITH {ML_RANK} SELECT query::VARCHAR AS record_id, rank::INT AS rank, code, round(score, 6) AS score FROM rk WHERE rank <= 3")
def multilabel_centroid(spark, d):
    """All documents are training notes, coded with their language and one of five others; benchmark items are ranked by the codes' mean notes."""
    docs = read(spark, d, "documents").filter("text is not null")
    train = docs.select(F.col("doc_id").cast("string").alias("record_id"), "text", F.array_compact(F.array(F.concat(F.lit("B"), "lang"), F.concat(F.lit("S"), (F.col("doc_id") % 5).cast("string")))).alias("gold_codes"))
    labels = train.select(F.explode("gold_codes").alias("code"), F.col("record_id").cast("long").alias("doc_id")).groupBy("code").agg(F.min("doc_id").alias("row_seq"))
    retrieval.release()
    codes = retrieval.kept(labels.select("code", F.col("code").alias("term"), F.col("row_seq")))
    notes = read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("record_id"), "text")
    return rounded(retrieval.MultiLabelCoder(1.0, 3).fit(train, codes).rank(notes).select("record_id", "rank", "code", "score"))


# ---- evaluation over time


TIMED = f"""first AS (SELECT l_partkey, min(l_shipdate) AS seen FROM lineitem GROUP BY 1), timed AS (SELECT recs.* EXCLUDE (split), seen FROM recs JOIN first ON l_partkey::VARCHAR = record_id),
cut AS (SELECT TIMESTAMP '1995-03-01' AS before), old AS (SELECT gold_code, text, min(row_seq) AS seq, min(seen) AS seen, gold_code || '|' || text AS item FROM timed GROUP BY gold_code, text),
q AS (SELECT DISTINCT text || '@' || seen AS query, text, seen FROM timed WHERE seen >= (SELECT before FROM cut)),
{space_sql('t', 'SELECT code AS item, term AS text FROM terms', grams_sql('text', 3, 5), False)}, {sims_sql('t', 'SELECT query, text FROM q', grams_sql('text', 3, 5), False)},
h_tf AS (SELECT item, gram, count(*) AS tf FROM (SELECT item, unnest({grams_sql('text', 3, 5)}) AS gram FROM old) GROUP BY ALL),
h_idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM old, cut WHERE seen < before)) / (1.0 + count(*))) + 1.0 AS idf FROM h_tf JOIN old USING (item), cut WHERE seen < before GROUP BY gram),
h_w AS (SELECT item, gram, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w FROM (SELECT item, gram, tf * idf AS w FROM h_tf JOIN h_idf USING (gram))),
{sims_sql('h', 'SELECT query, text FROM q', grams_sql('text', 3, 5), False)},
hs AS (SELECT query, gold_code AS code, max(sim) AS s FROM h_s JOIN old USING (item) JOIN q USING (query) WHERE old.seen < q.seen GROUP BY ALL),
allof AS (SELECT q.query, t.code, t.row_seq, coalesce(a.sim, 0) AS terminology_score, coalesce(b.s, 0) AS history_score, 0.5 * coalesce(a.sim, 0) + 0.5 * coalesce(b.s, 0) AS score
  FROM q CROSS JOIN terms t LEFT JOIN t_s a ON a.query = q.query AND a.item = t.code LEFT JOIN hs b ON b.query = q.query AND b.code = t.code),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, row_seq) AS rank FROM allof QUALIFY rank <= 3)"""


def timed_records(spark, d):
    """Parts as records of the day on which they were first shipped."""
    first = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("row_seq")).agg(F.min("l_shipdate").alias("at"))
    return frames.part_records(spark, d).drop("split").join(first, "row_seq")


@query(f"WITH {PARTS}, {TIMED} SELECT record_id, rank::INT AS rank, code, round(score, 6) AS score, round(terminology_score, 6) AS terminology_score, round(history_score, 6) AS history_score FROM timed r JOIN top ON top.query = r.text || '@' || r.seen")
def asof_topk(spark, d):
    """The best three codes of every part from March 1995 on, by the terminology and the parts shipped before it."""
    retrieval.release()
    rows = timed_records(spark, d)
    c = temporal.AsOfCoder(0.5, 3).fit(rows, frames.part_terms(spark, d), "1995-03-01")
    return rounded(c.predict(rows.filter("at >= '1995-03-01'")).drop("history_item"))


@query(f"""WITH {PREDICTIONS}, known AS (SELECT DISTINCT subject_id FROM pred WHERE split = 'train'), t AS (SELECT p.*, k.subject_id IS NOT NULL AS seen FROM pred p LEFT JOIN known k USING (subject_id) WHERE split = 'test'),
x AS (SELECT 'all' AS part, * FROM t UNION ALL SELECT CASE WHEN seen THEN 'seen_subjects' ELSE 'unseen_subjects' END, * FROM t) SELECT part, count(*) AS n, count(DISTINCT subject_id) AS n_subjects, round(avg(correct), 6) AS accuracy FROM x GROUP BY part""")
def subject_sensitivity(spark, d):
    """Accuracy on orders of customers that training has, and of others."""
    p = frames.predictions(spark, d)
    return rounded(temporal.sensitivity(p.filter("split = 'test'"), p.filter("split = 'train'"), "subject_id"))


@query("""WITH s AS (SELECT o_custkey, o_orderdate AS day, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'val' ELSE 'test' END AS split FROM orders WHERE o_orderdate IS NOT NULL)
SELECT o_custkey, count(DISTINCT split)::BIGINT AS n_splits, min(day) AS first_at, max(day) AS last_at FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def period_leakage(spark, d):
    """Customers whose orders lie in several periods."""
    o = read(spark, d, "orders").withColumnRenamed("o_orderdate", "at")
    rows = o.withColumn("split", temporal.period("at", "1998-01-01", "2000-01-01"))
    return temporal.period_leaks(rows, "o_custkey")


# ---- evaluation


@query(f"WITH {PREDICTIONS} SELECT count(*) AS n, round(avg(list_contains(codes[1:1], gold_code)::INT), 6) AS accuracy_at_1, round(avg(list_contains(codes[1:3], gold_code)::INT), 6) AS accuracy_at_3, round(avg(list_contains(codes[1:5], gold_code)::INT), 6) AS accuracy_at_5 FROM pred")
def accuracy_at_k(spark, d):
    return rounded(evaluation.accuracy_at_k(frames.predictions(spark, d), (1, 3, 5)))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT *, coalesce(list_position(codes[1:20], gold_code), 0) AS gr FROM pred) SELECT status, count(*) AS n, round(avg((gr = 1)::INT), 6) AS acc_at_1, round(avg((gr BETWEEN 1 AND 5)::INT), 6) AS recall_at_5, round(avg((gr BETWEEN 1 AND 20)::INT), 6) AS recall_at_20,
sum(1 - (gr BETWEEN 1 AND 5)::INT)::BIGINT AS failures_at_5, sum(1 - (gr BETWEEN 1 AND 20)::INT)::BIGINT AS failures_at_20, round(avg(CASE WHEN gr > 0 THEN 1.0 / gr ELSE 0 END), 6) AS mrr FROM r GROUP BY status""")
def metrics_by_group(spark, d):
    return rounded(evaluation.metric_block(frames.predictions(spark, d), "status", (5, 20)))


@query(f"WITH {PREDICTIONS} SELECT count(*) FILTER (confidence >= 0.6) AS n_auto, round(avg((confidence >= 0.6)::INT), 6) AS coverage, round(avg(correct) FILTER (confidence >= 0.6), 6) AS accuracy FROM pred")
def coverage_accuracy(spark, d):
    return rounded(evaluation.coverage_accuracy(frames.predictions(spark, d), 0.6))


DIAG = """diag AS (SELECT pred.*, nullif(coalesce(list_position(codes[1:10], gold_code), 0), 0) AS gold_candidate_rank, CASE WHEN gold_code IN (SELECT code FROM seen) THEN 'seen_code' ELSE 'unseen_code' END AS code_novelty,
  CASE WHEN predicted_code = gold_code THEN 'correct' WHEN coalesce(list_position(codes[1:10], gold_code), 0) = 0 THEN 'candidate_generation_failure' ELSE 'ranking_failure' END AS error_type FROM pred)"""


def diagnosed(spark, d):
    return evaluation.diagnostics(frames.predictions(spark, d), frames.seen_codes(spark, d))


@query(f"WITH {PREDICTIONS}, {DIAG} SELECT record_id, gold_candidate_rank::BIGINT AS gold_candidate_rank, code_novelty, error_type FROM diag")
def diagnostics(spark, d):
    return diagnosed(spark, d).select("record_id", F.col("gold_candidate_rank").cast("long").alias("gold_candidate_rank"), "code_novelty", "error_type")


@query(f"""WITH {PREDICTIONS}, {DIAG}, x AS (SELECT 'all' AS subgroup, * FROM diag UNION ALL SELECT code_novelty, * FROM diag)
SELECT g.subgroup, count(x.record_id) AS n, round(avg(x.correct), 6) AS acc_at_1, round(avg(list_contains(codes[1:5], gold_code)::INT), 6) AS recall_at_5, round(avg(list_contains(codes[1:10], gold_code)::INT), 6) AS recall_at_10 FROM (VALUES ('all'), ('seen_code'), ('unseen_code')) g(subgroup) LEFT JOIN x USING (subgroup) GROUP BY g.subgroup""")
def subgroup_metrics(spark, d):
    return rounded(evaluation.subgroup_metrics(diagnosed(spark, d)))


@query(f"""WITH {PREDICTIONS}, {DIAG}, x AS (SELECT 'all' AS subgroup, error_type FROM diag UNION ALL SELECT code_novelty, error_type FROM diag)
SELECT g.subgroup, e.error_type, count(x.subgroup) AS n, round(coalesce(count(x.subgroup) / any_value(tot.n)::DOUBLE, 0), 6) AS rate FROM (VALUES ('all'), ('seen_code'), ('unseen_code')) g(subgroup) LEFT JOIN (SELECT subgroup, count(*) AS n FROM x GROUP BY subgroup) tot USING (subgroup) CROSS JOIN (VALUES ('correct'), ('candidate_generation_failure'), ('ranking_failure')) e(error_type) LEFT JOIN x ON x.subgroup = g.subgroup AND x.error_type = e.error_type GROUP BY ALL""")
def failure_summary(spark, d):
    return rounded(evaluation.failure_summary(diagnosed(spark, d)))


CURVE = """curve AS (SELECT confidence AS threshold, (sum(n) OVER w)::BIGINT AS n_auto, (sum(ok) OVER w)::BIGINT AS n_correct FROM (SELECT confidence, count(*) AS n, sum(correct) AS ok FROM {0} GROUP BY confidence) WINDOW w AS (ORDER BY confidence DESC ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {PREDICTIONS}, {CURVE.format('pred')} SELECT threshold, n_auto, n_correct, round(n_auto / (SELECT count(*)::DOUBLE FROM pred), 6) AS coverage, round(n_correct / n_auto::DOUBLE, 6) AS accuracy FROM curve")
def coverage_curve(spark, d):
    return rounded(evaluation.coverage_curve(frames.predictions(spark, d)))


@query(f"WITH {PREDICTIONS}, {CURVE.format('pred')} SELECT threshold, n_auto, n_correct, round(n_auto / (SELECT count(*)::DOUBLE FROM pred), 6) AS coverage, round(n_correct / n_auto::DOUBLE, 6) AS accuracy FROM curve WHERE n_correct / n_auto::DOUBLE + 1e-12 >= 0.015 ORDER BY n_auto DESC, accuracy DESC, threshold LIMIT 1")
def threshold_max_coverage(spark, d):
    return rounded(evaluation.threshold_max_coverage(frames.predictions(spark, d), 0.015))


@query(f"""WITH {PREDICTIONS}, v AS (SELECT * FROM pred WHERE split = 'val'), te AS (SELECT * FROM pred WHERE split = 'test'), {CURVE.format('v')},
t AS (SELECT unnest([0.02, 0.03, 0.05, 0.99])::DOUBLE AS target), c AS (SELECT target, threshold, n_auto, row_number() OVER (PARTITION BY target ORDER BY n_auto DESC, n_correct DESC, threshold) AS r FROM t JOIN curve ON n_correct / n_auto::DOUBLE + 1e-12 >= target QUALIFY r = 1),
g AS (SELECT target, count(*) AS n, count(*) FILTER (confidence >= threshold) AS a, avg(correct) FILTER (confidence >= threshold) AS acc FROM c JOIN te ON true GROUP BY target)
SELECT t.target, c.threshold, c.n_auto AS val_n_auto, coalesce(g.a, 0) AS test_n_auto, round(coalesce(g.a, 0) / (SELECT count(*) FROM te)::DOUBLE, 6) AS test_coverage, round(g.acc, 6) AS test_accuracy, coalesce(g.acc + 1e-12 >= t.target, false) AS target_met FROM t LEFT JOIN c USING (target) LEFT JOIN g USING (target)""")
def policy_stress(spark, d):
    p = frames.predictions(spark, d)
    return rounded(evaluation.policy_stress(p.filter("split = 'val'"), p.filter("split = 'test'"), (0.02, 0.03, 0.05, 0.99)))


@query(f"""WITH {MULTILABEL}, g AS (SELECT record_id, sum(gold)::INT AS g, count(*)::INT AS n, {', '.join(f'sum(gold) FILTER (rank <= {k}) AS h{k}' for k in (1, 2, 5))} FROM mlr GROUP BY record_id)
SELECT count(*) AS n_notes, {', '.join(f'round(avg(h{k} / greatest(least(n, {k}), 1)::DOUBLE), 6) AS precision_at_{k}, round(avg(h{k} / greatest(g, 1)::DOUBLE), 6) AS recall_at_{k}' for k in (1, 2, 5))} FROM g""")
def ml_ranking_metrics(spark, d):
    return rounded(evaluation.ranking_metrics(frames.multilabel(spark, d), (1, 2, 5)))


@query(f"""WITH {MULTILABEL}, g AS (SELECT record_id, sum(gold) AS g, sum((score >= 0.5)::INT) AS p, sum(gold * (score >= 0.5)::INT) AS tp FROM ml GROUP BY record_id), a AS (SELECT count(*) AS n, sum(g) AS g, sum(p) AS p, sum(tp) AS tp, avg(CASE WHEN g + p > 0 THEN 2.0 * tp / (g + p) ELSE 0 END) AS f, avg((tp = g AND tp = p)::INT) AS e FROM g)
SELECT n AS n_notes, round(tp / p::DOUBLE, 6) AS micro_precision, round(tp / g::DOUBLE, 6) AS micro_recall, round(2.0 * tp / (p + g), 6) AS micro_f1, round(f, 6) AS macro_f1, round(e, 6) AS exact_match, p::BIGINT AS n_proposals, round(p / n::DOUBLE, 6) AS mean_proposals FROM a""")
def ml_threshold_metrics(spark, d):
    return rounded(evaluation.threshold_metrics(frames.multilabel(spark, d), 0.5))


@query(f"""WITH {MULTILABEL}, c AS (SELECT score AS threshold, sum(count(*)) OVER w AS n, sum(sum(gold)) OVER w AS ok FROM ml GROUP BY score WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, n::BIGINT AS n_proposals, round(ok / n::DOUBLE, 6) AS precision, round(ok / (SELECT sum(gold) FROM ml)::DOUBLE, 6) AS recall FROM c WHERE ok / n::DOUBLE + 1e-12 >= 0.33 ORDER BY recall DESC, n DESC, precision DESC, threshold DESC LIMIT 1""")
def ml_pr_threshold(spark, d):
    return rounded(evaluation.threshold_max_recall(frames.multilabel(spark, d), 0.33))


@query(f"WITH {PREDICTIONS}, {MULTILABEL} SELECT CASE WHEN code IN (SELECT code FROM seen) THEN 'seen_code' ELSE 'unseen_code' END AS code_novelty, count(*) AS n_gold, round(avg((rank <= 2)::INT), 6) AS recall_at_2 FROM mlr WHERE gold = 1 GROUP BY 1")
def novelty_recall(spark, d):
    return rounded(evaluation.novelty_recall(frames.multilabel(spark, d), frames.seen_codes(spark, d), 2))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT *, CASE WHEN confidence >= 0.7 THEN 'AUTO_CANDIDATE' ELSE 'TOP_K_HUMAN_CHOICE' END AS route FROM pred WHERE scores[1] >= 0.05 UNION ALL SELECT *, 'FULL_EXPERT_REVIEW' FROM pred WHERE scores[1] < 0.05)
SELECT route, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM r), 6) AS coverage, round(avg(correct), 6) AS acc_at_1, round(avg(list_contains(codes[1:5], gold_code)::INT), 6) AS recall_at_5 FROM r GROUP BY route""")
def route_metrics(spark, d):
    p = frames.predictions(spark, d)
    top = F.get("scores", F.lit(0))
    return rounded(evaluation.route_metrics(p.withColumn("route", policy.route_case(F.col("confidence"), 0.7, policy.ood_flag(top)))))


@query(f"""WITH {PREDICTIONS}, p AS (SELECT gold_code, codes[1] AS b, CASE WHEN record_id % 3 = 0 AND len(codes) > 1 THEN codes[2] ELSE codes[1] END AS a, record_id % 3 = 0 AS ok FROM pred)
SELECT count(*) AS n, round(avg((b = gold_code)::INT), 6) AS acc_before, round(avg((a = gold_code)::INT), 6) AS acc_after, sum((a = gold_code AND b <> gold_code)::INT)::BIGINT AS corrected, sum((b = gold_code AND a <> gold_code)::INT)::BIGINT AS harmed, sum((a = gold_code)::INT - (b = gold_code)::INT)::BIGINT AS net,
round(avg((a = gold_code)::INT) FILTER (ok), 6) AS acc_accepted, round(avg((a = gold_code)::INT) FILTER (NOT ok), 6) AS acc_fallback, round(avg((a = gold_code)::INT) - avg((b = gold_code)::INT), 6) AS delta FROM p""")
def paired_comparison(spark, d):
    p = frames.predictions(spark, d)
    third = F.col("record_id") % 3 == 0
    return rounded(evaluation.paired_comparison(p.select("gold_code", F.col("predicted_code").alias("before"), F.when(third & (F.size("codes") > 1), F.get("codes", F.lit(1))).otherwise(F.col("predicted_code")).alias("after"), third.alias("accepted"))))


# ---- policy


UNC = """u0 AS (SELECT record_id, confidence, scores, scores[1] AS top, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e FROM pred),
u1 AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM u0),
unc AS (SELECT record_id, confidence, top AS top_score, CASE WHEN len(scores) > 1 THEN scores[1] - scores[2] ELSE scores[1] END AS score_margin, CASE WHEN len(scores) > 1 THEN -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12))) / ln(len(scores)) ELSE 0 END AS normalised_entropy, p[1] AS top_softmax_share FROM u1)"""


@query(f"""WITH {PREDICTIONS.replace('pred AS (', 'pred_ AS (')}, pred AS (SELECT record_id, confidence, CASE WHEN record_id % 3 = 0 THEN list_reverse(scores) WHEN record_id % 3 = 1 THEN list_append(scores, 0.0) ELSE scores END AS scores FROM pred_), {UNC}
SELECT record_id, round(top_score, 6) AS top_score, round(score_margin, 6) AS score_margin, round(normalised_entropy, 6) AS normalised_entropy, round(top_softmax_share, 6) AS top_softmax_share FROM unc""")
def uncertainty(spark, d):
    """Features in the candidates' order: every third list is turned round, as a reranker may do, and every third ends in a null score."""
    m, s = F.col("record_id") % 3, F.col("scores")
    scores = F.when(m == 0, F.reverse(s)).when(m == 1, F.concat(s, F.array(F.lit(None).cast("double")))).otherwise(s)
    return rounded(frames.predictions(spark, d).select("record_id", policy.uncertainty(scores).alias("u")).select("record_id", "u.*"))


@query(f"WITH {PREDICTIONS}, {UNC} SELECT record_id, CASE WHEN top_score < 0.05 THEN 'FULL_EXPERT_REVIEW' WHEN confidence >= 0.85 AND round(normalised_entropy, 9) <= 1.0 AND score_margin >= 0.08 THEN 'AUTO_CANDIDATE' WHEN confidence >= 0.45 THEN 'TOP_K_HUMAN_CHOICE' ELSE 'FULL_EXPERT_REVIEW' END AS route FROM unc")
def routing(spark, d):
    """Routes of the orders. The entropy is taken to 9 decimals, as equal candidates may miss 1 by a rounding."""
    rows = frames.predictions(spark, d).select("record_id", "confidence", policy.uncertainty("scores").alias("u"))
    return rows.select("record_id", policy.route(F.col("confidence"), F.round("u.normalised_entropy", 9), F.col("u.score_margin"), ood=policy.ood_flag(F.col("u.top_score"))).alias("route"))


@query("""WITH g AS (SELECT o_custkey % 40 AS k, count(*) AS n, sum((o_orderstatus <> 'P')::INT)::BIGINT AS s FROM orders GROUP BY 1)
SELECT k, n, s, round(list_sum(list_transform(range(0, n - s + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + (n - j) * ln(0.7) + j * ln(0.3)))), 6) AS tail FROM g""")
def binomial_tail(spark, d):
    g = read(spark, d, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") != "P").cast("long")).alias("s"))
    return rounded(g.withColumn("tail", policy.binomial_tail(F.col("s"), F.col("n"), 0.7)))


@query(f"""WITH {PREDICTIONS}, flip AS (SELECT confidence, 1 - correct AS correct FROM pred), {CURVE.format('flip')},
x AS (SELECT *, list_sum(list_transform(range(0, n_auto - n_correct + 1), lambda j: exp(lgamma(n_auto + 1) - lgamma(j + 1) - lgamma(n_auto - j + 1) + (n_auto - j) * ln(0.97) + j * ln(0.03)))) AS tail FROM curve WHERE n_auto >= 20)
SELECT threshold, n_auto, n_correct, round(n_correct / n_auto::DOUBLE, 6) AS accuracy FROM x WHERE tail <= 0.05 ORDER BY n_auto DESC, threshold LIMIT 1""")
def policy_lower_bound(spark, d):
    """The largest automatic part whose accuracy is at least 0.97 with confidence 0.95 (errors and hits exchanged, as these predictions mostly miss)."""
    p = frames.predictions(spark, d).withColumn("correct", 1 - F.col("correct"))
    return rounded(policy.threshold_by_lower_bound(p, 0.97).select("threshold", "n_auto", "n_correct", "accuracy"))


@query(f"WITH {PREDICTIONS} SELECT count(*) AS total_n, count(*) FILTER (confidence >= 0.55) AS n_auto, sum(1 - correct) FILTER (confidence >= 0.55)::BIGINT AS n_errors, round(avg((confidence >= 0.55)::INT), 6) AS coverage, round(avg(correct) FILTER (confidence >= 0.55), 6) AS accuracy FROM pred WHERE split = 'test'".replace("sum(1 - correct) FILTER (confidence >= 0.55)::BIGINT", "(sum(1 - correct) FILTER (confidence >= 0.55))::BIGINT"))
def frozen_threshold(spark, d):
    return rounded(policy.apply_threshold(frames.predictions(spark, d).filter("split = 'test'"), 0.55))


# ---- explanation


#: Sentences in SQL: pieces that tile the text, each with its place; white space that Python strips.
SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8195) || chr(8239) || chr(12288)"
SENTENCES = f"""tiles AS (SELECT doc_id, length(text) AS n, regexp_extract_all(text, '[^.!?\\n]+[.!?]*|[.!?]+|\\n') AS p FROM documents WHERE text IS NOT NULL),
placed AS (SELECT doc_id, n, len(p) AS k, generate_subscripts(p, 1) AS i, unnest(p) AS piece, unnest(list_prepend(0, list_transform(p, lambda x: length(x)))[:len(p)]) AS size FROM tiles),
laid AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY i) AS place, lead(piece) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM placed),
sent AS (SELECT doc_id, (place + length(piece) - length(ltrim(piece, {SPACE})))::INT AS s, trim(piece, {SPACE}) AS quote FROM laid
  WHERE NOT regexp_matches(piece, '^[.!?\\n]') AND (regexp_matches(piece, '[.!?]$') OR i = k OR (i = k - 1 AND after = chr(10))) AND trim(piece, {SPACE}) <> '')"""


@query(f"WITH {SENTENCES} SELECT doc_id, s AS start, (s + length(quote))::INT AS \"end\", sha256(quote) AS quote_sha FROM sent")
def sentences(spark, d):
    docs = read(spark, d, "documents").filter("text is not null")
    return explain.sentences(docs, "doc_id").select("doc_id", "start", "end", F.sha2("quote", 256).alias("quote_sha"))


def _assertion_sql(t: str) -> str:
    edge = lambda words: f"regexp_matches(lower({t}), '(^|[^\\pL\\pN_])({words})($|[^\\pL\\pN_])')"
    return "CASE " + " ".join(f"WHEN {edge(words)} THEN '{name}'" for name, words in text.ASSERTIONS) + " ELSE 'affirmed' END"


@query(f"SELECT conv_id, turn, {_assertion_sql('text')} AS assertion FROM conversations")
def assertion_class(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.assertion("text").alias("assertion"))


def evidence_rows(spark, d):
    """Documents as records: their fourth and fifth words are the mention, a benchmark item's first words the term."""
    docs = read(spark, d, "documents").filter("text is not null")
    w = F.split("text", r"\s+", 14)  # thirteen words, and the rest of the text uncut
    term = F.concat_ws(" ", F.get(w, F.lit(7)), F.get(w, F.lit(8)))
    return docs.select(F.col("doc_id").alias("record_id"), "text", F.when(F.col("doc_id") % 3 == 0, F.concat_ws(" ", F.get(w, F.lit(3)), F.get(w, F.lit(4)))).otherwise("").alias("mention"), term.alias("term"), F.get(w, F.lit(12)).alias("synonyms")).fillna("")


#: Evidence in SQL: the explicit mention, then the best sentences beside it, three in all.
EVIDENCE = f"""w AS (SELECT doc_id, text, regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents WHERE text IS NOT NULL),
given AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', w[4], w[5]) ELSE '' END AS mention, concat_ws(' ', w[8], w[9]) AS term, coalesce(w[13], '') AS synonyms FROM w),
named AS (SELECT *, trim(mention, ' ') AS m, list_filter(list_transform(list_prepend(term, regexp_split_to_array(synonyms, '[|;\\n]')), lambda x: trim(x, {SPACE})), lambda x: x <> '') AS p0 FROM given),
phrased AS (SELECT doc_id, text, term, m, list_filter(p0, lambda x, i: list_position(list_transform(p0, lambda y: lower(y)), lower(x)) = i) AS phrases FROM named),
target AS (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(array_to_string(phrases, ' ') || ' ' || m, '[A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))) AS target,
  CASE WHEN m <> '' AND instr(lower(text), lower(m)) > 0 THEN instr(lower(text), lower(m)) - 1 END AS es FROM phrased),
scored AS (SELECT t.doc_id, s, s + length(quote) AS e, quote, m, es, len(list_intersect(target, list_transform(list_filter(regexp_extract_all(quote, '[A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x)))) / greatest(len(target), 1)::DOUBLE
  + 0.5 * len(list_filter(phrases, lambda x: contains(lower(quote), lower(x)))) + CASE WHEN m <> '' AND contains(lower(quote), lower(m)) THEN 1.0 ELSE 0.0 END AS score FROM target t JOIN sent USING (doc_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s) AS n FROM scored WHERE score > 0 AND (es IS NULL OR e <= es OR s >= es + length(m))),
spans AS (SELECT doc_id, s::INT AS s, e::INT AS e, 'supporting_sentence' AS source, score, quote FROM best WHERE n <= CASE WHEN es IS NULL THEN 3 ELSE 2 END
  UNION ALL SELECT doc_id, es::INT, (es + length(m))::INT, 'explicit_mention', 2.0, substr(text, es + 1, length(m)) FROM target WHERE es IS NOT NULL)"""


@query(f"WITH {SENTENCES}, {EVIDENCE} SELECT doc_id AS record_id, s AS start, e AS \"end\", source, round(score::DOUBLE, 6) AS score, sha256(quote) AS quote_sha FROM spans")
def evidence_spans(spark, d):
    s = explain.evidence_spans(evidence_rows(spark, d)).select("record_id", F.explode("spans").alias("s"))
    return rounded(s.select("record_id", "s.start", "s.end", "s.source", "s.score", F.sha2("s.quote", 256).alias("quote_sha")))


@query(f"""WITH {SENTENCES}, {EVIDENCE},
around AS (SELECT doc_id, greatest(s - length(regexp_extract(substr(text, 1, s), '[^.\\n]*$')), s - 100, 0) AS l, CASE WHEN regexp_matches(substr(text, e + 1), '[.\\n]') THEN e + length(regexp_extract(substr(text, e + 1), '^[^.\\n]*[.\\n]')) ELSE least(length(text), e + 100) END AS r, text FROM spans JOIN target USING (doc_id)),
judged AS (SELECT doc_id, count(*) FILTER ({_assertion_sql(f"trim(substr(text, l + 1, r - l), {SPACE})")} = 'affirmed') AS affirmed FROM around GROUP BY doc_id)
SELECT doc_id AS record_id, CASE WHEN coalesce(affirmed, 0) = 0 THEN 'FAIL' ELSE 'WARN' END AS quality_gate, CASE WHEN doc_id % 2 = 0 AND affirmed > 0 THEN 'AUTO_CANDIDATE' ELSE 'HUMAN_REVIEW' END AS decision,
CASE WHEN coalesce(affirmed, 0) = 0 THEN 'no_evidence_quotes,clinical_context_requires_review,insufficient_affirmed_evidence' ELSE '' END AS failures,
CASE WHEN trim(term, {SPACE}) = '' THEN 'missing_terminology_knowledge,' ELSE '' END || 'faithfulness_not_available' AS warnings FROM target LEFT JOIN judged USING (doc_id)""")
def explanation_audit(spark, d):
    """Evidence, its assertion classes and the quality gate, over all documents."""
    rows = evidence_rows(spark, d)
    e = explain.with_spans(rows).withColumn("decision", F.when(F.col("record_id") % 2 == 0, "AUTO_CANDIDATE").otherwise("HUMAN_REVIEW"))
    e = e.withColumn("explanation_status", F.when(F.size("spans") > 0, "grounded").otherwise("insufficient_grounding")).withColumn("why", F.lit("")).withColumn("comprehensiveness_drop", F.lit(None).cast("double"))
    g = explain.apply_quality_gate(explain.quality(explain.audit_context(e)))
    return g.select("record_id", "quality_gate", "decision", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings"))


@query("SELECT doc_id, sha256(substr(text, 1, 3) || repeat(' ', least(greatest(length(text) - 3, 0), 5)) || substr(text, 9)) AS masked_sha FROM documents WHERE text IS NOT NULL AND length(text) >= 8")
def masked_spans(spark, d):
    docs = read(spark, d, "documents").filter("length(text) >= 8")
    spans = F.array(F.struct(F.lit(3).alias("start"), F.lit(8).alias("end")))
    return docs.select("doc_id", F.sha2(text.without_spans("text", spans), 256).alias("masked_sha"))


#: Evidence of a part's codes in SQL: its text is one sentence, which supports a code if it holds a word or phrase of the code's term or synonyms.
SUPPORT = """low AS (SELECT code, list_distinct(list_transform(list_filter(regexp_extract_all(term || ' ' || replace(synonyms, '|', ' '), '[A-Za-z0-9]+'), lambda x: length(x) >= 2), lambda x: lower(x))) AS target, list_transform(list_prepend(term, string_split(synonyms, '|')), lambda x: lower(x)) AS phrases FROM terms),
held AS (SELECT r.record_id, r.text, top.rank, top.code, top.score, len(list_filter(regexp_extract_all(lower(r.text), '[a-z0-9]+'), lambda x: length(x) >= 2 AND list_contains(target, x))) > 0 OR len(list_filter(phrases, lambda x: contains(lower(r.text), x))) > 0 AS held
  FROM recs r JOIN top ON top.query = r.text JOIN low USING (code) WHERE r.split = 'test')"""


@query(f"""WITH {PARTS}, {top_sql(3, 0.25)}, {SUPPORT} SELECT record_id, rank::INT AS rank, code, round(score, 6) AS score, CASE WHEN held THEN text ELSE '' END AS quotes, CASE WHEN held THEN 'Supported by: ' || text ELSE 'No words of the text support this candidate.' END AS rationale FROM held""")
def candidate_rationales(spark, d):
    c, test = coder(spark, d, k=3)
    top = retrieval.kept(c.predict(test).join(test.select("record_id", "text", "mention"), "record_id"))
    terms = frames.part_terms(spark, d).withColumn("definition", F.lit(""))
    return rounded(explain.candidate_rationales(top, terms, top_k=3).select("record_id", "rank", "code", "score", F.array_join("evidence_quotes", "; ").alias("quotes"), "rationale"))


@query(f"""WITH {PARTS}, {top_sql(1, 0.25)}, {SUPPORT} SELECT record_id, code AS predicted_code, CASE WHEN held THEN 'grounded' ELSE 'insufficient_grounding' END AS explanation_status, round(score, 6) AS original_score, CASE WHEN held THEN round(score, 6) ELSE 0 END AS evidence_only_score,
CASE WHEN held THEN 0 ELSE round(score, 6) END AS evidence_removed_score, CASE WHEN held THEN 0 ELSE round(score, 6) END AS sufficiency_gap, CASE WHEN held THEN round(score, 6) ELSE 0 END AS comprehensiveness_drop FROM held""")
def faithfulness(spark, d):
    """How much of the predicted code's score the evidence carries."""
    c, test = coder(spark, d, k=1)
    p = retrieval.kept(c.predict(test).filter("rank = 1").join(test.select("record_id", "text", "mention"), "record_id"))
    terms = records.with_blank(frames.part_terms(spark, d), "definition", "hierarchy", "system", "knowledge_source")
    e = explain.explanations(p.select("record_id", "text", "mention", F.col("code").alias("predicted_code"), F.col("score").alias("confidence"), F.lit("AUTO_CANDIDATE").alias("decision")), terms)
    return rounded(explain.faithfulness(e, c).select("record_id", "predicted_code", "explanation_status", "original_score", "evidence_only_score", "evidence_removed_score", "sufficiency_gap", "comprehensiveness_drop"))


# ---- reliability: intervals, calibration


def _weights_sql(key: str, replicates: int) -> str:
    """(k, b, w): Poisson weights of every distinct key and replicate, by the same mixed hash; replicate 0 counts every document once."""
    m = "18446744073709551616::UHUGEINT"
    bounds = ", ".join(map(repr, reliability.poisson_bounds()))
    return f"""x0 AS (SELECT k, b, (k::UHUGEINT + b::UHUGEINT * {reliability.GOLDEN}::UHUGEINT) % {m} AS x FROM (SELECT DISTINCT {key} AS k FROM docs), range(1, {replicates + 1}) t(b)),
x1 AS (SELECT k, b, (xor(x, x >> 30) * {reliability.MIX1}::UHUGEINT) % {m} AS x FROM x0), x2 AS (SELECT k, b, (xor(x, x >> 27) * {reliability.MIX2}::UHUGEINT) % {m} AS x FROM x1),
x3 AS (SELECT k, b, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS u FROM x2),
weights AS (SELECT k, b, len(list_filter([{bounds}], lambda c: c <= u))::DOUBLE AS w FROM x3 UNION ALL SELECT DISTINCT {key}, 0, 1.0 FROM docs)"""


@query(f"""WITH {PREDICTIONS}, rows AS (SELECT ('0x' || substr(sha256('42:' || subject_id), 1, 15))::BIGINT AS k, status, correct, CASE WHEN confidence >= 0.6 THEN correct END AS auto, (confidence >= 0.6)::INT AS is_auto FROM pred),
docs AS (SELECT k, status, 'accuracy' AS metric, sum(correct)::DOUBLE AS num, count(*)::DOUBLE AS den FROM rows GROUP BY ALL UNION ALL SELECT k, status, 'automatic_accuracy', sum(coalesce(auto, 0))::DOUBLE, sum(is_auto)::DOUBLE FROM rows GROUP BY ALL),
{_weights_sql('k', 200)}, sums AS (SELECT status, metric, b, sum(num * w) AS num, sum(den * w) AS den FROM docs JOIN weights USING (k) GROUP BY ALL), v AS (SELECT *, CASE WHEN den <> 0 THEN num / den END AS value FROM sums)
SELECT status AS "group", metric, round(max(value) FILTER (b = 0), 6) AS estimate, round(quantile_cont(value, 0.025) FILTER (b > 0), 6) AS low, round(quantile_cont(value, 0.975) FILTER (b > 0), 6) AS high, round(stddev_samp(value) FILTER (b > 0), 6) AS spread, count(value) FILTER (b > 0) AS n_replicates FROM v GROUP BY ALL""")
def bootstrap_intervals(spark, d):
    """Accuracy of all and of automatic decisions, by status, with intervals over customers: all orders of a customer are drawn together."""
    auto = F.col("confidence") >= 0.6
    ratios = {"accuracy": (F.col("correct"), F.lit(1)), "automatic_accuracy": (F.when(auto, F.col("correct")), auto.cast("int"))}
    return rounded(reliability.bootstrap_intervals(frames.predictions(spark, d), ratios, "subject_id", "status", 200))


def _bins_sql(bins: int) -> str:
    return f"""per AS (SELECT confidence AS c, count(*) AS n, sum(correct) AS ok FROM pred GROUP BY 1),
placed AS (SELECT *, floor((sum(n) OVER (ORDER BY c) - n) * {bins} / sum(n) OVER ()::DOUBLE)::INT AS bin FROM per),
bins AS (SELECT bin, sum(n)::BIGINT AS n, sum(ok)::BIGINT AS ok, sum(n * c) / sum(n) AS mc, min(c) AS least, max(c) AS greatest FROM placed GROUP BY bin)"""


@query(f"""WITH {PREDICTIONS}, {_bins_sql(15)}, e AS (SELECT sum(n * abs(ok / n::DOUBLE - mc)) / sum(n) AS ece, max(abs(ok / n::DOUBLE - mc)) AS mce, count(*) AS k FROM bins)
SELECT count(*) AS n, round(avg((confidence - correct) ** 2), 6) AS brier, round(avg(confidence), 6) AS mean_confidence, round(avg(correct), 6) AS accuracy, round(max(ece), 6) AS expected_calibration_error, round(max(mce), 6) AS largest_calibration_error, max(k) AS n_bins FROM pred, e""")
def calibration(spark, d):
    return rounded(reliability.calibration(frames.predictions(spark, d)))


@query(f"WITH {PREDICTIONS}, {_bins_sql(10)} SELECT bin, n, ok, round(ok / n::DOUBLE, 6) AS accuracy, round(mc, 6) AS mean_confidence, round(least, 6) AS least, round(greatest, 6) AS greatest FROM bins")
def reliability_bins(spark, d):
    return rounded(reliability.equal_mass_bins(frames.predictions(spark, d), 10))


@query(f"""WITH {PREDICTIONS}, {_bins_sql(40)}, s AS (SELECT *, row_number() OVER (ORDER BY bin) AS i, sum(n) OVER (ORDER BY bin) AS cn, sum(ok) OVER (ORDER BY bin) AS ck FROM bins),
spans AS (SELECT x.i AS a, y.i AS z, (y.ck - x.ck + x.ok) / (y.cn - x.cn + x.n)::DOUBLE AS v FROM s x JOIN s y ON x.i <= y.i),
lows AS (SELECT s.i, a, min(v) AS v FROM s JOIN spans ON a <= s.i AND z >= s.i GROUP BY ALL), fitted AS (SELECT i, round(max(v), 12) AS v FROM lows GROUP BY i)
SELECT (dense_rank() OVER (ORDER BY v) - 1)::INT AS step, round(min(least), 6) AS least, round(max(greatest), 6) AS greatest, sum(n)::BIGINT AS n, sum(ok)::BIGINT AS ok, round(v, 6) AS calibrated FROM fitted JOIN s USING (i) GROUP BY v""")
def isotonic_steps(spark, d):
    """The confidence's share of right predictions as a step function that never falls; in SQL by its formula of greatest least means."""
    return rounded(reliability.isotonic(frames.predictions(spark, d), 40))


# ---- agreement: coders, hierarchies, wordings


RATINGS = "ratings AS (SELECT l_orderkey AS item, l_linenumber AS rater, min(l_returnflag || l_linestatus) AS code FROM lineitem GROUP BY ALL)"


def ratings(spark, d):
    """The lines of an order as coders that give it their flags; orders of fewer lines miss some ratings."""
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("rater"), F.concat("l_returnflag", "l_linestatus").alias("code"))


@query(f"""WITH {RATINGS}, t AS (SELECT x.code AS a, y.code AS b FROM ratings x JOIN ratings y ON x.item = y.item AND x.rater = 1 AND y.rater = 2), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS po FROM t),
m AS (SELECT sum(na * nb) / ((SELECT n FROM n) ** 2)::DOUBLE AS pe FROM (SELECT a AS code, count(*) AS na FROM t GROUP BY 1) JOIN (SELECT b AS code, count(*) AS nb FROM t GROUP BY 1) USING (code))
SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa FROM n, m""")
def coder_kappa(spark, d):
    return rounded(agreement.kappa(ratings(spark, d), 1, 2))


@query(f"""WITH {RATINGS}, u AS (SELECT item, code, count(*) AS c FROM ratings GROUP BY ALL), v AS (SELECT *, sum(c) OVER (PARTITION BY item) AS m FROM u QUALIFY m >= 2), o AS (SELECT sum(c * (c - 1) / (m - 1)::DOUBLE) AS agree, sum(c) AS n, count(DISTINCT item) AS k FROM v),
e AS (SELECT sum(t * (t - 1)) AS pairs FROM (SELECT code, sum(c) AS t FROM v GROUP BY code)), r AS (SELECT k, n, 1 - agree / n AS dis, 1 - pairs / (n * (n - 1))::DOUBLE AS ex FROM o, e)
SELECT k AS n_items, n::BIGINT AS n_ratings, round(dis, 6) AS observed, round(ex, 6) AS expected, round(1 - dis / ex, 6) AS alpha FROM r""")
def coder_alpha(spark, d):
    return rounded(agreement.alpha(ratings(spark, d)))


@query(f"""WITH {RATINGS}, u AS (SELECT item, code, count(*) AS n FROM ratings GROUP BY ALL), g AS (SELECT item, sum(n)::BIGINT AS n_ratings, count(*) AS n_codes, list(code || ':' || n ORDER BY n DESC, code) AS c, first(code ORDER BY n DESC, code) AS top, max(n) AS best FROM u GROUP BY item HAVING count(*) > 1)
SELECT item, n_ratings, n_codes, CASE WHEN best > 0.5 * n_ratings THEN top END AS majority, round(best / n_ratings::DOUBLE, 6) AS share, array_to_string(c, ',') AS codes FROM g""")
def adjudication(spark, d):
    rows = agreement.adjudication(ratings(spark, d))
    return rounded(rows.withColumn("codes", F.array_join(F.transform("codes", lambda x: F.concat_ws(":", x["code"], x["n"].cast("string"))), ",")))


@query("SELECT o_orderkey AS item, ['r0', 'r1', 'r2', 'r3', 'r4'][((('0x' || substr(sha256('42:' || o_orderkey), 1, 8))::BIGINT + k) % 5)::INT + 1] AS rater FROM orders, range(2) t(k)")
def coding_plan(spark, d):
    """Two of five coders for every order."""
    return agreement.coding_plan(read(spark, d, "orders").select(F.col("o_orderkey").alias("item")), [f"r{i}" for i in range(5)])


NATIONS = """nat AS (SELECT 'N' || n_nationkey AS code, 'R' || n_regionkey AS region FROM nation), lines AS (SELECT l_orderkey, arg_max('N' || s_nationkey, (l_extendedprice, l_linenumber, l_partkey, l_suppkey)) AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
pairs AS (SELECT 'N' || c_nationkey AS g, p FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lines ON l_orderkey = o_orderkey), j AS (SELECT g, p, a.region AS rg, b.region AS rp FROM pairs LEFT JOIN nat a ON a.code = g LEFT JOIN nat b ON b.code = p)"""


def nation_pairs(spark, d):
    """Orders: the customer's nation is gold, that of the supplier of the dearest line the prediction. And the hierarchy of nations, regions and the world."""
    li = read(spark, d, "lineitem").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    best = F.max_by(F.concat(F.lit("N"), "s_nationkey"), F.struct("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")).alias("predicted_code")
    own = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("N"), "c_nationkey").alias("gold_code")), "o_custkey")
    pred = own.join(li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(best), "o_orderkey", "left")
    n = read(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return pred, n.unionByName(n.select(F.col("parent").alias("code"), F.lit("WORLD").alias("parent")).distinct())


@query(f"""WITH {NATIONS}, l AS (SELECT unnest([-1, 0, 1, 2]) AS level, g, p, rg, rp FROM j)
SELECT level::INT AS level, count(*) AS n, count(*) FILTER (CASE level WHEN 0 THEN p IS NOT NULL WHEN 1 THEN rg = rp ELSE g = p END) AS n_agree, round(avg(coalesce(CASE level WHEN 0 THEN p IS NOT NULL WHEN 1 THEN rg = rp ELSE g = p END, false)::INT), 6) AS rate FROM l GROUP BY level""")
def agreement_by_level(spark, d):
    return rounded(agreement.agreement_by_level(*nation_pairs(spark, d)))


@query(f"WITH {NATIONS} SELECT count(*) AS n, round(avg(CASE WHEN p IS NULL THEN 0 WHEN g = p THEN 1.0 WHEN rg = rp THEN 2.0 / 3 ELSE 1.0 / 3 END), 6) AS similarity FROM j")
def hierarchy_similarity(spark, d):
    return rounded(agreement.hierarchy_similarity(*nation_pairs(spark, d)))


SURFACES = "sc AS (SELECT lower(trim(text, ' ')) AS surface, source AS code, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND trim(text, ' ') <> '' GROUP BY ALL)"


def labelled(spark, d):
    return read(spark, d, "documents").select(F.col("text").alias("surface"), F.col("source").alias("code"))


@query(f"WITH {SURFACES} SELECT sha256(surface) AS surface_sha, sum(n)::BIGINT AS n, count(*) AS n_codes, first(code ORDER BY n DESC, code) AS majority, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM sc GROUP BY surface HAVING count(*) > 1")
def label_conflicts(spark, d):
    """Texts that several sources carry."""
    rows = agreement.conflicts(labelled(spark, d))
    return rounded(rows.select(F.sha2("surface", 256).alias("surface_sha"), "n", "n_codes", "majority", "share"))


@query(f"WITH {SURFACES} SELECT code, sum(n)::BIGINT AS n, count(*) AS n_surfaces, sha256(first(surface ORDER BY n DESC, surface)) AS surface_sha, round(max(n) / sum(n)::DOUBLE, 6) AS share FROM sc GROUP BY code")
def code_wordings(spark, d):
    """In how many texts each source comes."""
    rows = agreement.wordings(labelled(spark, d))
    return rounded(rows.select("code", "n", "n_surfaces", F.sha2("most_frequent", 256).alias("surface_sha"), "share"))


@query(f"""WITH RECURSIVE {SURFACES}, e AS (SELECT DISTINCT a.code AS x, b.code AS y FROM sc a JOIN sc b USING (surface)), reach(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
g AS (SELECT x AS code, min(y) AS grp FROM reach GROUP BY x), s AS (SELECT surface, min(code) AS code, count(*) AS k FROM sc GROUP BY surface)
SELECT grp AS "group", (SELECT count(*) FROM g h WHERE h.grp = g.grp) AS n_codes, count(*) AS n_surfaces, count(*) FILTER (k > 1) AS n_conflicts FROM s JOIN g USING (code) GROUP BY grp HAVING (SELECT count(*) FROM g h WHERE h.grp = g.grp) > 1""")
def conflict_groups(spark, d):
    return agreement.conflict_groups(labelled(spark, d))


# ---- intervals


@query(f"WITH {SPANS} SELECT record_id, code, count(*)::BIGINT AS covered FROM px GROUP BY ALL")
def interval_union(spark, d):
    p, _ = frames.spans(spark, d)
    return intervals.merged(p, "record_id", "code").groupBy("record_id", "code").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))


@query(f"WITH {SPANS} SELECT record_id, code, count(*)::BIGINT AS overlap FROM px JOIN rx USING (record_id, code, x) GROUP BY ALL")
def interval_overlap(spark, d):
    p, r = frames.spans(spark, d)
    return intervals.overlap(intervals.merged(p, "record_id", "code"), intervals.merged(r, "record_id", "code"), "record_id", "code")


@query(f"""WITH {SPANS}, k AS (SELECT DISTINCT record_id, code FROM sp WHERE f <> 'R'), r AS (SELECT record_id, code, count(*) AS r FROM rx GROUP BY ALL), p AS (SELECT record_id, code, count(*) AS p FROM px GROUP BY ALL), o AS (SELECT record_id, code, count(*) AS o FROM px JOIN rx USING (record_id, code, x) GROUP BY ALL), y AS (SELECT DISTINCT record_id, code, true AS y FROM sp WHERE f = 'R')
SELECT record_id, code, round(CASE WHEN coalesce(p, 0) > 0 THEN coalesce(o, 0) / p::DOUBLE ELSE 0 END, 6) AS char_precision, round(CASE WHEN coalesce(r, 0) > 0 THEN coalesce(o, 0) / r::DOUBLE ELSE 0 END, 6) AS char_recall, round(CASE WHEN coalesce(r, 0) + coalesce(p, 0) > 0 THEN 2.0 * coalesce(o, 0) / (coalesce(r, 0) + coalesce(p, 0)) ELSE 0 END, 6) AS char_f1, coalesce(o, 0) > 0 AS any_overlap, coalesce(y, false) AS prediction_present
FROM k LEFT JOIN r USING (record_id, code) LEFT JOIN p USING (record_id, code) LEFT JOIN o USING (record_id, code) LEFT JOIN y USING (record_id, code)""")
def rationale_agreement(spark, d):
    p, r = frames.spans(spark, d)
    return rounded(intervals.rationale_agreement(p, r))


@query("""WITH a AS (SELECT l_orderkey % 1200 AS doc_id, l_partkey % 300 AS s, l_partkey % 300 + l_quantity::INT - 3 AS e, l_linenumber AS n FROM lineitem), r AS (SELECT a.*, text FROM a LEFT JOIN documents USING (doc_id)),
q AS (SELECT *, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN substr(text, s + 1, e - s) ELSE 'other words' END AS quote FROM r),
p AS (SELECT CASE WHEN text IS NULL THEN 'missing_record' WHEN s < 0 OR e <= s OR e > length(text) THEN 'invalid_offsets' WHEN quote <> '' AND quote <> substr(text, s + 1, e - s) THEN 'quote_mismatch' END AS p FROM q)
SELECT count(*) AS n, count(*) FILTER (p = 'missing_record') AS missing_record, count(*) FILTER (p = 'invalid_offsets') AS invalid_offsets, count(*) FILTER (p = 'quote_mismatch') AS quote_mismatch FROM p""")
def offset_validation(spark, d):
    """Line items as annotations of documents: a third without a quote, a third with the right one, a third with another."""
    li = read(spark, d, "lineitem")
    s, size, n = F.col("l_partkey") % 300, F.col("l_quantity").cast("int") - 3, F.col("l_linenumber") % 3
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("record_id"), "text", F.col("doc_id").alias("row_seq"))
    a = li.select((F.col("l_orderkey") % 1200).alias("record_id"), s.alias("start"), (s + size).alias("end"), n.alias("n"))
    a = a.join(docs.select("record_id", "text"), "record_id", "left")
    right = F.substring(F.col("text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return intervals.validate_offsets(a.select("record_id", "start", "end", F.when(F.col("n") == 0, "").when(F.col("n") == 1, right).otherwise("other words").alias("quote")), docs)


@query("SELECT question, count(v) AS n_rated, round(avg(v), 6) AS positive_rate FROM (SELECT 'quality' AS question, CASE quality WHEN 1 THEN 1 WHEN 0 THEN 0 END AS v FROM labels UNION ALL SELECT 'toxic', CASE toxic WHEN 1 THEN 1 WHEN 0 THEN 0 END FROM labels) GROUP BY question")
def binary_ratings(spark, d):
    return rounded(intervals.binary_ratings(read(spark, d, "labels"), "quality", "toxic"))


# ---- audits


@query(f"""WITH n AS (SELECT doc_id, doc_id % 40 AS subject_id, coalesce(text, '') AS text, list_distinct(list_filter([lang, source], lambda x: x IS NOT NULL)) AS codes, {frames.split_sql('doc_id')} AS split FROM documents), s AS (SELECT subject_id, list(DISTINCT split) AS s FROM n GROUP BY 1),
c AS (SELECT DISTINCT unnest(codes) AS code FROM n), m AS (SELECT code FROM c WHERE code NOT IN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))
SELECT count(*) AS n_notes, count(DISTINCT subject_id) AS n_subjects, count(*) FILTER (trim(text, ' ') = '') AS n_empty_text, count(*) FILTER (len(codes) = 0) AS n_empty_labels, {', '.join(f"count(*) FILTER (split = '{x}') AS n_{x}" for x in ('train', 'val', 'test'))},
{', '.join(f"(SELECT count(*) FILTER (list_contains(s, '{a}') AND list_contains(s, '{b}')) FROM s) AS {a}_{b}_overlap" for a, b in (('train', 'val'), ('train', 'test'), ('val', 'test')))},
{', '.join(f"round(quantile_cont(length(text), {q})::DOUBLE, 6) AS length_{int(q * 100)}" for q in audits.QUANTILES)}, quantile_cont(len(codes), 0.5)::DOUBLE AS codes_median,
(SELECT count(*) FROM m) AS n_missing_codes, (SELECT string_agg(code, ',' ORDER BY code) FROM m) AS missing, 'subject_id_leakage_across_splits,' || CASE WHEN count(*) FILTER (trim(text, ' ') = '') > 0 THEN 'empty_clinical_text,' ELSE '' END || CASE WHEN count(*) FILTER (len(codes) = 0) > 0 THEN 'records_without_icd10_labels,' ELSE '' END || 'terminology_coverage_below_threshold' AS failures,
CASE WHEN (SELECT count(*) FROM c) < 10 THEN 'very_small_code_vocabulary' ELSE '' END AS warnings FROM n""")
def audit_notes(spark, d):
    """Documents as notes of forty subjects, coded with their language and source; the dictionary has the languages alone."""
    docs = read(spark, d, "documents")
    notes = docs.select(F.col("doc_id").alias("record_id"), (F.col("doc_id") % 40).alias("subject_id"), "text", F.array_distinct(F.array_compact(F.array("lang", "source"))).alias("gold_codes"), hashing.split_by_hash(F.col("doc_id"), frames.SEED).alias("split"))
    a = audits.audit_notes(notes, docs.select(F.col("lang").alias("code")).filter("code is not null").distinct())
    lengths = [F.get("length_quantiles", F.lit(i)).alias(f"length_{int(q * 100)}") for i, q in enumerate(audits.QUANTILES)]
    kept = ("n_notes", "n_subjects", "n_empty_text", "n_empty_labels", "n_train", "n_val", "n_test", "train_val_overlap", "train_test_overlap", "val_test_overlap", "n_missing_codes")
    return rounded(a.select(*kept, *lengths, F.get("codes_quantiles", F.lit(2)).alias("codes_median"), F.array_join("missing_terminology_codes", ",").alias("missing"), F.array_join("hard_failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings")))


@query(f"""WITH {PREDICTIONS}, r AS (SELECT record_id, 'T' || (record_id % 7) AS annotation_id, CASE WHEN record_id % 97 = 0 THEN '' ELSE gold_code END AS gold_code, record_id % 50 <> 0 AS om, record_id % 9 = 0 AS dis FROM pred UNION ALL SELECT record_id, 'T' || (record_id % 7), CASE WHEN record_id % 2 = 0 AND record_id % 97 <> 0 THEN gold_code WHEN record_id % 2 = 0 THEN '' ELSE 'C00' END, true, false FROM pred WHERE record_id % 11 = 0),
g AS (SELECT DISTINCT gold_code FROM r), m AS (SELECT gold_code FROM g WHERE gold_code NOT IN (SELECT code FROM seen)),
a AS (SELECT count(*) AS n_rows, count(DISTINCT record_id) AS n_documents, count(DISTINCT gold_code) AS n_codes, avg(om::INT) AS o, count(*) FILTER (dis) AS dis, count(*) - count(DISTINCT (record_id, annotation_id, gold_code)) AS dup, count(*) FILTER (gold_code = '') AS blank FROM r),
s AS (SELECT count(*) FILTER (c > 1) AS multi FROM (SELECT count(DISTINCT gold_code) AS c FROM r GROUP BY record_id, annotation_id)), k AS (SELECT count(*) AS missing, string_agg(gold_code, ',' ORDER BY gold_code) AS codes FROM m)
SELECT n_rows, n_documents, n_codes, round(o, 6) AS offset_match_rate, dis AS n_discontinuous, dup AS n_duplicates, multi AS n_multi_code, missing AS n_missing_codes, codes AS missing_codes, round(1.0 - missing / n_codes::DOUBLE, 6) AS terminology_coverage,
array_to_string(list_filter([CASE WHEN blank > 0 THEN 'blank_gold_code' END, CASE WHEN o < 0.99 THEN 'offset_match_rate_below_threshold' END, CASE WHEN 1.0 - missing / n_codes::DOUBLE < 0.95 THEN 'terminology_coverage_below_threshold' END], lambda x: x IS NOT NULL), ',') AS failures,
array_to_string(list_filter([CASE WHEN dup > 0 THEN 'duplicate_rows_present' END, CASE WHEN multi > 0 THEN 'same_annotation_has_multiple_codes' END], lambda x: x IS NOT NULL), ',') AS warnings FROM a, s, k""")
def audit_annotations(spark, d):
    """Predictions as annotations: some codes blank, some rows twice, some annotations with a second code."""
    p = frames.predictions(spark, d)
    k = F.col("record_id")
    gold = F.when(k % 97 == 0, "").otherwise(F.col("gold_code"))
    rows = p.select("record_id", F.concat(F.lit("T"), (k % 7).cast("string")).alias("annotation_id"), gold.alias("gold_code"), (k % 50 != 0).cast("string").alias("offset_match"), F.when(k % 9 == 0, "Yes").otherwise("No").alias("is_discontinuous"))
    more = rows.filter(k % 11 == 0).withColumn("gold_code", F.when(k % 2 == 0, F.col("gold_code")).otherwise("C00")).withColumn("offset_match", F.lit("TRUE ")).withColumn("is_discontinuous", F.lit("0"))
    rows = rows.unionByName(more).withColumn("text", F.lit("")).withColumn("mention", F.lit(""))
    a = audits.audit_annotations(rows, frames.seen_codes(spark, d))
    kept = ("n_rows", "n_documents", "n_codes", "offset_match_rate", "n_discontinuous", "n_duplicates", "n_multi_code", "n_missing_codes", "terminology_coverage")
    return rounded(a.select(*kept, F.array_join("missing_terminology_codes", ",").alias("missing_codes"), F.array_join("hard_failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings")))


@query(f"""WITH {PREDICTIONS}, {DIAG}, p AS (SELECT record_id, confidence, correct, code_novelty, CASE WHEN confidence >= 0.9 THEN 'AUTO_CANDIDATE' ELSE 'HUMAN_REVIEW' END AS decision, CASE WHEN record_id % 11 = 0 THEN 'insufficient_grounding' ELSE 'grounded' END AS st FROM diag), q AS (SELECT quantile_cont(confidence, 0.75) AS q FROM p),
r AS (SELECT *, CASE WHEN decision = 'AUTO_CANDIDATE' AND correct = 0 THEN 1 WHEN correct = 0 AND confidence >= q THEN 2 WHEN correct = 0 AND code_novelty = 'unseen_code' THEN 3 WHEN st = 'insufficient_grounding' THEN 4 WHEN correct = 0 THEN 5 ELSE 6 END AS o FROM p, q),
n AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY CASE WHEN o < 6 THEN -confidence END, CASE WHEN o = 6 THEN sha256('42:' || record_id) END, record_id) AS place FROM r), k AS (SELECT *, row_number() OVER (ORDER BY o, place) AS i FROM n WHERE place <= 8 OR (o = 6 AND place <= 40))
SELECT 'CASE-' || lpad(i::VARCHAR, 3, '0') AS casebook_id, record_id, ['auto_candidate_error', 'high_confidence_error', 'unseen_code_error', 'insufficient_evidence', 'other_error', 'correct_control'][o] AS review_reason FROM k WHERE i <= 40""")
def review_casebook(spark, d):
    p = diagnosed(spark, d).withColumn("decision", F.when(F.col("confidence") >= 0.9, "AUTO_CANDIDATE").otherwise("HUMAN_REVIEW")).withColumn("explanation_status", F.when(F.col("record_id") % 11 == 0, "insufficient_grounding").otherwise("grounded"))
    return audits.casebook(p, 40).select("casebook_id", "record_id", "review_reason")


# ---- review, feedback


STATE = """st AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts DESC, event_id DESC) AS r FROM log)"""


@query(f"WITH {REVIEW}, {STATE} SELECT record_id, max(CASE WHEN kind = 'ENQUEUE' THEN 'PENDING' WHEN action = 'ESCALATE' THEN 'ESCALATED' ELSE 'RESOLVED' END) FILTER (r = 1) AS status, max(action) FILTER (r = 1) AS action, max(selected_code) FILTER (r = 1) AS selected_code, count(*) FILTER (kind = 'DECIDE') AS n_decisions FROM st GROUP BY record_id")
def queue_state(spark, d):
    return review.queue_state(frames.review_events(spark, d)).select("record_id", "status", "action", "selected_code", "n_decisions")


@query(f"WITH {REVIEW}, {STATE} SELECT 'status' AS what, CASE WHEN kind = 'ENQUEUE' THEN 'PENDING' WHEN action = 'ESCALATE' THEN 'ESCALATED' ELSE 'RESOLVED' END AS name, count(*) AS n FROM st WHERE r = 1 GROUP BY ALL UNION ALL SELECT 'action', action, count(*) FROM log WHERE kind = 'DECIDE' GROUP BY action")
def queue_summary(spark, d):
    e = frames.review_events(spark, d)
    return review.summary(review.queue_state(e), e)


@query(f"""WITH {FEEDBACK} SELECT event_id, array_to_string(list_filter([CASE WHEN action IN ('ACCEPT_TOP1', 'SELECT_ALTERNATIVE') AND NOT list_contains(cands, code) THEN 'selected_code_not_in_original_topk' END, CASE WHEN action = 'RECODE_OUTSIDE_TOPK' AND list_contains(cands, code) THEN 'outside_topk_action_inconsistent' END], lambda x: x IS NOT NULL), ',') AS errors FROM fb""")
def feedback_validation(spark, d):
    return frames.feedback(spark, d).select("event_id", F.array_join(review.feedback_errors(), ",").alias("errors"))


@query(f"WITH {FEEDBACK} SELECT count(*) AS n_feedback, {', '.join(f'''count(*) FILTER (action = '{a}') AS n_{a.lower()}''' for a in review.ACTIONS)}, round(avg((action = 'ACCEPT_TOP1')::INT), 6) AS top1_accept_rate, round(avg((action = 'SELECT_ALTERNATIVE')::INT), 6) AS topk_rescue_rate, round(avg((action = 'RECODE_OUTSIDE_TOPK')::INT), 6) AS outside_topk_rate FROM fb")
def feedback_summary(spark, d):
    return rounded(review.feedback_summary(frames.feedback(spark, d)))


@query(f"WITH {FEEDBACK} SELECT event_id, record_id, d.source AS mention, code AS gold_code, action AS feedback_human_action FROM fb JOIN documents d ON d.doc_id::VARCHAR = record_id WHERE action NOT IN ('ESCALATE', 'NO_CODE') AND code <> ''")
def feedback_memory(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text", F.col("source").alias("mention"), F.col("doc_id").alias("row_seq"))
    f = frames.feedback(spark, d)
    m = review.training_memory(f.withColumn("model_release", F.col("event_id").cast("string")), docs)
    return m.select(F.col("feedback_source_release").cast("long").alias("event_id"), "record_id", "mention", "gold_code", "feedback_human_action")


@query(f"""WITH {PREDICTIONS}, {REVIEW}, l AS (SELECT record_id, action, coalesce(selected_code, '') AS code, row_number() OVER (PARTITION BY record_id ORDER BY ts DESC, event_id DESC) AS r FROM log WHERE kind = 'DECIDE' QUALIFY r = 1),
p AS (SELECT record_id::VARCHAR AS record_id, predicted_code, CASE WHEN confidence >= 0.85 THEN 'AUTO_CANDIDATE' ELSE 'TOP_K_HUMAN_CHOICE' END AS route FROM pred), j AS (SELECT p.*, coalesce(action, '') AS action, coalesce(code, '') AS code FROM p LEFT JOIN l USING (record_id))
SELECT record_id, predicted_code, route AS route_before_review, action AS human_action, code AS human_selected_code, '1.0' AS artifact_schema_version,
CASE WHEN action IN ('ACCEPT_TOP1', 'SELECT_ALTERNATIVE', 'RECODE_OUTSIDE_TOPK') AND code <> '' THEN code WHEN action = 'NO_CODE' THEN '' ELSE predicted_code END AS final_code,
CASE WHEN action IN ('ACCEPT_TOP1', 'SELECT_ALTERNATIVE', 'RECODE_OUTSIDE_TOPK') AND code <> '' THEN 'HUMAN_ADJUDICATED' WHEN action = 'NO_CODE' THEN 'HUMAN_ADJUDICATED_NO_CODE' WHEN action = 'ESCALATE' THEN 'ESCALATED' ELSE route END AS final_status FROM j""")
def decision_trace(spark, d):
    p = frames.predictions(spark, d).select(F.col("record_id").cast("string").alias("record_id"), "predicted_code", F.when(F.col("confidence") >= 0.85, "AUTO_CANDIDATE").otherwise("TOP_K_HUMAN_CHOICE").alias("route_before_review"))
    return review.decision_trace(p, frames.review_events(spark, d))


@query("SELECT c_custkey, CASE WHEN trim(c_name) = '' THEN '' ELSE substr(sha256(trim(c_name)), 1, 16) END AS reviewer_hash FROM customer")
def reviewer_hash(spark, d):
    return read(spark, d, "customer").select("c_custkey", review.reviewer_hash("c_name").alias("reviewer_hash"))


# ---- model boundary


@query(f"""WITH {PREDICTIONS}, r AS (SELECT record_id, codes, CASE record_id % 4 WHEN 0 THEN list_reverse(codes) WHEN 1 THEN list_append(codes, codes[1]) WHEN 2 THEN codes[2:] ELSE codes END AS ranked FROM pred)
SELECT record_id, array_to_string(list_filter([CASE WHEN len(list_distinct(ranked)) <> len(ranked) THEN 'duplicate_ranked_codes' END, CASE WHEN list_sort(list_distinct(ranked)) <> list_sort(list_distinct(codes)) THEN 'candidate_set_changed' END], lambda x: x IS NOT NULL), ',') AS errors,
CASE WHEN len(list_distinct(ranked)) = len(ranked) AND list_sort(ranked) = list_sort(codes) THEN ranked[1] ELSE codes[1] END AS first_code FROM r""")
def rerank_validation(spark, d):
    p = frames.predictions(spark, d)
    m = F.col("record_id") % 4
    ranked = F.when(m == 0, F.reverse("codes")).when(m == 1, F.concat("codes", F.slice("codes", 1, 1))).when(m == 2, F.slice("codes", F.lit(2), F.size("codes"))).otherwise(F.col("codes"))
    p = p.withColumn("ranked", ranked).withColumn("errors", models.ranking_errors(F.col("ranked"), F.col("codes")))
    objects = F.transform("codes", lambda c: F.struct(c.alias("code")))
    first = F.get(models.reordered(objects, "ranked", F.size("errors") == 0), F.lit(0))["code"]
    return p.select("record_id", F.array_join("errors", ",").alias("errors"), first.alias("first_code"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::INT AS k, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END::INT AS n_codes FROM events")
def tolerant_json(spark, d):
    """Code lists out of JSON: objects, bare strings, and text that is no JSON."""
    e = read(spark, d, "events")
    m = F.col("event_id") % 3
    body = F.when(m == 0, '[{"code":"A"},{"code":"B"}]').when(m == 1, '["A"]').otherwise("[{")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.size(evaluation.candidate_codes(body)).alias("n_codes"))
