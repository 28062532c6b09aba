"""Evaluation over time: parts by period, and retrieval in which a record only sees the history before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators import retrieval
from termweave.sources.records import group_leaks, require_columns, row_keys


def period(at: Column | str, val_from, test_from) -> Column:
    """train before `val_from`, val from there on, test from `test_from` on; null without a time."""
    t = F.col(at) if isinstance(at, str) else at
    if not val_from < test_from:
        raise ValueError("val has to begin before test")
    return F.when(t < F.lit(val_from), "train").when(t < F.lit(test_from), "val").when(t.isNotNull(), "test")


def period_leaks(rows: DataFrame, group: str, at: str = "at", split: str = "split") -> DataFrame:
    """(group, n_splits, first_at, last_at): the subjects whose rows lie in several periods, for an analysis with and without them."""
    ends = rows.groupBy(group).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return group_leaks(rows.filter(F.col(split).isNotNull()), group, split).join(ends, group)


def without_seen_subjects(test: DataFrame, train: DataFrame, group: str) -> DataFrame:
    """Test rows of subjects that training does not have; rows without a subject stay."""
    known = train.select(group).filter(F.col(group).isNotNull()).distinct()
    return test.join(known, group, "left_anti")


def sensitivity(test: DataFrame, train: DataFrame, group: str, correct: str = "correct") -> DataFrame:
    """(part, n, n_subjects, accuracy) of all test rows, of those of subjects that training has, and of the others; a row without a subject is one of the others."""
    known = train.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("_known", F.lit(True))
    rows = test.join(known, group, "left").withColumn("part", F.explode(F.array(F.lit("all"), F.when(F.col("_known"), "seen_subjects").otherwise("unseen_subjects"))))
    # Subjects are counted from a row for each of them, as their number grows with the data
    per = rows.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(correct).cast("long"), F.lit(0))).alias("ok"))
    return per.groupBy("part").agg(F.sum("n").alias("n"), F.count(group).alias("n_subjects"), (F.sum("ok") / F.sum("n")).alias("accuracy"))


class AsOfCoder:
    """HistoricalCoder as of each record's time: a code's history score is its best history row that is older than the record.

    Grams are weighed by the history before `before` alone, so nothing of a later day enters a score, neither as a row
    nor in a weight. A history row that repeats a text and code is as old as the first of them.
    """

    def __init__(self, history_weight: float = 0.5, top_k: int = 10) -> None:
        if not 0 <= history_weight <= 1 or top_k < 1:
            raise ValueError("history_weight must be in [0, 1] and top_k at least 1")
        self.weight, self.k = history_weight, top_k

    def fit(self, history: DataFrame, terms: DataFrame, before) -> AsOfCoder:
        """history: text, gold_code, row_seq, at, and optionally mention; terms: code, term, row_seq. Rows without a time are left out."""
        require_columns(history, {"text", "gold_code", "row_seq", "at"})
        require_columns(terms, {"code", "term", "row_seq"})
        self.before = before
        self.codes = retrieval.kept(terms.select("code", "row_seq"))
        body = "search_text" if "search_text" in terms.columns else "term"
        self.terms = retrieval.fit(terms.select(F.col("code").alias("item"), F.col(body).alias("text")), retrieval.char_3_5)
        rows = retrieval.history_text(history.filter(F.col("at").isNotNull()))
        rows = rows.groupBy("gold_code", "text").agg(F.min("row_seq").alias("seq"), F.min(F.unix_micros(F.col("at").cast("timestamp"))).alias("at"))
        self.history = retrieval.kept(rows.withColumn("item", retrieval.text_key(F.concat_ws("\u0001", "gold_code", "text"))))
        old = self.history.filter(F.col("at") < F.unix_micros(F.lit(before).cast("timestamp")))
        self.memory = retrieval.fit(old.select("item", "text"), retrieval.char_3_5, items=self.history.select("item", "text"))
        return self

    def asked(self, records: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows with their query, queries (query, text, at)): a text asked at two times is two queries. ValueError for records older than `before`."""
        rows = retrieval.identified(require_columns(records, {"record_id", "text", "mention", "at"}))
        when = F.unix_micros(F.col("at").cast("timestamp"))
        if not rows.filter(F.col("at").isNull() | (when < F.unix_micros(F.lit(self.before).cast("timestamp")))).isEmpty():
            raise ValueError("Records need a time that is not before the one that the weights rest on")
        text = F.when(F.length("mention") > 0, F.col("mention")).otherwise(F.col("text"))
        named = rows.select(*row_keys(rows), text.alias("text"), when.alias("at"))
        named = named.withColumn("query", retrieval.text_key(F.concat_ws("\u0001", F.col("at").cast("string"), "text")))
        queries = retrieval.kept(named.groupBy("query").agg(F.min("text").alias("text"), F.min("at").alias("at")))
        return named.select(*row_keys(named), "query"), retrieval.dealt(queries, "query", queries.count())

    def owners(self) -> DataFrame:
        return self.history.select("item", F.col("gold_code").alias("code"), F.col("seq").alias("place"), "at")

    def top(self, queries: DataFrame, most: int | None = None) -> DataFrame:
        """(query, code, score, terminology_score, history_score, history_item) of the best codes, for (query, text, at)."""
        own = self.codes.select(F.col("code").alias("item"), "code", F.lit(0).alias("place"))
        sides = [([("terminology_score", self.terms, 1.0)], own, 1 - self.weight), ([("history_score", self.memory, 1.0)], self.owners(), self.weight)]
        best = retrieval.best_of_parts(retrieval.top_codes(queries, sides, self.codes, self.k, most=most), sides)
        return best.select("query", "code", "score", "terminology_score", "history_score", F.col("item1").alias("history_item"))

    def predict(self, records: DataFrame) -> DataFrame:
        """(record_id, rank, code, score, terminology_score, history_score, history_item), with row_id where records have one or repeat."""
        named, queries = self.asked(records)
        return named.join(retrieval.ranked(self.top(queries), self.codes, queries, self.k), "query").drop("query")

    def cases(self, records: DataFrame, n: int = 5) -> DataFrame:
        """(record_id, rank, code, case_text, case_at, similarity): the nearest history rows older than the record, in microseconds since 1970."""
        named, queries = self.asked(records)
        own = self.history.select("item", F.col("item").alias("code"), F.lit(0).alias("place"), "at")
        names = self.history.select(F.col("item").alias("code"), F.col("seq").alias("row_seq"))
        top = retrieval.top_codes(queries, [([("similarity", self.memory, 1.0)], own, 1.0)], names, n).select("query", F.col("code").alias("item"), "similarity")
        rows = top.join(self.history.select("item", F.col("gold_code").alias("code"), F.col("text").alias("case_text"), F.col("at").alias("case_at"), "seq"), "item")
        place = F.row_number().over(retrieval.W.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "seq"))
        rows = rows.withColumn("rank", place).filter(F.col("rank") <= n)
        return named.join(rows.select("query", "rank", "code", "case_text", "case_at", "similarity"), "query").drop("query")
