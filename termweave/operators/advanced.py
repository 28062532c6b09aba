"""Lexical retrieval fused with an encoder's vectors and a pair scorer, both handed in by the caller.

An encoder is a callable from a pandas Series of texts to a list of vectors, a pair scorer one from a pandas frame with
query text and candidate text to a list of scores. Both run in Arrow batches; nothing is downloaded. A weight of zero
leaves its model out altogether.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions.text import nonempty
from termweave.operators import retrieval
from termweave.sources.records import require_columns


@dataclass(frozen=True)
class Config:
    history_weight: float = 0.5
    dense_weight: float = 0.0
    reranker_weight: float = 0.0

    def complexity(self) -> tuple:
        """For ties: models without a reranker first, then without vectors, then of smaller weights."""
        return (int(self.reranker_weight > 0), int(self.dense_weight > 0), self.reranker_weight, self.dense_weight, self.history_weight)


def encoded(rows: DataFrame, encode: Callable, key: str) -> DataFrame:
    """(key, vector) for rows of (key, text); blank texts are encoded as `__empty__`."""
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for pdf in batches:
            yield pdf[[key]].assign(vector=[[float(x) for x in v] for v in encode(pdf["text"])])

    return rows.select(key, nonempty("text").alias("text")).mapInPandas(run, f"{key} {kind}, vector array<double>")


class DenseIndex:
    """Vectors of the terminology and of the history; a query's score for a code is its cosine to both."""

    def __init__(self, encode: Callable) -> None:
        self.encode = encode

    def fit(self, history: DataFrame, terms: DataFrame) -> DenseIndex:
        body = "search_text" if "search_text" in terms.columns else "term"
        self.terms = retrieval.kept(encoded(terms.select("code", F.col(body).alias("text")), self.encode, "code"))
        own = retrieval.history_text(history).select(F.col("gold_code").alias("code"), "text").distinct()
        self.history = retrieval.kept(encoded(own, self.encode, "code"))
        return self

    def pool(self, texts: DataFrame, history_weight: float, pool: int, wanted: DataFrame | None = None) -> DataFrame:
        """(query, code, dense_score, low, high) of the best codes and those wanted (query, code)."""
        asked = encoded(texts.select("query", "text"), self.encode, "query")
        return retrieval.dense_pool(asked, self.terms, self.history, history_weight, pool, wanted)

    def scores(self, texts: DataFrame, history_weight: float) -> DataFrame:
        """(query, code, dense_score) for every query and code of the terminology; a code without history has history score 0."""
        asked = encoded(texts.select("query", "text"), self.encode, "query")
        term = retrieval.dense_scores(asked, self.terms).withColumnRenamed("dense_score", "t")
        past = retrieval.dense_scores(asked, self.history).withColumnRenamed("dense_score", "h")
        score = (1 - history_weight) * F.col("t") + history_weight * F.coalesce("h", F.lit(0.0))
        return term.join(past, ["query", "code"], "left").select("query", "code", score.alias("dense_score"))


class AdvancedCoder:
    """Candidates of lexical retrieval and of the vectors are pooled and fused; a pair scorer may score the pool."""

    def __init__(self, config: Config, top_k: int = 10, pool: int = 50, dense: DenseIndex | None = None, reranker: Callable | None = None) -> None:
        self.config, self.k, self.pool = config, top_k, max(pool, top_k)
        self.dense, self.reranker = dense if config.dense_weight > 0 else None, reranker if config.reranker_weight > 0 else None

    def fit(self, history: DataFrame, terms: DataFrame, lexical: retrieval.HistoricalCoder | None = None) -> AdvancedCoder:
        """`lexical`: a coder fitted on the same tables, to be shared."""
        self.lexical = lexical or retrieval.HistoricalCoder(self.config.history_weight, self.pool).fit(history, terms)
        body = "search_text" if "search_text" in terms.columns else "term"
        self.texts = terms.select("code", F.col(body).alias("candidate_text"))
        if self.dense is not None and not hasattr(self.dense, "terms"):
            self.dense.fit(history, terms)
        return self

    def ranked(self, texts: DataFrame, parts: DataFrame | None = None) -> DataFrame:
        """(query, rank, code, score, ...) for (query, text); `parts`: the lexical components, where they are known."""
        c = self.config
        parts = self.lexical.components(texts) if parts is None else parts
        lexical = retrieval.ranked(self.lexical.fused(parts, c.history_weight), self.lexical.codes, texts, self.pool)
        if self.dense is not None:
            lexical = retrieval.kept(lexical)
        dense = self.dense.pool(texts, c.history_weight, self.pool, lexical.select("query", "code")) if self.dense is not None else lexical.select("query", "code", F.lit(0.0).alias("dense_score")).limit(0)

        def scored(rows: DataFrame) -> DataFrame:
            pairs = rows.select("query", "code").join(texts.select("query", F.col("text").alias("query_text")), "query").join(self.texts, "code")
            return retrieval.with_scorer(pairs, self.reranker, f"query {dict(pairs.dtypes)['query']}, code string, reranker_score double")

        return retrieval.advanced(lexical, dense, self.pool, self.k, c.dense_weight if self.dense is not None else 0.0, scored if self.reranker is not None else None, c.reranker_weight)

    def predict(self, records: DataFrame) -> DataFrame:
        """(record_id, rank, code, score, ...), with row_id where records have one or repeat."""
        return retrieval.by_text(retrieval.query_text(retrieval.identified(records)), self.ranked).drop("query")

    def score_code(self, pairs: DataFrame) -> DataFrame:
        """(key, score) for (key, text, code): the final score of one code for a text, 0 outside the candidates."""
        texts = pairs.select(retrieval.text_key("text").alias("query"), "text").distinct()
        whole = AdvancedCoder(self.config, self.pool, self.pool, self.dense, self.reranker)
        whole.lexical, whole.texts = self.lexical, self.texts
        named = pairs.withColumn("query", retrieval.text_key("text")).join(whole.ranked(texts).select("query", "code", "score"), ["query", "code"], "left")
        return named.select("key", F.coalesce("score", F.lit(0.0)).alias("score"))


def from_policy(frozen: dict, models: dict[str, Callable] | None = None, k: int = 10):
    """The model that a frozen policy names, not fitted yet. `models` has the callables by their names.

    ValueError if the policy weighs a dense model or a reranker that it does not name, KeyError if the name is unknown.
    """
    weight = float(frozen.get("history_weight", 0.5))
    if frozen.get("model_type", "lexical_historical") != "advanced_singlelabel":
        return retrieval.HistoricalCoder(weight, k)
    own = {}
    for share, name in (("dense_weight", "dense_model_name"), ("reranker_weight", "cross_encoder_model_name")):
        if float(frozen.get(share) or 0) > 0:
            if not frozen.get(name):
                raise ValueError(f"{share} without {name}")
            own[share] = (models or {})[frozen[name]]
    config = Config(weight, float(frozen.get("dense_weight") or 0), float(frozen.get("reranker_weight") or 0))
    return AdvancedCoder(config, k, dense=DenseIndex(own["dense_weight"]) if "dense_weight" in own else None, reranker=own.get("reranker_weight"))


def train_alias_map(train: DataFrame) -> DataFrame:
    """(code, alias): the mentions of each code in the training part, lower-cased and trimmed, blanks left out."""
    rows = require_columns(train, {"gold_code", "mention"}).select(F.col("gold_code").alias("code"), F.lower(F.trim("mention")).alias("alias"))
    return rows.filter("alias <> ''").distinct()
