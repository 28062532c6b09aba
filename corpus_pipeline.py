"""The corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents` (doc_id, text, lang, source, n_chars), with n_chars
counted anew where a stage changes the text.

In every stage an empty table gives an empty table, and columns beside those five are dropped, whatever their names. A
row without a doc_id is a document like others, told from others by its text. Rows that repeat a doc_id are one
document: the stages before near_duplicates treat them alike, and that stage keeps one of those with equal texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm import decontamination, jaccard, language, lines, packing
from termweave.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_words(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, with characters counted anew, of the documents whose text has words left."""
    rows = docs.filter(F.col("text").rlike(r"[^\x00-\x20]"))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found: those of null or empty text, without a letter or of no learned language (score 0) go."""
    docs = docs.select(*COLUMNS)
    found = language.predict(docs, language.fit(docs), keep=("text", "lang", "source", "n_chars"))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") > 0)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats within one edit go, and short ones that it repeats exactly; a document left without words goes too.

    Rows without a doc_id come after all others and keep their lines.
    """
    return with_words(lines.without_repeated_lines(docs, keep=("lang", "source")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest doc_id stays, and one of its rows for each text that they hold.

    Rows without a doc_id take part under ids made of their texts, above all others. Documents without words, which
    link with nothing, stay.
    """
    made = F.shiftright(F.xxhash64("text"), 2).bitwiseAND(F.lit((1 << 61) - 1)) + F.lit(1 << 62)
    rows = docs.select(*COLUMNS).withColumn("own_id", F.coalesce(F.col("doc_id").cast("long"), made))
    first = jaccard.similar(rows.select(F.col("own_id").alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("own_id")).distinct()
    # Equal rows collapse in each task before texts are shuffled
    return rows.dropDuplicates(["own_id", "text"]).join(first, "own_id", "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark phrases cover go from the texts; a document left without words goes too, and an empty benchmark takes nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_words(decontamination.decontaminate(docs, benchmark, keep=("lang", "source")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each at an offset of a sequence of at most 4096 ids; without a doc_id they have none either."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: No SQL for the rows of run(): language ID and packing cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
