"""Readers and adapters. Every reader gives strings, never inferred types, so that codes keep their leading zeros."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from termweave.functions.text import collapsed, trimmed


def require_columns(df: DataFrame, needed) -> DataFrame:
    if missing := sorted(set(needed) - set(df.columns)):
        raise ValueError(f"Missing columns: {missing}")
    return df


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """The rows, if no key occurs twice (the `many_to_one` side of a join)."""
    if not df.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV file with a header, all columns strings, blank where empty, and row_seq in the order of the file.

    monotonically_increasing_id grows with the file's byte ranges, so row_seq orders the rows of one file.
    """
    names = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return rows.fillna("").withColumn("row_seq", F.monotonically_increasing_id())


def with_blank(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit(""))
    return df


def with_row_id(df: DataFrame, order: str = "row_seq") -> DataFrame:
    """Rows with `row_id`, which tells apart the rows of a record: `record_id#row_seq`, and for rows that share both a number after it.

    Made once, at the source or at the door of a driver, and carried from there on; a row_id that is there already
    stays. Rows without a row_seq are numbered as they are read. Only where pairs repeat are rows shuffled.
    """
    if "row_id" in df.columns:
        return df
    fresh = order not in df.columns
    df = df.withColumn(order, F.monotonically_increasing_id()) if fresh else df
    base = F.concat(F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.lit("#"), F.coalesce(F.col(order).cast("string"), F.lit("")))
    if fresh or df.groupBy("record_id", order).count().filter("count > 1").isEmpty():
        return df.withColumn("row_id", base)
    nth = F.row_number().over(W.partitionBy("record_id", order).orderBy(F.xxhash64(*sorted(df.columns))))
    return df.withColumn("_nth", nth).withColumn("row_id", F.when(F.col("_nth") == 1, base).otherwise(F.concat(base, F.lit("."), F.col("_nth")))).drop("_nth")


def row_key(df: DataFrame) -> str:
    """The column that tells rows apart: row_id where there is one, else record_id."""
    return "row_id" if "row_id" in df.columns else "record_id"


def row_keys(df: DataFrame) -> list[str]:
    """The columns that name a row: record_id, and row_id where there is one."""
    return ["record_id", "row_id"] if "row_id" in df.columns else ["record_id"]


def records(df: DataFrame, mention_from_text: bool = False) -> DataFrame:
    """Coding records: record_id and text are required. A missing mention is blank, or with `mention_from_text` the text."""
    require_columns(df, {"record_id", "text"})
    if mention_from_text and "mention" not in df.columns:
        df = df.withColumn("mention", F.col("text"))
    df = with_blank(df, "record_id", "text", "mention", "gold_code", "gold_term")
    return with_row_id(df) if "row_seq" in df.columns else df


def first_per(df: DataFrame, key: str, order: str = "row_seq") -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def terminology(df: DataFrame, coding_system: str | None = None) -> DataFrame:
    """A terminology of one coding system with search_text, the first row of each code. ValueError if none or several systems are left."""
    require_columns(df, {"code", "term"})
    df = with_blank(df, "code", "term", "system", "synonyms", "definition", "hierarchy", "knowledge_source")
    if "row_seq" not in df.columns:
        df = df.withColumn("row_seq", F.monotonically_increasing_id())
    if coding_system is not None:
        if df.filter(trimmed("system") != "").isEmpty():
            df = df.withColumn("system", F.lit(coding_system))
        else:
            df = df.filter(F.lower(trimmed("system")) == coding_system.strip().lower())
            if df.isEmpty():
                raise ValueError(f"No rows of the coding system {coding_system}")
    if df.filter(trimmed("system") != "").select(F.lower(trimmed("system"))).distinct().limit(2).count() > 1:
        raise ValueError("Several coding systems in one terminology")
    text = collapsed(F.concat_ws(" ", "term", F.translate("synonyms", "|", " "), "definition"))
    return first_per(df.withColumn("search_text", text), "code")


def terminology_plain(df: DataFrame) -> DataFrame:
    """The older form: synonyms are appended to the term."""
    df = with_blank(require_columns(df, {"code", "term"}), "synonyms")
    return first_per(df.withColumn("term", trimmed(F.concat_ws(" ", "term", F.translate("synonyms", "|", " ")))), "code").select("code", "term")


def single_code_corpus(df: DataFrame) -> DataFrame:
    """Phrase-to-code rows of a corpus: trimmed phrase, code without a trailing `.0`, no blanks, no repeated rows."""
    require_columns(df, {"original_dataset", "instance_id", "phrase", "single_mapped_meddra_codes"})
    code = F.regexp_replace(trimmed(F.col("single_mapped_meddra_codes").cast("string")), r"\.0$", "")
    out = df.select(F.col("instance_id").cast("string").alias("record_id"), trimmed("phrase").alias("text"), trimmed("phrase").alias("mention"), code.alias("gold_code"), F.lit("").alias("gold_term"), F.col("original_dataset").cast("string").alias("source_dataset"))
    return out.filter("text <> '' and gold_code <> ''").distinct()


def train_terminology(train: DataFrame, max_aliases: int = 50) -> DataFrame:
    """A terminology out of coded mentions: per code its mentions in order of appearance; the first is the term."""
    once = train.filter("gold_code <> ''").groupBy("gold_code", "mention").agg(F.min("row_seq").alias("seq"))
    ranked = once.withColumn("_n", F.row_number().over(W.partitionBy("gold_code").orderBy("seq", "mention"))).filter(F.col("_n") <= max_aliases)
    alias = F.transform(F.array_sort(F.collect_list(F.struct("_n", "mention"))), lambda x: x["mention"])
    out = ranked.groupBy("gold_code").agg(alias.alias("aliases"), F.min("seq").alias("row_seq"))
    return out.select(F.col("gold_code").alias("code"), F.get("aliases", F.lit(0)).alias("term"), F.array_join(F.slice("aliases", 2, max_aliases), " | ").alias("synonyms"), "row_seq")


def multilabel_records(notes: DataFrame, diagnoses: DataFrame, dictionary: DataFrame, min_code_frequency: int = 1, version: str = "10", max_notes: int | None = None) -> DataFrame:
    """A row per stay: its latest note, and its codes of one version in order of first appearance, with their titles.

    Codes are trimmed before the dictionary is joined. Frequencies count diagnosis rows. ValueError if the dictionary
    has two titles for a code.
    """
    require_columns(notes, {"subject_id", "hadm_id", "note_id", "text"})
    require_columns(diagnoses, {"hadm_id", "icd_code", "icd_version"})
    require_columns(dictionary, {"icd_code", "icd_version", "long_title"})
    times = [F.desc(c) for c in ("charttime", "storetime", "note_id") if c in notes.columns]
    notes = notes.filter(trimmed("hadm_id") != "")
    latest = notes.withColumn("_n", F.row_number().over(W.partitionBy("hadm_id").orderBy(*times))).filter("_n = 1").drop("_n")
    own = diagnoses.filter(trimmed(F.col("icd_version").cast("string")) == version).withColumn("code", trimmed("icd_code"))
    titles = dictionary.filter(trimmed(F.col("icd_version").cast("string")) == version).select(trimmed("icd_code").alias("code"), "long_title")
    titles = require_unique(titles.distinct(), "code")
    often = own.groupBy("code").count().filter(F.col("count") >= min_code_frequency).select("code")
    seq = "seq_num" if "seq_num" in own.columns else "row_seq"
    first = own.join(often, "code", "left_semi").groupBy("hadm_id", "code").agg(F.min(seq).alias("seq")).join(titles, "code", "left")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "code", F.coalesce("long_title", F.lit("")).alias("title"))))
    codes = first.groupBy("hadm_id").agg(ordered.alias("c"))
    out = latest.join(codes, "hadm_id").select(F.col("hadm_id").cast("string").alias("record_id"), F.col("subject_id").cast("string").alias("subject_id"), "hadm_id", "note_id", "text", F.transform("c", lambda x: x["code"]).alias("gold_codes"), F.transform("c", lambda x: x["title"]).alias("gold_terms"), F.size("c").alias("n_gold_codes"))
    return out if max_notes is None else out.orderBy("note_id").limit(max_notes)


def dictionary_terminology(dictionary: DataFrame, version: str = "10", system: str = "ICD-10") -> DataFrame:
    """A terminology out of a code dictionary."""
    rows = dictionary.filter(trimmed(F.col("icd_version").cast("string")) == version)
    rows = rows.select(trimmed("icd_code").alias("code"), trimmed("long_title").alias("term"), F.lit(system).alias("system"), F.monotonically_increasing_id().alias("row_seq"))
    return first_per(rows.filter("code <> ''"), "code")


# The shape of a text-bound line of a stand-off file, and a code's digits.
TEXTBOUND, CODE = r"^(T\d+)\t([^\t]+)\t(.*)$", r"(?i)(?:MedDRA\s*[:#]?\s*)?(\d{6,9})\b"


def standoff_root(spark: SparkSession, root: str) -> str:
    """The folder that holds text, original and meddra: root/cadec where that is there, else root. FileNotFoundError if one of the three is missing."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = lambda p: fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs.Path(p))
    root = f"{root}/cadec" if there(f"{root}/cadec") else root
    if missing := [n for n in ("text", "original", "meddra") if not there(f"{root}/{n}")]:
        raise FileNotFoundError(f"{root} has no {', '.join(missing)}")
    return root


def standoff_parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(text-bound annotations, code lines) of a stand-off corpus: text/*.txt, original/*.ann and meddra/*.ann.

    A text-bound line is `T1<tab>TYPE 6 10;19 23<tab>words`. Spans that are empty or reach beyond the text are left
    out, and a line without a span left is invalid: it is not an annotation and does not replace an earlier one of its
    id, as later valid lines do (those of meddra come after those of original). A code line names meddra, a T-id and a
    code; its first code counts. Documents without a text or without a meddra file give nothing.
    """
    root = standoff_root(spark, root)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    texts = spark.read.text(f"{root}/text/*.txt", wholetext=True).select(F.col("value").alias("text")).withColumn("record_id", name)

    def lines(folder: str) -> DataFrame:
        whole = spark.read.text(f"{root}/{folder}/*.ann", wholetext=True).withColumn("record_id", name)
        return whole.select("record_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))

    meddra = lines("meddra")
    documents = texts.join(meddra.select("record_id").distinct(), "record_id", "left_semi")
    bound = lines("original").withColumn("part", F.lit(0)).unionByName(meddra.withColumn("part", F.lit(1))).filter(F.col("line").startswith("T")).join(documents, "record_id")
    shaped = F.col("line").rlike(TEXTBOUND) & F.regexp_extract("line", TEXTBOUND, 2).contains(" ")
    kind, pair = F.regexp_extract("line", TEXTBOUND, 2), r"(\d+)\D+(\d+)"
    segments = F.filter(F.split(F.regexp_replace(kind, r"^\S* ", ""), ";"), lambda p: p.rlike(pair))
    spans = F.transform(segments, lambda p: F.struct(F.regexp_extract(p, pair, 1).cast("int").alias("start"), F.regexp_extract(p, pair, 2).cast("int").alias("end")))
    spans = F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length("text")))
    bound = bound.select("record_id", "text", "part", "line_no", F.when(shaped, F.regexp_extract("line", TEXTBOUND, 1)).alias("annotation_id"), F.regexp_extract(kind, r"^(\S*) ", 1).alias("entity_type"), F.regexp_extract("line", TEXTBOUND, 3).alias("mention"), F.when(shaped, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))
    coded = meddra.filter(F.lower("line").contains("meddra")).join(documents.select("record_id"), "record_id", "left_semi")
    coded = coded.select("record_id", "line_no", F.regexp_extract("line", r"\b(T\d+)\b", 1).alias("annotation_id"), F.regexp_extract("line", CODE, 1).alias("gold_code"), F.when(F.col("line").contains("\t"), F.substring_index("line", "\t", 1)).otherwise("").alias("normalization_id"))
    return bound, coded.filter("annotation_id <> '' and gold_code <> ''")


def standoff_annotations(spark: SparkSession, root: str) -> DataFrame:
    """The coded annotations of a stand-off corpus, each annotation and code once; offset_match tells whether the spans' words are the annotation's."""
    bound, coded = standoff_parts(spark, root)
    last = bound.filter(F.size("spans") > 0).withColumn("_n", F.row_number().over(W.partitionBy("record_id", "annotation_id").orderBy(F.desc("part"), F.desc("line_no")))).filter("_n = 1").drop("_n", "part", "line_no")
    once = coded.withColumn("_n", F.row_number().over(W.partitionBy("record_id", "annotation_id", "gold_code").orderBy("line_no"))).filter("_n = 1")
    words = F.array_join(F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])), " ")
    out = once.select("record_id", "annotation_id", "gold_code", "normalization_id", F.col("line_no").alias("row_seq")).join(last, ["record_id", "annotation_id"])
    start, end = F.array_min(F.transform("spans", lambda s: s["start"])), F.array_max(F.transform("spans", lambda s: s["end"]))
    spans_json = F.to_json(F.transform("spans", lambda s: F.array(s["start"], s["end"])))
    return out.select(
        "record_id", "annotation_id", "normalization_id", "entity_type", "text", "mention", "gold_code", F.lit("").alias("gold_term"), "spans", spans_json.alias("spans_json"), start.alias("start"), end.alias("end"),
        (F.size("spans") > 1).alias("is_discontinuous"), words.alias("offset_text"), (collapsed(words) == collapsed("mention")).alias("offset_match"), "row_seq", F.concat("record_id", F.lit("#"), "annotation_id", F.lit("#"), "gold_code").alias("row_id"),
    )


def parse_stats(spark: SparkSession, root: str) -> DataFrame:
    """One row of counts over a stand-off corpus: files, code lines with and without their annotation, invalid text-bound lines, and what came of them."""
    bound, coded = standoff_parts(spark, root)
    rows = standoff_annotations(spark, root)
    files = spark.read.text(f"{standoff_root(spark, root)}/meddra/*.ann", wholetext=True).agg(F.count(F.lit(1)).alias("documents_seen"))
    invalid = bound.agg(F.count_if(F.size("spans") == 0).alias("invalid_textbound"))
    there = bound.filter(F.size("spans") > 0).select("record_id", "annotation_id").distinct().withColumn("there", F.lit(1))
    seen = coded.join(there, ["record_id", "annotation_id"], "left").agg(F.count(F.lit(1)).alias("normalizations_seen"), F.count("there").alias("normalizations_matched"), F.count_if(F.col("there").isNull()).alias("missing_target"))
    own = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("record_id").alias("unique_documents"), F.count_distinct("gold_code").alias("unique_codes"),
        F.count_if("is_discontinuous").alias("discontinuous_annotations"), F.count_if("offset_match").alias("offset_match_count"), F.coalesce(F.avg(F.col("offset_match").cast("int")), F.lit(0.0)).alias("offset_match_rate"),
    )
    row = files.crossJoin(invalid).crossJoin(seen).crossJoin(own)
    return row.withColumn("match_rate", F.coalesce(F.col("normalizations_matched") / F.nullif("normalizations_seen", F.lit(0)), F.lit(0.0))).withColumn("duplicate_rows_removed", F.col("normalizations_matched") - F.col("rows"))


def choose_tabular(names: list[str], wanted: str) -> str | None:
    """The best table among a repository's file names: the wanted word, then a CSV, then no compression, then a short name, then the alphabet."""
    tables = [n for n in names if n.lower().endswith((".csv", ".tsv", ".csv.gz", ".tsv.gz"))]
    return min(tables, key=lambda n: (wanted.lower() not in n.lower(), ".csv" not in n.lower(), n.lower().endswith(".gz"), len(n), n), default=None)


def fetched_table(spark: SparkSession, names: list[str], wanted: str, fetch, folder: str) -> DataFrame:
    """The best table of a repository, fetched into `folder` (any store that Spark writes) and read as strings. ValueError if there is none.

    fetch(name) gives a file's bytes; a file that is there already is not fetched again.
    """
    name = choose_tabular(names, wanted)
    if name is None:
        raise ValueError("The repository has no table")
    to = f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out = fs.create(p, True)
        out.write(bytearray(fetch(name)))
        out.close()
    return read_strings(spark, to, "\t" if name.lower().removesuffix(".gz").endswith((".tsv", ".txt")) else ",")


class Page(InputPartition):
    def __init__(self, offset: int, length: int) -> None:
        self.offset, self.length = offset, length


def paged_format(name: str, fetch, total: int, page_size: int, ddl: str, attempts: int = 3) -> type[DataSource]:
    """A Spark data source over a paged service: `fetch(offset, length)` gives the rows of a page as tuples.

    Each page is a partition of its own, read where the task runs, again if the fetch fails, up to `attempts` times.
    Register it with `spark.dataSource.register` and read it by `name`.
    """

    class Reader(DataSourceReader):
        def partitions(self):
            return [Page(at, min(page_size, total - at)) for at in range(0, total, page_size)]

        def read(self, partition):
            for left in range(attempts - 1, -1, -1):
                try:
                    rows = list(fetch(partition.offset, partition.length))
                    break
                except OSError:
                    if not left:
                        raise
            yield from (tuple(r) for r in rows)

    class Source(DataSource):
        def schema(self):
            return ddl

        def reader(self, schema):
            return Reader()

    Source.name = classmethod(lambda _: name)
    return Source


def paged_source(spark: SparkSession, fetch, total: int, page_size: int, schema: str) -> DataFrame:
    """The rows of a paged service, through a data source registered for it; a service without rows gives none."""
    if total <= 0:
        return spark.createDataFrame([], schema)
    name = f"paged_{uuid.uuid4().hex}"
    spark.dataSource.register(paged_format(name, fetch, total, page_size, schema))
    return spark.read.format(name).load()


def group_leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """The groups that occur in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("n_splits")).filter("n_splits > 1")


def assert_group_disjoint(df: DataFrame, group: str, split: str = "split") -> None:
    if not group_leaks(df, group, split).isEmpty():
        raise ValueError(f"{group} occurs in more than one split")


def alias_rows(terms: DataFrame) -> DataFrame:
    """(code, row_seq, alias_idx, alias): the term and the synonyms between |, trimmed, each once whatever its case."""
    def flat(c: Column) -> Column:
        return F.filter(F.transform(c, trimmed), lambda a: a != "")

    every = flat(F.concat(F.array("term"), F.split("synonyms", r"\|")))
    rows = with_blank(terms, "term", "synonyms").select("code", "row_seq", F.posexplode(F.when(F.size(every) == 0, F.array(F.lit("__empty__"))).otherwise(every)).alias("alias_idx", "alias"))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("code", F.lower("alias")).orderBy("alias_idx"))).filter("_n = 1").drop("_n")
