"""Half-open character intervals: union, overlap, validation, and agreement of rationales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(spans: DataFrame, *key: str) -> DataFrame:
    """The union of each key's intervals [s, e); touching ones become one, empty and negative ones go."""
    rows = spans.filter("e > s").select(*key, "s", "e")
    w = W.partitionBy(*key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


#: Characters of a tile: intervals are cut at its borders, so that a key with any number of them is swept in parts.
TILE = 4096


def covered(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """Per key, how many characters the intervals [s, e) of each side cover, and how many both do: (key, covered_a, covered_b, overlap).

    Every interval becomes an opening and a closing event; running through a key's events in order, the number of open
    intervals of each side tells what the stretch up to the next event belongs to. No pair of intervals is made, and
    equal ones count once before anything is sorted. Keys without characters on either side give no row.
    """
    def events(df: DataFrame, side: str) -> DataFrame:
        s, e = F.col("s").cast("long"), F.col("e").cast("long")
        tiles = F.sequence(F.floor(s / TILE), F.floor((e - 1) / TILE))
        rows = df.filter("e > s").select(*key, s.alias("s"), e.alias("e"), F.explode(tiles).alias("_tile"))
        rows = rows.select(*key, "_tile", F.greatest("s", F.col("_tile") * TILE).alias("s"), F.least("e", (F.col("_tile") + 1) * TILE).alias("e")).distinct()
        ends = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("step")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("step")))
        other = "b" if side == "a" else "a"
        return rows.select(*key, "_tile", F.inline(ends)).groupBy(*key, "_tile", "at").agg(F.sum("step").alias(side)).withColumn(other, F.lit(0).cast("long"))

    steps = events(first, "a").unionByName(events(second, "b")).groupBy(*key, "_tile", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))  # at most TILE + 1 in a tile
    w = W.partitionBy(*key, "_tile").orderBy("at")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = steps.select(*key, (F.lead("at").over(w) - F.col("at")).alias("size"), F.sum("a").over(run).alias("a"), F.sum("b").over(run).alias("b"))
    size = lambda c: F.sum(F.when(c, F.col("size")).otherwise(0))
    return rows.filter("size is not null").groupBy(*key).agg(size(F.col("a") > 0).alias("covered_a"), size(F.col("b") > 0).alias("covered_b"), size((F.col("a") > 0) & (F.col("b") > 0)).alias("overlap"))


def overlap(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Per key, how many characters both unions share, for keys where that is any."""
    return covered(a, b, *key).filter("overlap > 0").select(*key, "overlap")


def validate_offsets(annotations: DataFrame, records: DataFrame) -> DataFrame:
    """Counts: rows, annotations without a record, with offsets outside the text, and with another quote; each row counts once."""
    text = records.select("record_id", "text", "row_seq").withColumn("_n", F.row_number().over(W.partitionBy("record_id").orderBy("row_seq"))).filter("_n = 1").select("record_id", "text")
    rows = annotations.join(text, "record_id", "left")
    outside = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text"))
    other = (F.coalesce("quote", F.lit("")) != "") & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("quote"))
    problem = F.when(F.col("text").isNull(), "missing_record").when(outside, "invalid_offsets").when(other, "quote_mismatch")
    rows = rows.select(problem.alias("p"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("p") == p).alias(p) for p in ("missing_record", "invalid_offsets", "quote_mismatch")])


def rationale_agreement(pred: DataFrame, ref: DataFrame) -> DataFrame:
    """Per (record_id, code) of the reference: character precision, recall, F1, any_overlap and whether a prediction is there.

    Both sides are rows of (record_id, code, s, e).
    """
    key = ["record_id", "code"]
    both = covered(pred, ref, *key).select(*key, F.col("covered_a").alias("p"), F.col("covered_b").alias("r"), "overlap")
    rows = ref.select(*key).distinct().join(both, key, "left")
    rows = rows.join(pred.select(*key).distinct().withColumn("prediction_present", F.lit(True)), key, "left").fillna(0, ["r", "p", "overlap"]).fillna(False, ["prediction_present"])
    share = lambda n: F.when(F.col(n) > 0, F.col("overlap") / F.nullif(n, F.lit(0))).otherwise(0.0)
    f1 = F.when(F.col("r") + F.col("p") > 0, 2.0 * F.col("overlap") / F.nullif(F.col("r") + F.col("p"), F.lit(0))).otherwise(0.0)
    return rows.select(*key, share("p").alias("char_precision"), share("r").alias("char_recall"), f1.alias("char_f1"), (F.col("overlap") > 0).alias("any_overlap"), "prediction_present")


def agreement_means(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.avg(c).alias(c) for c in ("char_precision", "char_recall", "char_f1")], F.avg(F.col("any_overlap").cast("int")).alias("any_overlap_rate"), F.avg(F.col("prediction_present").cast("int")).alias("prediction_rate"))


# The words that a review table may use for yes and no.
YES = ("1", "true", "yes", "y", "pass", "supported", "complete", "correct")
NO = ("0", "false", "no", "n", "fail", "unsupported", "incomplete", "incorrect")


def binary_ratings(df: DataFrame, *columns: str) -> DataFrame:
    """Per rated column: how many ratings can be read, and the share of yes among them."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("question"), F.lower(F.trim(F.col(c).cast("string"))).alias("answer")) for c in columns])).alias("x")).select("x.*")
    value = F.when(F.col("answer").isin(*YES), 1).when(F.col("answer").isin(*NO), 0)
    return rows.groupBy("question").agg(F.count(value).alias("n_rated"), F.avg(value).alias("positive_rate"))
