"""How far measured numbers can be trusted: intervals by a bootstrap over documents, and calibration of confidences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.operators.products import kind_of, made

#: Replicates of an interval, and documents whose weights are made at once.
REPLICATES, AT_ONCE = 1000, 4096
# The odd constants of the 64-bit mixer, and the golden ratio's fraction.
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def poisson_bounds() -> list[float]:
    """P(X <= k) of a Poisson variable of mean 1, for k = 0, 1, ..., as far as doubles tell them from 1."""
    p, total, out, k = float(np.exp(-1.0)), 0.0, [], 0
    while total + p < 1.0 and k < 18:
        total += p
        out.append(total)
        k += 1
        p /= k
    return out


def poisson_weights(key: np.ndarray, replicates: int) -> np.ndarray:
    """(documents, replicates): how often each document is drawn, the same on every run: by a mixed hash of its key and the replicate's number."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(GOLDEN)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
        x ^= x >> np.uint64(31)
    u = (x >> np.uint64(11)).astype(np.float64) / 9007199254740992.0
    return np.searchsorted(np.array(poisson_bounds()), u.ravel(), side="right").reshape(u.shape).astype(np.float64)


def document_key(unit: str, seed: int):
    """60 bits of sha256 of `seed:unit`; a null unit is the empty one."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(unit).cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")


def replicate_sums(rows: DataFrame, ratios: dict[str, tuple], unit: str, by: str | None = None, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(group, metric, replicate, num, den): the weighted sums of every replicate; replicate 0 is the sample itself.

    ratios: name to (numerator, denominator), columns or expressions. Rows are summed for each document first, so a
    document with many rows is one draw. A task keeps one array of sums for each group, and hands on a row for each
    group, metric and replicate; groups are few (`by` names a column of some values), documents any number.
    """
    names = sorted(ratios)
    sums = [F.sum(F.coalesce(part.cast("double"), F.lit(0.0))).alias(f"{kind}{i}") for i, n in enumerate(names) for kind, part in zip(("n", "d"), ratios[n], strict=True)]
    group = (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("group")
    docs = rows.select("*", document_key(unit, seed).alias("_key")).groupBy("_key", group).agg(*sums)
    kind = kind_of("group string, metric string, replicate int, num double, den double")
    schema, columns = kind[1], [f"{k}{i}" for i in range(len(names)) for k in ("n", "d")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                weights = np.concatenate([np.ones((part.num_rows, 1)), poisson_weights(part.column("_key").to_numpy(), replicates)], axis=1)
                values = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in columns])
                groups = part.column("group").dictionary_encode()
                index = np.asarray(groups.indices.fill_null(-1))
                for g in np.unique(index):
                    own = index == g
                    name = None if g < 0 else groups.dictionary[int(g)].as_py()
                    total[name] = total.get(name, 0.0) + values[:, own] @ weights[own]
        for name, s in total.items():
            for i, metric in enumerate(names):
                n = s.shape[1]
                yield made(schema, [pa.array([name] * n, pa.string()), pa.array([metric] * n), np.arange(n), s[2 * i], s[2 * i + 1]])

    return docs.mapInArrow(run, kind[0]).groupBy("group", "metric", "replicate").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def bootstrap_intervals(rows: DataFrame, ratios: dict[str, tuple], unit: str = "record_id", by: str | None = None, replicates: int = REPLICATES, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(group, metric, estimate, low, high, spread, n_replicates): percentile intervals of ratios of sums, by Poisson weights over documents.

    low and high are interpolated quantiles of the replicates, spread their standard deviation. A replicate that draws
    no denominator has no value and is left out; n_replicates counts the others. Without rows there are none. A paired
    comparison of two systems is a ratio whose numerator is their difference: both get the same draws.
    """
    sums = replicate_sums(rows, ratios, unit, by, replicates, seed).withColumn("value", F.col("num") / F.nullif("den", F.lit(0.0)))
    own = F.when(F.col("replicate") > 0, F.col("value"))
    at = F.percentile(own, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))  # `replicates` values in a group
    out = sums.groupBy("group", "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), at.alias("q"), F.stddev_samp(own).alias("spread"), F.count(own).alias("n_replicates"))
    return out.select("group", "metric", "estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), "spread", "n_replicates")


def by_confidence(pred: DataFrame) -> DataFrame:
    """(confidence, n, ok): records and right ones for each distinct confidence; rows without one are left out, a missing `correct` is wrong."""
    rows = pred.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    return rows.groupBy(F.col("confidence").cast("double").alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("correct").cast("long"), F.lit(0))).alias("ok"))


def equal_mass_bins(pred: DataFrame, bins: int = 15) -> DataFrame:
    """(bin, n, ok, accuracy, mean_confidence, least, greatest): bins of about equally many records, in the order of the confidence; equal confidences share a bin.

    A confidence's bin is that of the first record it has, so a bin can be empty (no row) where one confidence has more
    records than a bin. Running counts go over distinct confidences in blocks.
    """
    per = by_confidence(pred).withColumn("block", F.least(F.greatest(F.floor(F.col("confidence") * 1024), F.lit(-1)), F.lit(1025)))
    sums = per.groupBy("block").agg(F.sum("n").alias("bn"))
    up = W.orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)  # 1027 rows at most
    sums = sums.select("block", (F.sum("bn").over(up) - F.col("bn")).alias("before"), F.sum("bn").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("block").orderBy("confidence").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = F.col("before") + F.sum("n").over(inside) - F.col("n")
    binned = per.join(F.broadcast(sums), "block").withColumn("bin", F.floor(first * bins / F.col("total")).cast("int"))
    mass = F.sum(F.col("n") * F.col("confidence"))
    return binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"), (F.sum("ok") / F.sum("n")).alias("accuracy"), (mass / F.sum("n")).alias("mean_confidence"), F.min("confidence").alias("least"), F.max("confidence").alias("greatest"))


def calibration(pred: DataFrame, bins: int = 15) -> DataFrame:
    """One row: n, Brier score, expected and largest calibration error over equal-mass bins, mean confidence and accuracy; nulls without rows.

    The Brier score needs no bins: it is summed over distinct confidences.
    """
    c = F.col("confidence")
    brier = by_confidence(pred).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum(F.col("ok") * (1 - c) * (1 - c) + (F.col("n") - F.col("ok")) * c * c) / F.sum("n")).alias("brier"), (F.sum(F.col("n") * c) / F.sum("n")).alias("mean_confidence"), (F.sum("ok") / F.sum("n")).alias("accuracy"))
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    error = equal_mass_bins(pred, bins).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("expected_calibration_error"), F.max(gap).alias("largest_calibration_error"), F.count(F.lit(1)).alias("n_bins"))
    return brier.crossJoin(error)


def pooled(n: list[float], ok: list[float]) -> list[tuple[int, int]]:
    """Neighbouring bins whose shares fall are pooled until shares only rise: (first bin, bin after the last) of each pool."""
    pools: list[list[float]] = []
    for i, (a, b) in enumerate(zip(n, ok, strict=True)):
        pools.append([i, i + 1, a, b])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] = last[1]
            pools[-1][2] += last[2]
            pools[-1][3] += last[3]
    return [(int(p[0]), int(p[1])) for p in pools]


def isotonic(pred: DataFrame, bins: int = 1000) -> DataFrame:
    """(step, least, greatest, n, ok, calibrated): the share of right records as a step function of the confidence that never falls.

    Fitted by pooling adjacent violators over equal-mass bins, which stay at most `bins` rows whatever the input; with
    as many bins as there are records it is the isotonic regression itself.
    """
    kind = kind_of("step int, least double, greatest double, n long, ok long, calibrated double")

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), small).sort_by("bin")
        n, ok, low, high = (rows[c].to_numpy() for c in ("n", "ok", "least", "greatest"))
        pools = pooled(n.tolist(), ok.tolist())
        if pools:
            yield made(kind[1], [np.arange(len(pools)), np.array([low[a] for a, _ in pools]), np.array([high[b - 1] for _, b in pools]), *(np.array([int(x[a:b].sum()) for a, b in pools]) for x in (n, ok)), np.array([ok[a:b].sum() / n[a:b].sum() for a, b in pools])])

    small = kind_of("bin int, n long, ok long, least double, greatest double")[1]
    return equal_mass_bins(pred, bins).select("bin", "n", "ok", "least", "greatest").coalesce(1).mapInArrow(run, kind[0])


def calibrated(pred: DataFrame, steps: DataFrame) -> DataFrame:
    """Predictions with `calibrated`: the step at or below each confidence, the first one for lower ones; null without a confidence or steps."""
    table = [(r["least"], r["calibrated"]) for r in steps.select("least", "calibrated").orderBy("least").collect()]  # the steps of a fit: at most its bins
    if not table:
        return pred.withColumn("calibrated", F.lit(None).cast("double"))
    edges, values = (F.array(*[F.lit(float(x[i])) for x in table]) for i in (0, 1))
    both = pred.sparkSession.range(1).select(edges.alias("_edges"), values.alias("_values"))
    at = F.greatest(F.size(F.filter("_edges", lambda e: e <= F.col("confidence"))), F.lit(1))
    value = F.when(F.col("confidence").isNotNull() & ~F.isnan("confidence"), F.element_at("_values", at))
    return pred.crossJoin(F.broadcast(both)).withColumn("calibrated", value).drop("_edges", "_values")
