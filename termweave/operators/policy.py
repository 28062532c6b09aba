"""Uncertainty, routing, and thresholds with an exact binomial lower bound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.operators.evaluation import coverage_curve


def uncertainty(scores: Column | str, temperature: float = 1.0) -> Column:
    """top_score, score_margin, normalised_entropy and top_softmax_share of candidate scores, in the candidates' order; nulls where there are none.

    The top is the first candidate, whatever the others' scores (a reranker may have put a smaller one first). A null
    score counts as 0.
    """
    c = F.col(scores) if isinstance(scores, str) else scores
    s = F.transform(c, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    n, t = F.size(s), max(temperature, 1e-6)
    best = F.array_max(s)
    e = F.transform(s, lambda x: F.exp(F.least(F.greatest((x - best) / t, F.lit(-50.0)), F.lit(50.0))))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(e, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total + 1e-12))
    at = lambda a, i: F.get(a, F.lit(i))
    some = n > 0
    return F.struct(
        F.when(some, at(s, 0)).alias("top_score"), F.when(n > 1, at(s, 0) - at(s, 1)).when(some, at(s, 0)).alias("score_margin"),
        F.when(n > 1, entropy / F.log(n.cast("double"))).when(some, F.lit(0.0)).alias("normalised_entropy"), F.when(some, at(e, 0) / F.nullif(total, F.lit(0.0))).alias("top_softmax_share"),
    )


def ood_flag(top_score: Column, terminology_overlap: Column | None = None, history_overlap: Column | None = None, least: float = 0.05) -> Column:
    """No top score, one under `least`, or neither overlap above 0."""
    weak = top_score.isNull() | (top_score < least)
    if terminology_overlap is None or history_overlap is None:
        return weak
    return weak | F.coalesce((terminology_overlap <= 0) & (history_overlap <= 0), F.lit(False))


def route(confidence: Column, entropy: Column, margin: Column, gate: Column | None = None, ood: Column | None = None, auto: float = 0.85, choice: float = 0.45, max_entropy: float = 1.0, min_margin: float = 0.08) -> Column:
    """FULL_EXPERT_REVIEW on a failed gate or out of domain; else AUTO_CANDIDATE, TOP_K_HUMAN_CHOICE or FULL_EXPERT_REVIEW by confidence."""
    stop = F.coalesce(ood, F.lit(False)) if ood is not None else F.lit(False)
    if gate is not None:
        stop = stop | (F.upper(F.coalesce(gate, F.lit(""))) == "FAIL")
    sure = (confidence >= auto) & F.coalesce(entropy <= max_entropy, F.lit(True)) & F.coalesce(margin >= min_margin, F.lit(True))
    return F.when(stop, "FULL_EXPERT_REVIEW").when(sure, "AUTO_CANDIDATE").when(confidence >= choice, "TOP_K_HUMAN_CHOICE").otherwise("FULL_EXPERT_REVIEW")


def route_case(confidence: Column, threshold: Column | float, ood: Column) -> Column:
    """The simpler router: out of domain to an expert, AUTO from the threshold on, else a choice of k."""
    return F.when(ood, "FULL_EXPERT_REVIEW").when(confidence >= threshold, "AUTO_CANDIDATE").otherwise("TOP_K_HUMAN_CHOICE")


def tail_of(successes: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    """P(Bin(n, t) >= successes): the regularised incomplete beta function I_t(s, n - s + 1) by its continued fraction.

    The fraction converges in some sqrt(n) steps at the worst, and in a few away from the mean.
    """
    s, n = np.asarray(successes, np.float64), np.asarray(n, np.float64)
    out = np.where((s <= 0) | (t >= 1), 1.0, 0.0)
    todo = np.flatnonzero((s > 0) & (s <= n) & (0 < t < 1))
    if not len(todo):
        return out
    a, b = s[todo], n[todo] - s[todo] + 1
    flip = t > (a + 1) / (a + b + 2)  # where the fraction of the other side converges faster
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - t, t)
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    front = np.exp((lgamma(a + b) - lgamma(a) - lgamma(b)).astype(np.float64) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, f, m = np.ones_like(d), d.copy(), 0
    while True:  # Lentz's method
        m += 1
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            f = f * step
        if np.all(np.abs(step - 1) < 1e-15) or m > 10 * int(np.sqrt((a + b).max())) + 1000:
            break
    value = front * f
    out[todo] = np.clip(np.where(flip, 1 - value, value), 0.0, 1.0)
    return out


def binomial_tail(successes: Column, n: Column, t: float) -> Column:
    """P(Bin(n, t) >= successes)."""

    @F.pandas_udf("double")
    def tail(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(tail_of(s.to_numpy(), n.to_numpy(), t))

    return tail(successes.cast("long"), n.cast("long"))


def tail_bounds(successes: Column, n: Column, t: float) -> tuple[Column, Column]:
    """Logarithms between which that of P(Bin(n, t) >= successes) lies: Chernoff's bound from above, Ash's from below.

    At or below the mean the tail is at least a half, as the median is not under the mean's whole part.
    """
    p = successes / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(0.0)
    chernoff = -n * (part(p, t) + part(1 - p, 1 - t))
    ash = F.when(successes >= n, chernoff).otherwise(chernoff - 0.5 * F.log(8 * n * p * (1 - p)))
    above = p > t
    return F.when(above, ash).otherwise(math.log(0.5)), F.when(above, chernoff).otherwise(0.0)


def lower_bound(successes: int, n: int, alpha: float = 0.05) -> float | None:
    """The one-sided Clopper-Pearson lower bound: the t at which P(Bin(n, t) >= successes) is alpha. None without trials."""
    if n <= 0:
        return None
    if not 0 <= successes <= n or not 0 < alpha < 1:
        raise ValueError("successes must be in [0, n] and alpha in (0, 1)")
    if successes == 0:
        return 0.0

    def tail(t: float) -> float:
        return float(tail_of(np.array([successes]), np.array([n]), t)[0])

    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if tail(mid) < alpha else (low, mid)
    return (low + high) / 2


def threshold_by_lower_bound(pred: DataFrame, target: float = 0.95, alpha: float = 0.05, min_auto: int = 20) -> DataFrame:
    """The threshold of most records whose lower bound reaches the target; no row where none does.

    The bound reaches the target exactly if P(Bin(n, target) >= successes) is at most alpha. Two closed bounds of that
    tail settle nearly every threshold; it is computed for the few in between alone, and the lower bound itself for the
    chosen threshold.
    """
    t = max(target - 1e-12, 0.0)
    rows = coverage_curve(pred).filter(F.col("n_auto") >= min_auto)
    if 0 < t < 1 and alpha < 0.5:
        slack = 1e-9  # rounding of the logarithms
        low, high = tail_bounds(F.col("n_correct"), F.col("n_auto"), t)
        rows = rows.withColumn("low", low).withColumn("high", high).filter(F.col("low") <= math.log(alpha) + slack)
        sure = rows.filter(F.col("high") <= math.log(alpha) - slack)
        rows = sure.unionByName(rows.filter(F.col("high") > math.log(alpha) - slack).filter(binomial_tail(F.col("n_correct"), F.col("n_auto"), t) <= alpha))
    else:
        rows = rows.filter(binomial_tail(F.col("n_correct"), F.col("n_auto"), t) <= alpha)
    chosen = rows.orderBy(F.desc("n_auto"), F.desc("accuracy"), "threshold").limit(1)

    def bound(batches):
        for pdf in batches:
            yield pdf.assign(tail=tail_of(pdf["n_correct"], pdf["n_auto"], t), lower_bound=[lower_bound(int(s), int(n), alpha) for s, n in zip(pdf["n_correct"], pdf["n_auto"], strict=True)])

    out = chosen.select("threshold", "n_auto", "n_correct", "coverage", "accuracy")
    return out.mapInPandas(bound, "threshold double, n_auto long, n_correct long, coverage double, accuracy double, tail double, lower_bound double")


def apply_threshold(pred: DataFrame, threshold: float | None) -> DataFrame:
    """What a frozen threshold gives: rows, automatic rows, errors among them, coverage of all rows and accuracy. None automates nothing."""
    auto = F.coalesce(F.col("confidence") >= threshold, F.lit(False)) if threshold is not None else F.lit(False)
    ok = F.coalesce("correct", F.lit(0))
    return pred.agg(F.count(F.lit(1)).alias("total_n"), F.count_if(auto).alias("n_auto"), F.coalesce(F.sum(F.when(auto, 1 - ok)), F.lit(0)).alias("n_errors"), F.avg(auto.cast("int")).alias("coverage"), F.avg(F.when(auto, ok)).alias("accuracy"))
