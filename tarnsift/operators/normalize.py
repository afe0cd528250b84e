"""Normalisers of scores, and their combination.  NaN is dropped before statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked


def _stats(df: DataFrame) -> DataFrame:
    x = F.when(~F.isnan("score"), F.col("score"))
    return F.broadcast(df.agg(F.avg(x).alias("_avg"), F.stddev_pop(x).alias("_sd"), F.least(F.lit(0.0), F.min(x)).alias("_lo"), F.greatest(F.lit(0.0), F.max(x)).alias("_hi"), F.max(x).alias("_max")))


def z_norm(df: DataFrame) -> DataFrame:
    """(v - mean) / population deviation; a constant is divided by itself, or by 1 if it is 0."""
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).when(F.col("_max") != 0, F.col("_max")).otherwise(1.0)
    value = F.when(F.col("_sd") > 0, (F.col("score") - F.col("_avg")) / sd).otherwise(F.col("score") / sd)
    return df.crossJoin(_stats(df)).select("key", F.round(value, 6).alias("norm"))


def _mm():
    return F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)


def mm_norm(df: DataFrame) -> DataFrame:
    """Range that always holds 0; spread 0 gives 0."""
    return df.crossJoin(_stats(df)).select("key", F.round(_mm(), 6).alias("norm"))


def lmm_norm(df: DataFrame) -> DataFrame:
    return df.crossJoin(_stats(df)).select("key", F.round(-F.log10(1 - _mm() * 0.9999) / 4, 6).alias("norm"))


def weighted_combine(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """long: (key, name, norm).  Weighted sums, NaN and missing as 0, shifted so that the least is 0."""
    w = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("name"))
    sums = long.filter(F.col("name").isin(list(weights))).groupBy("key").agg(F.sum(F.nanvl("norm", F.lit(0.0)) * w).alias("s"))
    return sums.crossJoin(F.broadcast(sums.agg(F.min("s").alias("_least")))).select("key", F.round(F.col("s") - F.col("_least"), 10).alias("combined"))


def calibrate(df: DataFrame, points: list[tuple[float, float]]) -> DataFrame:
    """1 - p by linear interpolation of (raw, p); below the first 0.99 of its p, past the last its p."""
    x, raw = F.col("score"), sorted(points)
    p = F.when(F.isnan(x), 1.0).when(x < raw[0][0], 0.99 * raw[0][1])
    for (a, pa), (b, pb) in zip(raw, raw[1:]):
        p = p.when(x < b, pa + (x - a) / (b - a) * (pb - pa))
    return df.select("key", F.round(1 - p.otherwise(raw[-1][1]), 6).alias("calibrated"))


def category(x, low: float, high: float):
    """Low up to low, Med up to high, else High; null for null."""
    return F.when(x <= low, "Low").when(x <= high, "Med").when(x.isNotNull(), "High")


def lerp(x, low: float, high: float, low_score: float, high_score: float):
    """Linear between two ends, clipped; missing gives the low score."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return F.coalesce(low_score + t * (high_score - low_score), F.lit(float(low_score)))


def rank_norm(df: DataFrame) -> DataFrame:
    """The rank, from 1, of ties the middle of their block."""
    return ranked(df.select("key", "score")).select("key", F.col("rank").cast("double").alias("norm"))


def pct_norm(df: DataFrame) -> DataFrame:
    """100 less the rank in percent of all: more is better."""
    return ranked(df.select("key", "score")).select("key", F.round(100 - F.col("rank") * 100.0 / F.col("total"), 6).alias("norm"))


def target_norm(df: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: (key, target).  A target has the least score of its keys; a key the best rank of its targets."""
    pairs = targets.distinct()
    scores = df.select("key", "score").join(pairs, "key").groupBy(F.col("target").alias("key")).agg(F.min("score").alias("score"))
    ranks = ranked(scores).select(F.col("key").alias("target"), "rank")
    return df.select("key").join(pairs, "key").join(ranks, "target").groupBy("key").agg(F.min("rank").cast("double").alias("norm"))


def _of_name(values: dict[str, float]):
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("name"))


def floor_combine(long: DataFrame, weights: dict[str, float], floors: dict[str, float]) -> DataFrame:
    """long: (key, name, norm).  Weighted sums of norms above a floor for each name, stretched to 0 to 1."""
    floor = _of_name(floors)
    value = F.greatest(F.col("norm") - floor, F.lit(0.0)) / (1 - floor)
    return long.filter(F.col("name").isin(list(weights))).groupBy("key").agg(F.round(F.sum(_of_name(weights) * value), 6).alias("combined"))


def sigmoid_combine(long: DataFrame, weights: dict[str, float], middles: dict[str, float], widths: dict[str, float]) -> DataFrame:
    """long: (key, name, norm).  Weighted sums of sigma((norm - middle) / width) with a middle and width for each name."""
    value = 1 / (1 + F.exp(-(F.col("norm") - _of_name(middles)) / _of_name(widths)))
    return long.filter(F.col("name").isin(list(weights))).groupBy("key").agg(F.round(F.sum(_of_name(weights) * value), 6).alias("combined"))


def weighted_columns(long: DataFrame, weights: dict[str, float]) -> DataFrame:
    """long: (key, name, norm) of the names that have a weight, by it; names compare without case."""
    lower = {k.lower(): v for k, v in weights.items()}
    x = long.withColumn("name", F.lower("name")).filter(F.col("name").isin(list(lower)))
    return x.select("key", "name", F.round(F.col("norm") * _of_name(lower), 6).alias("weighted"))


def pair_boosts(wide: DataFrame, names: list[str], metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """wide: (key, is_kt, a column a name).  For each two names the metric of (a + b) / 2 and of a + b - ab, less that
    of the better one alone.  Names are few: the plan has a branch a pair."""
    def of(score, *labels):
        m = metric(wide.select("key", score.alias("score"), "is_kt"))
        return m.select(*[F.lit(v).alias(n) for n, v in labels], F.col(m.columns[0]).alias("m"))

    single = reduce(DataFrame.unionByName, [of(F.col(n), ("f", n)) for n in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    ways = {"added": lambda a, b: (F.col(a) + F.col(b)) / 2, "multiplied": lambda a, b: F.col(a) + F.col(b) - F.col(a) * F.col(b)}
    both = reduce(DataFrame.unionByName, [of(f(a, b), ("f1", a), ("f2", b), ("way", w)) for a, b in pairs for w, f in ways.items()])
    x, y = (single.select(F.col("f").alias(f"f{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    return both.join(x, "f1").join(y, "f2").select("f1", "f2", "way", F.round(F.col("m") - F.greatest("m1", "m2"), 6).alias("boost"))
