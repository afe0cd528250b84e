"""Enrichment metrics of orderings (key, score, is_kt) against labelled keys.  Each gives one row."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import cut
from .prefix import least_from_above, running
from .ranking import score_blocks, tie_ranks

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def metric(name: str):
    """Registers a metric; others can add their own."""

    def add(f):
        METRICS[name] = f
        return f

    return add


def _steps(df: DataFrame) -> DataFrame:
    """One row a distinct score: n, hits and their sums from the best score to it."""
    n = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_kt").alias("hits"))
    x = running(n, "score", {"cum_n": "n", "cum_hits": "hits"})
    return x.withColumns({"cum_n": F.col("cum_n") + F.col("n"), "cum_hits": F.col("cum_hits") + F.col("hits")})


@metric("auroc")
def auroc(df: DataFrame) -> DataFrame:
    """Area under the ROC curve with mid-ranks; 0 without hits or misses."""
    s = _steps(df)
    t = s.agg(F.sum("hits").alias("p"), F.sum("n").alias("n"),
              F.sum(F.col("hits") * (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0)).alias("ranks"))
    p, m = F.col("p"), F.col("n") - F.col("p")
    # ranks are from the best; the least sum of ranks is best
    area = 1.0 - (F.col("ranks") - p * (p + 1) / 2.0) / (p * m)
    return t.select(F.round(F.when((p > 0) & (m > 0), area).otherwise(0.0), 6).alias("auroc"))


@metric("average_precision")
def average_precision(df: DataFrame) -> DataFrame:
    s = _steps(df)
    return s.agg(F.round(F.coalesce(F.sum(F.col("hits") * F.col("cum_hits") / F.col("cum_n")) / F.when(F.sum("hits") > 0, F.sum("hits")), F.lit(0.0)), 6).alias("aps"))


def sigma_of_rank(df: DataFrame, center: float, width: float, name: str) -> DataFrame:
    """Mean over all labelled keys of sigma((center - rank) / (width / 2)); absent ones count 0."""
    r = tie_ranks(df).select((1 / (1 + F.exp(-(center - F.col("tie_rank")) / (width / 2.0)))).alias("s"))
    n = df.agg(F.count_if("is_kt").alias("kts"))
    return r.agg(F.sum("s").alias("s")).crossJoin(n).select(F.round(F.coalesce(F.col("s") / F.col("kts"), F.lit(0.0)), 6).alias(name))


@metric("sor")
def sor(df: DataFrame) -> DataFrame:
    return sigma_of_rank(df, 200, 100, "sor")


@metric("sor1000")
def sor1000(df: DataFrame) -> DataFrame:
    return sigma_of_rank(df, 800, 200, "sor1000")


@metric("rank_rating")
def rank_rating(df: DataFrame) -> DataFrame:
    return tie_ranks(df).agg(F.round(-F.avg("tie_rank"), 6).alias("rank_rating"))


@metric("score_rating")
def score_rating(df: DataFrame, index: int = 800) -> DataFrame:
    """Mean over labelled keys of min(1, score / the score at 0-based index, or the last)."""
    top = df.select("score").orderBy(F.col("score").desc()).limit(index + 1).agg(F.min("score").alias("target"))
    return df.filter("is_kt").crossJoin(F.broadcast(top)).agg(
        F.round(F.avg(F.least(F.lit(1.0), F.col("score") / F.col("target"))), 6).alias("score_rating"))


@metric("sigma_portion")
def sigma_portion(df: DataFrame, center: float = 1000, width: float = 200, weighted: bool = False, name: str = "sigma_portion") -> DataFrame:
    """Share of the sigma weights of all ranks, by score if weighted, that labelled keys hold.  Ranks are from 0, of
    tied keys the middle of their block."""
    b = score_blocks(df)
    sigma = 1 / (1 + F.exp(-(center - (F.col("ahead") + F.floor(F.col("tied") / 2))) / (width / 2.0)))
    x = df.join(b, "score").withColumn("s", sigma * F.col("score") if weighted else sigma)
    return x.agg(F.round(F.sum(F.when(F.col("is_kt"), F.col("s")).otherwise(0.0)) / F.sum("s"), 6).alias(name))


@metric("sigma_portion_100")
def sigma_portion_100(df: DataFrame) -> DataFrame:
    return sigma_portion(df, 100, 20, name="sigma_portion_100")


@metric("sigma_portion_weighted")
def sigma_portion_weighted(df: DataFrame) -> DataFrame:
    return sigma_portion(df, weighted=True, name="sigma_portion_weighted")


@metric("sigma_portion_weighted_100")
def sigma_portion_weighted_100(df: DataFrame) -> DataFrame:
    return sigma_portion(df, 100, 20, True, "sigma_portion_weighted_100")


@metric("sor1000_continuous")
def sor1000_continuous(df: DataFrame) -> DataFrame:
    """sor1000 and a hundredth of score_rating."""
    return sor1000(df).crossJoin(score_rating(df)).select(F.round(F.col("sor1000") + 0.01 * F.col("score_rating"), 6).alias("sor1000_continuous"))


@metric("running_es")
def running_es(df: DataFrame) -> DataFrame:
    """Running enrichment: hits up by their share of |score|, misses down evenly; the extreme of
    larger magnitude, the upper one of equals.  Tied scores are one step."""
    n = df.groupBy("score").agg(F.count_if("is_kt").alias("h"), F.count_if(~F.col("is_kt")).alias("m"))
    t = n.agg(F.sum(F.col("h") * F.abs("score")).alias("hw"), F.sum("m").alias("mw"))
    x = n.crossJoin(F.broadcast(t))
    step = F.coalesce(F.col("h") * F.abs("score") / F.nullif("hw", F.lit(0.0)), F.lit(0.0)) - F.coalesce(F.col("m") / F.nullif("mw", F.lit(0)), F.lit(0.0))
    run = running(x.select("score", step.alias("step")), "score", {"ahead": "step"})
    e = run.select((F.col("ahead") + F.col("step")).alias("res")).agg(F.greatest(F.max("res"), F.lit(0.0)).alias("hi"), F.least(F.min("res"), F.lit(0.0)).alias("lo"))
    return e.select(F.round(F.when(F.col("hi") >= -F.col("lo"), F.col("hi")).otherwise(F.col("lo")), 6).alias("es"))


def _series(x: np.ndarray) -> np.ndarray:
    """Log factorials by Stirling's series, to double precision from 256 on."""
    return x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)


#: Log factorials of 0 to 65,535: sums of logs below 256, then the series.
_SMALL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256))), _series(np.arange(256, 65_536, dtype=float))])


def log_factorial(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, np.int64)
    if n.size and n.max() < len(_SMALL):
        return _SMALL[n]
    return np.where(n < len(_SMALL), _SMALL[np.minimum(n, len(_SMALL) - 1)], _series(np.maximum(n, 256).astype(float)))


#: Terms of a Fisher p that are summed at once: first, and at most.
TERMS, MOST_TERMS = 64, 65_536


def fisher_greater(a: np.ndarray, row: np.ndarray, col: np.ndarray, total: np.ndarray) -> np.ndarray:
    """P(overlap >= a) of a hypergeometric, with fixed margins, by log factorials.  Terms past the likeliest
    overlap only fall, so a sum ends where they no longer add to it."""
    base = sum(log_factorial(x) for x in (row, total - row, col, total - col)) - log_factorial(total)
    out = np.zeros(len(a))
    for i, (first, r, c, n) in enumerate(zip(a.tolist(), row.tolist(), col.tolist(), total.tolist())):
        first, end, top = max(first, r + c - n, 0), min(r, c) + 1, (r + 1) * (c + 1) // (n + 2)
        step = TERMS
        while first < end:
            x = np.arange(first, min(first + step, end))
            part = np.exp(base[i] - log_factorial(x) - log_factorial(r - x) - log_factorial(c - x) - log_factorial(n - r - c + x))
            out[i] += part.sum()
            first, step = first + step, min(2 * step, MOST_TERMS)
            if first > top and part[-1] * (end - first) < out[i] * 1e-17:
                break
    return np.minimum(out, 1.0)


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, row: pd.Series, col: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(fisher_greater(a.to_numpy(), row.to_numpy(), col.to_numpy(), total.to_numpy()))


def bh_fdr(df: DataFrame, key: str = "key", p: str = "p") -> DataFrame:
    """Benjamini-Hochberg q: least p * n / rank from the largest p on, at most 1.  Equal p have equal q; a null
    p is no test and its q is null."""
    places = running(df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n")), "_p", {"_below": "_n"}, descending=False)
    total = F.broadcast(df.agg(F.count(p).alias("_total")))
    x = places.crossJoin(total).withColumn("_x", F.col("_p") * F.col("_total") / (F.col("_below") + F.col("_n")))
    q = least_from_above(x, "_p", "_x", "_q").select("_p", "_q")
    return df.join(q, F.col(p) == F.col("_p"), "left").withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_q")))).drop("_p", "_q")


def place_tests(df: DataFrame) -> DataFrame:
    """One-sided Fisher tests at the tie-adjusted places (from 0) of hits and the places right before them: place,
    found (hits up to there), kts, total, p and Benjamini-Hochberg q.  p of 0 becomes the least double above it."""
    blocks = running(df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_kt").alias("hits")), "score", {"start": "n", "before": "hits"}).filter("hits > 0")
    first = F.col("start") + F.floor((F.col("n") - F.col("hits")) / 2)
    # hits of a block are side by side, so its places are a run, with the one right before it
    i = F.explode(F.sequence(F.lit(0), F.col("hits"))).alias("i")
    at = blocks.select(first.alias("first"), "before", i).select((F.col("first") + F.col("i") - 1).cast("long").alias("place"), (F.col("before") + F.col("i")).alias("found"))
    t = df.agg(F.count_if("is_kt").alias("kts"), F.count(F.lit(1)).alias("total"))
    p = at.filter("place >= 0").distinct().crossJoin(F.broadcast(t))
    return bh_fdr(p.withColumn("p", F.greatest(fisher_p("found", F.col("place") + 1, "kts", "total"), F.lit(5e-324))), "place")


@metric("febe")
def febe(df: DataFrame) -> DataFrame:
    """Largest -log10 q of place_tests; 0 without hits."""
    return place_tests(df).agg(F.round(F.coalesce(-F.log10(F.min("q")), F.lit(0.0)), 6).alias("febe"))


@metric("wfebe")
def wfebe(df: DataFrame) -> DataFrame:
    """As febe, each value by the share of the ordering from its place on; 0 without hits."""
    return place_tests(df).agg(F.round(F.coalesce(F.max(-F.log10("q") * (1 - F.col("place") / F.col("total"))), F.lit(0.0)), 6).alias("wfebe"))


#: What is added to the smallest cells of a table whose odds ratio has a zero divisor.  Fixed value.
BUMP = 0.1


@metric("glf")
def glf(df: DataFrame) -> DataFrame:
    """Largest log2 odds ratio of place_tests by the share of the ordering from its place on; 0 without hits.

    Where the ratio is not finite, zeros and the least other cell get BUMP more, larger cells their even share of it."""
    cells = [F.col("found"), F.col("total") - F.col("kts") - F.col("place") - 1 + F.col("found"), F.col("place") + 1 - F.col("found"), F.col("kts") - F.col("found")]
    x = place_tests(df).select("place", "total", *[c.cast("double").alias(n) for c, n in zip(cells, "abcd")])
    x = x.withColumn("least", F.least(*[F.when(F.col(n) > 0, F.col(n)) for n in "abcd"]))
    raised = {n: F.when(F.col("c") * F.col("d") > 0, F.col(n)).when(F.col(n) <= F.col("least"), F.col(n) + BUMP).otherwise(F.col(n) * (1 + BUMP / (F.col("least") + BUMP))) for n in "abcd"}
    odds = x.withColumns(raised).withColumn("odds", F.col("a") * F.col("b") / (F.col("c") * F.col("d")))
    value = F.when(F.col("odds") == 0, 0.0).otherwise(F.log2("odds")) * (1 - F.col("place") / F.col("total"))
    return odds.agg(F.round(F.coalesce(F.max(value), F.lit(0.0)), 6).alias("glf"))


#: Draws of a task, and drawn places that are held at once.
DRAWS, HELD = 2000, 40_000
#: Partitions that the tasks of draws are dealt to at least; adaptive execution would join them, as their rows are small.
DRAW_TASKS = 96


def _drawn(g: np.random.Generator, n: int, k: int, rows: int) -> np.ndarray:
    """rows sorted draws of k of n places without repeats, all sets of k places alike.

    Where k is small against n, some more places are drawn with repeats: the distinct ones are a uniform set of their
    number, and what is over of them is left out at random."""
    if k > n // 8 or k < 16:
        return np.sort(np.stack([g.choice(n, k, replace=False, shuffle=False) for _ in range(rows)]), axis=1)
    more = -n * math.log1p(-k / n)  # so many draws have k distinct places in the mean
    size, out, found = math.ceil(more + 3 * math.sqrt(more * k / n) + 3), np.empty((rows, k), np.int64), 0
    while found < rows:
        at = np.sort(g.integers(0, n, (rows - found, size), dtype=np.int32), axis=1)
        keep = np.ones(at.shape, bool)
        keep[:, 1:] = at[:, 1:] != at[:, :-1]
        distinct = keep.sum(1)
        enough = np.flatnonzero(distinct >= k)
        at, keep, over = at[enough], keep[enough], distinct[enough] - k
        for row, few in zip(keep, over.tolist()):
            if few:
                own = np.flatnonzero(row)
                row[own[g.choice(len(own), few, replace=False, shuffle=False)]] = False
        out[found:found + len(at)] = at[keep].reshape(len(at), k)
        found += len(at)
    return out


def _peaks(at: np.ndarray, up: np.ndarray, n: int, drawn: bool) -> np.ndarray:
    """Extremes of larger magnitude of running sums, a row each: up at the sorted places at, misses down evenly.
    As in the reference, hits without weight count as misses where they are drawn."""
    if drawn and not up.all():
        hit = up > 0
        after = np.cumsum(up, axis=1) - (at - np.cumsum(hit, axis=1) + hit) / max(n - at.shape[1], 1)
        hi, lo = np.where(hit, after, 0).max(axis=1).clip(0), np.where(hit, after - up, 0).min(axis=1).clip(None, 0)
    else:
        after = np.cumsum(up, axis=1) - (at - np.arange(at.shape[1])) / max(n - at.shape[1], 1)
        hi, lo = after.max(axis=1).clip(0), (after - up).min(axis=1).clip(None, 0)
    return np.where(hi >= -lo, hi, lo)


def median_interval(y: np.ndarray, alpha: float) -> tuple[float, float, float]:
    """Median, and the ends of Olive's interval, the upper one first; Student's quantile by its expansion in 1 / df."""
    y, n = np.sort(y), len(y)
    low = max(n // 2 - math.ceil(math.sqrt(n / 4)), 0)
    up = n - low
    d, z = max(up - low - 1, 1), NormalDist().inv_cdf(1 - alpha / 2)
    t = z + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * d**3)
    half = t * 0.5 * (y[up - 1] - y[low])
    return float(np.median(y)), float(np.median(y) + half), float(np.median(y) - half)


def set_enrichment(members: DataFrame, ordering: DataFrame, permutations: int = 100_000, seed: int = 1, weight: float = 3.0, alpha: float = 0.05) -> DataFrame:
    """members: (set, key); ordering: (key, score).  Running enrichment of each set with hits by their share of
    |score| ** weight, its normalised value with an interval, p (at least 1 / permutations) against index sets
    drawn by a seed of the set, and Benjamini-Hochberg q.  One task for each DRAWS of a set; a set without weight has
    es 0 and p 1.

    As the reference's GLEE, draws take the set's own norm; the median is the true one, where that is a place off."""
    place = ordering.withColumn("i", F.row_number().over(Window.orderBy(F.col("score").desc(), "key")) - 1)
    n = ordering.count()
    w = np.array([abs(r.score) for r in place.select("i", "score").orderBy("i").collect()], float) ** weight

    def real(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(pdf["i"].to_numpy())
        total = w[own].sum()
        es = float(_peaks(own[None], w[own][None] / total, n, False)[0]) if total else 0.0
        return pd.DataFrame({"set": pdf["set"].iloc[:1], "n": [len(own)], "total": [total], "es": [es]})

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        name, k, total, first = pdf["set"].iloc[0], int(pdf["n"].iloc[0]), pdf["total"].iloc[0], int(pdf["first"].iloc[0])
        g, null, left = np.random.default_rng([seed, first, *str(name).encode()]), [], min(DRAWS, permutations - first)
        share = w / total
        while left:
            at = _drawn(g, n, k, min(left, max(1, HELD // k)))
            null.append(_peaks(at, share[at], n, True))
            left -= len(at)
        return pd.DataFrame({"set": [name], "n": [k], "es": pdf["es"].iloc[:1], "first": [first], "null": [np.concatenate(null).tobytes()]})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name, k, es = pdf["set"].iloc[0], int(pdf["n"].iloc[0]), float(pdf["es"].iloc[0])
        if pdf["null"].isna().any():
            return pd.DataFrame({"set": [name], "n": [k], "es": [0.0], "nes": [0.0], "nes_lower": [0.0], "nes_upper": [0.0], "p": [1.0]})
        null = np.concatenate([np.frombuffer(x) for x in pdf.sort_values("first")["null"]])
        p = max(float((null < es).mean() if es < 0 else (null > es).mean()), 1 / permutations)
        sign = float(np.sign(es))
        least = 2 / max(n - k, 1) * sign
        mid, high, low = median_interval(null, alpha)
        if {np.sign(mid), np.sign(high), np.sign(low)} == {sign}:
            shift = least
        elif abs(es - high) > abs(es - low):
            shift = abs(high) * sign
        else:
            shift = (abs(low) + abs(least)) * sign
        nes, *ends = ((es + shift) / (x + shift) * sign if x + shift else 0.0 for x in (mid, high, low))
        return pd.DataFrame({"set": [name], "n": [k], "es": [es], "nes": [nes], "nes_lower": [min(ends)], "nes_upper": [max(ends)], "p": [p]})

    kind = members.schema["set"].dataType.simpleString()
    sets = cut(members.join(place.select("key", "i"), "key").groupBy("set").applyInPandas(real, f"set {kind}, n long, total double, es double"))
    tasks = sets.filter("total > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(DRAWS))))
    null = tasks.repartition(DRAW_TASKS, "set", "first").groupBy("set", "first").applyInPandas(draw, f"set {kind}, n long, es double, first int, null binary")
    rest = sets.filter("not total > 0").select("set", "n", "es", F.lit(0).alias("first"), F.lit(None).cast("binary").alias("null"))
    found = null.unionByName(rest).groupBy("set").applyInPandas(one, "set string, n long, es double, nes double, nes_lower double, nes_upper double, p double")
    return bh_fdr(found, "set")
