"""Orderings (key, score): ranks with exact tie rules.

Missing scores are not zero.  NaN ranks as minus infinity.  Ranks come from sums over distinct scores
(prefix.py); ties in row order go by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def nan_last(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.when(F.isnan("score"), float("-inf")).otherwise(F.col("score")))


def score_blocks(df: DataFrame) -> DataFrame:
    """One row a distinct score: n tied and ahead strictly above, from one aggregate; the running sum
    is over distinct scores, not rows."""
    return running(df.groupBy("score").agg(F.count(F.lit(1)).alias("tied")), "score", {"ahead": "tied"})


def ranked(df: DataFrame) -> DataFrame:
    """ahead, tied, behind, rank (middle of the tied block) and pct (share at or above, in percent)."""
    blocks = score_blocks(df)
    total = blocks.agg(F.sum("tied").alias("total"))
    rows = df.join(blocks, "score").crossJoin(F.broadcast(total))
    return rows.withColumns({
        "behind": F.col("total") - F.col("ahead") - F.col("tied"),
        "rank": 1 + F.col("ahead") + F.floor(F.col("tied") / 2),
        "pct": F.round(100.0 * (F.col("ahead") + F.col("tied")) / F.col("total"), 6),
    })


def tie_ranks(df: DataFrame) -> DataFrame:
    """Rows with is_kt: their 0-based ranks, packed in the middle of each tied block."""
    blocks = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_kt").alias("hits"))
    blocks = running(blocks, "score", {"start": "n"})
    hit = df.filter("is_kt").withColumn("_i", F.row_number().over(Window.partitionBy("score").orderBy("key")) - 1)
    return hit.join(blocks, "score").select(
        "key", "score", (F.col("start") + F.floor((F.col("n") - F.col("hits")) / 2) + F.col("_i")).cast("long").alias("tie_rank"))


def hit_cdf(df: DataFrame) -> DataFrame:
    """Steps of cumulative hits by rank: in a block half the misses, all hits, the rest."""
    blocks = df.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_kt").alias("hits"))
    blocks = running(blocks, "score", {"start": "n", "before": "hits"})
    return blocks.filter("hits > 0").select(
        "score", (F.col("start") + F.floor((F.col("n") - F.col("hits")) / 2)).cast("long").alias("first_rank"),
        F.col("before").alias("hits_before"), (F.col("before") + F.col("hits")).alias("hits_after"))


def topn_linear(df: DataFrame, n: int) -> DataFrame:
    value = F.greatest(F.lit(0.0), (n - F.col("ahead") - F.col("tied") / 2) / n)
    return df.join(score_blocks(df), "score").select("key", F.round(F.when(F.col("ahead") < n, value).otherwise(0.0), 6).alias("value"))


def floor_corrected(df: DataFrame, n: int) -> DataFrame:
    """Scores above that of the n-th row, less it; others 0."""
    floor = df.orderBy(F.col("score").desc(), "key").limit(n).agg(F.min("score").alias("floor"))
    return df.crossJoin(F.broadcast(floor)).select("key", F.round(F.greatest(F.col("score") - F.col("floor"), F.lit(0.0)), 6).alias("value"))


def fill_universe(df: DataFrame, universe: DataFrame) -> DataFrame:
    """Missing keys with the least score, at most 0."""
    last = df.agg(F.least(F.min("score"), F.lit(0.0)).alias("score"))
    return df.select("key", "score").unionByName(universe.select("key").distinct().join(df.select("key"), "key", "left_anti").crossJoin(F.broadcast(last)))


def condense(df: DataFrame, by_score: bool = True) -> DataFrame:
    """The first key of each group (and score); keys with required stay."""
    own = Window.partitionBy("group", *(["score"] if by_score else [])).orderBy(F.col("score").desc(), "key")
    return df.withColumn("_i", F.row_number().over(own)).filter((F.col("_i") == 1) | F.col("required")).drop("_i")


def rank_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rank less new rank over all keys; a missing key ranks behind all."""
    a, b = (ranked(x).select("key", F.col("rank").alias(n)) for x, n in ((old, "old"), (new, "new")))
    last = old.agg((F.count(F.lit(1)) + 1).alias("old_last")).crossJoin(new.agg((F.count(F.lit(1)) + 1).alias("new_last")))
    both = a.join(b, "key", "full_outer").crossJoin(F.broadcast(last))
    return both.select("key", (F.coalesce("old", "old_last") - F.coalesce("new", "new_last")).cast("long").alias("delta"))


def page(df: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start to start + size of the ordering, with their places."""
    top = df.orderBy(F.col("score").desc(), "key").limit(start + size)
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "key")) - 1
    return top.withColumn("idx", place.cast("long")).filter(F.col("idx") >= start)


def average_percentile(orderings: DataFrame) -> DataFrame:
    """orderings: (job, key, score): mean and median over all jobs of 1 - (rank - 1) / last rank, absent 0.  Jobs are
    few: a key's values are one array."""
    own = Window.partitionBy("job").orderBy(F.col("score").desc())
    ranks = orderings.withColumn("r", F.rank().over(own)).withColumn("m", F.max("r").over(Window.partitionBy("job")))
    jobs = orderings.agg(F.count_distinct("job").alias("jobs"))
    value = 1 - (F.col("r") - 1) / F.col("m")
    keys = ranks.groupBy("key").agg(F.sum(value).alias("s"), F.collect_list(value).alias("v")).crossJoin(F.broadcast(jobs))
    every = F.sort_array(F.concat("v", F.array_repeat(F.lit(0.0), (F.col("jobs") - F.size("v")).cast("int"))))
    middle = [F.element_at(every, (F.floor((F.col("jobs") + i) / 2)).cast("int")) for i in (1, 2)]
    return keys.select("key", F.round(F.col("s") / F.col("jobs"), 6).alias("apr"), F.round((middle[0] + middle[1]) / 2, 6).alias("median"))


def label_ranks(df: DataFrame, center: float = 200, width: float = 100) -> DataFrame:
    """Over labelled keys the mean rank and the mean of sigma((center - rank) / (width / 2)); null without any."""
    r = ranked(df).filter("is_kt")
    return r.agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.avg(1 / (1 + F.exp(-(center - F.col("rank")) / (width / 2)))), 6).alias("mean_sigma"))
