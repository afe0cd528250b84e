"""Contingency tables, stratified and pooled association, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_by_two(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))


def feature_portions(df: DataFrame, feature: str, target: Column) -> DataFrame:
    return df.groupBy(feature).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(target).alias("n_target"))


def association(df: DataFrame, feature: str, target: Column) -> DataFrame:
    """Per feature value against the rest: the four cells, odds ratio (null if undefined), relative
    risk.  Totals come from the counts, not from a second scan."""
    n = feature_portions(df, feature, target)
    t = n.agg(F.sum("n_all").alias("N"), F.sum("n_target").alias("T"))
    x = n.crossJoin(F.broadcast(t)).withColumns({
        "a": F.col("n_target"), "b": F.col("n_all") - F.col("n_target"), "c": F.col("T") - F.col("n_target"),
        "d": F.col("N") - F.col("T") - F.col("n_all") + F.col("n_target")})
    odds = (F.col("a") * F.col("d")).cast("double") / F.nullif((F.col("b") * F.col("c")).cast("double"), F.lit(0.0))
    risk = (F.col("a") / F.nullif(F.col("n_all"), F.lit(0))) / F.nullif(F.col("c") / F.nullif(F.col("N") - F.col("n_all"), F.lit(0)), F.lit(0.0))
    return x.select(feature, "a", "b", "c", "d", F.round(odds, 6).alias("odds_ratio"), F.round(risk, 6).alias("relative_risk"))


def stratified(df: DataFrame, stratum: str, exposed: Column, case: Column) -> DataFrame:
    return df.groupBy(stratum).agg(
        F.count_if(exposed & case).alias("a"), F.count_if(exposed & ~case).alias("b"),
        F.count_if(~exposed & case).alias("c"), F.count_if(~exposed & ~case).alias("d"))


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """Pooled odds ratio, risk ratio and chi-square (without correction) of strata a, b, c, d."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    t = tables.filter(n > 1).agg(
        F.sum(a * d / n).alias("ad"), F.sum(b * c / n).alias("bc"), F.sum(a * (c + d) / n).alias("e"), F.sum(c * (a + b) / n).alias("u"),
        F.sum(a - (a + b) * (a + c) / n).alias("diff"), F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("var"))
    return t.select(F.round(F.col("ad") / F.col("bc"), 6).alias("or_mh"), F.round(F.col("e") / F.col("u"), 6).alias("rr_mh"),
                    F.round(F.col("diff") * F.col("diff") / F.col("var"), 6).alias("chi2"))


def stratum_weights(df: DataFrame, stratum: str, case: Column) -> DataFrame:
    """Half of a stratum's share of cases for each class."""
    n = df.groupBy(stratum).agg(F.count_if(case).alias("cases"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("cases").alias("all_cases")))).select(
        stratum, F.round(F.col("cases") / F.col("all_cases") / 2, 6).alias("weight"))


def subtotals(df: DataFrame, group: str, fold: str) -> DataFrame:
    """Counts by group and fold, and by group ("sum")."""
    return df.rollup(group, fold).agg(F.count(F.lit(1)).alias("n"), F.grouping(group).alias("_g"), F.grouping(fold).alias("_f")).filter(
        "_g = 0").select(group, F.when(F.col("_f") == 1, "sum").otherwise(F.col(fold).cast("string")).alias(fold), "n")


def passing_fractions(df: DataFrame, group: str, fold: str, passed: Column, labels: list[str]) -> DataFrame:
    """Of each label the share of passed rows in its subtotal; 0 where it has none."""
    n = lambda c: subtotals(df.filter(c), group, fold).filter(F.col(fold) == "sum").select(group, "n")
    every = df.sparkSession.createDataFrame([(x,) for x in labels], f"{group} string")
    x = every.join(n(passed).withColumnRenamed("n", "_p"), group, "left").join(n(~passed).withColumnRenamed("n", "_f"), group, "left").fillna(0, ["_p", "_f"])
    return x.select(group, F.round(F.coalesce(F.col("_p") / F.nullif(F.col("_p") + F.col("_f"), F.lit(0)), F.lit(0.0)), 6).alias("fraction"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    n = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("t")
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).agg(F.round(F.sum(-p * F.log2(p)), 6).alias("entropy"))


def one_hot_dates(df: DataFrame, ts: str) -> DataFrame:
    """Quarters since 1970, and one column a quarter of the year."""
    q = (F.year(ts) - 1970) * 4 + F.quarter(ts) - 1
    return df.withColumns({"quarter": q, **{f"q{i}": (F.quarter(ts) == i).cast("int") for i in range(1, 5)}})


def bins(col: Column, size: int) -> Column:
    """int(v - 1) // size, null for missing."""
    return F.floor((F.floor(col) - 1) / size).cast("long")


def fit_logistic(df: DataFrame, features: list[str], label: str):
    """Logistic regression on a feature matrix; returns the fitted model."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=0.01, maxIter=50).fit(rows)
