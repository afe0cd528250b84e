"""Text: term matching, name folding, vocabulary match."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_match(cols: list[str], terms: list[str]) -> Column:
    """Whether any of the terms stands as a word in any of the columns, whatever the case.  Words end
    where ASCII letters, digits and underscores do, whatever the engine's own idea of a boundary."""
    pattern = r"(^|[^a-z0-9_])(" + "|".join(re.escape(t.lower()) for t in terms) + r")([^a-z0-9_]|$)"
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(F.lower(F.col(c)).rlike(pattern), F.lit(False))
    return out


#: Last words of names that span several molecules.
GENERIC = ("conjugate", "complex", "analog", "analogue", "compound", "derivative")


def fold_name(name: Column) -> Column:
    """Lower case; null for names of under three letters and for those whose last word is generic."""
    generic = name.endswith(" " + GENERIC[0])
    for word in GENERIC[1:]:
        generic = generic | name.endswith(" " + word)
    return F.when((F.length(name) >= 3) & ~generic, F.lower(name))


def wildcard(col: Column, pattern: str) -> Column:
    """% stands for anything; whole value, whatever the case."""
    return F.lower(col).rlike("^" + ".*".join(re.escape(p) for p in pattern.lower().split("%")) + "$")


def safe_name(col: Column) -> Column:
    return F.regexp_replace(col, r"[^A-Za-z0-9_.-]+", "_")


def tfidf_match(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, text) each: every target's best query by TF-IDF cosine over words.  Words are hashed to
    rows and joined on, so only pairs that share a word are made."""
    def words(df, name):
        w = F.explode(F.split(F.lower("text"), r"[^a-z0-9]+"))
        return df.select(F.col("id").alias(name), w.alias("w")).filter("w <> ''").groupBy(name, "w").agg(F.count(F.lit(1)).alias("tf"))

    q, t = words(queries, "q"), words(targets, "t")
    n = targets.count()
    idf = t.groupBy("w").agg((F.log((1.0 + n) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    def weigh(df, name):
        x = df.join(idf, "w").withColumn("x", F.col("tf") * F.col("idf"))
        return x.join(x.groupBy(name).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len")), name).select(name, "w", (F.col("x") / F.col("len")).alias("x"))

    a, b = weigh(q, "q"), weigh(t, "t").withColumnRenamed("x", "y")
    s = a.join(b, "w").groupBy("q", "t").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("cosine"))
    return s.groupBy("t").agg(F.max_by("q", F.struct("cosine", F.negative("q"))).alias("q"), F.max("cosine").alias("cosine"))
