"""Cleaning of values and screening of candidates.  A null value meets no rule unless a docstring says so."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Suffix of structure keys without stereochemistry, and the length of their skeleton.  Fixed values.
GENERIC_SUFFIX, SKELETON = "-UHFFFAOYSA-N", 14

#: Trial phases by number; any other name is 0.  Fixed values.
PHASES = {"Phase 3": 3, "Phase 2": 2, "Phase 2/Phase 3": 2, "Phase 1": 1, "Phase 1/Phase 2": 1, "Phase 4": 1}

#: What unnamed uses of a drug are folded to.  Fixed value.
UNKNOWN = "unknown indication"


def medcouple(values: np.ndarray) -> float:
    """Robust skewness of values, -1 to 1, from all pairs across the median: for a bounded sample."""
    x = np.sort(np.asarray(values, float))
    mid = float(np.median(x))
    up, low = x[x >= mid][::-1] - mid, x[x <= mid] - mid
    total = up[:, None] - low[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        h = (up[:, None] + low[None]) / total
    # pairs of values at the median count by their places
    ties = int((up == 0).sum())
    if ties:
        i = np.arange(ties)
        h[len(up) - ties:, len(low) - ties:] = np.sign(ties - 1 - (i[:, None] + i[None]))
    return float(np.median(h))


def remove_outliers(df: DataFrame, skewness: float, value: str = "value") -> DataFrame:
    """Values above 0 and below q3 + 1.5 exp(3 skewness) (q3 - q1) of all values; skewness is a medcouple, not negative."""
    if not skewness >= 0:
        raise ValueError("skewness must not be negative")
    q = F.broadcast(df.agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q")))
    ceiling = F.col("_q")[1] + 1.5 * math.exp(3 * skewness) * (F.col("_q")[1] - F.col("_q")[0])
    return df.crossJoin(q).filter((F.col(value) > 0) & (F.col(value) < ceiling)).drop("_q")


def fold_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct (key, value), stripped; any value that names an unknown indication is that alone."""
    v = F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))
    return df.select(key, F.when(v.contains(UNKNOWN), UNKNOWN).otherwise(v).alias(value)).distinct()


def last_doses(df: DataFrame, keys: list[str], amount: str, texts: list[str], order: str) -> DataFrame:
    """The last row of each keys by order; amounts that are no number are null.  Texts become whole numbers in the
    order in which they are first seen, missing and empty ones 0.  Distinct texts must be few: they are numbered in one task."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(order, amount, *texts), order).alias("_r")).select(*keys, "_r.*")
    out = last.withColumn(amount, F.expr(f"try_cast(`{amount}` as double)"))
    for t in texts:
        seen = df.filter(F.coalesce(F.col(t), F.lit("")) != "").groupBy(F.col(t).alias("_t")).agg(F.min(order).alias("_first"))
        codes = seen.select("_t", F.row_number().over(Window.orderBy("_first", "_t")).alias("_code"))
        out = out.join(codes, F.col(t) == F.col("_t"), "left").withColumn(t, F.coalesce("_code", F.lit(0))).drop("_t", "_code")
    return out.drop(order)


def distinct_titles(df: DataFrame, place: str = "place") -> DataFrame:
    """Rows (title, full_name, targets, place).  A row with its title's previous targets goes; where a title has
    several rows left, they take their full names."""
    own = Window.partitionBy("title").orderBy(place)
    new = (F.row_number().over(own) == 1) | ~F.col("targets").eqNullSafe(F.lag("targets").over(own))
    left = df.withColumn("_new", new).filter("_new").drop("_new")
    several = F.count(F.lit(1)).over(Window.partitionBy("title")) > 1
    return left.withColumn("_name", F.when(several, F.col("full_name")).otherwise(F.col("title"))).drop("title").withColumnRenamed("_name", "title")


def drop_generic_keys(df: DataFrame, group: str, key: str) -> DataFrame:
    """Without structure keys of the generic suffix whose skeleton another key of their group has with a suffix of its own."""
    head = F.substring(key, 1, SKELETON)
    generic = F.coalesce(F.col(key).endswith(GENERIC_SUFFIX), F.lit(False))
    full = F.count_if(~generic).over(Window.partitionBy(group, head))
    return df.withColumn("_full", full).filter(~generic | (F.col("_full") == 0)).drop("_full")


def phase_number(name: Column) -> Column:
    """Null is 0."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair]), name)
    return F.coalesce(F.when(name.isNotNull(), found), F.lit(0))


def alpha_then_int(text: Column) -> Column:
    """A sort key: texts first, in order, then whole numbers by size."""
    digits = F.regexp_replace(F.trim(text), "_", "")
    number = F.when(text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), digits.try_cast("decimal(38,0)"))
    return F.struct(number.isNotNull().alias("is_int"), number.alias("number"), F.when(number.isNull(), text).alias("text"))


def merge_maps(first: Column, *others: Column) -> Column:
    """Entries of all; the last map that has a key gives its value."""
    for other in others:
        first = F.map_concat(subtract_map(first, F.map_keys(other)), other)
    return first


def subset_map(of: Column, keys: Column) -> Column:
    return F.map_filter(of, lambda k, _: F.array_contains(keys, k))


def subtract_map(of: Column, keys: Column) -> Column:
    return F.map_filter(of, lambda k, _: ~F.array_contains(keys, k))


def modify_map(of: Column, template: Column) -> Column:
    """merge_maps, where a null of the template drops its key."""
    return F.map_concat(subtract_map(of, F.map_keys(template)), F.map_filter(template, lambda _, v: v.isNotNull()))


def screen(drugs: DataFrame, labels: DataFrame, unwanted: list[str], unclassified: list[str]) -> DataFrame:
    """drugs: (drug, ubiquitous, indication), labels: (drug, labels), an array a source.  Without ubiquitous drugs and
    drugs all of whose arrays hold an unwanted label; but drugs whose indication is classified stay.  Drugs without
    arrays are not unwanted; a null indication is classified."""
    bad = labels.groupBy("drug").agg(F.bool_and(F.coalesce(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in unwanted])), F.lit(False))).alias("_bad"))
    x = drugs.join(bad, "drug", "left")
    goes = (F.coalesce("ubiquitous", F.lit(False)) | F.coalesce("_bad", F.lit(False))) & F.coalesce(F.col("indication").isin(unclassified), F.lit(False))
    return x.filter(~goes).drop("_bad")


def smooth(df: DataFrame, group: str, order: str, value: str, kernel: list[float], center: int) -> DataFrame:
    """Convolution of each group's values in order with a kernel divided by its sum (as it is, if that is 0);
    beyond the ends values are 0.  One row a row."""
    own, total = Window.partitionBy(group).orderBy(order), sum(kernel) or 1.0
    terms = [F.coalesce(F.lead(value, center - k).over(own), F.lit(0.0)) * (weight / total) for k, weight in enumerate(kernel)]
    return df.withColumn("smoothed", sum(terms[1:], terms[0]))


def stable_mean(value: Column | str) -> Column:
    """The mean; of equal values that value itself, whatever rounding makes of their sum."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.avg(value))


def log_odds(odds: Column, least: float = 1e-4, most: float = 1e4) -> Column:
    """Natural log of odds within bounds; NaN and null count as 0, so as the lower bound."""
    return F.log(F.greatest(F.lit(least), F.least(F.lit(most), F.nanvl(F.coalesce(odds, F.lit(0.0)), F.lit(0.0)))))


def directional(evidence: Column, direction: Column) -> Column:
    """evidence by direction; without one it is taken for an inhibition."""
    return evidence * F.when(direction != 0, direction).otherwise(-1)


def quantize(value: Column, digits: int) -> Column:
    """To the nearest binary fraction that keeps so many decimal digits, halves to even."""
    bits = 2.0 ** math.ceil(math.log2(10.0**digits))
    return F.rint(value * bits) / bits
