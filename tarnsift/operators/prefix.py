"""Sums over all rows ahead in an ordering, without one task for all rows.

Values fall into spots, 4,096 to a power of two, which are a fixed function of the value: nothing is
sampled, so a lost task finds the same spots again.  Only sums by spot, of which a column of doubles has
at most 2 ** 24, pass through one task; values are sorted within their spots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spots to a power of two.
SPOTS = 4096


def spot(value: str) -> Column:
    """A whole number that never falls as the value rises.  Null is least, NaN greatest, as in Spark's orderings."""
    x = F.col(value).cast("double")
    size = F.abs(x)
    power = F.floor(F.log2(size))
    place = (power + 1100) * SPOTS + F.floor((size / F.pow(F.lit(2.0), power) - 1) * SPOTS) + 1
    end = F.lit(1 << 40)
    return (F.when(x.isNull(), -2 * end).when(F.isnan(x), 2 * end).when(x == float("inf"), end).when(x == float("-inf"), -end)
            .when(x == 0, F.lit(0)).when(x < 0, -place).otherwise(place)).cast("long")


def running(df: DataFrame, value: str, sums: dict[str, str], descending: bool = True) -> DataFrame:
    """df, one row a value, with sums[name] summed over the rows ahead as name."""
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    x = df.withColumn("_spot", spot(value))
    ahead = Window.orderBy(way("_spot")).rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy("_spot").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    starts = totals.select("_spot", *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_spot").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(starts, "_spot").withColumns({n: F.col(f"_{n}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).drop("_spot", *[f"_{n}" for n in sums])


def least_from_above(df: DataFrame, value: str, what: str, name: str) -> DataFrame:
    """df, one row a value, with the least what of its own row and the rows of larger values as name."""
    x = df.withColumn("_spot", spot(value))
    above = Window.orderBy(F.col("_spot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = x.groupBy("_spot").agg(F.min(what).alias("_m")).select("_spot", F.min("_m").over(above).alias("_least"))
    own = Window.partitionBy("_spot").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.join(starts, "_spot").withColumn(name, F.least("_least", F.min(what).over(own))).drop("_spot", "_least")
