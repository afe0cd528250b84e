"""Relations between keys: selection, mapping, merging and comparison.

Everything takes and returns DataFrames.  Keys compare by equality; a null key matches nothing and is
kept by anti joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import score_blocks


def threshold(df: DataFrame, least: float, col: str = "evidence") -> DataFrame:
    """Rows with col >= least; null and NaN go."""
    return df.filter((F.col(col) >= least) & ~F.isnan(col))


def select_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Semi join: of any number of keys."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def exclude_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_anti")


def any_column(df: DataFrame, cols: list[str], values: list) -> DataFrame:
    """Rows in which any of cols equals one of values."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isin(values) for c in cols]))


def key_filter(df: DataFrame, on: str, include: list[DataFrame] = (), exclude: list[DataFrame] = ()) -> DataFrame:
    """Include sets intersect, exclude sets add up; without include sets all keys are in."""
    for keys in include:
        df = select_keys(df, keys, on)
    for keys in exclude:
        df = exclude_keys(df, keys, on)
    return df


def score_filter(df: DataFrame, spec: str, score: str = "score", key: str = "key") -> DataFrame:
    """Spec "<x", ">x" (strict), "topN" or "topN%" (whole rows of the ordering, ties by key)."""
    if spec[:1] in "<>":
        x = float(spec[1:])
        return df.filter(F.col(score) < x if spec[0] == "<" else F.col(score) > x)
    if not spec.startswith("top") or not spec[3:].rstrip("%").isdigit():
        raise ValueError(f"bad score filter {spec!r}")
    n = int(spec[3:].rstrip("%"))
    if not spec.endswith("%"):
        return df.orderBy(F.col(score).desc(), key).limit(n)
    n = df.count() * n // 100
    blocks = score_blocks(df.select(F.col(score).alias("score")))
    last = blocks.filter((F.col("ahead") < n) & (F.col("ahead") + F.col("tied") >= n)).first()
    if last is None:
        return df.limit(0)
    above = F.col(score).isNotNull() if last.score is None else F.col(score) > last.score
    # only the tied rows at the cut are ordered
    return df.filter(above).unionByName(df.filter(F.col(score).eqNullSafe(F.lit(last.score))).orderBy(key).limit(n - last.ahead))


def hash_sample(df: DataFrame, key: str, num: int, denom: int, seed: str) -> DataFrame:
    """Deterministic share num / denom of keys, from the last 15 hex digits of an md5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 18, 15)
    return df.filter(F.conv(digits, 16, 10).cast("long") % denom < num)


def fallback_key(df: DataFrame, clusters: DataFrame, on: str, name: str = "key") -> DataFrame:
    """The cluster's key where the row has one, else its own."""
    return df.join(clusters.withColumnRenamed("cluster_key", "_found"), on, "left").withColumn(
        name, F.coalesce("_found", on)).drop("_found")


def override(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """All of right, and of left the keys that right lacks."""
    return exclude_keys(left, right, on).unionByName(right)


def union_relation(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right).distinct()


def flatten_unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).filter("_n = 1").drop("_n")


def outer_merge(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """One row a key with each frame's value, null where it has none: one aggregate over the union, not
    a chain of joins.  Frames hold (key, value), one row a key."""
    long = reduce(DataFrame.unionByName, [f.select(key, F.lit(n).alias("_name"), F.col("value").cast("double").alias("_value")) for n, f in frames.items()])
    return long.groupBy(key).agg(*[F.max(F.when(F.col("_name") == n, F.col("_value"))).alias(n) for n in frames])


def attribute_pivot(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, attribute, value) to a column an attribute, the largest value of several."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col("attribute") == n, F.col("value"))).alias(n) for n in names])


def venn_cells(df: DataFrame, key: str, group: str) -> DataFrame:
    """How many keys are in exactly each combination of groups."""
    cells = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(group)), " ").alias("cell"))
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n_keys"))


def diff_stats(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Added, removed and kept keys and their percentage of before (0 if that was empty)."""
    both = before.select(key).distinct().withColumn("_b", F.lit(1)).join(after.select(key).distinct().withColumn("_a", F.lit(1)), key, "full_outer")
    n = both.agg(
        F.count("_b").alias("n_before"), F.count("_a").alias("n_after"),
        F.count_if(F.col("_b").isNull()).alias("n_added"), F.count_if(F.col("_a").isNull()).alias("n_removed"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_kept"))
    share = lambda c: F.round(F.when(F.col("n_before") == 0, F.lit(0.0)).otherwise(100.0 * F.col(c) / F.col("n_before")), 6)
    return n.withColumns({"pct_added": share("n_added"), "pct_removed": share("n_removed"), "pct_kept": share("n_kept")})


def latest_per_group(df: DataFrame, group: str, order: Column, what: list[str]) -> DataFrame:
    """The columns what of the row with the greatest order in each group."""
    return df.groupBy(group).agg(*[F.max_by(c, order).alias(c) for c in what])


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Suffix _1, _2 ... for names that occur more than once."""
    own = Window.partitionBy(name)
    n, i = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy(order))
    return df.withColumn("unique_name", F.when(n > 1, F.concat(F.col(name), F.lit("_"), i.cast("string"))).otherwise(F.col(name)))


def rekey(df: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Every key as the first key of each namespace in its cluster; keys without cluster pass, with a
    null namespace.  clusters: (cluster, namespace, member)."""
    first = clusters.groupBy("cluster", "namespace").agg(F.min("member").alias("rekeyed"))
    home = clusters.select("cluster", F.col("member").alias(key)).distinct()
    found = df.join(home, key, "left").join(first, "cluster", "left")
    return found.withColumn("rekeyed", F.coalesce("rekeyed", key)).drop("cluster")


def composed_attributes(items: DataFrame, shared: DataFrame, on: str, name: str) -> DataFrame:
    """An item's own attribute, else its group's."""
    other = shared.select(on, F.col(name).alias("_shared"))
    return items.join(other, on, "left").withColumn(name, F.coalesce(name, "_shared")).drop("_shared")


def property_pairs(eav: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(value1, value2) of two attributes for each key that has both; every pair of values, repeats kept."""
    a = eav.filter(F.col("attribute") == first).select(key, F.col("value").alias("value1"))
    b = eav.filter(F.col("attribute") == second).select(key, F.col("value").alias("value2"))
    return a.join(b, key).select("value1", "value2")


def annotate(annotations: DataFrame, eav: DataFrame, key: str, attribute: str, invalid: bool | None = None) -> DataFrame:
    """annotations: (id, workspace, key, invalid) with the values of an attribute; all, or those that are or aren't invalid."""
    x = annotations if invalid is None else annotations.filter(F.col("invalid") == invalid)
    return x.join(eav.filter(F.col("attribute") == attribute).select(key, "value"), key).select("workspace", "id", "value")


def bridge_max(ordering: DataFrame, first: DataFrame, second: DataFrame, associations: DataFrame) -> DataFrame:
    """ordering: (name, score); first: (name, concept); second: (concept, term); associations: (term, prot, overall).
    Largest overall * score of each (name, prot) over all ways, none below 0.  A name's terms are told apart before the last join."""
    terms = ordering.join(first.distinct(), "name").join(second.distinct(), "concept").groupBy("name", "term").agg(F.max("score").alias("score"))
    return terms.join(associations, "term").groupBy("name", "prot").agg(F.greatest(F.lit(0.0), F.max(F.col("overall") * F.col("score"))).alias("score"))


def stack_matrices(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(row, feature, value) of both, with one numbering of features from 0: base's by name, then what extra adds.
    Features are numbered in one task."""
    both = base.select("row", "feature", "value", F.lit(0).alias("_src")).unionByName(extra.select("row", "feature", "value", F.lit(1).alias("_src")))
    features = both.groupBy("feature").agg(F.min("_src").alias("_src"))
    numbers = features.select("feature", (F.row_number().over(Window.orderBy("_src", "feature")) - 1).cast("long").alias("column"))
    return both.join(numbers, "feature").select("row", "column", "value")


def flag_groups(df: DataFrame, flags: list[Column]) -> DataFrame:
    """Rows by their combination of up to 63 flags, as a number whose bit i is flag i; null is not set."""
    if len(flags) > 63:
        raise ValueError("more than 63 flags")
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags)]
    return df.groupBy(sum(bits[1:], bits[0]).alias("flags")).agg(F.count(F.lit(1)).alias("n"))


def canonical_sets(nodes: DataFrame, members: DataFrame, siblings_only: bool = False) -> DataFrame:
    """nodes: (id, parent, place), members: (id, item).  The id of the first node by place with the same items, among
    all or a parent's children; nodes without items are alike.  Items of an id are gathered by the hash of each, summed."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "item").cast("decimal(38,0)"))
    sets = members.distinct().groupBy("id").agg(F.struct(F.count(F.lit(1)), h(1), h(2)).alias("_set"))
    x = nodes.join(sets, "id", "left")
    own = Window.partitionBy("_set", *(["parent"] if siblings_only else []))
    return x.select("id", F.min(F.struct("place", "id")).over(own)["id"].alias("canonical"))
