"""Interaction tables (drug, prot, evidence, direction): consensus, correction, collapsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

PAIR = ["drug", "prot"]


def consensus(df: DataFrame) -> DataFrame:
    """Per pair the greatest evidence and the sign of the summed directions, over all rows, repeated ones too."""
    return df.groupBy(*PAIR).agg(F.max("evidence").alias("evidence"), F.signum(F.sum("direction")).cast("int").alias("direction"))


def standardize(df: DataFrame) -> DataFrame:
    """Median evidence.  With several directions the sign of their sum decides: 0 takes the median of
    all, else that of the rows with the same sign."""
    sign = F.signum(F.sum("direction").over(Window.partitionBy(*PAIR))).cast("int")
    rows = df.withColumn("_sign", sign)
    return rows.groupBy(*PAIR).agg(
        F.when(F.max("_sign") == 0, F.median("evidence")).otherwise(
            F.median(F.when(F.signum("direction") == F.col("_sign"), F.col("evidence")))).alias("evidence"),
        F.max("_sign").alias("direction"))


def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (drug, prot, new_evidence, new_direction); a null evidence deletes, others override."""
    found = df.join(edits.withColumn("_edit", F.lit(True)), PAIR, "left")
    return found.filter(F.col("_edit").isNull() | F.col("new_evidence").isNotNull()).select(
        *PAIR, F.coalesce("new_evidence", "evidence").alias("evidence"), F.coalesce("new_direction", "direction").alias("direction"))


def correct_falsehoods(df: DataFrame, removals: DataFrame, corrections: DataFrame) -> DataFrame:
    """Pairs of removals go; corrections replace their pairs, and may add new ones."""
    gone = removals.select(*PAIR).unionByName(corrections.select(*PAIR)).distinct()
    return df.join(gone, PAIR, "left_anti").unionByName(corrections)


def merge_by_priority(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters: (cluster, coll, drug, priority).  In a cluster with a collection of priority 0 the
    last key of that collection alone counts; else all count.  The output key is the lowest of the
    best priority."""
    own = Window.partitionBy("cluster")
    ranked = clusters.withColumns({
        "out": F.first("drug").over(own.orderBy("priority", "drug")),
        "lead": F.max(F.when(F.col("priority") == 0, F.col("drug"))).over(own),
    }).filter(F.col("lead").isNull() | ((F.col("priority") == 0) & (F.col("drug") == F.col("lead"))))
    return consensus(df.join(ranked.select("drug", "out"), "drug").select(F.col("out").alias("drug"), "prot", "evidence", "direction"))


def moa_collapse(df: DataFrame, least: float = 0.5, with_direction: bool = True) -> DataFrame:
    """One row for each distinct set of (prot, direction) that some drug binds: its key and members."""
    sign = F.when(F.col("direction") > 0, "+").when(F.col("direction") < 0, "-").otherwise("?") if with_direction else F.lit("")
    parts = df.filter(F.col("evidence") >= least).select("drug", F.concat(F.col("prot").cast("string"), sign).alias("part"))
    sets = parts.groupBy("drug").agg(F.array_join(F.array_sort(F.collect_set("part")), "_").alias("moa"))
    return sets.groupBy("moa").agg(F.count(F.lit(1)).alias("n_drugs"), F.min("drug").alias("first_drug"))


def condense_keys(df: DataFrame) -> DataFrame:
    """Group number of drugs with equal sorted (prot, evidence, direction) lists: the smallest drug."""
    pairs = consensus(df)
    part = F.concat_ws(":", "prot", F.format_string("%.4f", F.col("evidence")), "direction")
    sets = pairs.groupBy("drug").agg(F.md5(F.array_join(F.array_sort(F.collect_set(part)), ",")).alias("_set"))
    return sets.select("drug", F.min("drug").over(Window.partitionBy("_set")).alias("group_key"))


def clean_repeats(df: DataFrame) -> DataFrame:
    """Measurements (drug, prot, direction, value > 0): geometric mean and sample deviation to 2 places;
    a single one stays, with deviation 0."""
    n = F.count(F.lit(1))
    return df.groupBy("drug", "prot", "direction").agg(
        n.alias("n"), F.when(n == 1, F.max("value")).otherwise(F.round(F.exp(F.avg(F.log("value"))), 2)).alias("value"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.round(F.stddev_samp("value"), 2)).alias("sd"))


def direction_vote(df: DataFrame) -> DataFrame:
    """The direction of most measurements; then the smaller deviation, the lower value, the direction."""
    own = Window.partitionBy("drug", "prot").orderBy(F.col("n").desc(), "sd", "value", "direction")
    return df.withColumn("_i", F.row_number().over(own)).filter("_i = 1").drop("_i")


def directed_edges(edges: DataFrame, least: float = 0.9) -> DataFrame:
    """edges: (left, right, evidence, directed).  A pair goes if only its reverse is directed with
    evidence of least or more."""
    sure = edges.filter(F.col("directed") & (F.col("evidence") >= least)).select("left", "right").distinct()
    back = sure.select(F.col("right").alias("left"), F.col("left").alias("right")).join(sure, ["left", "right"], "left_anti")
    return edges.join(back, ["left", "right"], "left_anti")


def affinity_evidence(kind, value):
    """Evidence steps of a C50 or Ki measurement."""
    return (
        F.when((kind == "c50") & (value <= 200), 0.9).when((kind == "c50") & (value <= 630), 0.5)
        .when((kind == "ki") & (value <= 40), 0.7).when((kind == "ki") & (value <= 320), 0.4).otherwise(0.0)
    )


#: Parts of the places of edges, bindings and edges that meet in one task, about, numbers that it holds at once, and
#: proteins whose parts are broadcast.
PLACES, CELL_ROWS, CELL_EDGES, MOST_HELD, MOST_NEAR = 64, 500_000, 1_000_000, 2_000_000, 200_000


def _indirect(own: pa.Table, near: pa.Table) -> pa.Table:
    """(drug, indirect): the summed greatest products over the neighbours in near, of drugs in own."""
    a, b, e = (near.column(c).to_numpy() for c in ("prot1", "prot2", "e2"))
    order = np.lexsort((b, a))
    a, b, e = a[order], b[order], e[order]
    names, start, each = np.unique(a, return_index=True, return_counts=True)
    to, column = np.unique(b, return_inverse=True)
    drug, prot, ev = (own.column(c).to_numpy() for c in ("drug", "prot", "ev"))
    if not len(names) or not len(drug):
        return pa.table({"drug": drug[:0], "indirect": np.zeros(0)})
    at = np.minimum(np.searchsorted(names, prot), len(names) - 1)
    order = np.flatnonzero(names[at] == prot)
    order = order[np.argsort(drug[order], kind="stable")]
    drug, at, ev = drug[order], at[order], ev[order]
    drugs, first, n = np.unique(drug, return_index=True, return_counts=True)
    out = np.zeros(len(drugs))
    # a protein by itself, without repeated edges, needs no look at each neighbour
    again = np.zeros(len(names), np.int64)
    np.add.at(again, np.searchsorted(names, a[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])]), 1)
    alone = (n == 1) & (again[at[first]] == 0) if len(drugs) else np.zeros(0, bool)
    out[alone] = ev[first[alone]] * np.add.reduceat(e, start)[at[first[alone]]]
    rest, step = np.flatnonzero(~alone), max(1, MOST_HELD // len(to))
    for i in range(0, len(rest), step):
        some = rest[i:i + step]
        rows = np.repeat(first[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))
        size = each[at[rows]]
        edge = np.repeat(start[at[rows]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        held = np.full(len(some) * len(to), -np.inf)
        np.maximum.at(held, np.repeat(np.repeat(np.arange(len(some)), n[some]) * len(to), size) + column[edge], np.repeat(ev[rows], size) * e[edge])
        held[held == -np.inf] = 0
        out[some] = held.reshape(len(some), len(to)).sum(1)
    return pa.table({"drug": drugs, "indirect": out})


def selectivity(df: DataFrame, edges: DataFrame, least: float = 0.9) -> DataFrame:
    """Per drug the summed greatest evidence a protein, direct, and over neighbours of a protein.

    Bindings and edges meet in tasks by a block of drugs and a part of the neighbours, which return one sum a drug, so no
    row for each drug and neighbour travels.  Edges may have a place that is the same for all that edges connect; then a
    binding goes to one part."""
    direct = df.select("drug", "prot", "evidence").repartition("drug").groupBy("drug", "prot").agg(F.max("evidence").alias("ev"))
    placed = "place" in edges.columns
    near = cut(edges.filter(F.col("evidence") >= least).select("prot1", "prot2", F.col("evidence").cast("double").alias("e2"), *["place"] * placed))
    parts = PLACES if placed else -(-near.count() // CELL_EDGES) or 1
    near = near.withColumn("part", F.pmod(F.xxhash64("place" if placed else "prot2"), F.lit(parts)).cast("int"))
    blocks = -(-df.count() // (CELL_ROWS * min(parts, 16))) or 1
    reach = cut(near.select(F.col("prot1").alias("prot"), "part").distinct())
    few = reach.limit(MOST_NEAR + 1).count() <= MOST_NEAR
    cell = lambda block: (F.col("part") * blocks + block).cast("long").alias("cell")
    own = direct.filter("ev is not null and drug is not null").join(F.broadcast(reach) if few else reach, "prot").select(
        cell(F.pmod(F.xxhash64("drug"), F.lit(blocks))), "drug", "prot", F.col("ev").cast("double").alias("ev"))
    near = near.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(cell(F.col("block")), "prot1", "prot2", "e2")
    kind = df.schema["drug"].dataType.simpleString()
    found = own.groupBy("cell").cogroup(near.groupBy("cell")).applyInArrow(_indirect, f"drug {kind}, indirect double")
    near = found.groupBy("drug").agg(F.sum("indirect").alias("indirect"))
    return direct.groupBy("drug").agg(F.sum("ev").alias("direct")).join(near, "drug", "left").select(
        "drug", F.round("direct", 6).alias("direct"), F.round(F.coalesce("indirect", F.lit(0.0)), 6).alias("indirect"))


#: Bindings of a base that are broadcast.
BASE_ROWS = 100_000


def combo_add(drugs: DataFrame, base: DataFrame) -> DataFrame:
    """Each drug with the base's bindings: the greater evidence, direction 0 where the two disagree.

    base is one drug's bindings, and the result holds it once a drug.  Up to BASE_ROWS it is broadcast; a larger one
    goes in blocks, each of which meets all drugs.  Then one aggregate."""
    blocks = -(-base.count() // BASE_ROWS) or 1
    keys = drugs.select("drug").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    own = base.select(F.pmod(F.xxhash64("prot"), F.lit(blocks)).cast("int").alias("_block"), "prot", "evidence", "direction")
    added = keys.join(F.broadcast(own) if blocks == 1 else own, "_block").drop("_block")
    both = drugs.select(*PAIR, "evidence", "direction").unionByName(added)
    return both.groupBy(*PAIR).agg(
        F.max("evidence").alias("evidence"),
        F.when(F.min("direction") == F.max("direction"), F.max("direction")).otherwise(0).alias("direction"))
