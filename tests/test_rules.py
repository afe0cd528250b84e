"""Hand tables and brute force for cleaning, screening, norms and hierarchies."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.operators import graph, normalize, paths, relation
from tarnsift.operators import screening as scr
from tarnsift.sources import files


def kernel(values):
    """Medcouple by its definition: the middle of h over pairs at or across the median."""
    mid, out = np.median(values), []
    up, low = sorted([v for v in values if v >= mid]), sorted([v for v in values if v <= mid], reverse=True)
    ties = sum(v == mid for v in values)
    for i, j in itertools.product(range(len(up)), range(len(low))):
        if up[i] == low[j]:  # both at the median: by places among the tied
            out.append(np.sign(ties - 1 - ((ties - 1 - i) + j)) if ties else 0)
        else:
            out.append((up[i] + low[j] - 2 * mid) / (up[i] - low[j]))
    return float(np.median(out))


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 5], [1, 2, 3, 10, 50], [0, 0, 0, 1, 9, 30], [5, 5, 5, 5], [1, 3, 3, 3, 4, 8, 20]])
def test_medcouple(values):
    got = scr.medcouple(np.array(values, float))
    assert got == pytest.approx(kernel(values)) and -1 <= got <= 1
    assert scr.medcouple(-np.array(values, float)) == pytest.approx(-got)


def test_remove_outliers(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 1, 2, 3, 4, 5, 100)] + [(None,)], "value double")
    assert sorted(r.value for r in scr.remove_outliers(df, 0.0).collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        scr.remove_outliers(df, -0.1)


def test_fold_values(spark):
    df = spark.createDataFrame([("a", " x "), ("a", "x"), ("a", "drug used for unknown indication?"), ("b", "\tx\n"), ("b", None)], "k string, v string")
    assert sorted(map(str, (tuple(r) for r in scr.fold_values(df, "k", "v").collect()))) == sorted(map(str, [("a", "x"), ("a", "unknown indication"), ("b", "x"), ("b", None)]))


def test_last_doses(spark):
    df = spark.createDataFrame([(1, "d", 1, "2.5", "mg"), (1, "d", 2, "many", "g"), (2, "d", 3, "7", ""), (3, "d", 4, "1e2", "mg")], "e int, drug string, i int, amount string, unit string")
    got = {r.e: (r.amount, r.unit) for r in scr.last_doses(df, ["e", "drug"], "amount", ["unit"], "i").collect()}
    assert got == {1: (None, 2), 2: (7.0, 0), 3: (100.0, 1)}


def test_distinct_titles(spark):
    rows = [("a", "a one", "x", 1), ("a", "a two", "x", 2), ("a", "a three", "y", 3), ("b", "b one", "x", 4), ("b", "b two", "x", 5), ("c", "c one", None, 6), ("c", "c two", None, 7)]
    df = spark.createDataFrame(rows, "title string, full_name string, targets string, place int")
    assert {(r.place, r.title) for r in scr.distinct_titles(df).collect()} == {(1, "a one"), (3, "a three"), (4, "b"), (6, "c")}


def test_drop_generic_keys(spark):
    keys = ["AAAAAAAAAAAAAA" + scr.GENERIC_SUFFIX, "AAAAAAAAAAAAAA-XXXXXXXXXX-N", "BBBBBBBBBBBBBB" + scr.GENERIC_SUFFIX, None]
    df = spark.createDataFrame([(1, k) for k in keys], "g int, k string")
    assert {r.k for r in scr.drop_generic_keys(df, "g", "k").collect()} == set(keys[1:])


def test_sort_key(spark):
    df = spark.createDataFrame([(v,) for v in ("10", "9", "b", "-3", "a1", "1_000", "")], "v string")
    assert [r.v for r in df.orderBy(scr.alpha_then_int(F.col("v"))).collect()] == ["", "a1", "b", "-3", "9", "10", "1_000"]


def test_log_odds_and_directions(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (1.0,), (float("inf"),), (None,)], "o double")
    got = [r[0] for r in df.select(scr.log_odds(F.col("o"))).collect()]
    assert got == pytest.approx([math.log(1e-4), math.log(1e-4), 0.0, math.log(1e4), math.log(1e-4)])
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, -1)], "e double, d int")
    assert [r[0] for r in df.select(scr.directional(F.col("e"), F.col("d"))).collect()] == [0.5, -0.5, -0.5]


def test_smooth_against_numpy(spark):
    values, weights = [float(x) for x in np.random.default_rng(1).normal(size=20)], [1.0, 2.0, 3.0, 0.5]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    for center in range(3):
        full = np.convolve(values, np.array(weights) / sum(weights))
        got = [r.smoothed for r in scr.smooth(df, "g", "i", "v", weights, center).orderBy("i").collect()]
        assert got == pytest.approx(list(full[center:center + 20]))


def test_screen(spark):
    drugs = spark.createDataFrame([(1, True, "none"), (2, False, "none"), (3, False, "none"), (4, True, "hit"), (5, None, "none"), (6, True, None)], "drug int, ubiquitous boolean, indication string")
    labels = spark.createDataFrame([(2, ["bad"]), (2, ["bad", "x"]), (3, ["bad"]), (3, ["x"])], "drug int, labels array<string>")
    assert {r.drug for r in scr.screen(drugs, labels, ["bad"], ["none"]).collect()} == {3, 4, 5, 6}


def test_canonical_sets(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("a", "r", 1), ("b", "a", 2), ("c", "r", 3), ("d", "r", 4)], "id string, parent string, place int")
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("d", "y")], "id string, item string")
    assert {r.id: r.canonical for r in relation.canonical_sets(nodes, members).collect()} == {"r": "r", "a": "a", "b": "a", "c": "a", "d": "d"}
    assert {r.id: r.canonical for r in relation.canonical_sets(nodes, members, True).collect()} == {"r": "r", "a": "a", "b": "b", "c": "a", "d": "d"}


def test_target_norm(spark):
    scores = spark.createDataFrame([("a", 9.0), ("b", 5.0), ("c", 1.0), ("d", 8.0)], "key string, score double")
    targets = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "z"), ("a", "z")], "key string, target string")
    # x and y have 5, z has 1: two tied in front
    assert {r.key: r.norm for r in normalize.target_norm(scores, targets).collect()} == {"a": 2.0, "b": 2.0, "c": 3.0}


@pytest.mark.parametrize("seed", range(3))
def test_condense_hierarchy_against_a_loop(spark, seed):
    g = random.Random(seed)
    parents = {i: [g.randrange(i) for _ in range(1 + (g.random() < 0.2))] for i in range(1, 40)}
    score = {i: float(g.randrange(6)) for i in range(40) if g.random() < 0.8}
    up = {0: set()}
    for i in range(1, 40):
        up[i] = set(parents[i]).union(*[up[p] for p in parents[i]])
    depth, kept = {i: len(up[i]) % 4 for i in range(40)}, []
    for node in sorted(score, key=lambda n: (-score[n], depth[n], n)):
        if not any(k in up[node] or node in up[k] for k in kept):
            kept.append(node)
    edges = spark.createDataFrame([(i, p) for i, ps in parents.items() for p in ps], "node int, parent int")
    got = graph.condense_hierarchy(spark.createDataFrame(list(score.items()), "node int, score double"), edges, spark.createDataFrame(list(depth.items()), "node int, depth int"))
    assert sorted(r.node for r in got.collect()) == sorted(kept)


def test_condense_nothing(spark):
    empty = spark.createDataFrame([], "node int, score double")
    assert graph.condense_hierarchy(empty, spark.createDataFrame([], "node int, parent int"), spark.createDataFrame([], "node int, depth int")).count() == 0


def test_overrepresentation_of_a_whole_pathway(spark):
    drugs = spark.createDataFrame([("d", i) for i in range(5)] + [("e", 0)], "drug string, prot int")
    pathways = spark.createDataFrame([("p", i) for i in range(5)], "pathway string, prot int")
    got = paths.pathway_overrepresentation(drugs, pathways, 20).collect()
    assert [(r.drug, r.score) for r in got] == [("d", pytest.approx(math.log10(math.comb(20, 5))))]


def test_matching_paths(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.tsv", "b.csv", "deep/c.tsv"):
        (tmp_path / name).write_text("1")
    names = lambda **k: {r.path.rsplit("/", 1)[1] for r in files.matching_paths(spark, str(tmp_path), "*.tsv", **k).collect()}
    assert names() == {"a.tsv"} and names(deep=True) == {"a.tsv", "c.tsv"}
