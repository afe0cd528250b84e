"""Queries over all ids, against brute force on small tables with ids beyond those that the SQL takes."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnsift.operators import paths
from tarnsift.plans import slate


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """The folder, and the rows of lineitem (part, supplier, discount, flag) and supplier (key, nation, balance)."""
    g = random.Random(5)
    parts, suppliers = [1, *range(55, 66), *range(195, 206)], range(35, 47)
    lines = [(g.choice(parts), g.choice(suppliers), g.randrange(11) / 100, g.choice("ANR")) for _ in range(150)] + [(1, 36, 0.07, "A"), (1, 44, 0.02, "R")]
    supplier = [(k, k % 3, float(g.randrange(0, 1500))) for k in suppliers]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_discount double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(supplier, "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    return path, lines, supplier


def jaccards(sets):
    return sorted((a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in combinations(sorted(sets), 2) if sets[a] & sets[b])


def test_jaccard_pairs(spark, small):
    path, lines, _ = small
    want = jaccards({s: {p for p, x, *_ in lines if x == s} for s in {x for _, x, *_ in lines}})
    assert sorted(map(tuple, slate.QUERIES["jaccard_pairs"](spark, path).collect())) == want
    assert any(b > 40 for _, b, _ in want)


def test_path_combo_add(spark, small):
    path, lines, _ = small
    bound = {}
    for drug, prot, discount, flag in lines:
        bound.setdefault((drug, prot), []).append((round(discount * 10, 4), {"A": -1, "N": 0}.get(flag, 1)))
    sign = lambda n: (n > 0) - (n < 0)
    cons = {k: (max(e for e, _ in v), sign(sum(d for _, d in v))) for k, v in bound.items()}
    both = {k: [v] for k, v in cons.items()}
    for drug in {d for d, _ in cons}:
        for (base, prot), v in cons.items():
            if base == 1:
                both.setdefault((drug, prot), []).append(v)
    want = sorted((*k, max(e for e, _ in v), v[0][1] if len({d for _, d in v}) == 1 else 0) for k, v in both.items())
    got = slate.QUERIES["path_combo_add"](spark, path).select("drug", "prot", "evidence", "direction").collect()
    assert sorted(map(tuple, got)) == want and any(d > 200 for d, *_ in want)


def expanded(rows, sets):
    """All pairs of sets, from pairs of classes and the sets of each class."""
    of = {s: [s] for s in sets}
    for r in rows:
        if r.same:
            assert r.jaccard == 1 and r.set1 < r.set2 and of.pop(r.set2) == [r.set2]
            of[r.set1].append(r.set2)
    pairs = [(a, b, 1.0) for c in of.values() for a, b in combinations(sorted(c), 2)]
    for r in rows:
        if not r.same:
            assert r.set1 < r.set2
            pairs += [(min(a, b), max(a, b), r.jaccard) for a in of[r.set1] for b in of[r.set2]]
    return sorted(pairs)


@pytest.mark.parametrize("block,step", [(1024, 2048), (3, 2)])
def test_indirect_jaccard(spark, small, monkeypatch, block, step):
    monkeypatch.setattr(paths, "BLOCK_SETS", block)
    monkeypatch.setattr(paths, "STEP_ITEMS", step)
    path, lines, supplier = small
    near = {a: {b for b, m, y in supplier if a != b and n == m and abs(x - y) < 1000 and round(1 - abs(x - y) / 10000, 4) >= 0.95} for a, n, x in supplier}
    sets = {d: {p for x, p, *_ in lines if x == d} for d in {x for x, *_ in lines}}
    want = jaccards({d: s.union(*(near[p] for p in s)) for d, s in sets.items()})
    assert expanded(slate.QUERIES["indirect_jaccard"](spark, path).collect(), sets) == want
    assert any(b > 60 for _, b, _ in want) and any(len(v) for v in near.values())


def shuffled(spark):
    """Records that all stages so far wrote for exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_indirect_jaccard_of_copies(spark, tmp_path, monkeypatch):
    """Copies with shifted keys, whose balances are the same, so that each set has the copies' suppliers near its own."""
    monkeypatch.setattr(paths, "BLOCK_SETS", 5)
    g, copies = random.Random(9), 6
    supplier = [(k, k % 2, float(g.randrange(0, 3000))) for k in range(12)]
    lines = [(p, g.randrange(12), 0.01, "A") for p in range(40) for _ in range(3)]
    path = str(tmp_path)
    spark.createDataFrame([(p + 100 * k, s + 100 * k, d, f) for p, s, d, f in lines for k in range(copies)], "l_partkey long, l_suppkey long, l_discount double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(s + 100 * k, n, b) for s, n, b in supplier for k in range(copies)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{path}/supplier.parquet")
    near = {a: {b for b, m, y in supplier if n == m and round(1 - abs(x - y) / 10000, 4) >= 0.95} for a, n, x in supplier}
    sets = {p + 100 * k: {q + 100 * c for x, s, *_ in lines if x == p for q in near[s] for c in range(copies)} for p in range(40) for k in range(copies)}
    before = shuffled(spark)
    rows = slate.QUERIES["indirect_jaccard"](spark, path).collect()
    # a member for each of 48 blocks before
    assert shuffled(spark) - before < sum(map(len, sets.values()))
    assert expanded(rows, sets) == jaccards(sets)
    n = len({frozenset(s) for s in sets.values()})
    assert n <= 40 and sum(not r.same for r in rows) <= n * (n - 1) // 2 and sum(r.same for r in rows) == len(sets) - n


def test_ratios_are_rounded_as_spark_rounds(spark):
    """Halves go up, as 1 / 128 shows; Python rounds that one down."""
    pairs = [(c, n) for n in [*range(1, 130), 640, 3200, 65536, 999_999, 10_000_019] for c in {*range(1, min(n, 130) + 1), n // 2 or 1, n}]
    df = spark.createDataFrame(pairs, "c long, n long").select("c", "n", F.round(F.col("c") / F.col("n"), 6).alias("r"))
    rows = df.collect()
    got = paths._ratio(*(np.array([r[k] for r in rows]) for k in ("c", "n")))
    assert got.tolist() == [r.r for r in rows] and (1, 128, 0.007813) in map(tuple, rows)


def test_no_step_follows_the_pairs(spark, small):
    """Each pair went through two more projections and a decimal in the JVM before."""
    plan = slate.QUERIES["indirect_jaccard"](spark, small[0])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union") and plan.splitlines()[1].lstrip(" :+-").startswith("MapInArrow")
