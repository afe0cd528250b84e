"""Small hand tables for rules that are easy to get wrong."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsift.functions import text
from tarnsift.operators import evidence, graph, interactions, metrics, normalize, paths, ranking, relation
from tarnsift.plans.jobs import Job, run_all
from tarnsift.sources import files
from tarnsift.streaming import events

SCORES = [10, 9, 9, 9, 8, 7, 7, 5, 5, 5]


def ordering(spark, hits, scores=SCORES):
    return spark.createDataFrame([(f"d{i}", float(s), i in hits) for i, s in enumerate(scores)], "key string, score double, is_kt boolean")


@pytest.mark.parametrize("hits,ranks", [([0], [0]), ([1], [2]), ([2], [2]), ([3], [2]), ([1, 3], [1, 2]), ([1, 2, 3], [1, 2, 3]), ([1, 5], [2, 5]), ([1, 5, 9], [2, 5, 8])])
def test_tie_ranks(spark, hits, ranks):
    assert sorted(r.tie_rank for r in ranking.tie_ranks(ordering(spark, hits)).collect()) == ranks


def test_ranker(spark):
    got = {r.key: (r["rank"], r.pct) for r in ranking.ranked(ordering(spark, [])).collect()}
    assert [got[f"d{i}"][0] for i in range(10)] == [1, 3, 3, 3, 5, 7, 7, 9, 9, 9]
    assert [got[f"d{i}"][1] for i in range(10)] == [10, 40, 40, 40, 50, 70, 70, 100, 100, 100]


def test_sigma_of_rank(spark):
    assert metrics.sor(ordering(spark, [0])).first()[0] == pytest.approx(0.982014, abs=1e-6)


def test_febe(spark):
    values = [metrics.febe(ordering(spark, [i], list(range(10, 0, -1)))).first()[0] for i in (0, 9)]
    assert values == [pytest.approx(1.0), pytest.approx(0.0)]


def test_fisher_greater():
    p = metrics.fisher_greater(np.array([3]), np.array([4]), np.array([4]), np.array([8]))
    assert p[0] == pytest.approx(17 / 70)


def test_metrics_ignore_order_in_ties(spark):
    a, b = ordering(spark, [1, 5]), ordering(spark, [3, 6])
    for name in ("auroc", "average_precision", "sor", "running_es", "febe"):
        assert metrics.METRICS[name](a).first()[0] == metrics.METRICS[name](b).first()[0]


def test_metrics_without_hits(spark):
    assert metrics.auroc(ordering(spark, [])).first()[0] == 0.0
    assert metrics.average_precision(ordering(spark, [])).first()[0] == 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20))
def test_ranks_add_up(spark, scores):
    for r in ranking.ranked(ordering(spark, [], scores)).collect():
        assert r.ahead + r.tied + r.behind == len(scores)


def test_standardize(spark):
    rows = [("a", "p", 0.2, 1), ("a", "p", 0.6, 1), ("a", "p", 0.9, -1), ("b", "p", 0.2, 1), ("b", "p", 0.6, -1)]
    got = {r.drug: (r.evidence, r.direction) for r in interactions.standardize(spark.createDataFrame(rows, "drug string, prot string, evidence double, direction int")).collect()}
    assert got == {"a": (pytest.approx(0.4), 1), "b": (pytest.approx(0.4), 0)}


def test_norms_of_constants(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 3.0)], "key string, score double")
    assert {r.norm for r in normalize.z_norm(df).collect()} == {1.0}
    zero = spark.createDataFrame([("a", 0.0)], "key string, score double")
    assert normalize.mm_norm(zero).first().norm == 0.0


def test_score_filter_specs(spark):
    df = ordering(spark, [])
    assert relation.score_filter(df, "top25%").count() == 2
    assert relation.score_filter(df, ">8").count() == 4
    for bad in ("top", "x5", "topx%", ""):
        with pytest.raises(ValueError):
            relation.score_filter(df, bad)


def test_components_and_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "node long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 6)], "a long, b long")
    assert {r.node: r.component for r in graph.components(nodes, chain).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8}
    walk = graph.pagerank(chain.withColumn("weight", F.lit(1.0)), spark.createDataFrame([(1, 1.0)], "node long, p double"))
    assert walk.agg(F.sum("r")).first()[0] == pytest.approx(1.0)
    with pytest.raises(RuntimeError):
        graph.pagerank(chain.withColumn("weight", F.lit(1.0)), spark.createDataFrame([(1, 1.0)], "node long, p double"), rounds=1)


def test_mrmr(spark):
    rel = spark.createDataFrame([("a", 1.0), ("b", 0.9), ("c", 0.5)], "feature string, rel double")
    red = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.0), ("b", "c", 0.0)], "f1 string, f2 string, o double")
    assert graph.mrmr(rel, red, 2) == ["a", "c"]


def test_spearman_of_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "x double, y double")
    assert paths.spearman(df, "x", "y").first()[0] == pytest.approx(0.948683, abs=1e-6)


def test_pathway_products(spark):
    disease = spark.createDataFrame([(1, 0.5, 1), (2, 2.0, -1), (3, 1.0, 1)], "pathway long, d_score double, d_direction int")
    drugs = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 2, 0.5, 1), ("a", 9, 5.0, 1), ("b", 3, 0.0, 0)], "drug string, pathway long, score double, direction int")
    got = {r.drug: r for r in paths.pathway_products(disease, drugs).collect()}
    # of 0.5 and 1.0: log(1.648721 + 2.718282 - 2) and (0.5 e + 1.0 e^2) / (e + e^2)
    assert got["a"].p_soft == pytest.approx(0.861625, abs=2e-6) and got["a"].p_smooth == pytest.approx(0.865529, abs=1e-6)
    assert (got["a"].p_max, got["a"].p_sum, got["a"].direction) == (1.0, 1.5, 0)
    assert got["b"].p_soft == float("-inf") and got["b"].direction == 0


def test_text(spark):
    df = spark.createDataFrame([("Aspirin Sodium", "A b."), ("xy", None)], "name string, text string")
    assert [r[0] for r in df.select(text.fold_name(F.col("name"))).collect()] == ["aspirin sodium", None]
    names = ["Ab", "Abc", "Folate conjugate", "Zinc Complex", "x analogue", "biocompound", "Derivative", None]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").coalesce(1).select(text.fold_name(F.col("n"))).collect()] == [
        None, "abc", None, "zinc complex", None, "biocompound", "derivative", None]
    assert [r[0] for r in df.select(text.term_match(["text"], ["B"])).collect()] == [True, False]
    assert [r[0] for r in df.select(text.wildcard(F.col("name"), "a%sod%")).collect()] == [True, False]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("00123", 0.5), ("P1", None)], "key string, score double")
    files.write_records(df, str(tmp_path / "x.tsv"))
    back = files.read_records(spark, str(tmp_path / "x.tsv"), "key string, score double")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    with pytest.raises(NotImplementedError):
        files.format_of("x.xls")
    assert files.VersionedName.choose(["a.b.v1.c.tsv", "a.b.v12.c.tsv", "junk"], role="c").version == 12
    with pytest.raises(LookupError):
        files.VersionedName.choose(["a.b.v1.c.tsv"], role="d")


def test_jobs(spark):
    one = Job("one", lambda s, d: s.range(3))
    two = Job("two", lambda s, d: d["one"].filter("id > 0"), ("one",))
    assert run_all(spark, [two, one])["two"].count() == 2
    with pytest.raises(ValueError):
        run_all(spark, [Job("a", one.run, ("b",)), Job("b", one.run, ("a",))])


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    query = events.tumbling(events.read_events(spark, "/root/testdata/sf0.001")).writeStream.format("memory").queryName("windows").outputMode("complete").option(
        "checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, events.tumbling(table).collect()))


def test_set_enrichment_is_seeded(spark):
    order = spark.createDataFrame([(f"k{i}", float(-i)) for i in range(50)], "key string, score double")
    sets = spark.createDataFrame([("top", f"k{i}") for i in range(5)] + [("low", f"k{i}") for i in range(45, 50)], "set string, key string")
    a, b = ({r["set"]: (r.es, r.nes, r.p) for r in metrics.set_enrichment(sets, order).collect()} for _ in range(2))
    assert a == b and a["top"][0] == pytest.approx(1.0) and a["low"][0] < 0 and not math.isnan(a["top"][1])


def test_set_enrichment_weighs_hits(spark):
    scores = [9.0, 7.0, 6.0, 5.0, 4.0, 2.0]
    order = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(scores)], "key string, score double")
    sets = spark.createDataFrame([("a", "k1"), ("a", "k5"), ("b", "k0"), ("b", "k1")], "set string, key string")
    got = {r["set"]: r for r in metrics.set_enrichment(sets, order, permutations=5000).collect()}
    assert got["a"].es == pytest.approx(7**3 / (7**3 + 2**3) - 1 / 4) and got["b"].es == pytest.approx(1.0)
    # of the 15 pairs none has more than b's own
    assert got["b"].p == 1 / 5000 and got["b"].q == pytest.approx(2 / 5000) and got["a"].nes_lower <= got["a"].nes <= got["a"].nes_upper
    peaks = []
    for i in range(6):
        for j in range(i + 1, 6):
            run = [0.0]
            for x in range(6):
                run.append(run[-1] + (scores[x] ** 3 / (7**3 + 2**3) if x in (i, j) else -1 / 4))
            peaks.append(max(run) if max(run) >= -min(run) else min(run))
    assert got["a"].p == pytest.approx(sum(x > got["a"].es + 1e-9 for x in peaks) / 15, abs=0.03)


@pytest.mark.parametrize("n,k", [(200, 20), (160, 16), (30, 20), (40, 3)])
def test_drawn_places_are_uniform_sets(n, k):
    at = metrics._drawn(np.random.default_rng(4), n, k, 20_000)
    assert at.shape == (20_000, k) and (np.diff(at, axis=1) > 0).all() and at.min() >= 0 and at.max() < n
    share, few = k / n, 6 * math.sqrt(20_000 * k / n * (1 - k / n))
    assert (abs(np.bincount(at.ravel(), minlength=n) - 20_000 * share) < few).all()
    both = ((at == 5).any(1) & (at == 6).any(1)).sum()
    want = 20_000 * share * (k - 1) / (n - 1)
    assert abs(both - want) < 6 * math.sqrt(want) + 1


def test_set_enrichment_draws_in_many_tasks(spark):
    order = spark.createDataFrame([(f"k{i}", float(i)) for i in range(50)], "key string, score double")
    sets = spark.createDataFrame([("a", f"k{i}") for i in range(20)], "set string, key string")
    plan = metrics.set_enrichment(sets, order)._jdf.queryExecution().analyzed().toString()
    assert any("FlatMapGroupsInPandas" in line and "first" in line.split("]")[0] for line in plan.splitlines())


@pytest.mark.parametrize("place", [True, False])
def test_selectivity_sends_no_row_for_a_neighbour(spark, monkeypatch, place):
    for name, value in (("MOST_HELD", 7), ("CELL_ROWS", 9), ("CELL_EDGES", 11)):
        monkeypatch.setattr(interactions, name, value, raising=False)
    g = random.Random(3)
    bound = [(g.randrange(9), g.randrange(14), g.randrange(11) / 10) for _ in range(90)] + [(50, 3, None), (51, 99, 0.5)]
    links = [(a, b, g.randrange(80, 101) / 100, a % 2) for a in range(14) for b in range(14) if a != b and a % 2 == b % 2 and g.random() < 0.6]
    links += [(a, b, 0.93, p) for a, b, _, p in links[:20]]  # repeated edges
    want = {}
    for d, p, e in bound:
        x = want.setdefault(d, ({}, {}))
        x[0][p] = max(e or 0, x[0].get(p, 0))
        for a, b, f, _ in links:
            if a == p and f >= 0.9 and e is not None:
                x[1][b] = max(e * f, x[1].get(b, 0))
    got = interactions.selectivity(
        spark.createDataFrame(bound, "drug long, prot long, evidence double"), spark.createDataFrame(links, "prot1 long, prot2 long, evidence double, place int").drop(*["place"] * (not place)), 0.9)
    assert {r.drug: (r.direct, r.indirect) for r in got.collect()} == {
        d: (None if d == 50 else pytest.approx(sum(x.values()), abs=1e-6), pytest.approx(sum(y.values()), abs=1e-6)) for d, (x, y) in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any("hashpartitioning" in line and "drug" in line and "prot2" in line for line in plan.splitlines())


def test_demographic_filter(spark):
    df = spark.createDataFrame([("m", 5.0), ("f", 5.0), ("f", 0.0), ("f", 10.0)], "sex string, age double")
    keep = lambda spec: df.filter(evidence.demographic_filter(spec, F.col("sex"), F.col("age"))).count()
    assert [keep(s) for s in ("m", "a<10", "a>10.5", "a>0.5fa<5", "")] == [1, 3, 0, 1, 4]
    for bad in ("x", "a<", "mf"):
        with pytest.raises(ValueError):
            evidence.demographic_filter(bad, F.col("sex"), F.col("age"))
