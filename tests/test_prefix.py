"""Sums over orderings against plain Python."""

import itertools
import math

import pytest

from tarnsift.operators import metrics, prefix, relation

VALUES = [float("-inf"), -1e308, -2.0, -1.9999999999999998, -1.0, -5e-324, -0.0, 5e-324, 2.2e-308, 0.1, 0.5, 0.9999999999999999, 1.0,
          1.0000000000000002, 1.5, 2.0, 3.0, 7.9999999, 8.0, 1e300, 1.7e308, float("inf"), float("nan")]


def table(spark, rows):
    return spark.createDataFrame(rows, "v double, n long")


def test_spots_never_fall(spark):
    got = table(spark, [(v, 1) for v in [None, *VALUES]]).select("v", prefix.spot("v").alias("s")).collect()
    spots = [r.s for r in got]
    assert spots == sorted(spots) and None not in spots


@pytest.mark.parametrize("descending", [True, False])
def test_running(spark, descending):
    rows = [(v, i % 5) for i, v in enumerate(VALUES)] + [(None, 3)] + [(1 + i / 1e6, 2) for i in range(1, 200)]
    order = lambda r: (r[0] is not None, r[0] is not None and math.isnan(r[0]), 0 if r[0] is None or math.isnan(r[0]) else r[0])
    want, ahead = {}, 0
    for v, n in sorted(rows, key=order, reverse=descending):
        want[str(v)], ahead = ahead, ahead + n
    got = prefix.running(table(spark, rows[::-1]), "v", {"ahead": "n"}, descending).collect()
    assert {str(r.v): r.ahead for r in got} == want


def test_empty(spark):
    empty = table(spark, [])
    assert prefix.running(empty, "v", {"ahead": "n"}).count() == 0
    assert metrics.bh_fdr(empty.withColumnsRenamed({"v": "p", "n": "key"})).count() == 0


def test_bh_fdr_leaves_null_p(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, None), (5, 0.9)], "key long, p double")
    assert {r.key: r.q for r in metrics.bh_fdr(df).collect()} == {1: pytest.approx(0.08 / 3), 2: pytest.approx(0.08 / 3), 3: pytest.approx(0.08 / 3), 4: None, 5: pytest.approx(0.9)}


def test_share_of_rows_with_ties(spark):
    rows = [(k, None if s is None else float(s)) for k, s in enumerate([5, 5, 5, 1, 9, None, 5, 2, 1, 1])]
    df = spark.createDataFrame(rows, "key long, score double")
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for share in (0, 10, 30, 50, 90, 100):
        got = {r.key for r in relation.score_filter(df, f"top{share}%").collect()}
        assert got == {k for k, _ in ordered[: len(rows) * share // 100]}


@pytest.mark.parametrize("hit,value", [(0, 1.0), (1, 0.39794), (2, 0.221849), (3, 0.09691), (4, 0.0), (9, 0.0)])
def test_febe_of_single_hits(spark, hit, value):
    df = spark.createDataFrame([(f"d{i}", float(10 - i), i == hit) for i in range(10)], "key string, score double, is_kt boolean")
    assert metrics.febe(df).first()[0] == pytest.approx(value, abs=1e-6)


def test_log_factorials():
    import numpy as np

    n = np.array([0, 1, 2, 10, 255, 256, 257, 1000, 10**6])
    assert metrics.log_factorial(n) == pytest.approx([math.lgamma(x + 1) for x in n.tolist()], rel=1e-13)


def test_fisher_against_sums_of_binomials():
    import numpy as np

    for a, r, c, n in itertools.product(range(0, 5), (3, 5), (4, 6), (12, 20)):
        want = sum(math.comb(c, x) * math.comb(n - c, r - x) for x in range(a, min(r, c) + 1)) / math.comb(n, r)
        assert metrics.fisher_greater(*(np.array([x]) for x in (a, r, c, n)))[0] == pytest.approx(want)
