import json
import random

import brute
import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnsift.llm import chat, graph_index, mixing, queries, revisits, sharding
from tarnsift.llm.common import materialize

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    got = queries.QUERIES[name](spark, DIR)
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())


# --- 4: revisits -----------------------------------------------------------------------------


def test_canonical_url(spark):
    same = ["http://www.A.org:80/x/?b=2&a=1&utm_source=q#f", "https://a.org/x?a=1&b=2&ref=z", "HTTP://a.ORG/x/?a=1&b=2"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in [*same, "nonsense", "", None]], "url string").coalesce(1).select(revisits.canonical_url(F.col("url"))).collect()]
    assert got == ["a.org/x?a=1&b=2"] * 3 + [None] * 3


@pytest.mark.parametrize("partitions", [1, 7])
def test_revisits(spark, partitions):
    g = random.Random(5)
    log = []
    for i in range(300):
        url = "http://hot.org/" if g.random() < 0.6 else f"http://h{g.randrange(9)}.org/"
        tag = {"etag": f'"{g.randrange(3)}"'} if g.random() < 0.9 else {}
        log.append((i, g.choice(["response", "revisit", "request"]), url, g.randrange(80), {**tag, "content-type": f"t{i}", "date": str(i)}, "x"))
    log += [(900, "revisit", None, 5, {}, "x"), (901, "revisit", "http://never.org", 5, None, "x"), (902, "response", "http://n.org", 1, None, "x"), (903, "revisit", "http://n.org", 2, None, "x")]
    df = spark.createDataFrame(log, "record_id long, kind string, url string, captured long, headers map<string,string>, key string")
    got = {r.record_id: r for r in revisits.resolve_revisits(df, partitions).collect()}
    assert len(got) == sum(x[1] == "revisit" for x in log)
    for i, kind, url, at, headers, _ in log:
        if kind != "revisit":
            continue
        earlier = [x for x in log if x[1] == "response" and url and x[2] == url and x[3] < at]
        best = max(earlier, key=lambda x: (x[3], x[0]), default=None)
        r = got[i]
        if not url:
            assert r.status == "no_url"
        elif best is None:
            assert r.status == "no_response"
        else:
            ours, theirs = (headers or {}).get("etag"), (best[4] or {}).get("etag")
            want = "no_validator" if ours is None or theirs is None else "resolved" if ours == theirs else "mismatch"
            assert (r.response_id, r.status) == (best[0], want)
            if want == "resolved":
                assert r.headers == {**best[4], "date": headers["date"], "etag": ours}
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


# --- 5: nearest neighbours -------------------------------------------------------------------


def exact(rows, asked, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in ok:
        if i in asked:
            near = sorted((-round(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), 12), j) for j, w in ok if j != i and len(w) == len(v))
            out[i] = [j for _, j in near[:k]]
    return out


def test_nearest(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.standard_normal(8).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(90)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] * 4), (2003, [float("nan")] * 8), (2004, []), (2005, [1.0, 2.0]), (2006, [2.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    asked = {i for i, _ in rows if i is not None and i % 50 == 0 or i in (1007, 2005)}
    got = {}
    for r in graph_index.nearest(df, df.filter(F.col("vec_id").isin(list(asked)))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(rows, asked)
    assert got.keys() == want.keys()
    assert got[1007] == want[1007] == [1000, 1001, 1002, 1003, 1004] and got[2005] == [2006]
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.9 * sum(map(len, want.values()))
    assert graph_index.nearest(df.limit(0), df.limit(0)).count() == 0


def test_several_shards(spark, monkeypatch):
    monkeypatch.setattr(graph_index, "SHARD_POINTS", 64)
    g = np.random.default_rng(6)
    rows = [(i, g.standard_normal(6).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = graph_index.nearest(df, df.filter("vec_id % 20 = 0")).groupBy("query_id").agg(F.collect_list("vec_id").alias("v")).collect()
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], set(range(0, 300, 20)))
    assert sum(len(set(r.v) & set(want[r.query_id])) for r in got) >= 0.9 * 5 * len(want)


# --- 7: mixing -------------------------------------------------------------------------------


def test_targets(spark):
    g = random.Random(1)
    for _ in range(5):
        sizes = {f"s{i}": g.choice([0, 1, 10, 1000, 50_000]) for i in range(9)} | {"big": 80_000}
        weights = {s: g.choice([1, 2, 3]) for s in sizes}
        df = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "source string, source_size long, weight double")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute.targets(sizes, weights))


@pytest.mark.parametrize("limit", [10_000, 0])
def test_mixing(docs, rows, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    narrow = mixing.sized(docs)
    out = mixing.mix_sources(narrow, mixing.targets_of(narrow)).collect()
    assert len(out) == len(rows) and all(r.mix_copies <= 2 and r.mix_target <= 2 * r.mix_source_size for r in out)
    assert {r.doc_id: r.mix_size for r in out} == {r[0]: len(brute.words(r[1])) for r in rows}
    again = mixing.mix_sources(narrow, mixing.targets_of(narrow)).collect()
    assert {r.doc_id: r.mix_copies for r in again} == {r.doc_id: r.mix_copies for r in out}


def test_mix_comes_near_its_targets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    narrow = mixing.sized(df)
    out = mixing.mix_sources(narrow, mixing.targets_of(narrow)).groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_size")).alias("got"), F.max("mix_target").alias("want"))
    assert all(abs(r.got - r.want) < 0.06 * r.want for r in out.collect())
    empty = mixing.sized(df.limit(0))
    assert mixing.mix_sources(empty, mixing.targets_of(empty)).count() == 0


# --- 8: sharding -----------------------------------------------------------------------------


def check_shards(out, shards, largest):
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    for s, got in by.items():
        assert 0 <= s < shards and sorted(r.slot for r in got) == list(range(len(got)))
    size = [sum(r.shard_bytes for r in by.get(s, [])) for s in range(shards)]
    assert max(size) - min(size) <= 2 * largest + 0.01 * sum(size) / shards


def test_sharding(spark, docs, no_docs):
    narrow = docs.filter("length(text) < 5000 or text is null").select("doc_id", "text")
    for df in (narrow, spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")),
               spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.repeat(F.lit("z"), (F.col("id") % 200).cast("int"))).alias("text"))):
        keyed = materialize(sharding.with_keys(df).drop("text"), "test")
        out = sharding.shard_rows(keyed, shards=10).collect()
        assert len(out) == df.count()
        check_shards(out, 10, max(r.shard_bytes for r in out))
    empty = materialize(sharding.with_keys(no_docs).select("shard_high", "shard_low", "shard_bytes"), "test")
    assert sharding.shard_rows(empty).count() == 0


@pytest.mark.parametrize("cell_rows", [sharding.CELL_ROWS, 3])
def test_shards_against_a_sort(spark, docs, monkeypatch, cell_rows):
    """Whole texts, with clashing columns: shards are runs of the sorted keys, cut where the bytes are nearest equal."""
    monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
    clashing = docs.withColumns({n: F.lit(7) for n in ("slot", "_cell", "_at", "_offset", "_row")})
    out = sharding.shard_rows(materialize(sharding.with_keys(clashing), "test"), shards=5)
    assert sorted(out.columns) == sorted({*docs.columns, "slot", "shard_high", "shard_low", "shard_bytes"})
    rows = sorted(out.collect(), key=lambda r: (r.shard_high, r.shard_low))
    size = [len((r.text or "").encode()) + sharding.ROW_BYTES for r in rows]
    assert len(rows) == docs.count() and [r.shard_bytes for r in rows] == size
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert [(r.shard, r.slot) for r in rows] == [(r.shard, sum(x.shard == r.shard for x in rows[:i])) for i, r in enumerate(rows)]
    ends = [0, *np.cumsum(size).tolist()]
    for i in range(1, 5):
        target, cut = ends[-1] * i / 5, ends[sum(r.shard < i for r in rows)]
        assert abs(cut - target) <= min(abs(e - target) for e in ends) + sharding.TOLERANCE * ends[-1] / 5


def test_equal_texts_lie_together(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text"))
    out = sharding.shard_rows(materialize(sharding.with_keys(df), "test"), shards=8)
    assert out.groupBy("text").agg(F.count_distinct("shard").alias("n")).filter("n > 1").count() <= 7


# --- 9: chat ---------------------------------------------------------------------------------

TEXT = st.lists(st.sampled_from([*"<|\\>ab\n", "im_end", "<|im_start|>", "<|im_end|>"]), max_size=30).map("".join)


@given(st.lists(st.tuples(st.one_of(TEXT, st.just("assistant")), TEXT), max_size=5))
def test_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert [chat.unescape(text[s["start"]:s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": {"deep": [1]}},
        {"messages": [{"role": "user", "content": [{"text": "q"}]}, {"role": "model", "content": [{"text": "a"}]}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(50, json.dumps({"instruction": "q", "input": "more", "output": "a", "system": "s"})), (51, "{"), (52, None), (53, "[]"), (54, '{"other": 1}')]
    out = {r.conv_id: r for r in chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert all(chat.parse_turns(out[i].formatted) == turns for i in range(len(records)))
    assert len({out[i].fingerprint for i in range(len(records))}) == len(records)
    assert chat.parse_turns(out[50].formatted) == [("system", "s"), ("user", "q\n\nmore"), ("assistant", "a")]
    assert [out[i].n_turns for i in (51, 52, 53, 54)] == [0, 0, 0, 0]


def test_rows(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (None, 1, None, "x"), (1, 2, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: chat.parse_turns(r.formatted) for r in chat.format_rows(df).collect()}
    assert got == {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("", "x")]}
    assert chat.read_back(chat.format_rows(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.format_rows(df.select("conv_id", "role"))
