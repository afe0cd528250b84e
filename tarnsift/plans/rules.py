"""Queries over single rules: cleaning, screening, norms, sets.  They join those of slate.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnsift.operators import contingency as con
from tarnsift.operators import graph, metrics, normalize, paths, ranking
from tarnsift.operators import relation as rel
from tarnsift.operators import screening as scr
from tarnsift.plans.slate import RANKED, query

NORMS = """, nm AS (SELECT l_partkey AS key, l_linenumber AS line, max(l_discount * 10) AS norm FROM lineitem GROUP BY 1, 2)"""


def _norms(t):
    x = t.lineitem.groupBy(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("line")).agg(F.max(F.col("l_discount") * 10).alias("norm"))
    return x.select("key", F.concat(F.lit("f"), F.col("line").cast("string")).alias("name"), "norm")


@query("clean_outliers", """, q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
  SELECT l_orderkey, l_linenumber FROM lineitem, q WHERE l_extendedprice > 0 AND l_extendedprice < q3 + 1.5 * exp(3 * 0.05::DOUBLE) * (q3 - q1)""")
def _(t):
    return scr.remove_outliers(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), 0.05, "l_extendedprice").drop("l_extendedprice")


@query("fold_values", "SELECT DISTINCT o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown indication' ELSE o_orderpriority END AS value FROM orders")
def _(t):
    value = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x unknown indication "), "o_orderpriority")).otherwise(F.concat(F.lit("\t "), "o_orderpriority", F.lit(" ")))
    return scr.fold_values(t.orders.select("o_custkey", value.alias("value")), "o_custkey", "value")


@query("last_doses", """, e AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 5 > 0 THEN round(value, 3) END AS amount, CASE WHEN event_id % 7 > 0 THEN 'u' || event_id % 11 ELSE '' END AS unit FROM events),
  c AS (SELECT unit, row_number() OVER (ORDER BY min(event_id), unit) AS code FROM e WHERE unit <> '' GROUP BY 1),
  l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
  SELECT user_id, event_type, amount, CAST(coalesce(code, 0) AS INTEGER) AS unit FROM l LEFT JOIN c ON l.unit = c.unit""")
def _(t):
    amount = F.when(F.col("event_id") % 5 > 0, F.round("value", 3).cast("string")).otherwise("some")
    unit = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("u"), (F.col("event_id") % 11).cast("string"))).otherwise("")
    return scr.last_doses(t.events.select("user_id", "event_type", "event_id", amount.alias("amount"), unit.alias("unit")), ["user_id", "event_type"], "amount", ["unit"], "event_id")


@query("distinct_titles", """, r AS (SELECT p_partkey, p_type || ' ' || p_brand AS title, p_name || p_partkey AS full_name, p_size // 10 AS targets FROM part),
  k AS (SELECT *, lag(targets) OVER (PARTITION BY title ORDER BY p_partkey) AS prev FROM r), l AS (SELECT * FROM k WHERE prev IS NULL OR prev <> targets)
  SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY title) > 1 THEN full_name ELSE title END AS title FROM l""")
def _(t):
    title, full = F.concat_ws(" ", "p_type", "p_brand"), F.concat("p_name", F.col("p_partkey").cast("string"))
    rows = t.part.select("p_partkey", title.alias("title"), full.alias("full_name"), F.floor(F.col("p_size") / 10).alias("targets"), F.col("p_partkey").alias("place"))
    return scr.distinct_titles(rows).select("p_partkey", "title")


@query("drop_generic_keys", """, k AS (SELECT p_partkey, p_size, substr(md5(p_brand || p_type), 1, 14) AS head, CASE WHEN p_partkey % 3 = 0 THEN '-UHFFFAOYSA-N' ELSE '-ABCDEFGHIJ-N' END AS tail FROM part)
  SELECT p_partkey, head || tail AS key FROM k a WHERE p_partkey % 3 > 0 OR NOT EXISTS (SELECT 1 FROM k b WHERE b.p_size = a.p_size AND b.head = a.head AND b.p_partkey % 3 > 0)""")
def _(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, "-UHFFFAOYSA-N").otherwise("-ABCDEFGHIJ-N")
    keys = t.part.select("p_partkey", "p_size", F.concat(F.substring(F.md5(F.concat("p_brand", "p_type")), 1, 14), tail).alias("key"))
    return scr.drop_generic_keys(keys, "p_size", "key").drop("p_size")


@query("phase_number", """SELECT c_custkey, CASE c_nationkey % 8 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS phase FROM customer""")
def _(t):
    names = F.array(*[F.lit(x) for x in ("Phase 3", "Phase 2", "Phase 2/Phase 3", "Phase 1", "Phase 1/Phase 2", "Phase 4", "Early Phase 1")], F.lit(None).cast("string"))
    return t.customer.select("c_custkey", scr.phase_number(F.element_at(names, (F.col("c_nationkey") % 8 + 1).cast("int"))).alias("phase"))


@query("alpha_then_int", """, v AS (SELECT DISTINCT CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS v FROM customer)
  SELECT v, row_number() OVER (ORDER BY try_cast(v AS BIGINT) IS NOT NULL, try_cast(v AS BIGINT), v) AS place FROM v""")
def _(t):
    v = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    key = scr.alpha_then_int(F.col("v"))
    return t.customer.select(v.alias("v")).distinct().select("v", F.row_number().over(Window.orderBy(key)).cast("long").alias("place"))


@query("map_edits", """SELECT c_custkey, 'name=' || c_name || ',seg=X,t=1' AS merged, 'seg=' || c_mktsegment AS subset, 'name=' || c_name AS subtracted,
  CASE WHEN c_nationkey % 2 = 0 THEN 'name=' || c_name || ',t=1' ELSE 'name=' || c_name || ',seg=X,t=1' END AS modified FROM customer""")
def _(t):
    own = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    edit = F.create_map(F.lit("seg"), F.lit("X"), F.lit("t"), F.lit("1"))
    template = F.create_map(F.lit("seg"), F.when(F.col("c_nationkey") % 2 == 1, "X"), F.lit("t"), F.lit("1"))
    text = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    keys = F.array(F.lit("seg"), F.lit("none"))
    return t.customer.select("c_custkey", text(scr.merge_maps(own, edit)).alias("merged"), text(scr.subset_map(own, keys)).alias("subset"),
                             text(scr.subtract_map(own, keys)).alias("subtracted"), text(scr.modify_map(own, template)).alias("modified"))


@query("screen_drugs", """, b AS (SELECT l_partkey, bool_and(l_returnflag = 'R' OR l_linestatus = 'F') AS bad FROM lineitem GROUP BY 1)
  SELECT p_partkey AS drug FROM part LEFT JOIN b ON p_partkey = l_partkey WHERE NOT ((p_size <= 3 OR coalesce(bad, false)) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22'))""")
def _(t):
    labels = t.lineitem.select(F.col("l_partkey").alias("drug"), F.array("l_returnflag", F.concat(F.lit("s"), "l_linestatus")).alias("labels"))
    drugs = t.part.select(F.col("p_partkey").alias("drug"), (F.col("p_size") <= 3).alias("ubiquitous"), F.col("p_brand").alias("indication"))
    return scr.screen(drugs, labels, ["R", "sF"], ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"]).select("drug")


@query("smooth", """, e AS (SELECT user_id, event_id, value, coalesce(lag(value) OVER w, 0) AS a, coalesce(lead(value) OVER w, 0) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT event_id, round((b * 1 + value * 2 + a * 5) / 8, 8) AS smoothed FROM e""")
def _(t):
    return scr.smooth(t.events, "user_id", "event_id", "value", [1.0, 2.0, 5.0], 1).select("event_id", F.round("smoothed", 8).alias("smoothed"))


@query("stable_mean", "SELECT l_suppkey, CASE WHEN min(l_discount) = max(l_discount) THEN min(l_discount) ELSE round(avg(l_discount), 9) END AS mean, min(0.1::DOUBLE) AS constant FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.withColumn("c", F.lit(0.1)).groupBy("l_suppkey").agg(F.round(scr.stable_mean("l_discount"), 9).alias("mean"), scr.stable_mean("c").alias("constant"))


@query("log_odds", """, f AS (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b, count(*) FILTER (WHERE l_linestatus = 'F') AS c FROM lineitem GROUP BY 1)
  SELECT l_partkey, round(ln(greatest(0.0001::DOUBLE, least(10000.0::DOUBLE, CASE WHEN b > 0 THEN a::DOUBLE / b WHEN a > 0 THEN 10000.0 ELSE 0 END))), 6) AS log_odds FROM f""")
def _(t):
    f = t.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b"))
    odds = F.when(F.col("b") > 0, F.col("a") / F.col("b")).when(F.col("a") > 0, float("inf")).otherwise(float("nan"))
    return f.select("l_partkey", F.round(scr.log_odds(odds), 6).alias("log_odds"))


@query("directional_evidence", "SELECT l_orderkey, l_linenumber, round(l_discount * CASE l_returnflag WHEN 'R' THEN 1 ELSE -1 END, 4) + 0.0::DOUBLE AS evidence FROM lineitem")
def _(t):
    direction = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(scr.directional(F.col("l_discount"), direction), 4).alias("evidence"))


@query("quantize", "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 1024, 0) / 1024 AS price FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", scr.quantize(F.col("l_extendedprice"), 3).alias("price"))


# --- relations and sets ------------------------------------------------------------------------


@query("property_pairs", "SELECT p_brand AS value1, p_type AS value2 FROM part")
def _(t):
    return rel.property_pairs(t.eav(), "p_partkey", "brand", "type")


@query("annotate", "SELECT l_suppkey AS workspace, l_orderkey * 10 + l_linenumber AS id, p_brand AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R'")
def _(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("workspace"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "R").alias("invalid"))
    return rel.annotate(rows, t.eav(), "p_partkey", "brand", False)


@query("bridge_max", """, t AS (SELECT DISTINCT s_nationkey AS name, l_suppkey * 10 + l_linenumber AS term FROM supplier JOIN lineitem ON s_suppkey = l_suppkey),
  a AS (SELECT l_suppkey * 10 + l_linenumber AS term, l_partkey AS prot, max(l_discount) AS overall FROM lineitem GROUP BY 1, 2)
  SELECT name, prot, round(greatest(0.0::DOUBLE, max(overall * (name + 1))), 6) AS score FROM t JOIN a ON t.term = a.term GROUP BY 1, 2""")
def _(t):
    term = (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("term")
    found = rel.bridge_max(
        t.nation.select(F.col("n_nationkey").alias("name"), (F.col("n_nationkey") + 1).alias("score")), t.supplier.select(F.col("s_nationkey").alias("name"), F.col("s_suppkey").alias("concept")),
        t.lineitem.select(F.col("l_suppkey").alias("concept"), term), t.lineitem.groupBy(term, F.col("l_partkey").alias("prot")).agg(F.max("l_discount").alias("overall")))
    return found.select("name", "prot", F.round("score", 6).alias("score"))


@query("stack_matrices", """, b AS (SELECT c_custkey AS "row", c_mktsegment AS feature, c_acctbal AS value, 0 AS src FROM customer UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'nation' || s_nationkey END, s_acctbal, 1 FROM supplier),
  f AS (SELECT feature, row_number() OVER (ORDER BY min(src), feature) - 1 AS "column" FROM b GROUP BY 1) SELECT "row", "column", value FROM b JOIN f ON b.feature = f.feature""")
def _(t):
    feature = F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise(F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")))
    return rel.stack_matrices(t.customer.select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("feature"), F.col("c_acctbal").alias("value")),
                              t.supplier.select(F.col("s_suppkey").alias("row"), feature.alias("feature"), F.col("s_acctbal").alias("value")))


@query("flag_groups", "SELECT CAST((l_quantity > 25)::INT + 2 * (l_discount > 0.05)::INT + 4 * (l_tax > 0.04)::INT + 8 * (l_returnflag = 'R')::INT AS BIGINT) AS flags, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return rel.flag_groups(t.lineitem, [F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, F.col("l_returnflag") == "R"])


CANON = """, s AS (SELECT p_partkey AS id, p_size AS parent, list_sort(list(DISTINCT l_returnflag || l_linestatus || l_linenumber % 2)) AS items FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2)
  SELECT id, min(id) OVER (PARTITION BY items{}) AS canonical FROM s"""


def _canonical(t, siblings_only):
    item = F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 2).cast("string"))
    nodes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("parent"), F.col("p_partkey").alias("place"))
    return rel.canonical_sets(nodes, t.lineitem.select(F.col("l_partkey").alias("id"), item.alias("item")), siblings_only)


@query("canonical_sets", CANON.format(""))
def _(t):
    return _canonical(t, False)


@query("canonical_siblings", CANON.format(", parent"))
def _(t):
    return _canonical(t, True)


@query("status_counters", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderdate) AS latest, min(o_orderdate) AS first FROM orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"), F.min("o_orderdate").alias("first"))


@query("unique_targets", "SELECT drug, count(DISTINCT prot) AS n_targets FROM dpi WHERE evidence >= 0.5 GROUP BY 1")
def _(t):
    return rel.threshold(t.dpi(), 0.5).groupBy("drug").agg(F.count_distinct("prot").alias("n_targets"))


@query("top_hits", "SELECT key, score FROM scores ORDER BY score DESC, key LIMIT 1000")
def _(t):
    return rel.score_filter(t.scores().select("key", "score"), "top1000")


@query("path_groups", 'SELECT l_partkey AS drug, l_suppkey AS "group", round(sum((l_discount + l_tax) / 2), 6) AS score FROM lineitem GROUP BY 1, 2')
def _(t):
    return paths.path_groups(t.lineitem.withColumnsRenamed({"l_partkey": "drug", "l_suppkey": "group"}), "group", ["l_discount", "l_tax"])


PATHWAYS = """, dr AS (SELECT DISTINCT l_suppkey AS drug, l_partkey AS prot FROM lineitem WHERE l_quantity > 40), pw AS (SELECT p_brand || p_size % 5 AS pathway, p_partkey AS prot FROM part)"""


def _pathways(t):
    drugs = t.lineitem.filter("l_quantity > 40").select(F.col("l_suppkey").alias("drug"), F.col("l_partkey").alias("prot")).distinct()
    return drugs, t.part.select(F.concat("p_brand", (F.col("p_size") % 5).cast("string")).alias("pathway"), F.col("p_partkey").alias("prot"))


@query("pathway_portions", PATHWAYS + """, n AS (SELECT pathway, count(*) AS n FROM pw GROUP BY 1), x AS (SELECT drug, pw.pathway, round(sum(0.25::DOUBLE) / any_value(n), 6) AS portion FROM dr JOIN pw ON dr.prot = pw.prot JOIN n ON n.pathway = pw.pathway GROUP BY 1, 2)
  SELECT drug, pathway, portion, CAST(ceil(portion) AS BIGINT) AS "binary" FROM x""")
def _(t):
    drugs, pathways = _pathways(t)
    return paths.pathway_portions(drugs.withColumn("evidence", F.lit(0.25)), pathways)


@query("pathway_overrepresentation", PATHWAYS + """, a AS (SELECT drug, pathway, count(*) AS k FROM dr JOIN pw ON dr.prot = pw.prot GROUP BY 1, 2), d AS (SELECT drug, count(*) AS r FROM dr GROUP BY 1), w AS (SELECT pathway, count(*) AS c FROM pw GROUP BY 1),
  x AS (SELECT a.drug, a.pathway, r, c, (SELECT count(*) FROM part) AS n, unnest(range(k, CAST(least(r, c) AS BIGINT) + 1)) AS x FROM a JOIN d ON a.drug = d.drug JOIN w ON a.pathway = w.pathway),
  p AS (SELECT drug, pathway, sum(exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(c + 1) + lgamma(n - c + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r - x + 1) - lgamma(c - x + 1) - lgamma(n - r - c + x + 1))) AS p FROM x WHERE n - r - c + x >= 0 GROUP BY 1, 2)
  SELECT drug, pathway, round(-log10(p), 4) AS score FROM p WHERE -log10(p) > 0.5""")
def _(t):
    drugs, pathways = _pathways(t)
    return paths.pathway_overrepresentation(drugs, pathways, t.part.count(), 0.5).select("drug", "pathway", F.round("score", 4).alias("score"))


@query("condense_hierarchy")
def _(t):
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = t.nation.select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent")).unionByName(
        t.supplier.select(node("s", "s_suppkey").alias("node"), node("n", "s_nationkey").alias("parent")))
    score = t.supplier.select(node("s", "s_suppkey").alias("node"), "s_acctbal", node("n", "s_nationkey").alias("n"))
    own = score.select("node", F.col("s_acctbal").alias("score"))
    means = t.customer.groupBy(node("n", "c_nationkey").alias("node")).agg(F.avg("c_acctbal").alias("score"))
    depth = edges.select("node", F.when(F.col("node").startswith("n"), 1).otherwise(2).alias("depth"))
    return graph.condense_hierarchy(own.unionByName(means), edges, depth)


# --- norms and combinations ----------------------------------------------------------------------


@query("rank_norm", RANKED + " SELECT key, CAST(1 + ahead + tied // 2 AS DOUBLE) AS norm FROM r")
def _(t):
    return normalize.rank_norm(t.scores())


@query("pct_norm", RANKED + " SELECT key, round(100 - (1 + ahead + tied // 2) * 100.0::DOUBLE / total, 6) AS norm FROM r")
def _(t):
    return normalize.pct_norm(t.scores())


@query("target_norm", """, g AS (SELECT prot, min(score) AS score FROM scores JOIN (SELECT DISTINCT drug, prot FROM dpi) d ON key = drug GROUP BY 1),
  k AS (SELECT prot, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) // 2 AS r FROM g)
  SELECT drug AS key, CAST(min(r) AS DOUBLE) AS norm FROM k JOIN (SELECT DISTINCT drug, prot FROM dpi) d ON d.prot = k.prot GROUP BY 1""")
def _(t):
    return normalize.target_norm(t.scores(), t.dpi().select(F.col("drug").alias("key"), F.col("prot").alias("target")))


@query("floor_combine", NORMS + " SELECT key, round(sum(CASE line WHEN 1 THEN 0.5 ELSE 0.8 END * greatest(norm - CASE line WHEN 1 THEN 0.1 ELSE 0.3 END, 0) / (1 - CASE line WHEN 1 THEN 0.1::DOUBLE ELSE 0.3 END)), 6) AS combined FROM nm WHERE line <= 2 GROUP BY 1")
def _(t):
    return normalize.floor_combine(_norms(t), {"f1": 0.5, "f2": 0.8}, {"f1": 0.1, "f2": 0.3})


@query("sigmoid_combine", NORMS + " SELECT key, round(sum(CASE line WHEN 1 THEN 0.5 ELSE 0.8 END / (1 + exp(-(norm - CASE line WHEN 1 THEN 0.4::DOUBLE ELSE 0.6 END) / CASE line WHEN 1 THEN 0.1::DOUBLE ELSE 0.2 END))), 6) AS combined FROM nm WHERE line <= 2 GROUP BY 1")
def _(t):
    return normalize.sigmoid_combine(_norms(t), {"f1": 0.5, "f2": 0.8}, {"f1": 0.4, "f2": 0.6}, {"f1": 0.1, "f2": 0.2})


@query("weighted_columns", NORMS + " SELECT key, 'f' || line AS name, round(norm * CASE line WHEN 1 THEN 0.5::DOUBLE ELSE 0.8 END, 6) AS weighted FROM nm WHERE line <= 2")
def _(t):
    return normalize.weighted_columns(_norms(t), {"F1": 0.5, "F2": 0.8})


@query("pair_boosts", """, w AS (SELECT l_partkey AS key, any_value(p_size <= 5) AS is_kt, max(l_discount * 10) AS d, max(l_tax * 10) AS x, max(l_quantity / 50) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
  u AS (SELECT 'd' AS f1, 'd' AS f2, 'one' AS way, d AS score, is_kt FROM w UNION ALL SELECT 'x', 'x', 'one', x, is_kt FROM w UNION ALL SELECT 'q', 'q', 'one', q, is_kt FROM w
    UNION ALL SELECT 'd', 'x', 'added', (d + x) / 2, is_kt FROM w UNION ALL SELECT 'd', 'x', 'multiplied', d + x - d * x, is_kt FROM w
    UNION ALL SELECT 'd', 'q', 'added', (d + q) / 2, is_kt FROM w UNION ALL SELECT 'd', 'q', 'multiplied', d + q - d * q, is_kt FROM w
    UNION ALL SELECT 'x', 'q', 'added', (x + q) / 2, is_kt FROM w UNION ALL SELECT 'x', 'q', 'multiplied', x + q - x * q, is_kt FROM w),
  b AS (SELECT f1, f2, way, score, count(*) AS n, count(*) FILTER (WHERE is_kt) AS h FROM u GROUP BY ALL),
  c AS (SELECT *, sum(n) OVER z AS cn, sum(h) OVER z AS ch FROM b WINDOW z AS (PARTITION BY f1, f2, way ORDER BY score DESC)),
  m AS (SELECT f1, f2, way, round(coalesce(sum(h * ch::DOUBLE / cn) / sum(h), 0), 6) AS m FROM c GROUP BY ALL)
  SELECT p.f1, p.f2, p.way, round(p.m - greatest(a.m, z.m), 6) AS boost FROM m p JOIN m a ON a.way = 'one' AND a.f1 = p.f1 JOIN m z ON z.way = 'one' AND z.f1 = p.f2 WHERE p.way <> 'one'""")
def _(t):
    wide = t.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.max(F.col("l_discount") * 10).alias("d"), F.max(F.col("l_tax") * 10).alias("x"), F.max(F.col("l_quantity") / 50).alias("q"))
    kts = t.part.select(F.col("p_partkey").alias("key"), (F.col("p_size") <= 5).alias("is_kt"))
    return normalize.pair_boosts(wide.join(kts, "key"), ["d", "x", "q"], metrics.average_precision)


@query("background_distance", """, x AS (SELECT a.score AS x, coalesce(b.score, 0) AS y FROM scores a LEFT JOIN (SELECT * FROM scores2 WHERE key % 3 > 0) b ON a.key = b.key),
  r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM x) SELECT round(1 - round(corr(rx, ry), 6), 6) AS bg_distance FROM r""")
def _(t):
    return paths.background_distance(t.scores(), t.scores2().filter("key % 3 > 0"))


@query("label_ranks", RANKED + """, k AS (SELECT 1 + ahead + tied // 2 AS p FROM r JOIN scores s ON r.key = s.key WHERE is_kt)
  SELECT round(avg(p), 6) AS mean_rank, round(avg(1 / (1 + exp(-(200 - p) / 50.0::DOUBLE))), 6) AS mean_sigma FROM k""")
def _(t):
    return ranking.label_ranks(t.scores())


@query("rank_delta_norm", """, a AS (SELECT key, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) // 2 AS r FROM scores), b AS (SELECT key, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) // 2 AS r FROM scores2 WHERE key % 5 <> 0),
  d AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.r, (SELECT count(*) + 1 FROM a)) - coalesce(b.r, (SELECT count(*) + 1 FROM b)) AS d FROM a FULL JOIN b ON a.key = b.key)
  SELECT key, round((d - (SELECT avg(d) FROM d)) / (SELECT stddev_pop(d) FROM d), 6) AS norm FROM d""")
def _(t):
    return normalize.z_norm(ranking.rank_delta(t.scores().select("key", "score"), t.scores2().filter("key % 5 <> 0")).select("key", F.col("delta").cast("double").alias("score")))


@query("score_categories", "SELECT key, CASE WHEN score <= 500 THEN 'Low' WHEN score <= 800 THEN 'Med' ELSE 'High' END AS category FROM scores")
def _(t):
    return t.scores().select("key", normalize.category(F.col("score"), 500, 800).alias("category"))


@query("passing_fractions", "SELECT p AS o_orderpriority, round(coalesce(avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 0), 6) AS fraction FROM (SELECT unnest(['1-URGENT', '2-HIGH', 'none']) AS p) LEFT JOIN orders ON p = o_orderpriority GROUP BY 1")
def _(t):
    return con.passing_fractions(t.orders.withColumn("fold", F.col("o_totalprice") > 1000), "o_orderpriority", "fold", F.col("o_orderstatus") == "F", ["1-URGENT", "2-HIGH", "none"])
