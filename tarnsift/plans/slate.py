"""All queries over the driver's tables, and their SQL.

The tables stand in for the domain's: line items are interactions of drugs (parts) and proteins
(suppliers), parts have attributes, summed quantities are scores, small parts are the known targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnsift.functions import text
from tarnsift.operators import contingency as con
from tarnsift.operators import graph, metrics, normalize, paths, ranking
from tarnsift.operators import evidence as evid
from tarnsift.operators import interactions as inter
from tarnsift.operators import relation as rel
from tarnsift.streaming import events as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables and the shapes that are made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def dpi(self) -> DataFrame:
        direction = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
        return self.lineitem.select(F.col("l_partkey").alias("drug"), F.col("l_suppkey").alias("prot"), F.round(F.col("l_discount") * 10, 4).alias("evidence"), direction.alias("direction"))

    def eav(self) -> DataFrame:
        return self.part.select("p_partkey", F.expr("stack(3, 'brand', p_brand, 'type', p_type, 'size', cast(p_size as string)) as (attribute, value)"))

    def scores(self) -> DataFrame:
        s = self.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("score"))
        kt = self.part.select(F.col("p_partkey").alias("key"), (F.col("p_size") <= 5).alias("is_kt"))
        return s.join(kt, "key")

    def scores2(self) -> DataFrame:
        return self.lineitem.groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("score"))

    def edges(self, place: bool = False) -> DataFrame:
        """Suppliers of a nation whose balances differ by under 1,000: those of the same or the next band of 1,000; the
        nation as their place, if asked for."""
        band = F.floor(F.col("s_acctbal") / 1000)
        a = self.supplier.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("a")
        b = self.supplier.withColumn("band", band).alias("b")
        near = F.abs(F.col("a.s_acctbal") - F.col("b.s_acctbal"))
        meet = (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.band") == F.col("b.band"))
        return a.join(b, meet & (F.col("a.s_suppkey") != F.col("b.s_suppkey")) & (near < 1000)).select(
            F.col("a.s_suppkey").alias("prot1"), F.col("b.s_suppkey").alias("prot2"), F.round(1 - near / 10000, 4).alias("evidence"), *[F.col("a.s_nationkey").alias("place")] * place)

    def measures(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("drug"), F.col("l_linenumber").alias("prot"), F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("direction"), F.col("l_quantity").alias("value"))

    def members(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("item")).distinct()


SHAPES = """
WITH dpi AS (SELECT l_partkey AS drug, l_suppkey AS prot, round(l_discount * 10, 4) AS evidence,
  CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS direction FROM lineitem),
eav AS (SELECT p_partkey, 'brand' AS attribute, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part),
scores AS (SELECT l_partkey AS key, sum(l_quantity) AS score, any_value(p_size <= 5) AS is_kt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
scores2 AS (SELECT l_partkey AS key, CAST(count(*) AS DOUBLE) AS score FROM lineitem GROUP BY 1),
edges AS (SELECT a.s_suppkey AS prot1, b.s_suppkey AS prot2, round(1 - abs(a.s_acctbal - b.s_acctbal) / 10000, 4) AS evidence
  FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 1000),
measures AS (SELECT l_suppkey AS drug, l_linenumber AS prot, CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END AS direction, l_quantity AS value FROM lineitem),
members AS (SELECT DISTINCT l_suppkey AS "set", l_partkey AS item FROM lineitem),
cons AS (SELECT drug, prot, max(evidence) AS evidence, CAST(sign(sum(direction)) AS INTEGER) AS direction FROM dpi GROUP BY 1, 2),
blocks AS (SELECT score, count(*) AS n, count(*) FILTER (WHERE is_kt) AS hits FROM scores GROUP BY 1),
steps AS (SELECT *, CAST(sum(n) OVER (ORDER BY score DESC) AS BIGINT) AS cum_n, CAST(sum(hits) OVER (ORDER BY score DESC) AS BIGINT) AS cum_hits FROM blocks),
ties AS (SELECT key, s.score, cum_n - n + (n - hits) // 2 + row_number() OVER (PARTITION BY s.score ORDER BY key) - 1 AS tie_rank
  FROM scores s JOIN steps b ON s.score = b.score WHERE is_kt)
"""


def query(name: str, sql: str | None = None):
    """Registers a query over Tables, with its SQL over SHAPES."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = SHAPES + sql
        return f

    return add


# --- relations -------------------------------------------------------------------------------


@query("scan_project_filter", "SELECT drug, prot, evidence FROM dpi WHERE evidence >= 0.5")
def _(t):
    return rel.threshold(t.dpi(), 0.5).select("drug", "prot", "evidence")


@query("semi_join_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def _(t):
    keys = t.part.filter("p_size <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return rel.select_keys(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), keys, "l_partkey").drop("l_partkey")


@query("anti_join_exclude", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1)")
def _(t):
    return rel.exclude_keys(t.supplier.select("s_suppkey"), t.lineitem.filter("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey")


@query("any_column_select", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', '1-URGENT') OR o_orderpriority IN ('F', '1-URGENT')")
def _(t):
    return rel.any_column(t.orders, ["o_orderstatus", "o_orderpriority"], ["F", "1-URGENT"]).select("o_orderkey")


@query("key_filter_algebra", "SELECT key FROM scores WHERE is_kt AND key IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND key NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount = 0)")
def _(t):
    line = t.lineitem.withColumnRenamed("l_partkey", "key")
    return rel.key_filter(t.scores().select("key"), "key", [t.scores().filter("is_kt"), line.filter("l_quantity > 45")], [line.filter("l_discount = 0")])


@query("score_filter_top", "SELECT key, score FROM scores ORDER BY score DESC, key LIMIT (SELECT count(*) * 10 // 100 FROM scores)")
def _(t):
    return rel.score_filter(t.scores().select("key", "score"), "top10%")


@query("hash_sample", "SELECT p_partkey FROM part WHERE CAST('0x' || substr(md5('s1' || p_partkey), 18, 15) AS BIGINT) % 10 < 3")
def _(t):
    return rel.hash_sample(t.part.select("p_partkey"), "p_partkey", 3, 10, "s1")


@query("fallback_key_join", "SELECT p_partkey, coalesce(f, p_partkey) AS key FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS f FROM lineitem WHERE l_quantity = 50 GROUP BY 1) ON p_partkey = l_partkey")
def _(t):
    c = t.lineitem.filter("l_quantity = 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("cluster_key"))
    return rel.fallback_key(t.part.select("p_partkey"), c, "p_partkey")


@query("override_join", "SELECT p_partkey, attribute, value FROM eav WHERE p_partkey % 7 <> 0 UNION ALL SELECT p_partkey, 'name', p_name FROM part WHERE p_partkey % 7 = 0")
def _(t):
    right = t.part.filter("p_partkey % 7 = 0").select("p_partkey", F.lit("name").alias("attribute"), F.col("p_name").alias("value"))
    return rel.override(t.eav(), right, "p_partkey")


@query("union_relation", "SELECT p_partkey, value FROM eav WHERE attribute <> 'size' UNION SELECT p_partkey, p_brand FROM part")
def _(t):
    return rel.union_relation(t.eav().filter("attribute <> 'size'").select("p_partkey", "value"), t.part.select("p_partkey", F.col("p_brand").alias("value")))


@query("intersect_except", "(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity = 1")
def _(t):
    k = lambda c: t.lineitem.filter(c).select(F.col("l_partkey").alias("k"))
    return k("l_returnflag = 'A'").intersect(k("l_returnflag = 'R'")).subtract(k("l_quantity = 1"))


@query("flatten_unambiguous", "SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def _(t):
    return rel.flatten_unambiguous(t.lineitem, "l_orderkey", "l_suppkey")


@query("outer_merge_features", """SELECT key, max(q) AS qty, max(n) AS lines, max(z) AS size FROM (
  SELECT key, score AS q, NULL AS n, NULL AS z FROM scores UNION ALL SELECT key, NULL, score, NULL FROM scores2
  UNION ALL SELECT p_partkey, NULL, NULL, CAST(p_size AS DOUBLE) FROM part) GROUP BY 1""")
def _(t):
    return rel.outer_merge({"qty": t.scores().select("key", F.col("score").alias("value")), "lines": t.scores2().select("key", F.col("score").alias("value")),
                            "size": t.part.select(F.col("p_partkey").alias("key"), F.col("p_size").alias("value"))}, "key")


@query("eav_pivot", "SELECT p_partkey, p_brand AS brand, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part")
def _(t):
    return rel.attribute_pivot(t.eav(), "p_partkey", ["brand", "type", "size"])


@query("venn_cells", "SELECT cell, count(*) AS n_keys FROM (SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS cell FROM lineitem GROUP BY 1) GROUP BY 1")
def _(t):
    return rel.venn_cells(t.lineitem, "l_suppkey", "l_returnflag")


@query("diff_stats", """, b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 10), a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 10),
  n AS (SELECT count(b.k) AS n_before, count(a.k) AS n_after, count(*) FILTER (WHERE b.k IS NULL) AS n_added, count(*) FILTER (WHERE a.k IS NULL) AS n_removed,
    count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS n_kept FROM a FULL JOIN b ON a.k = b.k)
  SELECT *, round(100.0::DOUBLE * n_added / n_before, 6) AS pct_added, round(100.0::DOUBLE * n_removed / n_before, 6) AS pct_removed, round(100.0::DOUBLE * n_kept / n_before, 6) AS pct_kept FROM n""")
def _(t):
    early = F.col("l_quantity") < 10
    return rel.diff_stats(t.lineitem.filter(early), t.lineitem.filter(~early), "l_partkey")


@query("latest_per_group", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def _(t):
    return rel.latest_per_group(t.orders, "o_custkey", F.col("o_orderkey"), ["o_orderkey", "o_totalprice"])


@query("unique_names", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_type) > 1 THEN p_type || '_' || row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) ELSE p_type END AS unique_name FROM part")
def _(t):
    return rel.unique_names(t.part, "p_type", "p_partkey").select("p_partkey", "unique_name")


@query("namespace_rekey", """SELECT s_suppkey, r_regionkey AS namespace, rekeyed FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT s_nationkey AS c, min(s_suppkey) AS rekeyed FROM supplier GROUP BY 1) ON c = s_nationkey""")
def _(t):
    clusters = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("cluster"), F.col("n_regionkey").alias("namespace"), F.col("s_suppkey").alias("member"))
    return rel.rekey(t.supplier.select("s_suppkey"), clusters, "s_suppkey").select("s_suppkey", "namespace", "rekeyed")


@query("composed_attributes", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, n_name) AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    items = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("label"))
    return rel.composed_attributes(items, t.nation.select("n_nationkey", F.col("n_name").alias("label")), "n_nationkey", "label").select("c_custkey", "label")


# --- interactions ----------------------------------------------------------------------------


@query("interaction_consensus", "SELECT * FROM cons")
def _(t):
    return inter.consensus(t.dpi())


@query("interaction_standardize", """, d AS (SELECT *, sign(sum(direction) OVER (PARTITION BY drug, prot)) AS s FROM dpi)
  SELECT drug, prot, CAST(CASE WHEN max(s) = 0 THEN median(evidence) ELSE median(evidence) FILTER (WHERE sign(direction) = s) END AS DOUBLE) AS evidence, CAST(max(s) AS INTEGER) AS direction FROM d GROUP BY 1, 2""")
def _(t):
    return inter.standardize(t.dpi())


@query("apply_edits", """SELECT drug, prot, CASE WHEN drug % 5 = 1 THEN 0.95 ELSE evidence END AS evidence, CASE WHEN drug % 5 = 1 THEN 1 ELSE direction END AS direction FROM cons WHERE drug % 5 <> 0""")
def _(t):
    c = inter.consensus(t.dpi())
    edits = c.filter("drug % 5 < 2").select("drug", "prot", F.when(F.col("drug") % 5 == 1, 0.95).alias("new_evidence"), F.when(F.col("drug") % 5 == 1, 1).alias("new_direction"))
    return inter.apply_edits(c, edits)


@query("correct_falsehoods", "SELECT * FROM cons WHERE drug % 11 <> 0 AND drug % 13 <> 0 UNION ALL SELECT drug, prot, 1.0, 0 FROM cons WHERE drug % 13 = 0")
def _(t):
    c = inter.consensus(t.dpi())
    return inter.correct_falsehoods(c, c.filter("drug % 11 = 0 and drug % 13 <> 0"), c.filter("drug % 13 = 0").select("drug", "prot", F.lit(1.0).alias("evidence"), F.lit(0).alias("direction")))


@query("merge_priority", """, c AS (SELECT p_size AS cluster, p_partkey AS drug, CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 1 + p_partkey % 3 END AS priority FROM part),
  l AS (SELECT *, first(drug) OVER (PARTITION BY cluster ORDER BY priority, drug) AS out, max(CASE WHEN priority = 0 THEN drug END) OVER (PARTITION BY cluster) AS lead FROM c)
  SELECT out AS drug, prot, max(evidence) AS evidence, CAST(sign(sum(direction)) AS INTEGER) AS direction FROM dpi JOIN l ON dpi.drug = l.drug WHERE lead IS NULL OR l.drug = lead GROUP BY 1, 2""")
def _(t):
    c = t.part.select(F.col("p_size").alias("cluster"), F.col("p_partkey").alias("drug"), F.when(F.col("p_brand") == "Brand#11", 0).otherwise(1 + F.col("p_partkey") % 3).alias("priority"))
    return inter.merge_by_priority(t.dpi(), c)


@query("moa_collapse", """, m AS (SELECT drug, string_agg(DISTINCT prot || CASE WHEN direction > 0 THEN '+' WHEN direction < 0 THEN '-' ELSE '?' END, '_'
    ORDER BY prot || CASE WHEN direction > 0 THEN '+' WHEN direction < 0 THEN '-' ELSE '?' END) AS moa FROM cons WHERE evidence >= 0.95 GROUP BY 1)
  SELECT moa, count(*) AS n_drugs, min(drug) AS first_drug FROM m GROUP BY 1""")
def _(t):
    return inter.moa_collapse(inter.consensus(t.dpi()), 0.95)


@query("condense_keys", """, g AS (SELECT drug, string_agg(prot || ':' || printf('%.4f', evidence) || ':' || direction, ',' ORDER BY prot || ':' || printf('%.4f', evidence) || ':' || direction) AS s FROM cons GROUP BY 1)
  SELECT drug, min(drug) OVER (PARTITION BY s) AS group_key FROM g""")
def _(t):
    return inter.condense_keys(t.dpi())


CLEAN = """, clean AS (SELECT drug, prot, direction, count(*) AS n, CASE WHEN count(*) = 1 THEN max(value) ELSE round(exp(avg(ln(value))), 2) END AS value,
  CASE WHEN count(*) = 1 THEN 0.0 ELSE round(stddev_samp(value), 2) END AS sd FROM measures GROUP BY 1, 2, 3)"""


@query("repeat_measures", CLEAN + " SELECT drug, prot, direction, n, value, CAST(sd AS DOUBLE) AS sd FROM clean")
def _(t):
    return inter.clean_repeats(t.measures())


@query("direction_vote", CLEAN + " SELECT drug, prot, direction, n, value, CAST(sd AS DOUBLE) AS sd FROM clean QUALIFY row_number() OVER (PARTITION BY drug, prot ORDER BY n DESC, sd, value, direction) = 1")
def _(t):
    return inter.direction_vote(inter.clean_repeats(t.measures()))


@query("directed_edges", """, e AS (SELECT prot1 AS "left", prot2 AS "right", evidence, (prot1 * 7 + prot2) % 3 = 0 AS directed FROM edges), s AS (SELECT DISTINCT "left", "right" FROM e WHERE directed AND evidence >= 0.95)
  SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s."left" = e."right" AND s."right" = e."left") OR EXISTS (SELECT 1 FROM s WHERE s."left" = e."left" AND s."right" = e."right")""")
def _(t):
    e = t.edges().select(F.col("prot1").alias("left"), F.col("prot2").alias("right"), "evidence", ((F.col("prot1") * 7 + F.col("prot2")) % 3 == 0).alias("directed"))
    return inter.directed_edges(e, 0.95)


@query("affinity_step", """SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_retailprice <= 200 THEN 0.9 WHEN p_retailprice <= 630 THEN 0.5 ELSE 0 END
  ELSE CASE WHEN p_retailprice <= 40 THEN 0.7 WHEN p_retailprice <= 320 THEN 0.4 ELSE 0 END END AS DOUBLE) AS evidence FROM part""")
def _(t):
    return t.part.select("p_partkey", inter.affinity_evidence(F.when(F.col("p_size") % 2 == 0, "c50").otherwise("ki"), F.col("p_retailprice")).alias("evidence"))


@query("selectivity", """, d AS (SELECT drug, prot, max(evidence) AS ev FROM dpi GROUP BY 1, 2), n AS (SELECT drug, prot2, max(ev * e.evidence) AS ev2 FROM d JOIN edges e ON prot = prot1 WHERE e.evidence >= 0.95 GROUP BY 1, 2),
  i AS (SELECT drug, sum(ev2) AS x FROM n GROUP BY 1) SELECT d.drug, round(sum(ev), 6) AS direct, round(coalesce(any_value(x), 0.0), 6) AS indirect FROM d LEFT JOIN i ON d.drug = i.drug GROUP BY 1""")
def _(t):
    return inter.selectivity(t.dpi(), t.edges(place=True), 0.95)


@query("path_combo_add", """, k AS (SELECT DISTINCT drug FROM cons), b AS (SELECT prot, evidence, direction FROM cons WHERE drug = 1),
  u AS (SELECT * FROM cons UNION ALL SELECT drug, prot, evidence, direction FROM k CROSS JOIN b)
  SELECT drug, prot, max(evidence) AS evidence, CASE WHEN min(direction) = max(direction) THEN max(direction) ELSE 0 END AS direction FROM u GROUP BY 1, 2""")
def _(t):
    c = inter.consensus(t.dpi())
    return inter.combo_add(c, c.filter("drug = 1"))


# --- ranking and norms -----------------------------------------------------------------------

RANKED = """, r AS (SELECT key, s.score, cum_n - n AS ahead, n AS tied, (SELECT count(*) FROM scores) AS total FROM scores s JOIN steps b ON s.score = b.score)"""


@query("ranked_groups", "SELECT score, n AS tied, CAST(cum_n - n AS BIGINT) AS ahead FROM steps")
def _(t):
    return ranking.score_blocks(t.scores())


@query("ranker", RANKED + " SELECT key, ahead, tied, total - ahead - tied AS behind, 1 + ahead + tied // 2 AS rank, round(100.0::DOUBLE * (ahead + tied) / total, 6) AS pct FROM r")
def _(t):
    return ranking.ranked(t.scores()).select("key", "ahead", "tied", "behind", "rank", "pct")


@query("tie_adjusted_ranks", "SELECT key, score, CAST(tie_rank AS BIGINT) AS tie_rank FROM ties")
def _(t):
    return ranking.tie_ranks(t.scores())


@query("hit_cdf", "SELECT score, CAST(cum_n - n + (n - hits) // 2 AS BIGINT) AS first_rank, cum_hits - hits AS hits_before, cum_hits AS hits_after FROM steps WHERE hits > 0")
def _(t):
    return ranking.hit_cdf(t.scores())


@query("topn_linear", RANKED + " SELECT key, round(CASE WHEN ahead < 50 THEN greatest(0.0, (50 - ahead - tied / 2) / 50) ELSE 0.0 END, 6) AS value FROM r")
def _(t):
    return ranking.topn_linear(t.scores(), 50)


@query("floor_corrected", "SELECT key, round(greatest(score - (SELECT score FROM scores ORDER BY score DESC, key LIMIT 1 OFFSET 49), 0.0), 6) AS value FROM scores")
def _(t):
    return ranking.floor_corrected(t.scores(), 50)


@query("fill_universe", "SELECT key, score FROM scores WHERE key % 3 = 0 UNION ALL SELECT p_partkey, (SELECT least(min(score), 0.0) FROM scores) FROM part WHERE p_partkey NOT IN (SELECT key FROM scores WHERE key % 3 = 0)")
def _(t):
    return ranking.fill_universe(t.scores().filter("key % 3 = 0"), t.part.select(F.col("p_partkey").alias("key")))


@query("condense_ordering", """, g AS (SELECT key, score, p_brand AS "group", is_kt AS required FROM scores JOIN part ON key = p_partkey)
  SELECT key, score FROM g QUALIFY row_number() OVER (PARTITION BY "group", score ORDER BY key) = 1 OR required""")
def _(t):
    g = t.scores().join(t.part.select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("group")), "key").withColumnRenamed("is_kt", "required")
    return ranking.condense(g).select("key", "score")


@query("rank_delta", """, a AS (SELECT key, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) // 2 AS r FROM scores WHERE key % 4 <> 0), b AS (SELECT key, rank() OVER (ORDER BY score DESC) + count(*) OVER (PARTITION BY score) // 2 AS r FROM scores2 WHERE key % 5 <> 0)
  SELECT coalesce(a.key, b.key) AS key, CAST(coalesce(a.r, (SELECT count(*) + 1 FROM a)) - coalesce(b.r, (SELECT count(*) + 1 FROM b)) AS BIGINT) AS delta FROM a FULL JOIN b ON a.key = b.key""")
def _(t):
    return ranking.rank_delta(t.scores().filter("key % 4 <> 0").select("key", "score"), t.scores2().filter("key % 5 <> 0"))


@query("page_slice", "SELECT key, score, row_number() OVER (ORDER BY score DESC, key) - 1 AS idx FROM scores ORDER BY score DESC, key LIMIT 25 OFFSET 50")
def _(t):
    return ranking.page(t.scores().select("key", "score"), 50, 25)


@query("average_percentile_rank", """, o AS (SELECT 1 AS job, key, score FROM scores UNION ALL SELECT 2, key, score FROM scores2 WHERE key % 2 = 0), r AS (SELECT job, key, rank() OVER (PARTITION BY job ORDER BY score DESC) AS r FROM o),
  m AS (SELECT *, max(r) OVER (PARTITION BY job) AS m FROM r), g AS (SELECT key, j AS job FROM (SELECT DISTINCT key FROM o), (SELECT unnest([1, 2]) AS j)),
  v AS (SELECT g.key, coalesce(1 - (r - 1)::DOUBLE / m, 0) AS v FROM g LEFT JOIN m ON g.key = m.key AND g.job = m.job) SELECT key, round(avg(v), 6) AS apr, round(median(v), 6) AS median FROM v GROUP BY 1""")
def _(t):
    o = t.scores().select(F.lit(1).alias("job"), "key", "score").unionByName(t.scores2().filter("key % 2 = 0").select(F.lit(2).alias("job"), "key", "score"))
    return ranking.average_percentile(o)


@query("znorm", "SELECT key, round((score - (SELECT avg(score) FROM scores)) / (SELECT stddev_pop(score) FROM scores), 6) AS norm FROM scores")
def _(t):
    return normalize.z_norm(t.scores())


@query("mmnorm", "SELECT key, round((score - lo) / (hi - lo), 6) AS norm FROM scores, (SELECT least(0.0, min(score)) AS lo, greatest(0.0, max(score)) AS hi FROM scores)")
def _(t):
    return normalize.mm_norm(t.scores())


@query("lmmnorm", "SELECT key, round(-log10(1 - (score - lo) / (hi - lo) * 0.9999::DOUBLE) / 4, 6) AS norm FROM scores, (SELECT least(0.0, min(score)) AS lo, greatest(0.0, max(score)) AS hi FROM scores)")
def _(t):
    return normalize.lmm_norm(t.scores())


@query("weighted_combine", """, n AS (SELECT key, score / (SELECT max(score) FROM scores) AS x FROM scores), m AS (SELECT key, score / (SELECT max(score) FROM scores2) AS y FROM scores2),
  s AS (SELECT n.key, round(x, 6) * 0.7::DOUBLE + round(y, 6) * 0.3::DOUBLE AS s FROM n JOIN m ON n.key = m.key) SELECT key, round(s - (SELECT min(s) FROM s), 10) AS combined FROM s""")
def _(t):
    long = normalize.mm_norm(t.scores()).withColumn("name", F.lit("q")).unionByName(normalize.mm_norm(t.scores2()).withColumn("name", F.lit("n")))
    return normalize.weighted_combine(long, {"q": 0.7, "n": 0.3})


@query("calibrate_piecewise", """SELECT key, round(1 - CASE WHEN score < 100 THEN 0.99::DOUBLE * 0.9 WHEN score < 500 THEN 0.9::DOUBLE + (score - 100) / 400 * (0.5::DOUBLE - 0.9::DOUBLE)
  WHEN score < 1000 THEN 0.5::DOUBLE + (score - 500) / 500 * (0.1::DOUBLE - 0.5::DOUBLE) ELSE 0.1::DOUBLE END, 6) AS calibrated FROM scores""")
def _(t):
    return normalize.calibrate(t.scores(), [(100.0, 0.9), (500.0, 0.5), (1000.0, 0.1)])


@query("lerp_score", "SELECT c_custkey, round(0.1::DOUBLE + least(1.0, greatest(0.0, c_acctbal / 5000)) * 0.8::DOUBLE, 6) AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(normalize.lerp(F.col("c_acctbal"), 0.0, 5000.0, 0.1, 0.9), 6).alias("s"))


# --- metrics and statistics ------------------------------------------------------------------

SIGMA = "SELECT round(sum(1 / (1 + exp(-({c} - tie_rank) / {h}))) / (SELECT count(*) FROM scores WHERE is_kt), 6) AS {n} FROM ties"


@query("auroc", "SELECT round(1.0::DOUBLE - (sum(hits * (cum_n - n + (n + 1) / 2.0::DOUBLE)) - sum(hits) * (sum(hits) + 1) / 2.0::DOUBLE) / (sum(hits) * (sum(n) - sum(hits))), 6) AS auroc FROM steps")
def _(t):
    return metrics.auroc(t.scores())


@query("average_precision", "SELECT round(sum(hits * cum_hits::DOUBLE / cum_n) / sum(hits), 6) AS aps FROM steps")
def _(t):
    return metrics.average_precision(t.scores())


@query("sigma_of_rank", SIGMA.format(c=200, h="50.0::DOUBLE", n="sor"))
def _(t):
    return metrics.sor(t.scores())


@query("sigma_of_rank_1000", SIGMA.format(c=800, h="100.0::DOUBLE", n="sor1000"))
def _(t):
    return metrics.sor1000(t.scores())


@query("rank_rating", "SELECT round(-avg(tie_rank), 6) AS rank_rating FROM ties")
def _(t):
    return metrics.rank_rating(t.scores())


@query("score_rating", "SELECT round(avg(least(1.0, score / (SELECT min(score) FROM (SELECT score FROM scores ORDER BY score DESC LIMIT 801)))), 6) AS score_rating FROM scores WHERE is_kt")
def _(t):
    return metrics.score_rating(t.scores())


PORTION = ", g AS (SELECT is_kt, {w} / (1 + exp(-({c} - (cum_n - n + n // 2)) / {h})) AS s FROM scores s JOIN steps b ON s.score = b.score) SELECT round(sum(s) FILTER (WHERE is_kt) / sum(s), 6) AS {n} FROM g"


@query("sigma_portion", PORTION.format(w=1, c=1000, h="100.0::DOUBLE", n="sigma_portion"))
def _(t):
    return metrics.sigma_portion(t.scores())


@query("sigma_portion_100", PORTION.format(w=1, c=100, h="10.0::DOUBLE", n="sigma_portion_100"))
def _(t):
    return metrics.sigma_portion_100(t.scores())


@query("sigma_portion_weighted", PORTION.format(w="s.score", c=1000, h="100.0::DOUBLE", n="sigma_portion_weighted"))
def _(t):
    return metrics.sigma_portion_weighted(t.scores())


@query("sigma_portion_weighted_100", PORTION.format(w="s.score", c=100, h="10.0::DOUBLE", n="sigma_portion_weighted_100"))
def _(t):
    return metrics.sigma_portion_weighted_100(t.scores())


@query("sor1000_continuous", """, a AS (""" + SIGMA.format(c=800, h="100.0::DOUBLE", n="x") + """), b AS (SELECT round(avg(least(1.0, score / (SELECT min(score) FROM (SELECT score FROM scores ORDER BY score DESC LIMIT 801)))), 6) AS y FROM scores WHERE is_kt)
  SELECT round(x + 0.01::DOUBLE * y, 6) AS sor1000_continuous FROM a, b""")
def _(t):
    return metrics.sor1000_continuous(t.scores())


@query("running_es", """, w AS (SELECT score, hits * abs(score) / sum(hits * abs(score)) OVER () - (n - hits) / sum(n - hits) OVER () AS d FROM blocks), r AS (SELECT sum(d) OVER (ORDER BY score DESC) AS e FROM w),
  x AS (SELECT greatest(max(e), 0.0) AS hi, least(min(e), 0.0) AS lo FROM r) SELECT round(CASE WHEN hi >= -lo THEN hi ELSE lo END, 6) AS es FROM x""")
def _(t):
    return metrics.running_es(t.scores())


PLACES = """, h AS (SELECT tie_rank AS r, row_number() OVER (ORDER BY tie_rank) AS f FROM ties), spots AS (SELECT r AS place, f AS found FROM h UNION SELECT r - 1, f - 1 FROM h WHERE r > 0),
  m AS (SELECT place, found, place + 1 AS k, (SELECT count(*) FROM h) AS c, (SELECT count(*) FROM scores) AS n FROM spots),
  e AS (SELECT place, exp(lgamma(k + 1) + lgamma(n - k + 1) + lgamma(c + 1) + lgamma(n - c + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(k - x + 1) - lgamma(c - x + 1) - lgamma(n - k - c + x + 1)) AS e
    FROM (SELECT *, unnest(range(CAST(greatest(found, k + c - n) AS BIGINT), CAST(least(k, c) AS BIGINT) + 1)) AS x FROM m)),
  p AS (SELECT place, least(1.0::DOUBLE, sum(e)) AS p FROM e GROUP BY 1),
  z AS (SELECT place, p, count(*) OVER () AS tests, count(*) OVER (ORDER BY p) AS upto FROM p),
  q AS (SELECT m.*, least(1.0::DOUBLE, min(p * tests / upto) OVER (ORDER BY p DESC)) AS q FROM z JOIN m ON z.place = m.place)
"""


@query("febe", PLACES + "SELECT round(coalesce(max(-log10(q)), 0.0), 6) AS febe FROM q")
def _(t):
    return metrics.febe(t.scores())


@query("wfebe", PLACES + "SELECT round(coalesce(max(-log10(q) * (1 - place / n)), 0.0), 6) AS wfebe FROM q")
def _(t):
    return metrics.wfebe(t.scores())


@query("glf", PLACES + """, l AS (SELECT place, n, found::DOUBLE AS a, (n - c - k + found)::DOUBLE AS b, (k - found)::DOUBLE AS c, (c - found)::DOUBLE AS d FROM m),
  s AS (SELECT *, least(nullif(a, 0), nullif(b, 0), nullif(c, 0), nullif(d, 0)) AS s FROM l),
  o AS (SELECT place, n, CASE WHEN c * d > 0 THEN a * b / (c * d) ELSE
    (CASE WHEN a <= s THEN a + 0.1 ELSE a * (1 + 0.1 / (s + 0.1)) END) * (CASE WHEN b <= s THEN b + 0.1 ELSE b * (1 + 0.1 / (s + 0.1)) END) /
    ((CASE WHEN c <= s THEN c + 0.1 ELSE c * (1 + 0.1 / (s + 0.1)) END) * (CASE WHEN d <= s THEN d + 0.1 ELSE d * (1 + 0.1 / (s + 0.1)) END)) END AS o FROM s)
  SELECT round(max(CASE WHEN o = 0 THEN 0 ELSE log2(o) END * (1 - place / n)), 6) AS glf FROM o""")
def _(t):
    return metrics.glf(t.scores())


@query("set_enrichment")
def _(t):
    brands = t.part.select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("key"))
    return metrics.set_enrichment(brands, t.scores().select("key", "score"))


@query("bh_fdr", """, p AS (SELECT s_suppkey AS key, round(abs(s_acctbal) / 20000, 6) AS p FROM supplier), x AS (SELECT key, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, key) AS x FROM p)
  SELECT key, p, round(least(1.0, min(x) OVER (ORDER BY p DESC, key DESC)), 6) AS q FROM x""")
def _(t):
    return metrics.bh_fdr(t.supplier.select(F.col("s_suppkey").alias("key"), F.round(F.abs("s_acctbal") / 20000, 6).alias("p"))).withColumn("q", F.round("q", 6))


@query("fisher_exact", """, f AS (SELECT l_suppkey AS s, count(*) AS r, count(*) FILTER (WHERE l_returnflag = 'R') AS a FROM lineitem GROUP BY 1), t AS (SELECT sum(r) AS n, sum(a) AS c FROM f),
  x AS (SELECT s, r, a, n, c, unnest(range(a, CAST(least(r, c) AS BIGINT) + 1)) AS k FROM f, t),
  y AS (SELECT s, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(c + 1) + lgamma(n - c + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(c - k + 1) - lgamma(n - r - c + k + 1)) AS e FROM x)
  SELECT s AS l_suppkey, round(least(1.0, sum(e)), 5) AS p FROM y GROUP BY 1""")
def _(t):
    f = con.feature_portions(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R")
    n = f.agg(F.sum("n_all").alias("n"), F.sum("n_target").alias("c"))
    return f.crossJoin(F.broadcast(n)).select("l_suppkey", F.round(metrics.fisher_p("n_target", "n_all", "c", "n"), 5).alias("p"))


@query("contingency_2x2", "SELECT count(*) FILTER (WHERE a AND b) AS n11, count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE NOT a AND NOT b) AS n00 FROM (SELECT o_orderstatus = 'F' AS a, o_totalprice > 150000 AS b FROM orders)")
def _(t):
    return con.two_by_two(t.orders, F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000)


@query("feature_portions", "SELECT l_suppkey, count(*) AS n_all, count(*) FILTER (WHERE l_returnflag = 'R') AS n_target FROM lineitem GROUP BY 1")
def _(t):
    return con.feature_portions(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R")


@query("relative_risk", """, f AS (SELECT l_suppkey, count(*) AS r, count(*) FILTER (WHERE l_returnflag = 'R') AS a FROM lineitem GROUP BY 1), x AS (SELECT l_suppkey, a, r - a AS b, sum(a) OVER () - a AS c, sum(r - a) OVER () - (r - a) AS d FROM f)
  SELECT l_suppkey, a, b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round((a * d)::DOUBLE / (b * c)::DOUBLE, 6) AS odds_ratio, round((a / (a + b)) / (c / (c + d)), 6) AS relative_risk FROM x""")
def _(t):
    return con.association(t.lineitem, "l_suppkey", F.col("l_returnflag") == "R")


STRATA = """, st AS (SELECT c_mktsegment AS s, count(*) FILTER (WHERE e AND k) AS a, count(*) FILTER (WHERE e AND NOT k) AS b, count(*) FILTER (WHERE NOT e AND k) AS c, count(*) FILTER (WHERE NOT e AND NOT k) AS d
  FROM (SELECT c_mktsegment, o_orderpriority = '1-URGENT' AS e, o_orderstatus = 'F' AS k FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)"""


def _strata(t):
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return con.stratified(rows, "c_mktsegment", F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F")


@query("stratified_table", STRATA + " SELECT s AS c_mktsegment, a, b, c, d FROM st")
def _(t):
    return _strata(t)


@query("mantel_haenszel", STRATA + """, x AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, (a + b + c + d)::DOUBLE AS n FROM st)
  SELECT round(sum(a * d / n) / sum(b * c / n), 6) AS or_mh, round(sum(a * (c + d) / n) / sum(c * (a + b) / n), 6) AS rr_mh,
    round(sum(a - (a + b) * (a + c) / n) * sum(a - (a + b) * (a + c) / n) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS chi2 FROM x""")
def _(t):
    return con.mantel_haenszel(_strata(t))


@query("strat_weights", ", n AS (SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY 1) SELECT o_orderpriority, round(k / (SELECT sum(k) FROM n) / 2, 6) AS weight FROM n")
def _(t):
    return con.stratum_weights(t.orders, "o_orderpriority", F.col("o_orderstatus") == "F")


@query("support_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT l_returnflag, 'sum', count(*) FROM lineitem GROUP BY 1")
def _(t):
    return con.subtotals(t.lineitem, "l_returnflag", "l_linestatus")


@query("entropy", ", n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT round(sum(-n / t * log2(n / t)), 6) AS entropy FROM n, (SELECT sum(n) AS t FROM n)")
def _(t):
    return con.entropy(t.part, "p_brand")


@query("one_hot_bins", """SELECT o_orderkey, (year(o_orderdate) - 1970) * 4 + quarter(o_orderdate) - 1 AS quarter, CAST(quarter(o_orderdate) = 1 AS INTEGER) AS q1, CAST(quarter(o_orderdate) = 2 AS INTEGER) AS q2,
  CAST(quarter(o_orderdate) = 3 AS INTEGER) AS q3, CAST(quarter(o_orderdate) = 4 AS INTEGER) AS q4, CAST(floor((floor(o_totalprice) - 1) / 10000) AS BIGINT) AS bin FROM orders""")
def _(t):
    return con.one_hot_dates(t.orders, "o_orderdate").select("o_orderkey", "quarter", "q1", "q2", "q3", "q4", con.bins(F.col("o_totalprice"), 10000).alias("bin"))


@query("logistic_fit")
def _(t):
    rows = t.orders.select((F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_totalprice") / 1e5).alias("price"), F.month("o_orderdate").cast("double").alias("month"))
    model = con.fit_logistic(rows, ["price", "month"], "label")
    return t.spark.createDataFrame([(n, float(c)) for n, c in zip(["price", "month"], model.coefficients)], "feature string, coefficient double")


@query("spearman", ", x AS (SELECT a.score AS x, b.score AS y FROM scores a JOIN scores2 b ON a.key = b.key), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM x) SELECT round(corr(rx, ry), 6) AS spearman FROM r")
def _(t):
    return paths.spearman(t.scores().select("key", F.col("score").alias("x")).join(t.scores2().select("key", F.col("score").alias("y")), "key"), "x", "y")


@query("pearson", "SELECT round(corr(a.score, b.score), 6) AS pearson FROM scores a JOIN scores2 b ON a.key = b.key")
def _(t):
    return paths.pearson(t.scores().select("key", F.col("score").alias("x")).join(t.scores2().select("key", F.col("score").alias("y")), "key"), "x", "y")


# --- paths, similarity, graph ----------------------------------------------------------------

TISSUES = """, tis AS (SELECT n_name AS tissue, s_suppkey AS prot, round(abs(s_acctbal) / 10000, 4) AS t_ev, CAST(sign(s_acctbal) AS INTEGER) AS t_dir FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _tissues(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("tissue"), F.col("s_suppkey").alias("prot"), F.round(F.abs("s_acctbal") / 10000, 4).alias("t_ev"), F.signum("s_acctbal").cast("int").alias("t_dir"))


@query("path_direct", TISSUES + """, b AS (SELECT drug, tissue, max(t_ev * evidence) AS best, sum(-t_dir * direction) AS dirs FROM tis JOIN cons ON tis.prot = cons.prot GROUP BY 1, 2)
  SELECT drug, round(sum(best), 9) AS score, CAST(sum(dirs) AS BIGINT) AS direction FROM b GROUP BY 1""")
def _(t):
    return paths.path_scores(_tissues(t), inter.consensus(t.dpi()))


@query("path_indirect", TISSUES + """, i AS (SELECT tissue, prot2 AS prot, t_dir, max(t_ev * edges.evidence) AS t_ev FROM tis JOIN edges ON prot = prot1 GROUP BY 1, 2, 3),
  b AS (SELECT drug, tissue, max(t_ev * evidence) AS best, sum(-t_dir * direction) AS dirs FROM i JOIN cons ON i.prot = cons.prot GROUP BY 1, 2)
  SELECT drug, round(sum(best), 9) AS score, CAST(sum(dirs) AS BIGINT) AS direction FROM b GROUP BY 1""")
def _(t):
    return paths.path_scores(_tissues(t), inter.consensus(t.dpi()), t.edges())


@query("hierarchy_max_rollup", """, a AS (SELECT s_nationkey AS n, max(s_acctbal) AS v FROM supplier GROUP BY 1)
  SELECT 0 AS level, CAST(s_suppkey AS VARCHAR) AS node, s_acctbal AS value FROM supplier UNION ALL SELECT 1, CAST(n AS VARCHAR), v FROM a
  UNION ALL SELECT 2, CAST(n_regionkey AS VARCHAR), max(v) FROM a JOIN nation ON n = n_nationkey GROUP BY 2""")
def _(t):
    return paths.hierarchy_max(t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_acctbal").alias("value")), [
        t.supplier.select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("parent")), t.nation.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("parent"))])


@query("jaccard_pairs", """, n AS (SELECT "set", count(*) AS n FROM members GROUP BY 1), c AS (SELECT a."set" AS set1, b."set" AS set2, count(*) AS c FROM members a JOIN members b ON a.item = b.item AND a."set" < b."set" GROUP BY 1, 2)
  SELECT set1, set2, round(c / (x.n + y.n - c), 6) AS jaccard FROM c JOIN n x ON x."set" = set1 JOIN n y ON y."set" = set2""")
def _(t):
    return paths.jaccard_pairs(t.members())


@query("indirect_jaccard")
def _(t):
    near = t.edges().filter("evidence >= 0.95").select(F.col("prot1").alias("item"), F.col("prot2").alias("other"))
    return paths.jaccard_classes(t.dpi().select(F.col("drug").alias("set"), F.col("prot").alias("item")), near)


@query("weighted_overlap", "SELECT round(sum(least(coalesce(a.score, 0), coalesce(b.score, 0))) / sum(greatest(coalesce(a.score, 0), coalesce(b.score, 0))), 6) AS overlap FROM scores a FULL JOIN (SELECT * FROM scores2 WHERE key % 3 <> 0) b ON a.key = b.key")
def _(t):
    return paths.weighted_overlap(t.scores().select("key", F.col("score").alias("value")), t.scores2().filter("key % 3 <> 0").select("key", F.col("score").alias("value")))


PATHWAYS = """, dis AS (SELECT s_suppkey AS pathway, round(abs(s_acctbal) / 10000, 4) AS d_score, CAST(sign(s_acctbal) AS INTEGER) AS d_direction FROM supplier),
  pr AS (SELECT drug, evidence * d_score AS p, direction * d_direction AS d FROM cons JOIN dis ON prot = pathway)"""


@query("depend_aggs", PATHWAYS + """ SELECT drug, round(max(p), 10) AS p_max, round(sum(p), 10) AS p_sum, round(avg(p), 10) AS p_mean,
  round(CASE WHEN sum(exp(p)) > count(*) THEN ln(sum(exp(p)) - count(*)) ELSE '-infinity'::DOUBLE END, 6) AS p_soft,
  round(sum(p * exp(2.0::DOUBLE * p)) / sum(exp(2.0::DOUBLE * p)), 10) AS p_smooth, CAST(-sum(d) AS BIGINT) AS direction FROM pr GROUP BY 1""")
def _(t):
    return paths.pathway_products(
        t.supplier.select(F.col("s_suppkey").alias("pathway"), F.round(F.abs("s_acctbal") / 10000, 4).alias("d_score"), F.signum("s_acctbal").cast("int").alias("d_direction")),
        inter.consensus(t.dpi()).select("drug", F.col("prot").alias("pathway"), F.col("evidence").alias("score"), "direction"))


@query("similarity_weighted_max", """, e AS (SELECT s_suppkey AS ref, round(abs(s_acctbal) / 20000, 4) AS p, round(1 + s_suppkey / 100, 4) AS enr FROM supplier), x AS (SELECT drug AS key, ref, (1 - p) * enr * evidence * evidence AS s FROM cons JOIN e ON prot = ref)
  SELECT key, round(max(s), 6) AS score, first(ref ORDER BY s DESC, ref) AS connecting FROM x GROUP BY 1""")
def _(t):
    sim = inter.consensus(t.dpi()).select(F.col("prot").alias("ref"), F.col("drug").alias("key"), F.col("evidence").alias("sim"))
    return paths.similarity_max(sim, t.supplier.select(F.col("s_suppkey").alias("ref"), F.round(F.abs("s_acctbal") / 20000, 4).alias("p"), F.round(1 + F.col("s_suppkey") / 100, 4).alias("enr")))


@query("signature_mean", """, s AS (SELECT l_suppkey AS prot, l_linestatus AS dataset, l_discount AS ev, l_quantity - 25 AS fold FROM lineitem)
  SELECT prot, round(avg(ev), 6) AS ev, round(avg(fold), 6) AS fold, count(DISTINCT dataset) AS n_datasets, round(avg(sign(fold)), 6) AS av_dir FROM s GROUP BY 1 HAVING count(DISTINCT dataset) >= 2""")
def _(t):
    return paths.signature(t.lineitem.select(F.col("l_suppkey").alias("prot"), F.col("l_linestatus").alias("dataset"), F.col("l_discount").alias("ev"), (F.col("l_quantity") - 25).alias("fold")), 2)


@query("loo_importance", ", x AS (SELECT drug, prot AS target, sum(evidence) AS own FROM dpi GROUP BY 1, 2) SELECT drug, target, round(CASE WHEN sum(own) OVER (PARTITION BY drug) <> 0 THEN own / sum(own) OVER (PARTITION BY drug) ELSE 0.0 END, 12) AS importance FROM x")
def _(t):
    return paths.leave_one_out(t.dpi().select("drug", F.col("prot").alias("target"), F.col("evidence").alias("part")))


@query("loi_importance", """, x AS (SELECT drug, prot AS target, evidence AS score FROM cons), y AS (SELECT *, score - least(0.0, min(score) OVER (PARTITION BY drug)) AS s, row_number() OVER (PARTITION BY drug ORDER BY score DESC, target) AS i FROM x),
  z AS (SELECT *, s - coalesce(lead(s) OVER (PARTITION BY drug ORDER BY s DESC, target), 0.0) AS d FROM y),
  w AS (SELECT drug, target, sum(d / i) OVER (PARTITION BY drug ORDER BY s DESC, target ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS h, sum(d) OVER (PARTITION BY drug) AS t FROM z)
  SELECT drug, target, round(h / t, 6) AS importance FROM w WHERE t <> 0 AND round(h / t, 6) > 1e-4""")
def _(t):
    return paths.leave_one_in(inter.consensus(t.dpi()).select("drug", F.col("prot").alias("target"), F.col("evidence").alias("score")))


def _links(t):
    return t.edges().filter("evidence >= 0.98").select(F.col("prot1").alias("a"), F.col("prot2").alias("b"))


@query("connected_components")
def _(t):
    return graph.components(t.supplier.select(F.col("s_suppkey").alias("node")), _links(t))


ORACLES["connected_components"] = """
WITH RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey
  AND round(1 - abs(a.s_acctbal - b.s_acctbal) / 10000, 4) >= 0.98),
c AS (SELECT s_suppkey AS node, s_suppkey AS r FROM supplier UNION SELECT e.b, c.r FROM c JOIN e ON c.node = e.a)
SELECT node, min(r) AS component FROM c GROUP BY 1"""


@query("personalised_pagerank")
def _(t):
    e = t.edges().select(F.col("prot1").alias("a"), F.col("prot2").alias("b"), F.col("evidence").alias("weight"))
    return graph.pagerank(e, t.spark.createDataFrame([(1, 1.0)], "node long, p double")).select("node", F.round("r", 8).alias("r"))


@query("trim_promiscuous", "SELECT p_partkey, attribute, value FROM eav WHERE value IN (SELECT value FROM eav GROUP BY 1 HAVING count(DISTINCT p_partkey) BETWEEN 2 AND 50)")
def _(t):
    return graph.trim_promiscuous(t.eav().select(F.col("p_partkey").alias("key"), F.col("attribute").alias("kind"), F.col("value").alias("attribute")), 2, 50).select(
        F.col("key").alias("p_partkey"), F.col("kind").alias("attribute"), F.col("attribute").alias("value"))


@query("tree_leaf_class", """, e AS (SELECT p_partkey AS entry, 'A.' || (p_size % 3) || '.' || (p_size % 5) || '.' || (p_partkey % 4) || CASE WHEN p_size > 25 THEN '.' || (p_partkey % 7) || '.' || (p_size % 2) || '.1' ELSE '' END AS code FROM part),
  u AS (SELECT DISTINCT array_to_string(list_slice(string_split(code, '.'), 1, i), '.') AS c FROM (SELECT code, unnest(range(1, len(string_split(code, '.')) - 2)) AS i FROM e))
  SELECT entry, max(c IS NULL) AS is_leaf FROM e LEFT JOIN u ON code = c GROUP BY 1""")
def _(t):
    s, k = F.col("p_size"), F.col("p_partkey")
    tail = F.when(s > 25, F.concat(F.lit("."), (k % 7).cast("string"), F.lit("."), (s % 2).cast("string"), F.lit(".1"))).otherwise("")
    code = F.concat(F.lit("A."), (s % 3).cast("string"), F.lit("."), (s % 5).cast("string"), F.lit("."), (k % 4).cast("string"), tail)
    return paths.tree_leaves(t.part.select(k.alias("entry"), code.alias("code")), "code")


# --- text, features, events ------------------------------------------------------------------


@query("term_regex", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(the|und|les)\b')")
def _(t):
    return t.documents.filter(text.term_match(["text"], ["the", "und", "les"])).select("doc_id")


@query("name_remap", """SELECT p_partkey, CASE WHEN len(p_name) >= 3 AND NOT (ends_with(p_name, ' conjugate') OR ends_with(p_name, ' complex') OR ends_with(p_name, ' analog')
  OR ends_with(p_name, ' analogue') OR ends_with(p_name, ' compound') OR ends_with(p_name, ' derivative')) THEN lower(p_name) END AS name FROM part""")
def _(t):
    return t.part.select("p_partkey", text.fold_name(F.col("p_name")).alias("name"))


@query("tfidf_match")
def _(t):
    return text.tfidf_match(t.benchmark.select(F.col("item_id").alias("id"), "text"), t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(t):
    return stream.tumbling(t.events)


@query("event_sessions", """, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
  n AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, k""")
def _(t):
    return stream.sessions(t.events)


@query("array_ops", "SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey))[1] AS first_supp, len(list(DISTINCT l_suppkey)) AS n_supp, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1")
def _(t):
    s = F.array_sort(F.collect_set("l_suppkey"))
    return t.lineitem.groupBy("l_orderkey").agg(F.element_at(s, 1).alias("first_supp"), F.size(s).cast("long").alias("n_supp"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


# --- evidence --------------------------------------------------------------------------------

VARIANTS = """, va AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN '-' ELSE 'g' || l_suppkey END AS gene, round(l_tax / 10, 6) AS p, round(l_quantity / 50, 4) AS link, l_partkey AS variant, l_orderkey % 50 AS study FROM lineitem)"""


def _variants(t):
    gene = F.when(F.col("l_suppkey") % 10 == 0, "-").otherwise(F.concat(F.lit("g"), F.col("l_suppkey").cast("string")))
    return t.lineitem.select(gene.alias("gene"), F.round(F.col("l_tax") / 10, 6).alias("p"), F.round(F.col("l_quantity") / 50, 4).alias("link"), F.col("l_partkey").alias("variant"), (F.col("l_orderkey") % 50).alias("study"))


@query("max_thresholded", VARIANTS + " SELECT gene, round(max(-log10(p) * link), 6) AS score FROM va WHERE p <= 0.006 AND link >= 0.5 AND p > 0 GROUP BY 1")
def _(t):
    return evid.best_variant(_variants(t), 0.006, 0.5).select("gene", F.round("score", 6).alias("score"))


@query("excluded_assocs", VARIANTS + " SELECT DISTINCT gene FROM va WHERE gene NOT IN (SELECT gene FROM va WHERE p <= 0.0005 AND link >= 0.99 AND p > 0)")
def _(t):
    v = _variants(t)
    return rel.exclude_keys(v.select("gene").distinct(), evid.best_variant(v, 0.0005, 0.99), "gene")


@query("gene_signature", VARIANTS + " SELECT gene, round(avg(link), 6) AS score, count(*) AS n FROM va WHERE gene <> '-' GROUP BY 1")
def _(t):
    return evid.gene_signature(_variants(t).withColumnRenamed("link", "score"))


@query("study_summary", VARIANTS + """, g AS (SELECT DISTINCT variant, gene FROM va WHERE gene <> '-') SELECT study, count(DISTINCT x.variant) AS n_variants, count(DISTINCT g.gene) AS n_genes
  FROM (SELECT DISTINCT study, variant FROM va) x LEFT JOIN g ON x.variant = g.variant GROUP BY 1""")
def _(t):
    v = _variants(t)
    return evid.study_summary(v.select("study", "variant").distinct(), v.select("variant", "gene").distinct())


@query("variant_quality", """SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey > 1900 THEN 'position' WHEN lower(l_returnflag) NOT IN ('a', 'c', 'g', 't') THEN 'allele' WHEN l_discount - 0.01 < 0 THEN 'maf' WHEN (l_discount - 0.01) * l_quantity * 100 / 2 <= 25 THEN 'count' END AS reject_reason FROM lineitem""")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pos"), F.col("l_tax").cast("string").alias("p"), F.col("l_returnflag").alias("allele"), (F.col("l_discount") - 0.01).alias("maf"), (F.col("l_quantity") * 100).alias("n"))
    return evid.variant_quality(rows, F.lit(1900)).select("l_orderkey", "l_linenumber", "reject_reason")


@query("earliest_date", "SELECT l_orderkey, min(CASE WHEN year(l_shipdate) BETWEEN 1994 AND 1996 THEN l_shipdate ELSE TIMESTAMP '1997-06-01' END) AS earliest FROM lineitem GROUP BY 1")
def _(t):
    return evid.earliest(t.lineitem, "l_orderkey", F.col("l_shipdate"), F.lit("1997-06-01").cast("timestamp_ntz"), 1994, 1996)


@query("demographic_filter", "SELECT c_custkey FROM customer WHERE c_nationkey % 2 = 0 AND c_nationkey <> 0 AND c_nationkey >= 5.5 AND c_nationkey <= 20")
def _(t):
    sex = F.when(F.col("c_nationkey") % 2 == 0, "m").otherwise("f")
    return t.customer.filter(evid.demographic_filter("ma>5.5a<20", sex, F.col("c_nationkey"))).select("c_custkey")


@query("demo_dedupe", """SELECT o_custkey AS "case", list_sort(list(o_orderstatus))[count(*) // 2 + 1] AS sex, median(CAST(o_totalprice AS DOUBLE)) AS age, median(CAST(o_orderkey AS DOUBLE)) AS weight, max(o_orderpriority) AS reporter FROM orders GROUP BY 1""")
def _(t):
    return evid.case_demographics(t.orders.select(F.col("o_custkey").alias("case"), F.col("o_orderstatus").alias("sex"), F.col("o_totalprice").alias("age"), F.col("o_orderkey").cast("double").alias("weight"), F.col("o_orderpriority").alias("reporter")))


@query("fuzzy_name", """, n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN 'x/' || p_type WHEN 2 THEN p_type || ' sodium' ELSE 'none' END AS name FROM part), v AS (SELECT lower(p_type) AS term, min(p_partkey) AS id FROM part GROUP BY 1)
  SELECT DISTINCT name, id, CASE WHEN lower(name) LIKE 'x/%' THEN 'part' WHEN lower(name) LIKE '% sodium' THEN 'suffix' ELSE 'exact' END AS how FROM n JOIN v ON term = replace(regexp_replace(lower(name), '^x/', ''), ' sodium', '')""")
def _(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_type")).when(k == 1, F.concat(F.lit("x/"), "p_type")).when(k == 2, F.concat("p_type", F.lit(" sodium"))).otherwise("none")
    vocabulary = t.part.groupBy(F.lower("p_type").alias("term")).agg(F.min("p_partkey").alias("id"))
    return evid.fuzzy_names(t.part.select(name.alias("name")).distinct(), vocabulary, ["sodium", "acetate"])


@query("signature_subtract", ", a AS (SELECT prot, round(avg(evidence), 4) AS ev FROM dpi WHERE direction >= 0 GROUP BY 1), b AS (SELECT prot, round(avg(evidence), 4) AS t FROM dpi WHERE direction < 0 AND prot % 3 <> 0 GROUP BY 1) SELECT a.prot, round(greatest(0.0, abs(ev) - abs(coalesce(t, 0.0))), 6) AS ev FROM a LEFT JOIN b ON a.prot = b.prot")
def _(t):
    mean = lambda c: t.dpi().filter(c).groupBy("prot").agg(F.round(F.avg("evidence"), 4).alias("ev"))
    return evid.signature_difference(mean("direction >= 0"), mean("direction < 0 and prot % 3 <> 0"), True)


@query("delta_baseline", """, r AS (SELECT l_suppkey AS g, l_linenumber AS parameter, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2) SELECT r.parameter, round(avg(r.score - b.score), 6) AS mean, round(stddev_samp(r.score - b.score), 6) AS sd FROM r JOIN r b ON r.g = b.g AND b.parameter = 1 WHERE r.parameter <> 1 GROUP BY 1""")
def _(t):
    rows = t.lineitem.groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("parameter")).agg(F.sum("l_quantity").alias("score"))
    return evid.delta_to_baseline(rows, ["g"], F.col("parameter") == 1, "parameter")


@query("background_pvalue", """, r AS (SELECT l_linenumber AS run, l_partkey AS key, sum(l_quantity) AS r FROM lineitem GROUP BY 1, 2) SELECT s.key, round(coalesce(sum(r), 0.0) / 7, 6) AS bg, round(s.score / 5 - coalesce(sum(r), 0.0) / 7, 6) AS normed,
  round((count(*) FILTER (WHERE r < s.score / 5) + CASE WHEN s.score > 0 THEN 7 - count(r) ELSE 0 END) / 7, 6) AS pval FROM scores s LEFT JOIN r ON s.key = r.key GROUP BY s.key, s.score""")
def _(t):
    runs = t.lineitem.groupBy(F.col("l_linenumber").alias("run"), F.col("l_partkey").alias("key")).agg(F.sum("l_quantity").alias("score"))
    return evid.background_scores(t.scores().select("key", (F.col("score") / 5).alias("score")), runs, 7)


@query("support_enrichment", ", x AS (SELECT o_orderpriority = '1-URGENT' AS s, CAST(o_orderstatus = 'F' AS DOUBLE) AS p FROM orders) SELECT round(avg(p) FILTER (WHERE s), 6) AS with_support, round(avg(p) FILTER (WHERE NOT s), 6) AS without_support, round(avg(p) FILTER (WHERE s) / avg(p) FILTER (WHERE NOT s), 6) AS ratio FROM x")
def _(t):
    return evid.support_enrichment(t.orders.select((F.col("o_orderpriority") == "1-URGENT").alias("support"), (F.col("o_orderstatus") == "F").alias("passed")))


@query("signature_compare", """, c AS (SELECT drug, evidence * direction * round(s_acctbal / 10000, 4) AS p FROM cons JOIN supplier ON prot = s_suppkey) SELECT drug, CAST(sum(sign(p)) AS BIGINT) AS sign_sum, round(max(abs(p)), 6) AS max_abs FROM c GROUP BY 1""")
def _(t):
    return evid.signature_compare(inter.consensus(t.dpi()).select("drug", "prot", (F.col("evidence") * F.col("direction")).alias("value")), t.supplier.select(F.col("s_suppkey").alias("prot"), F.round(F.col("s_acctbal") / 10000, 4).alias("d_value")))


@query("synergy", ", x AS (SELECT a.key, round(a.score - least(b.score * 40, 900.0), 6) AS synergy FROM scores a JOIN scores2 b ON a.key = b.key) SELECT * FROM x WHERE synergy > 0")
def _(t):
    return evid.synergy(t.scores().select("key", "score"), t.scores2().select("key", (F.col("score") * 40).alias("score")), 900.0)


@query("pairwise_corr", """SELECT 'discount' AS a, 'price' AS b, round(corr(l_discount, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'discount', 'quantity', round(corr(l_discount, l_quantity), 6) FROM lineitem UNION ALL SELECT 'price', 'quantity', round(corr(l_extendedprice, l_quantity), 6) FROM lineitem""")
def _(t):
    return evid.pairwise_correlation(t.lineitem.select(F.col("l_discount").alias("discount"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity")), ["discount", "price", "quantity"])


@query("rule_flags", "SELECT c_custkey, 'poor' AS category, CAST(c_nationkey AS VARCHAR) AS detail FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'machines', c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY'")
def _(t):
    return evid.flags(t.customer, "c_custkey", [("poor", F.col("c_acctbal") < 0, F.col("c_nationkey")), ("machines", F.col("c_mktsegment") == "MACHINERY", F.col("c_mktsegment"))])


@query("json_props", "SELECT event_id, len(json_keys(props)) AS n_keys FROM events")
def _(t):
    return t.events.select("event_id", F.size(F.expr("json_object_keys(props)")).cast("long").alias("n_keys"))


# --- flagship --------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ranked by summed quantity with tie-aware rank and percentile, their target flag and the
    enrichment of targets, SigmaOfRank1000."""
    t = Tables(spark, sf_dir)
    s = t.scores()
    return ranking.ranked(s).crossJoin(F.broadcast(metrics.sor1000(s))).select("key", "score", "rank", "pct", "is_kt", "sor1000")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = SHAPES + RANKED + """, m AS (""" + SIGMA.format(c=800, h="100.0::DOUBLE", n="sor1000") + """)
SELECT r.key, r.score, 1 + ahead + tied // 2 AS rank, round(100.0::DOUBLE * (ahead + tied) / total, 6) AS pct, is_kt, sor1000 FROM r JOIN scores ON r.key = scores.key, m"""
