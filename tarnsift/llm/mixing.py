"""Mixing sources to target weights.

Words are summed per source, targets are derived from weights with a cap on repetition, and each
document is taken floor(rate) times plus one more copy by a hash-seeded Bernoulli draw whose
probability is the fraction of the rate.

Defined cases: null text has size 0; a null source is a source of its own; a source without weight,
or with a null, negative or zero weight, gets target 0; a source of size 0 has rate 0; rows that
agree in id and text get the same draw; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, table, word_count

#: Source tables up to this many rows are broadcast; beyond it the join is salted and shuffled.
BROADCAST_SOURCES = 10_000
#: Rows of one source are dealt over so many salts in the shuffled join.
SALTS = 64


def source_targets(sizes: DataFrame, *, total_factor: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: (source, source_size, weight), one row a source.  Adds target.

    total_factor times all sizes is shared by weight.  A target stops at cap times the size of its
    source, and what is above is shared anew by weight among the rest until none is above.  Each
    round is one aggregate to a single row, so the number of sources is not bounded by the driver.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(0.0)
    sizes = sizes.withColumn("weight", F.coalesce(weight, F.lit(0.0)))
    most = F.lit(float(cap)) * F.col("source_size")
    capped_before, share = -1, 0.0
    above: Column = F.lit(False)
    while True:
        row = sizes.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, F.col("source_size")).otherwise(0)).alias("capped"),
            F.sum(F.when(above, F.lit(0.0)).otherwise(F.col("weight"))).alias("weights"),
            F.sum(F.when(above, F.lit(1)).otherwise(0)).alias("n"),
        ).first()
        if row.total is None or not row.weights or row.n == capped_before:
            break
        capped_before = row.n
        share = (float(total_factor) * row.total - float(cap) * row.capped) / row.weights
        above = most < F.col("weight") * F.lit(share)
    return sizes.withColumn("target", F.least(most, F.col("weight") * F.lit(share)))


def unit_draw(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5; the same on every run and machine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "mix",
) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row).

    docs may already hold mix_size.  targets: (source, source_size, target).
    """
    if "mix_size" not in docs.columns:
        docs = docs.withColumn("mix_size", word_count(F.col(text_col)))
    side = targets.select(
        F.col("source").alias("_mix_source"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    if side.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(side), F.col(source_col).eqNullSafe(F.col("_mix_source")))
    else:
        salt = F.pmod(F.xxhash64(F.col(id_col), F.col("mix_size")), F.lit(SALTS)).cast("int")
        side = side.withColumn("_mix_side", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("_mix_salt", salt).join(
            side,
            F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_salt") == F.col("_mix_side")),
        ).drop("_mix_salt", "_mix_side")
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    text_key = F.col("_mix_text_md5") if "_mix_text_md5" in docs.columns else F.md5(F.coalesce(F.col(text_col), F.lit("")))
    draw = unit_draw(seed, F.col(id_col), text_key)
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), F.lit(1)).otherwise(0)
    return joined.withColumn("mix_copies", copies.cast("long")).drop("_mix_source")


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size) with the weights dealt round by code point of the source, null last.

    The order is a distributed sort with positions added per partition, not a window over one task.
    """
    spark = sizes.sparkSession
    schema = T.StructType([
        T.StructField("source", T.StringType()),
        T.StructField("source_size", T.LongType()),
        T.StructField("weight", T.DoubleType()),
    ])
    ordered = sizes.select("source", "source_size").orderBy(F.col("source").asc_nulls_last())
    rows = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % len(weights)])))
    return spark.createDataFrame(rows, schema)


def sized(docs: DataFrame) -> DataFrame:
    """The narrow table that one pass over the texts leaves: id, source, words, md5 of the text."""
    return materialize(
        docs.select(
            "doc_id", "source",
            word_count(F.col("text")).alias("mix_size"),
            F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_mix_text_md5"),
        ),
        "mix-sizes",
    )


def targets_of(narrow: DataFrame) -> DataFrame:
    sizes = narrow.groupBy("source").agg(F.sum("mix_size").alias("source_size"))
    return source_targets(materialize(cyclic_weights(sizes), "mix-sources"))


def op7_mixing(spark, sf_dir) -> DataFrame:
    narrow = sized(table(spark, sf_dir, "documents"))
    mixed = mix_sources(narrow, targets_of(narrow))
    return mixed.select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


#: Closed form of the capped shares: sources in the order in which they reach their cap.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
             WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
        CAST(coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS capped,
        sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
l AS (SELECT arg_min(share, capped) AS share FROM (
        SELECT capped, (CAST(1.5 AS DOUBLE) * total - CAST(2.0 AS DOUBLE) * capped) / weights AS share,
               CAST(2.0 AS DOUBLE) * source_size / weight AS own FROM o) WHERE own >= share),
t AS (SELECT w.source, w.source_size,
        least(CAST(2.0 AS DOUBLE) * source_size, weight * l.share) AS target FROM w, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST(('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(d.doc_id AS VARCHAR), ''), d.h)), 1, 13)) AS BIGINT)
          / CAST(4503599627370496 AS DOUBLE) AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken
FROM r
"""
