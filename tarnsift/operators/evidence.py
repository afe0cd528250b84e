"""Evidence from studies, measurements and cases: quality filters, best evidence, backgrounds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_variant(rows: DataFrame, most_p: float, least_link: float, cap: int | None = None) -> DataFrame:
    """rows: (gene, p, link): the greatest -log10(p) * link of rows within both limits.  A cap keeps
    the scores at or above that of 0-based index cap, so ties and that row itself stay."""
    out = rows.filter((F.col("p") <= most_p) & (F.col("link") >= least_link) & (F.col("p") > 0)).groupBy("gene").agg(
        F.max(-F.log10("p") * F.col("link")).alias("score"))
    if cap is None:
        return out
    floor = out.orderBy(F.col("score").desc()).limit(cap + 1).agg(F.min("score").alias("_floor"))
    return out.crossJoin(F.broadcast(floor)).filter(F.col("score") >= F.col("_floor")).drop("_floor")


def gene_signature(rows: DataFrame) -> DataFrame:
    """Mean score and count a gene; '-' is no gene."""
    return rows.filter("gene <> '-'").groupBy("gene").agg(F.round(F.avg("score"), 6).alias("score"), F.count(F.lit(1)).alias("n"))


def study_summary(variants: DataFrame, genes: DataFrame) -> DataFrame:
    """Per study its variants and the distinct genes that they lead to."""
    found = variants.join(genes.filter("gene <> '-'"), "variant", "left")
    return found.groupBy("study").agg(F.count_distinct("variant").alias("n_variants"), F.count_distinct("gene").alias("n_genes"))


def variant_quality(rows: DataFrame, size: Column, least_count: float = 25) -> DataFrame:
    """Rows with the reason why they are rejected, null for good ones.  The first that applies."""
    reason = (
        F.when(F.col("pos") > size, "position").when(F.col("p").try_cast("double").isNull(), "p")
        .when(~F.lower("allele").isin("a", "c", "g", "t"), "allele").when(F.col("maf") < 0, "maf")
        .when(F.col("maf") * F.col("n") / 2 <= least_count, "count")
    )
    return rows.withColumn("reject_reason", reason)


def earliest(rows: DataFrame, key: str, date: Column, fallback: Column, first_year: int, last_year: int) -> DataFrame:
    """Least date a key; a date outside the years is replaced by the fallback."""
    good = F.when(F.year(date).between(first_year, last_year), date).otherwise(fallback)
    return rows.groupBy(key).agg(F.min(good).alias("earliest"))


_TERM = re.compile(r"a([<>])(\d+(?:\.\d+)?)")


def demographic_filter(spec: str, sex: Column, age: Column) -> Column:
    """Grammar [mf], a<N, a>N in any order; limits are inclusive, and age 0 is missing."""
    rest, out, sexes = spec, [], 0
    while rest:
        m = _TERM.match(rest)
        if m:
            limit = float(m[2])
            out.append((age != 0) & (age <= limit if m[1] == "<" else age >= limit))
        elif rest[0] in "mf" and not sexes:
            sexes = 1
            out.append(sex == rest[0])
        else:
            raise ValueError(f"bad filter {spec!r} at {rest!r}")
        rest = rest[m.end() if m else 1:]
    return reduce(lambda a, b: a & b, out, F.lit(True))


def case_demographics(rows: DataFrame) -> DataFrame:
    """rows: (case, sex, age, weight, reporter) with repeats: all-equal values stay, else the upper
    middle of the sorted sexes, the median of ages and weights, and the greatest reporter."""
    sexes = F.array_sort(F.collect_list("sex"))
    return rows.groupBy("case").agg(
        F.element_at(sexes, (F.floor(F.size(sexes) / 2) + 1).cast("int")).alias("sex"),
        F.median("age").alias("age"), F.median("weight").alias("weight"), F.max("reporter").alias("reporter"))


def fuzzy_names(names: DataFrame, vocabulary: DataFrame, suffixes: list[str]) -> DataFrame:
    """(name) to (name, id, how): the whole name, else one of its parts, else it without a suffix.
    Every try is an equi-join."""
    whole = F.trim(F.lower("name"))
    bare = F.trim(F.regexp_replace(whole, r"( (" + "|".join(map(re.escape, suffixes)) + r"))+$", ""))
    tries = names.select("name", F.explode(F.concat(
        F.array(F.struct(F.lit(1).alias("how"), whole.alias("try"))),
        F.transform(F.split(whole, r"[)(,+/]"), lambda p: F.struct(F.lit(2).alias("how"), F.trim(p).alias("try"))),
        F.array(F.struct(F.lit(3).alias("how"), bare.alias("try"))))).alias("t")).select("name", "t.*")
    found = tries.join(vocabulary.select(F.lower("term").alias("try"), "id"), "try")
    return found.groupBy("name").agg(F.min(F.struct("how", "id")).alias("b")).select("name", "b.id", F.element_at(F.array(F.lit("exact"), F.lit("part"), F.lit("suffix")), F.col("b.how")).alias("how"))


def signature_difference(rows: DataFrame, trained: DataFrame, absolute: bool) -> DataFrame:
    """ev less the other's, or what remains of its size."""
    x = rows.join(trained.select("prot", F.col("ev").alias("_t")), "prot", "left")
    t = F.coalesce("_t", F.lit(0.0))
    return x.select("prot", F.round(F.greatest(F.lit(0.0), F.abs("ev") - F.abs(t)) if absolute else F.col("ev") - t, 6).alias("ev"))


def delta_to_baseline(rows: DataFrame, group: list[str], is_base: Column, parameter: str) -> DataFrame:
    """Scores less their group's baseline row's: mean and sample deviation by parameter."""
    base = rows.filter(is_base).groupBy(*group).agg(F.max("score").alias("_b"))
    d = rows.filter(~is_base).join(base, group).withColumn("d", F.col("score") - F.col("_b"))
    return d.groupBy(parameter).agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_samp("d"), 6).alias("sd"))


def background_scores(scores: DataFrame, runs: DataFrame, n_runs: int) -> DataFrame:
    """runs: (run, key, score), absent ones 0: mean background, score less it, and the share of runs
    strictly below the score."""
    b = scores.select("key", F.col("score").alias("raw")).join(runs.select("key", F.col("score").alias("r")), "key", "left")
    n = F.count("r")
    return b.groupBy("key", "raw").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("s"), n.alias("n"), F.count_if(F.col("r") < F.col("raw")).alias("below")).select(
        "key", F.round(F.col("s") / n_runs, 6).alias("bg"), F.round(F.col("raw") - F.col("s") / n_runs, 6).alias("normed"),
        F.round((F.col("below") + F.when(F.col("raw") > 0, n_runs - F.col("n")).otherwise(0)) / n_runs, 6).alias("pval"))


def support_enrichment(rows: DataFrame) -> DataFrame:
    """rows: (support, passed): passing fractions with and without support, and their ratio."""
    frac = lambda c: F.avg(F.when(c, F.col("passed").cast("double")))
    return rows.agg(frac(F.col("support")).alias("a"), frac(~F.col("support")).alias("b")).select(
        F.round("a", 6).alias("with_support"), F.round("b", 6).alias("without_support"), F.round(F.col("a") / F.col("b"), 6).alias("ratio"))


def signature_compare(drugs: DataFrame, disease: DataFrame) -> DataFrame:
    """(drug, prot, value) against (prot, d_value): summed sign of products, and the greatest product."""
    p = F.col("value") * F.col("d_value")
    return drugs.join(disease, "prot").groupBy("drug").agg(F.sum(F.signum(p)).cast("long").alias("sign_sum"), F.round(F.max(F.abs(p)), 6).alias("max_abs"))


def synergy(combo: DataFrame, mono: DataFrame, base: float) -> DataFrame:
    """Combined score less the smaller of the single one and the base, where positive."""
    x = combo.join(mono.select("key", F.col("score").alias("_m")), "key")
    return x.withColumn("synergy", F.round(F.col("score") - F.least("_m", F.lit(base)), 6)).filter("synergy > 0").select("key", "synergy")


def pairwise_correlation(wide: DataFrame, names: list[str]) -> DataFrame:
    """Pearson of every pair of columns over rows that have both: one scan."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    row = wide.agg(*[F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))


def flags(df: DataFrame, key: str, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """(key, category, detail) for each rule that a row meets: one scan, not one a rule."""
    found = F.array(*[F.when(c, F.struct(F.lit(n).alias("category"), d.cast("string").alias("detail"))) for n, c, d in rules])
    return df.select(key, F.inline(F.filter(found, lambda x: x.isNotNull())))
