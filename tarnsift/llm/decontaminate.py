"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders; every window of template words of a text is
hashed and joined by hash to the benchmark's windows; a passage is the windows of one item on one
diagonal, and its slots must agree: one benchmark value stands for one document value throughout, and
different names or units for different ones (different numbers may become equal).  So a question asked
again with other numbers or names is caught, and one that merely shares scattered template words is not.
A name is a capitalised word, wherever it stands, that is none of the usual STARTERS of a sentence.

Defined cases: null and empty texts match nothing; items of fewer words than MIN_WORDS must match whole, and
so must items so rich in slots that their windows with MIN_LITERALS literals can't cover MIN_WORDS (with
fewer literals in all, with the same values); items of MIN_LITERALS words or more, but fewer than a
window, must stand whole and with the same values in a text; still shorter ones match nothing, as any text may hold such a
phrase; an item that occurs more than once in a text counts once, with its longest passage; an item id with
several texts is found by each of them; repeated rows of one id count as one document; empty tables give
an empty result; other columns of either table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, without_ids

#: Template words of a window.
WINDOW = 8
#: Words that a passage must cover, or the whole item if that is shorter.
MIN_WORDS = 13
#: Words of a window that must not be placeholders.
MIN_LITERALS = 4
#: Benchmarks of up to so many windows are broadcast; larger ones are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

SPACE = r"[\x20\x09-\x0D]+"
#: Unit names that may follow a number.
UNITS = (
    "mm|cm|m|km|in|ft|yd|mi|mg|g|kg|t|lb|lbs|oz|ml|cl|l|s|sec|min|h|hr|hrs|hours?|minutes?|seconds?|days?|weeks?|months?|"
    "years?|meters?|metres?|kilometers?|kilometres?|miles?|feet|inches|grams?|kilograms?|pounds?|ounces|liters?|litres?|"
    "dollars?|cents?|euros?|percent|degrees?|volts?|watts?|joules?|newtons?|hz|khz|mhz|ghz|kb|mb|gb|tb"
)


#: Capitalised words that begin sentences and are no names.
STARTERS = (
    "A|After|All|Also|An|And|Are|As|At|Because|Before|But|By|Calculate|Can|Compute|Consider|Convert|Define|Describe|Determine|Do|Does|Each|Every|"
    "Explain|Find|For|From|Give|Given|Has|Have|He|Her|His|How|However|I|If|In|Is|It|Its|Let|List|Many|Name|No|Not|Now|Of|On|One|Or|Our|"
    "Prove|Question|Show|She|So|Solve|Some|Suppose|Than|That|The|Their|Then|There|These|They|This|Those|To|Two|Under|Use|Was|We|What|"
    "When|Where|Which|While|Who|Why|Will|With|Write|Yes|You|Your"
)


#: ASCII and general punctuation and signs.
PUNCTUATION = r"[!-/:-@\[-`{-~¡-¿\u2010-\u2027\u2030-\u205E\u20A0-\u20BF]"


def template_text(text: Column) -> Column:
    """Text with typed placeholders, lower case and without punctuation; white space is untouched, so
    its words stand at the places of the text's words."""
    # the capital is tested before what stands before it, which is rarer than the other way round
    text = F.regexp_replace(text, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}'’-]\p{{Lu}})[\p{{L}}'’-]*+(?<!(?<![\p{{L}}\p{{N}}'’-])(?:{STARTERS}))", "⟨name⟩")
    text = F.regexp_replace(text, r"[0-9]+(?:[.,:/][0-9]+)*", "⟨num⟩")
    text = F.regexp_replace(text, rf"⟨num⟩(\s?)(?i:{UNITS})(?![\p{{L}}\p{{N}}])", "⟨num⟩$1⟨unit⟩")
    return F.lower(F.regexp_replace(text, f"{PUNCTUATION}+", ""))


def is_slot(word: Column) -> Column:
    return word.contains("⟨")


def _words(text: Column) -> Column:
    return F.split(text, SPACE)


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def _windows(df: DataFrame, window: int) -> DataFrame:
    """df: id, raw (trimmed text).  One row a window: id, raw, template (all its words), at, hash.

    The windows are dealt out before they are hashed, so that both run in compiled code, and a row is
    made only of those that the join keeps."""
    df = df.filter(F.col("raw").isNotNull() & (F.col("raw") != ""))
    # words made of punctuation alone leave empty template words, never fewer
    df = df.select("id", "raw", _words(template_text(F.col("raw"))).alias("template"))
    # outer, and no filter by the words: else the optimiser computes the template once more for it;
    # a text that is too short has one window with nulls, which equals none of the benchmark's
    places = F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("template") - window, F.lit(0))))
    return df.select("id", "raw", "template", places.alias("at")).withColumn(
        "hash", F.xxhash64(*[F.get("template", F.col("at") + k) for k in range(window)]))


def benchmark_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw): the distinct texts of each item."""
    return items.select(F.col(id_col).alias("id"), _trimmed(F.col(text_col)).alias("raw")).distinct()


def benchmark_windows(items: DataFrame, window: int, min_words: int, min_literals: int, short: bool = False) -> DataFrame:
    """The windows by which items are found; short: of the items of just so many words."""
    rows = _windows(items, window).select(
        F.col("id").alias("item_id"), F.xxhash64("raw").alias("item_key"), F.size("template").alias("item_words"), F.col("at").alias("item_at"), "hash", "template", _words(F.col("raw")).alias("words"),
        F.slice("template", F.col("at") + 1, window).alias("item_template"), F.slice(_words(F.col("raw")), F.col("at") + 1, window).alias("item_window"),
    ).withColumn("literals", _literals("item_template"))
    if short:
        rows = rows.filter(F.col("item_words") == window).withColumns({"whole": F.lit(True), "best": F.lit(True)})
    else:
        # windows that are mostly slots say nothing; an item whose other windows can't cover its need is matched
        # whole, around its window of most literals; not from its first word, whose capital may be lost in a sentence
        own = Window.partitionBy("item_id", "item_key")
        kept = F.collect_set(F.when(F.col("literals") >= min_literals, F.col("item_at"))).over(own)
        rows = rows.filter(F.col("item_words") >= window).withColumns({
            "whole": _covered(kept, window) < F.least(F.lit(min_words), F.col("item_words")),
            "best": F.row_number().over(own.orderBy(F.col("item_at") == 0, F.col("literals").desc(), "item_at")) == 1})
    return rows.filter(F.when(F.col("whole"), F.col("best")).otherwise(F.col("literals") >= min_literals)).select(
        "item_id", "item_key", "item_at", "item_words", "hash", F.array_join("item_template", " ").alias("item_text"),
        F.when(F.col("whole"), 0).otherwise(F.col("item_at")).alias("item_from"),
        F.when(F.col("whole"), F.col("template")).otherwise(F.col("item_template")).alias("item_template"),
        F.when(F.col("whole"), F.col("words")).otherwise(F.col("item_window")).alias("item_window"),
        F.col("whole").alias("item_whole"), (F.col("whole") & (F.lit(short) | (_literals("template") < min_literals))).alias("item_same"))


def _covered(places: Column, window: int) -> Column:
    """Words that windows at these places cover together."""
    at = F.array_sort(places)
    steps = F.zip_with(F.slice(at, 2, 1 << 30), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(window)))
    return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(steps, F.lit(window), lambda total, step: total + step))


def _literals(words: str) -> Column:
    return F.size(F.filter(words, lambda w: ~is_slot(w) & (w != "")))


#: Of a window, or of all the item from item_from 0 on: item_whole; item_same: with so few literals that its values must be the same.
_ITEM = ["item_id", "item_key", "item_at", "item_words", "item_from", "item_whole", "item_same", "item_template", "item_window"]


def _here(words: Column, at: Column, item_at: Column, item_from: Column, item_template: Column) -> Column:
    """The words of a text that stand where the item's do."""
    return F.slice(words, F.greatest(at - item_at + item_from + 1, F.lit(1)), F.size(item_template))


def _equal() -> Column:
    """Whether the words that stand where an item's do are the item's; the first of a whole item may differ in case."""
    rest = lambda c: F.slice(c, 2, 1 << 30)
    first = lambda c: F.lower(_bare(F.get(c, F.lit(0))))
    like = (rest("template") == rest("item_template")) & (
        (F.get("template", F.lit(0)) == F.get("item_template", F.lit(0))) | (first("words") == first("item_window")))
    return F.when(F.col("item_whole"), like).otherwise(F.col("template") == F.col("item_template"))


def _found_at_once(rows: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """Windows that equal one of a benchmark small enough to be broadcast."""
    # equality by two prefixes: as an equation it would be a join key, computed for every window, and as
    # a lambda it would keep the join out of compiled code, so that every window became a row
    here, there = F.array_join(F.slice("template", F.col("at") + 1, window), " "), F.col("item_text")
    where = [F.col(c) for c in ("at", "item_at", "item_from", "item_template")]
    return rows.join(bench, (rows["hash"] == bench["hash"]) & here.startswith(there) & there.startswith(here)).select(
        "id", "at", *_ITEM,
        _here(F.col("template"), *where).alias("template"),
        _here(_words(F.col("raw")), *where).alias("words"),
    ).filter(~F.col("item_whole") | _equal())


def _found_by_shuffle(texts: DataFrame, rows: DataFrame, bench: DataFrame, window: int) -> DataFrame:
    """The same for any benchmark: only (id, text's hash, at, hash) are dealt by hash; a text's hits then meet it."""
    hits = rows.select("id", F.xxhash64("raw").alias("key"), "at", "hash").join(bench, "hash").distinct().groupBy("id", "key").agg(
        F.collect_list(F.struct("at", *_ITEM)).alias("hits")).withColumnsRenamed({"id": "_hit", "key": "_key"})
    texts = texts.withColumn("key", F.xxhash64("raw")).distinct()
    texts = texts.join(hits, texts["id"].eqNullSafe(F.col("_hit")) & (F.col("key") == F.col("_key"))).select(
        "id", "hits", _words(template_text(F.col("raw"))).alias("template"), _words(F.col("raw")).alias("words"))
    cut = F.transform("hits", lambda h: F.struct(
        *[h[c].alias(c) for c in ("at", *_ITEM)],
        *[_here(F.col(c), h["at"], h["item_at"], h["item_from"], h["item_template"]).alias(c) for c in ("template", "words")]))
    return texts.select("id", F.inline(cut)).filter(_equal())


def leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    min_words: int = MIN_WORDS,
    min_literals: int = MIN_LITERALS,
) -> DataFrame:
    """One row for each document and benchmark item whose passage it holds: id_col, item_id,
    n_windows, n_words (covered), n_slots, n_changed (slots whose values differ)."""
    texts = docs.select(F.col(id_col).alias("id"), _trimmed(F.col(text_col)).alias("raw"))
    items = benchmark_items(items, item_id_col, item_text_col)
    # items shorter than a window need windows of their lengths, of which there are fewer than window
    lengths = items.filter("raw != ''").select(F.size(_words(F.col("raw"))).alias("n")).filter(F.col("n").between(min_literals, window - 1)).distinct().collect()
    found = None
    for n in sorted([r.n for r in lengths] + [window]):
        bench = benchmark_windows(items, n, min_words, min_literals, short=n < window)
        rows = _windows(texts, n)
        if bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
            some = _found_at_once(rows, F.broadcast(bench), n)
        else:
            some = _found_by_shuffle(texts, rows, bench, n)
        some = some.withColumn("window", F.lit(n))
        found = some if found is None else found.unionByName(some)
    pairs = F.filter(
        F.transform(F.arrays_zip("item_template", "item_window", "words"), lambda x: F.struct(
            x["item_template"].alias("kind"), _bare(x["item_window"]).alias("item"), _bare(x["words"]).alias("doc"))),
        lambda p: is_slot(p["kind"]),
    )
    found = found.select("id", "item_id", "item_key", "item_at", "item_words", "item_whole", "item_same", "window", (F.col("at") - F.col("item_at")).alias("diagonal"), pairs.alias("pairs"))
    places = F.collect_set("item_at")
    passages = found.groupBy("id", "item_id", "item_key", "window", "diagonal").agg(
        F.max("item_words").alias("item_words"),
        F.max("item_same").alias("same"),
        F.when(F.max("item_whole"), F.max("item_words") - F.col("window") + 1).otherwise(F.size(places)).cast("long").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        F.when(F.max("item_whole"), F.max("item_words")).otherwise(_covered(places, window)).cast("long").alias("n_words"),
    )
    number = lambda p: p["kind"].contains("num")
    agree = (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: F.struct(p["kind"], p["item"]))))) & (
        F.size(F.filter("pairs", lambda p: ~number(p))) == F.size(F.array_distinct(F.transform(F.filter("pairs", lambda p: ~number(p)), lambda p: F.struct(p["kind"], p["doc"])))))
    passages = passages.filter(
        agree & (~F.col("same") | F.forall("pairs", lambda p: p["item"] == p["doc"])) & (F.col("n_words") >= F.least(F.lit(min_words), F.col("item_words"))))
    best = F.max_by(F.struct("n_windows", "n_words", F.size("pairs").cast("long").alias("n_slots"),
                             F.size(F.filter("pairs", lambda p: p["item"] != p["doc"])).cast("long").alias("n_changed")),
                    F.struct("n_words", "n_windows", -F.col("diagonal"), "item_key"))
    return passages.groupBy("id", "item_id").agg(best.alias("b")).select(
        F.col("id").alias(id_col), "item_id", "b.n_windows", "b.n_words", "b.n_slots", "b.n_changed")


def _bare(word: Column) -> Column:
    """A slot's value without the punctuation around it."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the documents that hold a benchmark passage."""
    bad = materialize(leaks(docs, items, id_col=id_col, **options).select(id_col).distinct(), "leaks")
    return without_ids(docs, bad, id_col)


def op3_decontaminate(spark, sf_dir) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
