import collections
import time
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnsift.llm import decontaminate, language_model, ngram_join, repeats, toxicity
from tarnsift.llm.common import DROP_SHUFFLES, materialize, shared_dir


# --- 1: repeats ------------------------------------------------------------------------------


@pytest.mark.parametrize("frequent,very", [(512, 40_000), (2, 40_000), (2, 3), (1, 1)])
def test_repeats(spark, docs, rows, frequent, very):
    extra = [(None, rows[3][1]), (7, rows[7][1])]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = sorted((tuple(r) for r in repeats.remove_repeats(both, frequent=frequent, very=very).collect()), key=repr)
    assert got == brute.repeats([(r[0], r[1]) for r in rows] + extra)


@pytest.mark.parametrize("partitions", [160, 1])
def test_repeats_in_many_partitions(spark, docs, rows, partitions):
    """Blocks of any number, and the same string in pieces of any size."""
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs.repartition(partitions, "doc_id"), bins=5).collect()), key=repr)
    assert got == brute.repeats([(r[0], r[1]) for r in rows])


def test_anchors_do_not_depend_on_the_piece():
    g = np.random.default_rng(3)
    string = g.integers(97, 101, 300).astype(np.uint8)
    for before, after in ((0, 0), (5, 9), (5000, 0), (100_000, 70_000)):
        data = np.r_[g.integers(97, 101, before).astype(np.uint8), string, g.integers(97, 101, after).astype(np.uint8)]
        _, hashes, place, low, high = repeats.anchors(data, np.array([0, len(data)]))
        own = {}
        for h, p, a, b in zip(hashes, place, low, high):
            own |= {s - before: (h, p - before) for s in range(a, b + 1) if 0 <= s - before <= 100}
        assert len(own) == 101
        first = own if not before and not after else first
        assert own == first


def test_repeats_of_nothing(no_docs):
    assert repeats.remove_repeats(no_docs).count() == 0


def test_run_index():
    g = np.random.default_rng(4)
    base = bytes(g.integers(97, 99, 400).astype(np.uint8))
    texts = sorted({base[i:i + 60] for i in range(0, 300, 7)} | {b"x" * 60, b"x" * 59 + b"y"})
    seen = collections.Counter(t[i:i + 20] for t in texts for i in range(len(t) - 19))
    got = repeats.mark(np.zeros(len(texts), np.uint64), texts, np.ones(len(texts), int), np.arange(len(texts)) * 1000, 20)
    for t, f in zip(texts, got):
        assert f.tolist() == [seen[t[i:i + 20]] > 1 for i in range(len(t) - 19)]
    index = repeats.RunIndex(np.frombuffer(b"abababab" * 50, np.uint8))
    assert index.lengths.sum() == 400 and len(index.heads) < 8


# --- 2: n-gram join --------------------------------------------------------------------------


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(docs, rows, size, num):
    got = {r.id: (r.n_shingles, r.component) for r in ngram_join.jaccard_components(docs, size=size, threshold=ngram_join.Threshold(num, 100)).collect()}
    assert got == brute.components([(r[0], r[1]) for r in rows], size, num, 100)


def test_keys_meet_whatever_is_common():
    g = np.random.default_rng(2)
    t = ngram_join.Threshold(85, 100)
    for n in (6, 20, 61, 200, 900):
        a = np.unique(g.integers(0, 1 << 62, n, dtype=np.uint64))
        most = int(0.15 * len(a))
        b = np.unique(np.r_[a[most:], g.integers(0, 1 << 62, 0, dtype=np.uint64)])
        if 100 * len(b) < 85 * len(a):
            b = np.unique(a[most - 1:])
        for common in (None, np.sort(a[::2]), np.sort(a)):
            keys, owner = ngram_join.part_keys([a, b], t, common)
            assert len(a) == len(b) or set(keys[owner == 0]) & set(keys[owner == 1])


def test_tree_loses_nothing():
    g = np.random.default_rng(8)
    t = ngram_join.Threshold(85, 100)
    base = g.integers(0, 1 << 62, 120, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: g.integers(60, 120)], g.integers(0, 1 << 62, g.integers(0, 30), dtype=np.uint64)]) for _ in range(300)]
    v, n = np.stack([ngram_join.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = ngram_join.CountTree(v, n)
    for i in range(0, 300, 17):
        linked = {j for j in range(300) if 100 * (c := np.intersect1d(sets[i], sets[j]).size) >= 85 * (n[i] + n[j] - c)}
        assert linked <= set(tree.candidates(v[i], int(n[i]), t).tolist())


def long_sets(n, g, size=1500, shared=300):
    """n long sets that share a passage by tens, and a near copy of every ninth; count vectors alone can't tell them apart."""
    draw = lambda k: g.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)
    passages, sets = [draw(shared) for _ in range(n // 10 + 1)], []
    for i in range(n):
        sets.append(np.unique(np.r_[draw(size - shared), passages[i // 10]]))
    return sets + [np.unique(np.r_[s[len(s) // 25:], draw(len(s) // 50)]) for s in sets[::9]]


@pytest.mark.parametrize("num,den", [(85, 100), (80, 100), (60, 100), (1, 1)])
@pytest.mark.parametrize("cross", [False, True])
def test_links_within_are_all_found(monkeypatch, num, den, cross):
    monkeypatch.setattr(ngram_join, "SLICE", 1000)
    g, t = np.random.default_rng(3), ngram_join.Threshold(num, den)
    base = g.integers(0, 1 << 62, 60, dtype=np.uint64)
    sets = [np.unique(g.choice(base, g.integers(1, 60))) for _ in range(60)] + long_sets(30, g, 200, 40)
    sets += [s.copy() for s in sets[:80:7]]
    side = g.integers(0, 2, len(sets)) if cross else np.full(len(sets), 2)
    want, got = ngram_join.Forest(len(sets)), ngram_join.Forest(len(sets))
    linked = lambda i, j: den * (c := np.intersect1d(sets[i], sets[j]).size) >= num * (len(sets[i]) + len(sets[j]) - c)
    for i in range(len(sets)):
        for j in range(i):
            if (not cross or side[i] != side[j]) and linked(i, j):
                want.join(i, j)
    for i, j in ngram_join.links_within(sets, side, t):
        assert linked(i, j) and (not cross or side[i] != side[j]) and got.join(i, j)
    assert [got.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))] and len({*map(want.root, range(len(sets)))}) < len(sets)


def test_long_sets_with_a_common_passage_are_not_verified(monkeypatch):
    """A cell of N such sets had N * N / 2 verified pairs."""
    sets, verified = long_sets(120, np.random.default_rng(6)), []
    count = np.count_nonzero
    monkeypatch.setattr(ngram_join.np, "count_nonzero", lambda x, *a, **k: verified.append(1) or count(x, *a, **k))
    monkeypatch.setattr(ngram_join.np, "intersect1d", lambda *a, f=np.intersect1d, **k: verified.append(1) or f(*a, **k))
    links = ngram_join.links_within(sets, np.full(len(sets), 2), ngram_join.Threshold(80, 100))
    assert len(links) == 14 and len(verified) < 3 * len(sets)


def test_one_of_each(spark, docs, no_docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    found = {r.id: r.component for r in ngram_join.jaccard_components(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in found.items() if i == c)
    again = docs.union(docs.filter("doc_id in (3, 5)"))  # rows that repeat
    assert sorted(r.doc_id for r in ngram_join.one_of_each(again).collect()) == sorted(i for i, c in found.items() if i == c)
    assert ngram_join.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("points", [4, 7])
def test_ngram_join_of_large_cells(spark, docs, rows, monkeypatch, points):
    monkeypatch.setattr(ngram_join, "BLOCK_POINTS", points)  # the family of near copies has several chunks
    across, made = ngram_join.links_across, []
    monkeypatch.setattr(ngram_join, "links_across", lambda *a: made.append(across(*a)) or made[-1])
    got = {r.id: (r.n_shingles, r.component) for r in ngram_join.jaccard_components(docs, size=2, threshold=ngram_join.Threshold(60, 100)).collect()}
    assert got == brute.components([(r[0], r[1]) for r in rows], 2, 60, 100)
    assert made


def shuffled(spark):
    """Records that all stages so far wrote for exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_sets_of_large_cells_travel_once(spark, monkeypatch):
    g = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:k], f"x{g.integers(1 << 40)}", *base[k:]]) for k in range(100, 160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = ngram_join.set_table(docs, 4).select("id", "set_id").collect()
    cells = spark.createDataFrame([(r.id, r.set_id, 1, i % 12, 12) for i, r in enumerate(sets)], "id long, set_id long, cell long, own int, chunks int")
    before = shuffled(spark)
    links = ngram_join.cell_links(docs, cells, 4, ngram_join.Threshold(85, 100))
    links = [tuple(r) for r in links.collect()]
    assert shuffled(spark) - before <= 2 * len(texts)  # 720 where a set travels for each chunk
    forest = ngram_join.Forest(len(sets))
    at = {r.set_id: i for i, r in enumerate(sets)}
    for a, b in links:
        forest.join(at[a], at[b])
    assert len({forest.root(i) for i in range(len(sets))}) == 1


def test_shuffle_files_go_with_their_query(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for top in folders for f in Path(top).rglob("shuffle_*.data")}
    df = spark.range(5000).repartition(3, "id")
    before = files()
    df.write.mode("overwrite").parquet(f"{shared_dir(spark)}/plain")
    plain = files() - before
    assert plain  # they stay until the driver collects its garbage
    assert len(materialize(df, "shuffled").collect()) == 5000
    for _ in range(50):
        if not (left := files() - before - plain):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(DROP_SHUFFLES) == "false"


# --- 3: decontamination ----------------------------------------------------------------------

ITEM = "the farmer Tom Baker sold 12 apples and then Tom Baker bought 30 kg of pears from the market before noon"


def leak(spark, texts, item=ITEM):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(2))
    b = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    return {r.doc_id: r.n_changed for r in decontaminate.leaks(d, b).collect()}


def test_leaks(spark):
    same = "x y z " + ITEM + " and so on"
    other = ITEM.replace("Tom", "Ann").replace("Baker", "Miller").replace("12", "7").replace("30 kg", "4,5 lb")
    mixed = ITEM.replace("Tom Baker bought", "Ann Baker bought")  # one name for two
    assert leak(spark, [same, other, mixed, ITEM[:40], "quite another text " * 20, "", None, "12 30 12 30 " * 30, ITEM.replace("apples", "plums")]) == {
        0: 0, 1: 5, 8: 0}


def test_leaks_at_scale_limits(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert leak(spark, [ITEM, "z " * 50_000 + ITEM]) == {0: 0, 1: 0}


@pytest.mark.parametrize("most", [200_000, 0])
def test_leaks_of_items_rich_in_slots(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    long = "How long are 3 hours 20 minutes and 15 seconds plus 2 hours 50 minutes and 5 seconds"
    convert = "Convert 5 km 3 m 20 cm and 7 km 4 m 60 cm to mm"
    for item in (long, convert):
        other = item.replace("20", "21").replace("7 ", "9 ")
        twice = item.replace("5 ", "3 ").replace("3 ", "8 ", 1)  # other values all the same
        cut = item.rsplit(" ", 1)[0]
        got = leak(spark, [item, f"x y {item} z", f"x. {other}", cut, f"{cut} or", twice, item.split(" ", 1)[1]], item)
        assert {0: 0, 1: 0} == {k: v for k, v in got.items() if v == 0} and 2 in got and not {3, 4, 6} & set(got)
    numbers = "10 11 12 13 14 15 16 17 18 19"
    assert leak(spark, [f"so {numbers} on", "20 21 22 23 24 25 26 27 28 29"], numbers) == {0: 0}


@pytest.mark.parametrize("most", [200_000, 0])
def test_leaks_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    g = np.random.default_rng(12)
    plain = [f"w{chr(97 + i)}x" for i in range(12)]
    pick = lambda *x: x[g.integers(len(x))]
    word = lambda: pick(*plain, *plain, "Tom", "Ann", "The", f"{g.integers(3, 60)}", f"{g.integers(3, 60)} {pick('kg', 'm', 'h')}", "Élise's", "end. How")
    items = [(i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate([*g.integers(8, 30, 14), 4, 5, 7, 2, 12, 13])]
    items += [(3, items[4][1]), (3, "  " + items[5][1]), (None, items[6][1] + "?"), (98, ""), (99, None)]
    docs = []
    for i in range(160):
        words = items[g.integers(20)][1].split()
        for _ in range(g.integers(0, 4)):  # some words are changed, to others of the same kind or not
            words[g.integers(len(words))] = word()
        if g.random() < 0.4:
            to = {"Tom": "Bob", "Ann": pick("Bob", "Eve")}
            words = [to.get(w, w) for w in words]
        a, b = (0, len(words)) if g.random() < 0.7 else sorted(g.integers(0, len(words) + 1, 2))
        docs.append((i, " ".join([word() for _ in range(g.integers(0, 6))] + words[a:b] + [word() for _ in range(g.integers(0, 6))])))
    docs += [(200, None), (201, ""), (202, " \n"), (203, items[0][1].replace(" ", "\n  ")), (204, "zz " * 30_000 + items[1][1])]
    want = brute.leaks(docs, items)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.n_words for r in found.collect()} == want and len(want) > 40


def test_leaks_that_were_missed(spark):
    twenty = "a farmer sold red apples and then bought pears from that market before noon while rain fell over fields nearby"
    assert leak(spark, [twenty.replace(" that ", " this ")], twenty) == {0: 0}
    ask = "Tom has 12 apples in a basket. Tom gives 5 apples to his friend. How many are left?"
    assert leak(spark, [ask.replace("Tom", "Bob").replace("12", "9")], ask) == {0: 2}
    two = "Ann has 12 apples in a basket. Joe gives 5 apples to his friend. How many are left?"
    assert leak(spark, [two.replace("Ann", "Tom").replace("Joe", "Tom"), two.replace("5", "12"), "as ever the sky is blue"], two) == {1: 1}
    assert leak(spark, ["so: the sky is blue today", "the sky is red"], "The sky is blue") == {0: 0}


def test_without_leaks(spark, no_docs):
    d = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, "clean"), (None, "clean too")], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [r.text for r in decontaminate.without_leaks(d, b).collect()] == ["clean"]
    assert decontaminate.without_leaks(no_docs, b).count() == 0
    assert decontaminate.without_leaks(d, b.limit(0)).count() == 4


# --- 6: toxicity -----------------------------------------------------------------------------


def test_gradients():
    net, data = toxicity.Network(), pa.array(["the worst is here today and more", "a b c d e"], pa.large_string())
    _, data, offsets = next(toxicity.pieces(data))
    words = toxicity.Words(data, offsets)
    begin, length, _ = toxicity.windows(words.row_bounds)
    ids = words.token[np.minimum(begin + np.arange(7)[:, None], len(words.token) - 1)]
    drop = np.ones(len(words.bucket), np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        logit, saved = net.forward(net.inputs(words, drop), ids, length, keep=True)
        return float((logit * np.array([1.0, -2.0])).sum()), saved

    grads = net.backward(np.array([1.0, -2.0]), ids, loss()[1], words, drop, len(words.bucket))
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = net.p[k][at], 1e-3
        net.p[k][at] = old + step
        up = loss()[0]
        net.p[k][at] = old - step
        down = loss()[0]
        net.p[k][at] = old
        assert g[at] == pytest.approx((up - down) / 2 / step, rel=0.02, abs=1e-4), k


def test_windows_cover():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        s = toxicity.window_starts(n)
        covered = np.zeros(n, bool)
        for a in s:
            covered[a:a + toxicity.WINDOW] = True
        assert covered.all()


def test_learns_stems(spark, no_docs):
    g = np.random.default_rng(1)
    vocab = [f"{a}{b}{c}" for a in ("ta", "ri", "mo") for b in ("le", "vu", "sa", "no") for c in ("", "n", "ri", "sta")]
    rows = []
    for i in range(500):
        w = list(g.choice(vocab, 40))
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                w[g.integers(40)] = "blarg" + g.choice(["o", "ix", "en", "us"])
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9999, 1), (0, None)], "doc_id long, toxic int")
    net = toxicity.fit(docs.withColumn("toxic", F.lit(1)).repartition(5), labels)  # a column that clashes
    held = docs.filter(toxicity.fold(F.col("doc_id"), 3) == 1).select("doc_id", toxicity.score_column(net, spark)("text").alias("s")).collect()
    assert len(held) > 100 and np.mean([(r.s >= 0.7) == (r.doc_id % 3 == 0) for r in held]) >= 0.97
    fresh = ["mo blargull ri", "mole talen " * 30, "", None, "   ", "mole " * 30_000 + "blargatt " + "mole " * 100]
    score = toxicity.score_column(net, spark)
    got = [r[0] for r in spark.createDataFrame([(x,) for x in fresh], "text string").coalesce(1).select(score("text")).collect()]
    assert got[0] > 0.7 and got[1] < 0.3 and got[2:5] == [0.0, 0.0, 0.0] and got[5] > 0.7
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert no_docs.select(score("text")).count() == 0
    assert spark.createDataFrame([("x",)], "text string").select(toxicity.score_column(None, spark)("text")).first()[0] == 0.0


# --- 10: language model ----------------------------------------------------------------------


def test_elias_fano():
    g = np.random.default_rng(0)
    for n, bits in ((0, 56), (1, 56), (5, 56), (3000, 20), (20_000, 56)):
        v = np.unique(g.integers(0, 1 << bits, n, dtype=np.uint64))
        e = language_model.EliasFano.encode(v, bits)
        assert (e.find(v) == np.arange(len(v))).all()
        absent = np.setdiff1d(g.integers(0, 1 << bits, 500, dtype=np.uint64), v)
        assert (e.find(absent) == -1).all()


def scored(docs):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return language_model.score_texts(docs.select(F.col("doc_id").alias("id"), "text", (~held).alias("train")))


@pytest.mark.parametrize("split", [4, 1])
def test_scores(docs, rows, split, monkeypatch):
    monkeypatch.setattr(language_model, "SPLIT", split)
    want = brute.base_scores([(r[0], r[1]) for r in rows])
    got = {r.doc_id: r for r in scored(docs).collect()}
    assert got.keys() == want.keys()
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    near = [i for i in range(70, 82) if want[i][0]]
    assert all(got[i].score > got[i].base_score for i in near)


def test_scores_do_not_depend_on_shards(docs, monkeypatch):
    got = []
    for split, bins in ((0.01, 3), (4, 4), (1, 37), (200, 2)):  # from no frequent word to many
        monkeypatch.setattr(language_model, "SPLIT", split)
        rows = language_model.score_texts(docs.select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 5 != 1).alias("train")), bins).collect()
        got.append(sorted((r.doc_id, r.score, r.n_known) for r in rows))
    assert got[0] == got[1] == got[2] == got[3]


def test_scores_of_little(spark, no_docs):
    assert scored(no_docs).count() == 0
    one = spark.createDataFrame([(None, None), (4, "a b")], "doc_id long, text string")
    assert sorted(r.n_tokens for r in scored(one).collect()) == [1, 3]


def test_scores_by_exact_counts_of_rare_words(spark):
    common = " ".join(f"f{i}" for i in range(17_000))
    rows = [(i, common, True) for i in range(6)] + [(10, "five z " * 5 + "two z " * 2, True), (11, "new five", False), (12, "new two", False), (13, "new other", False)]
    got = {r.doc_id: r.score for r in language_model.score_texts(spark.createDataFrame(rows, "id long, text string, train boolean")).collect()}
    after = lambda n: 0.6 + 0.4 * 0.8 / n if n else 1
    for i, n, j, m in ((11, 5, 12, 2), (12, 2, 13, 0)):
        assert got[i] - got[j] == pytest.approx(np.log10(n / max(m, 1) * after(n) / after(m)), abs=2e-3)
