import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.functions import text as T
from quillbank.operators import kernels as M
from quillbank.operators import nearest as K
from quillbank.operators import select as Q
from quillbank.operators import statistics as S
from quillbank.session import dense_index
from quillbank.sources import files


def unit(n, d, seed):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, x, c):
    items = spark.createDataFrame([(i, v.tolist(), 0.1 * (i % 3)) for i, v in enumerate(x)], "id bigint, v array<double>, r double").repartition(3)
    clusters = spark.createDataFrame([(k, v.tolist(), 1.0 + k) for k, v in enumerate(c)], "cid bigint, centroid array<double>, weight double")
    return items, clusters


def plain(x, r, rule, budget):
    left, out = list(range(len(x))), []
    for _ in range(budget):
        s = np.round(rule.scores(x[left], r[left]), Q.DIGITS)
        best = left[int(np.lexsort((left, -s))[0])]
        out.append(best)
        rule.take(x[best])
        left.remove(best)
    return out


@pytest.mark.parametrize("make", [lambda c, w: Q.Facility(c, w, 0.35), lambda c, w: Q.Marginal(c, 0.5), lambda c, w: Q.Farthest(c, 1.0)])
def test_batched_selection_is_the_plain_greedy_order(spark, make):
    x, c, w = unit(60, 5, 1), unit(4, 5, 2), 1.0 + np.arange(4)
    r = 0.1 * (np.arange(60) % 3)
    items, _ = frames(spark, x, c)
    for batch in (7, 1000):
        assert [i for i, _ in Q.select(items, make(c, w), 12, batch)] == plain(x, r, make(c, w), 12)


def result_mb(spark, work):
    """What ``work`` gives and the MB of all its tasks' results, from the application's status."""
    tracker, jvm = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc()
    group = f"sent-{id(work)}"
    spark.sparkContext.setJobGroup(group, "")
    got = work()
    stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
    spark.sparkContext._jvm.java.lang.Thread.sleep(1000)  # the status follows the events
    return got, sum(jvm.statusStore().lastStageAttempt(i).resultSize() for i in stages) / 1e6


def test_a_round_of_selection_sends_one_batch_to_the_driver(spark):
    x, c = unit(4000, 16, 21), unit(4, 16, 22)
    items = frames(spark, x, c)[0].repartition(16).persist()
    items.count()
    _, one = result_mb(spark, lambda: Q._best(items.coalesce(1), Q.Facility(c, np.ones(4), 0.0), [], 250))
    _, many = result_mb(spark, lambda: Q._best(items, Q.Facility(c, np.ones(4), 0.0), [], 250))
    assert many < one + 0.2  # beyond the batch only each task's own figures


def test_greedy_is_near_the_best_subset():
    x, c, w = unit(9, 4, 3), unit(3, 4, 4), np.array([1.0, 2.0, 3.0])
    value = lambda s: sum(w[k] * max(0, max(x[i] @ c[k] for i in s)) for k in range(3))
    picked = plain(x, np.zeros(9), Q.Facility(c, w, 0.0), 3)
    assert value(picked) >= (1 - 1 / math.e) * max(value(s) for s in itertools.combinations(range(9), 3))


def test_nearest_in_batches_and_by_join(spark):
    x, c = unit(40, 6, 5), unit(7, 6, 6)
    items, clusters = frames(spark, np.vstack([x, np.zeros((1, 6))]), c)
    both = [{(q.id, q.cid) for q in f.collect()} for f in (K.nearest(items, clusters), K._nearest_by_join(items, clusters, None))]
    assert both[0] == both[1] and (40, 0) in both[0]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit(1).alias("p")).repartition(5)
    got = dense_index(df, F.desc("x")).collect()
    assert sorted((r.id, r.x) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert dense_index(df.limit(0), "x").count() == 0


def test_undefined_statistics(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 1), (2, 1.0, 3.0, 1)], "i bigint, x double, y double, l int")
    assert S.spearman(rows, [], "x", "y").first()[0] == 0
    assert S.kendall(rows, [], "i", "x", "y").first()[0] == 0
    assert S.auc(rows, [], "x", "l", "i").first()[0] == 0.5
    empty = F.array().cast("array<string>")
    assert rows.select(S.jaccard(empty, empty)).first()[0] is None
    assert rows.select(N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))).first()[0] == 0


def test_counter_generator(spark):
    got = [r[0] for r in spark.range(1, 4).select(N.uniform(F.lit(20260706), F.col("id"))).collect()]
    assert got == pytest.approx([0.69819920, 0.43607784, 0.42547372], abs=5e-8)
    assert sorted(M.shuffled(20, 3)) == list(range(20)) and M.shuffled(20, 3) != M.shuffled(20, 4)


def test_fnv(spark):
    def want(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    rows = spark.createDataFrame([("",), ("a",), ("small ring",)], "s string")
    assert [r[0] for r in rows.select(N.fnv1a(F.col("s"))).collect()] == [want(""), want("a"), want("small ring")]


def test_text_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("What is THIS? 12 a,b",)], "t string")
    got = df.select(F.concat_ws(" ", T.skeleton(F.col("t"))).alias("s"), T.letter_verdict(F.col("t")).alias("v"), T.percent_verdict(F.col("t")).alias("p"), *T.style_features(F.col("t"))).collect()
    assert [r.s for r in got][1:] == ["<s> </s>", "<s> what is this ? NUM X </s>"]
    assert [r.p for r in got] == [None, None, 12] and got[2].f1 == 5 and got[2].f9 == 1 and got[1].f8 == 0


def test_grams_counted_in_one_walk_are_those_of_the_columns(spark):
    from collections import Counter

    from quillbank.plans import text as P

    texts = ["What is THIS? 12 a,b", "", " x\u00a0y the. The!? best-of ...", "zig zag zog, 9lives don't \u0130s\x1cit \u212aelvin", "the the\x0b\x0cthe ?! _ X x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lists = [(r.doc_id, r.n, r.g) for r in docs.where("text IS NOT NULL").select("doc_id", F.size(T.skeleton(F.col("text"))).alias("n"), T.grams(T.skeleton(F.col("text"))).alias("g")).collect()]
    want = Counter(g for _, _, gs in lists for g in set(gs))
    assert {r.gram: r.df for r in P._counted(docs).groupBy("gram").agg(F.sum("df").alias("df")).collect()} == want
    chosen = sorted(want)[::2]
    got = {(r.doc_id, r.n, r.gram, r.k) for r in P._counted(docs, chosen).collect()}
    assert got == {(i, n, g, k) for i, n, gs in lists for g, k in Counter(gs).items() if g in chosen}


def test_item_response_recovers_order():
    r = np.random.default_rng(0)
    b, theta = np.linspace(-1.5, 1.5, 12), r.normal(size=40)
    trials = np.full((12, 40), 30.0)
    succ = r.binomial(30, 1 / (1 + np.exp(-(theta[None] - b[:, None])))).astype(float)
    a, got, t = M.fit_2pl(succ, trials)
    assert np.corrcoef(got, b)[0, 1] > 0.97 and np.corrcoef(t, theta)[0, 1] > 0.97 and abs(t.mean()) < 1e-9 and (a > 0).all()


def test_frontier_and_discriminator():
    p = np.array([0.2, 0.3, 0.5])
    assert M.frontier(p, p) > 0.95 > M.frontier(np.array([1.0, 0, 0]), np.array([0, 0, 1.0]))
    x = np.random.default_rng(1).normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(float)
    assert M.rank_auc(M.fit_logistic(x, y)(x), y) > 0.98 and M.rank_auc(x[:, 0], np.ones(300)) == 0.5


def test_vendi_bounds(spark):
    one = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(5)] + [(5 + i, [float(i == 0), float(i == 1)], 1) for i in range(2)], "id bigint, v array<double>, k bigint")
    got = {r.k: r.vendi for r in M.vendi(one, "k").collect()}
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(2)


def test_csv_with_quotes_and_line_ends(spark):
    rows = [(1, 'a "b", c'), (2, "two\nlines"), (3, "")]
    path = files.scratch_path(spark)
    files.write_csv(spark.createDataFrame(rows, "i bigint, t string"), path)
    got = sorted((r.i, r.t or "") for r in files.read_csv(spark, path, "i bigint, t string").collect())
    assert got == rows


def test_csv_gives_back_every_character(spark):
    odd = ["", None, " lead", "trail ", "\t", "\n", "a\n\n", '\n"', '"\n', "\r", "\r\n", "a\r\nb", "a\rb", "\x00x", "\x1f", '"', '""', '","', "\\", '\\"', "\\N", "\\\\N", "\\N\n", "N", "null", "#c", "\u00a0\ufeff\u2028"]
    path = files.scratch_path(spark)
    files.write_csv(spark.createDataFrame(list(enumerate(odd)), "i bigint, t string").coalesce(1), path)
    assert dict(files.read_csv(spark, path, "i bigint, t string").collect()) == dict(enumerate(odd))


def test_item_response_takes_the_steps_of_the_reference():
    import numpy as np

    from quillbank.operators import kernels

    r = np.random.default_rng(0)
    trials = r.integers(1, 9, (6, 8)).astype(float)
    succ = np.floor(trials * r.random((6, 8)))
    for got, want in zip(kernels.fit_2pl(succ, trials), kernels.fit_2pl(succ, trials, 3000), strict=True):
        assert np.array_equal(got, want)
    assert any(not np.array_equal(x, y) for x, y in zip(kernels.fit_2pl(succ, trials), kernels.fit_2pl(succ, trials, 1500), strict=True))


def test_kmeans_is_lloyd_from_the_same_starts(spark):
    x = unit(300, 6, 11)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(4)
    for cosine in (True, False):
        (centroids, gain), (more, other) = M.fit_kmeans(frame, [(5, 3), (8, 3)], cosine, restarts=2)
        best = None
        for r in range(2):
            model = M.Lloyd(M.first_centroids(x, 5, cosine, 3 + 101 * r), cosine, 3 + 101 * r)
            for _ in range(60):
                at, _ = model.nearest(x)
                sums = np.zeros_like(model.centroids)
                np.add.at(sums, at, x)
                model.update(sums, np.bincount(at, minlength=5), x)
                if model.done:
                    break
            total = model.nearest(x)[1].sum()
            best = max(best, total) if best is not None else total
        assert gain == pytest.approx(best) and len(centroids) == 5 and len(more) == 8 and other > gain
        told = {q.id: q.cid for q in M.assigned(frame, centroids, cosine).collect()}
        assert [told[i] for i in range(300)] == M.Lloyd(centroids, cosine, 0).nearest(x)[0].tolist()


def test_kmeans_sends_each_model_once_to_the_driver(spark):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit(4000, 32, 8))], "id bigint, v array<double>")
    fit = lambda parts: result_mb(spark, lambda: M.fit_kmeans(rows.repartition(parts, "id"), [(100, 1)], restarts=2, max_iter=3))
    (few, one), (many, wide) = fit(2), fit(24)
    assert few[0][1] == pytest.approx(many[0][1])
    assert wide < one + 24 * 4 * 0.03  # two starts of 0.026 MB each; beyond them only each task's own figures


def test_a_centroid_without_rows_is_seeded_again():
    model = M.Lloyd(np.array([[1.0, 0.0], [0.0, 1.0]]), True, 1)
    model.update(np.array([[2.0, 0.0], [0.0, 0.0]]), np.array([2, 0]), np.array([[0.6, 0.8]]))
    assert model.centroids.tolist() == [[1.0, 0.0], [0.6, 0.8]]


def test_calibration_tells_far_classes_and_not_equal_ones(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=4) + (3.0 * (i % 2) if shift else 0.0)).tolist(), i % 2) for shift in (0,) for i in range(600)]
    far = [(i, (r.normal(size=4) + 3.0 * (i % 2)).tolist(), i % 2) for i in range(600)]
    kind = "id bigint, x array<double>, y int"
    auc, mauve, _ = M.calibration(spark.createDataFrame(rows, kind))
    auc_far, mauve_far, model = M.calibration(spark.createDataFrame(far, kind))
    assert abs(auc - 0.5) < 0.12 and mauve > 0.6 and auc_far > 0.99 and mauve_far < 0.1
    assert model(np.array([[3.0] * 4]))[0] > 0.9 > 0.1 > model(np.array([[0.0] * 4]))[0]


def test_folds_take_seventy_percent_of_either_class():
    y = np.array([1.0] * 10 + [0.0] * 20)
    train = M.folds(y, 5)
    assert train[:10].sum() == 7 and train[10:].sum() == 14


def test_random_halves_equal_a_plain_count(spark):
    r = np.random.default_rng(4)
    cells = [("a" if u % 3 else "b", int(u), int(k), int(n)) for u, k, n in zip(r.integers(0, 50, 400), r.integers(0, 6, 400), r.integers(1, 5, 400))]
    got = {(q.g, q.b, q.domain): (q.x, q.y) for q in S.random_halves(spark.createDataFrame(cells, "g string, unit long, domain long, n long").repartition(3), 7).collect()}
    want = {}
    for g, u, k, n in cells:
        for b in range(7):
            side = (u * 7919 + b * 104729) % 1009 % 2
            x, y = want.get((g, b, k), (0, 0))
            want[g, b, k] = (x + n * (side == 0), y + n * (side == 1))
    assert got == want


def test_random_halves_hold_one_domain_of_remainders(spark):
    """Units of one remainder are one before Python sees them, and a unit that is null is on neither side."""
    seen = spark.createDataFrame([(0, u, 3, 1) for u in (5, 5 + 1009, 5 - 1009)] + [(0, None, 3, 7), (0, None, 4, 7)], "g long, unit long, domain long, n long")
    got = {(q.b, q.domain): (q.x, q.y) for q in S.random_halves(seen, 40).collect()}
    side = [(5 * 7919 + b * 104729) % 1009 % 2 for b in range(40)]
    assert got == {(b, k): ((3, 0) if s == 0 else (0, 3)) if k == 3 else (0, 0) for b, s in enumerate(side) for k in (3, 4)}


def test_keyless_ranks_share_ties(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0, 3.0)], "x double")
    assert sorted((q.x, q.r) for q in S.average_ranks(rows, [], "x", "r").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_head_search_gates_and_takes_each_text_once(spark):
    from quillbank.plans.text import head_search

    corpus = [(1, "red ring now"), (2, "what red ring is best"), (3, "the red rings and blue ring"), (4, "blue ring " * 30), (5, "is blue ring worth it")]
    frames_ = spark.createDataFrame([("blue ring",), ("red ring",), ("ring",), ("none here",)], "head string"), spark.createDataFrame(corpus, "id bigint, q string")
    assert sorted((r["head"], r["id"]) for r in head_search(*frames_, 10).collect()) == [("blue ring", 3), ("red ring", 2), ("ring", 5)]
    assert head_search(*frames_, 1).count() == 1
    with pytest.raises(ValueError):
        head_search(*frames_, 10, least=4)


def test_head_search_goes_on_past_heads_whose_texts_are_taken(spark):
    from quillbank.plans.text import head_search

    heads = spark.createDataFrame([(f"red ring {'.' * k}",) for k in range(12)] + [("zinc bolt",)], "head string")  # all ask for one text
    corpus = spark.createDataFrame([(1, "the red ring of today"), (2, "the zinc bolt of today")], "id bigint, q string")
    assert sorted((r["head"].split()[0], r["id"]) for r in head_search(heads, corpus, 2).collect()) == [("red", 1), ("zinc", 2)]


def test_vendi_of_known_spectra(spark):
    rows = [(i, np.eye(6)[i].tolist(), 0) for i in range(6)] + [(10 + i, [2.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1) for i in range(5)] + [(20 + i, np.eye(6)[i % 2].tolist(), 2) for i in range(8)]
    got = {r.cid: r.vendi for r in M.vendi(spark.createDataFrame(rows, "id bigint, v array<double>, cid bigint"), "cid").collect()}
    assert got[0] == pytest.approx(6) and got[1] == pytest.approx(1) and got[2] == pytest.approx(2)


def test_quota_walks_seeds_in_order(spark):
    from quillbank.plans.statistics import quota_in_order

    r = np.random.default_rng(6)
    rows = [(f"s{a}", f"k{b:02d}", float(v)) for a, b, v in zip(r.integers(0, 6, 300), r.integers(0, 25, 300), r.integers(0, 40, 300))]
    best = {}
    for seed, kw, v in rows:
        best[seed, kw] = max(v, best.get((seed, kw), v))
    taken, want = set(), set()
    for seed in sorted({s for s, _ in best}):
        n = 0
        for v, kw in sorted((-v, k) for (s, k), v in best.items() if s == seed):
            if kw not in taken and n < 3:
                taken.add(kw)
                want.add((seed, kw))
                n += 1
    assert {(q.seed, q.kw) for q in quota_in_order(spark.createDataFrame(rows, "seed string, kw string, volume double"), 3).collect()} == want


def test_running_totals_cross_partitions(spark):
    from quillbank.session import running

    r = np.random.default_rng(8)
    values = r.integers(-50, 50, 200).tolist()
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long").repartition(5)
    got = {q.i: (q.s, q.m) for q in running(running(df, "v", "i", name="s"), "v", "i", how="max", name="m").collect()}
    assert got == {i: (sum(values[: i + 1]), max(values[: i + 1])) for i in range(200)}
    assert running(df.limit(0), "v", "i").collect() == []


def test_settings_never_override_and_calls_stop_at_bad_requests(spark):
    lines = spark.createDataFrame([(1, "A=1"), (2, "# B=2"), (3, ' C = "three" '), (4, "A=4"), (5, "C=5"), (6, "no setting")], "at long, value string")
    assert {r.key: r.value for r in files.settings(lines, spark.createDataFrame([("C", "kept")], "key string, value string")).collect()} == {"A": "4", "C": "kept"}

    def call(key, attempt):
        return (400, None) if key == 1 else (503, None) if attempt < key else (200, "ok")

    got = {r.key: (r.status, r.body, r.attempts, r.waited) for r in files.called(spark.createDataFrame([(k,) for k in (0, 1, 3, 9)], "key long"), "key", call, sleep=False).collect()}
    assert got == {0: (200, "ok", 1, 0.0), 1: (400, None, 1, 0.0), 3: (200, "ok", 4, 7.0), 9: (503, None, 6, 31.0)}


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_kendall_of_all_rows_is_that_of_all_pairs(spark, block_rows):
    r = np.random.default_rng(9)
    for top in (5, 1000):
        x, y = r.integers(0, top, 150), r.integers(0, top, 150)
        s = px = py = 0
        for i, j in itertools.combinations(range(150), 2):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, px, py = s + a * b, px + abs(a), py + abs(b)
        frame = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(1, None)], "x long, y long").repartition(4)
        assert S._kendall_of_all(frame, "x", "y", block_rows).first().tau == pytest.approx(s / math.sqrt(px * py))
    assert S.kendall(frame.limit(0), [], "x", "x", "y").first().tau == 0.0
    assert S.inversions(np.array([3, 1, 2] * 50)) == sum(a > b for a, b in itertools.combinations([3, 1, 2] * 50, 2))


@pytest.mark.parametrize("block_cells", [40, 10**6])
def test_a_cluster_for_each_item_is_selected_in_blocks(spark, block_cells):
    x = unit(50, 5, 11) * (1 + np.arange(50) % 3)[:, None]
    x[7] = 0
    r, length = 0.1 * (np.arange(50) % 3), np.linalg.norm(x, axis=1, keepdims=True)
    each = x / np.where(length > 0, length, 1)
    items, _ = frames(spark, x, each)
    got = Q.select_each(items, 20.0, [0.0, 0.7], 6, block_cells)
    for lam, picked in got.items():
        assert [i for i, _ in picked] == plain(x, r, Q.Facility(each, np.full(50, 0.4), lam), 6)
