"""Rank statistics, aggregates of reports, ordered selection, resampling and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.functions import text as T
from quillbank.operators import statistics as S
from quillbank.plans.probes import CORRELATION, ranked_sql
from quillbank.plans.registry import query, table
from quillbank.plans.text import CONTENT
from quillbank.session import dense_index, running

SUPPLIER = "s AS (SELECT s_suppkey AS i, s_acctbal AS x, round(s_acctbal / 500) AS y, s_nationkey AS g FROM supplier)"


def suppliers(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("x"), F.round(F.col("s_acctbal") / 500).alias("y"), F.col("s_nationkey").alias("g"))


def labelled(spark, d):
    """doc_id, score (a count of words) and the two labels."""
    docs = table(spark, d, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("score"))
    return docs.join(table(spark, d, "labels"), "doc_id")


LABELLED = "t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '')) AS score, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("r1_average_ranks", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS r FROM part")
def r1(spark, d):
    """Ranks from counts of the distinct values, so that only those are ordered in one place."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    sizes = parts.groupBy("p_size").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = sizes.select("p_size", (below + (F.col("n") + 1) / 2).alias("r"))
    return parts.join(F.broadcast(ranks), "p_size").select("p_partkey", "r")


@query("r2_pearson", "SELECT event_type, " + CORRELATION("value", "user_id::DOUBLE") + " AS r FROM events GROUP BY event_type")
def r2(spark, d):
    rows = table(spark, d, "events").withColumn("u", F.col("user_id").cast("double"))
    return S.pearson(rows, ["event_type"], "value", "u").select("event_type", F.round("r", 6).alias("r"))


@query("r3_spearman", f"WITH {SUPPLIER}, t AS (SELECT i, x, (i * 37) % 11 AS y, g FROM s) SELECT g::BIGINT AS g, {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('t', 'g')} GROUP BY g")
def r3(spark, d):
    rows = suppliers(spark, d).withColumn("y", F.col("i") * 37 % 11)
    return S.spearman(rows, ["g"], "x", "y").select(F.col("g").cast("bigint").alias("g"), F.round("r", 6).alias("rho"))


@query("r4_kendall", f"WITH {SUPPLIER}, t AS (SELECT i, x, (i * 37) % 11 AS y FROM s), k AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum(abs(sign(a.x - b.x))) AS px, sum(abs(sign(a.y - b.y))) AS py FROM t a JOIN t b ON a.i < b.i) SELECT round(coalesce(s / nullif(sqrt(px * py::DOUBLE), 0), 0), 6) AS tau FROM k")
def r4(spark, d):
    rows = suppliers(spark, d).withColumn("y", F.col("i") * 37 % 11)
    return S.kendall(rows, [], "i", "x", "y").select(F.round("tau", 6).alias("tau"))


@query("r5_auc", f"WITH {LABELLED}, p AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS place FROM t) SELECT round((sum(place) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM p")
def r5(spark, d):
    return S.auc(labelled(spark, d), [], "score", "quality", "doc_id").select(F.round("auc", 6).alias("auc"))


@query("r7_cohen_kappa", "WITH p AS (SELECT avg((quality = 1 - toxic)::INT) AS po, avg(quality) AS a, avg(1 - toxic) AS b FROM labels) SELECT round(po, 6) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa FROM p")
def r7(spark, d):
    return S.cohen_kappa(table(spark, d, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")


@query("r8_krippendorff", """WITH r AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, 1 - toxic FROM labels), c AS (SELECT doc_id, v, count(*) AS c FROM r GROUP BY 1, 2), m AS (SELECT doc_id, sum(c) AS m, sum(c * c) AS same FROM c GROUP BY 1 HAVING sum(c) > 1),
k AS (SELECT sum((m * m - same) / (m - 1)) AS d, sum(m) AS n FROM m), t AS (SELECT sum(t * t) AS tt FROM (SELECT sum(c) AS t FROM c JOIN m USING (doc_id) GROUP BY v)) SELECT round(1 - d / ((n * n - tt) / (n - 1)), 6) AS alpha FROM k, t""")
def r8(spark, d):
    labels = table(spark, d, "labels")
    ratings = labels.select("doc_id", F.col("quality").alias("v")).unionByName(labels.select("doc_id", (1 - F.col("toxic")).alias("v")))
    return S.krippendorff(ratings, "doc_id", "v")


DRAW_SQL = """n AS (SELECT b.x AS b, i.x AS i, ({seed} + (b.x * {n} + i.x + 1) * 1831565813) & 4294967295 AS s FROM range(0, {boots}) b(x), range(0, {n}) i(x)), a AS (SELECT b, i, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM n),
m AS (SELECT b, i, xor((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)::BIGINT) & 4294967295, t) AS m FROM a), draw AS (SELECT b, i AS slot, xor(m, m >> 14) / 4294967296.0 AS u FROM m)"""


def draws(spark, boots: int, n: int, seed: int):
    """b, slot and u: ``n`` uniform numbers for each of ``boots`` replicates, each from its own place in one sequence."""
    spine = spark.range(boots * n, numPartitions=max(1, boots * n // 500_000)).withColumnRenamed("id", "c")
    return spine.select(F.floor(F.col("c") / n).alias("b"), (F.col("c") % n).alias("slot"), N.uniform(F.lit(seed), F.col("c") + 1).alias("u"))


#: Resamples of an interval, of a paired difference and of a correlation.
BOOTS, PAIRED, CORRELATED = 2000, 5000, 2000


@query("r9_bootstrap_ci", f"WITH v AS (SELECT n_nationkey AS i, total AS x FROM (SELECT n_nationkey, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)), {DRAW_SQL.format(seed=7, n=25, boots=BOOTS)}, r AS (SELECT b, avg(x) AS m FROM draw JOIN v ON i = floor(u * 25) GROUP BY b) SELECT round((SELECT avg(x) FROM v), 4) AS est, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM r")
def r9(spark, d):
    """Percentile interval of a mean over the nations' balances."""
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("i")).agg(F.sum("c_acctbal").alias("x"))
    drawn = draws(spark, BOOTS, 25, 7).select("b", F.floor(F.col("u") * 25).cast("bigint").alias("i"))
    means = drawn.join(F.broadcast(customers), "i").groupBy("b").agg(F.avg("x").alias("m"))
    return customers.agg(F.round(F.avg("x"), 4).alias("est")).crossJoin(means.agg(F.round(F.percentile("m", 0.025), 4).alias("lo"), F.round(F.percentile("m", 0.975), 4).alias("hi")))


@query("r10_paired_bootstrap", f"""WITH v AS (SELECT c_nationkey AS i, sum(c_acctbal) AS x, sum(c_custkey % 97 * 10.0) AS y FROM customer GROUP BY 1), {DRAW_SQL.format(seed=11, n=25, boots=PAIRED)}, r AS (SELECT b, avg(x) - avg(y) AS m FROM draw JOIN v ON i = floor(u * 25) GROUP BY b),
p AS (SELECT avg((m <= 0)::INT) AS f FROM r) SELECT round((SELECT avg(x) - avg(y) FROM v), 4) AS est, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi, round(greatest(2 * least(any_value(f), 1 - any_value(f)), 1.0 / {PAIRED}), 6) AS p FROM r, p""")
def r10(spark, d):
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("i")).agg(F.sum("c_acctbal").alias("x"), F.sum(F.col("c_custkey") % 97 * 10.0).alias("y"))
    drawn = draws(spark, PAIRED, 25, 11).select("b", F.floor(F.col("u") * 25).cast("bigint").alias("i"))
    gaps = drawn.join(F.broadcast(customers), "i").groupBy("b").agg((F.avg("x") - F.avg("y")).alias("m"))
    below = F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0))
    interval = gaps.agg(F.round(F.percentile("m", 0.025), 4).alias("lo"), F.round(F.percentile("m", 0.975), 4).alias("hi"), F.round(F.greatest(2 * F.least(below, 1 - below), F.lit(1.0 / PAIRED)), 6).alias("p"))
    return customers.agg(F.round(F.avg("x") - F.avg("y"), 4).alias("est")).crossJoin(interval)


@query("r11_bootstrap_correlation", f"""WITH v AS (SELECT n_regionkey AS g, n_nationkey, sum(c_acctbal) AS x, avg(c_acctbal) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n_nationkey) - 1 AS place FROM v),
{DRAW_SQL.format(seed=13, n=25, boots=CORRELATED)}, r AS (SELECT b, g, coalesce(covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 0) AS m FROM draw JOIN p ON g = slot // 5 AND place = floor(u * 5) GROUP BY b, g),
e AS (SELECT b, avg(m) AS m FROM r GROUP BY b) SELECT round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.5), 5) AS mid, round(quantile_cont(m, 0.975), 5) AS hi FROM e""")
def r11(spark, d):
    """Domains are drawn within each vertical (here nations within regions) from one sequence; a replicate averages the verticals."""
    nations = table(spark, d, "nation").select(F.col("n_regionkey").alias("g"), "n_nationkey")
    cells = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("g", "n_nationkey").agg(F.sum("c_acctbal").alias("x"), F.avg("c_acctbal").alias("y"))
    placed = cells.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy("n_nationkey")) - 1)
    drawn = draws(spark, CORRELATED, 25, 13).select("b", F.floor(F.col("slot") / 5).alias("g"), F.floor(F.col("u") * 5).alias("place"))
    each = drawn.join(F.broadcast(placed), ["g", "place"]).groupBy("b", "g").agg(S.pearson_of("x", "y").alias("m")).groupBy("b").agg(F.avg("m").alias("m"))
    return each.agg(*[F.round(F.percentile("m", p), 5).alias(n) for n, p in (("lo", 0.025), ("mid", 0.5), ("hi", 0.975))])


@query("r12_holm", "WITH p AS (SELECT n_nationkey AS i, ((n_nationkey * 7 + 1) % 26) / 100.0 AS p FROM nation), s AS (SELECT *, least(1.0, (26 - row_number() OVER (ORDER BY p, i)) * p) AS s FROM p) SELECT i::BIGINT AS i, round(p, 6)::DOUBLE AS p, round(max(s) OVER (ORDER BY p, i ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS adjusted FROM s")
def r12(spark, d):
    tests = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"), ((F.col("n_nationkey") * 7 + 1) % 26 / 100.0).cast("double").alias("p"))
    return S.holm(tests, "p", "i").select("i", F.round("p", 6).alias("p"), F.round("adjusted", 6).alias("adjusted"))


#: Random halvings of a reliability and of a permutation null.
SPLITS, PERMUTATIONS = 200, 2000
CELLS = "cells AS (SELECT {g} AS g, user_id AS unit, CAST(json_extract_string(props, '$.k') AS BIGINT) AS domain, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL)"
HALVES = "h AS (SELECT g, b.x AS b, domain, coalesce(sum(n) FILTER ((unit * 7919 + b.x * 104729) % 1009 % 2 = 0), 0) AS x, coalesce(sum(n) FILTER ((unit * 7919 + b.x * 104729) % 1009 % 2 = 1), 0) AS y FROM cells, range(0, {splits}) b(x) GROUP BY 1, 2, 3)"


def cited(spark, d, g):
    """g, unit, domain, n: citations of each domain by each query (user)."""
    rows = table(spark, d, "events").select(g.alias("g"), F.col("user_id").alias("unit"), F.get_json_object("props", "$.k").cast("bigint").alias("domain")).where("domain IS NOT NULL")
    return rows.groupBy("g", "unit", "domain").agg(F.count("*").alias("n"))


@query("r13_split_half", f"""WITH {CELLS.format(g="event_type")}, {HALVES.format(splits=SPLITS)}, r AS (SELECT g, b, {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('h', 'g, b')} GROUP BY g, b),
s AS (SELECT *, coalesce(2 * rho / nullif(1 + rho, 0), 0) AS sb FROM r) SELECT g, round(any_value(rho) FILTER (b = 0), 6) AS rho, round(greatest(-1, least(1, any_value(sb) FILTER (b = 0))), 6) AS reliability, round(avg(sb), 6) AS mean_reliability FROM s GROUP BY g""")
def r13(spark, d):
    """Rank agreement of two halves of the queries, stepped up to full length: one split, clamped, and the mean of 200."""
    halves = S.random_halves(cited(spark, d, F.col("event_type")), SPLITS)
    rho = S.spearman(halves, ["g", "b"], "x", "y").select("g", "b", F.round("r", 6).alias("rho")).withColumn("sb", S.spearman_brown(F.col("rho")))
    one = lambda c: F.max(F.when(F.col("b") == 0, c))
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sb")))
    return rho.groupBy("g").agg(F.round(one(F.col("rho")), 6).alias("rho"), F.round(one(clamped), 6).alias("reliability"), F.round(F.avg("sb"), 6).alias("mean_reliability"))


@query("r15_permutation_null", f"""WITH {CELLS.format(g="0::BIGINT")}, {HALVES.format(splits=PERMUTATIONS)}, r AS (SELECT b, {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('h', 'b')} GROUP BY b),
q AS (SELECT user_id AS unit, row_number() OVER (ORDER BY sum(round(value * 100)::BIGINT) / count(*) DESC, user_id) - 1 AS p, count(*) OVER () AS n FROM events GROUP BY user_id),
o AS (SELECT 0 AS g, domain, coalesce(sum(c.n) FILTER (p < q.n // 2), 0) AS x, coalesce(sum(c.n) FILTER (p >= q.n // 2), 0) AS y FROM cells c JOIN q USING (unit) GROUP BY domain),
e AS (SELECT {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('o', 'g')} GROUP BY g)
SELECT (SELECT rho FROM e) AS observed, round(avg(rho), 5) AS mean, round(quantile_cont(rho, 0.025), 5) AS lo, round(quantile_cont(rho, 0.975), 5) AS hi, round(avg((rho <= (SELECT rho FROM e))::INT), 6) AS percentile FROM r""")
def r15(spark, d):
    """An observed split, queries of high against low mean value, placed among the correlations of random halves."""
    cells = cited(spark, d, F.lit(0).cast("bigint"))
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("unit")).agg((F.sum(F.round(F.col("value") * 100).cast("bigint")) / F.count("*")).alias("m"))
    order = dense_index(users, F.desc("m"), "unit", name="p")
    half = order.count() // 2
    side = lambda low: F.sum(F.when((F.col("p") < half) == low, F.col("n")).otherwise(0))
    observed = S.spearman(cells.join(order, "unit").groupBy("g", "domain").agg(side(True).alias("x"), side(False).alias("y")), ["g"], "x", "y").select(F.round("r", 6).alias("observed"))
    null = S.spearman(S.random_halves(cells, PERMUTATIONS), ["b"], "x", "y").select(F.round("r", 6).alias("rho"))
    placed = null.crossJoin(F.broadcast(observed))  # one row
    return placed.agg(F.max("observed").alias("observed"), F.round(F.avg("rho"), 5).alias("mean"), F.round(F.percentile("rho", 0.025), 5).alias("lo"), F.round(F.percentile("rho", 0.975), 5).alias("hi"), F.round(F.avg(F.when(F.col("rho") <= F.col("observed"), 1.0).otherwise(0.0)), 6).alias("percentile"))


@query("r17_matched_threshold", "WITH a AS (SELECT avg((c_acctbal < 1000)::INT) AS drop_rate FROM customer), q AS (SELECT s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier), p AS (SELECT drop_rate * (n - 1) AS pos, x, i FROM a, q) SELECT round(sum(CASE WHEN i = floor(pos) AND floor(pos) = ceil(pos) THEN x WHEN i = floor(pos) THEN x * (ceil(pos) - pos) WHEN i = ceil(pos) THEN x * (pos - floor(pos)) ELSE 0 END), 4) AS threshold FROM p")
def r17(spark, d):
    """The quantile of a second score that drops the same share as the first score's threshold does."""
    share = table(spark, d, "customer").agg(F.avg(F.when(F.col("c_acctbal") < 1000, 1.0).otherwise(0.0))).first()[0]
    return table(spark, d, "supplier").agg(F.round(F.percentile("s_acctbal", float(share or 0)), 4).alias("threshold"))


@query("v11_disattenuation", "SELECT n_nationkey::BIGINT AS i, round(0.5 / sqrt(greatest(1e-6, (n_nationkey / 25.0) * 0.9)), 6) AS rho FROM nation")
def v11(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"), F.round(S.disattenuated(F.lit(0.5), F.col("n_nationkey") / 25.0, F.lit(0.9)), 6).alias("rho"))


@query("v12_spearman_brown", "SELECT n_nationkey::BIGINT AS i, round(coalesce(2 * r / nullif(1 + r, 0), 0), 6) AS full_length FROM (SELECT n_nationkey, n_nationkey / 12.0 - 1 AS r FROM nation)")
def v12(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"), F.round(S.spearman_brown(F.col("n_nationkey") / 12.0 - 1), 6).alias("full_length"))


BY_BRAND = "b AS (SELECT p_brand, sum(p_retailprice) AS x FROM part GROUP BY p_brand)"


def brands(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("x"))


@query("a8_buckets", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY p_brand")
def a8(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("a9_categories", "SELECT p_type AS kind, count(*) AS n FROM part GROUP BY p_type")
def a9(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query("a11_gini", f"WITH {BY_BRAND}, r AS (SELECT x, row_number() OVER (ORDER BY x, p_brand) AS i, count(*) OVER () AS n FROM b) SELECT round(sum((2 * i - n - 1) * x) / (any_value(n) * sum(x)), 6) AS gini FROM r")
def a11(spark, d):
    placed = dense_index(brands(spark, d), "x", "p_brand", name="i")
    n = placed.count()
    return placed.agg(F.round(F.sum((2 * (F.col("i") + 1) - n - 1) * F.col("x")) / (n * F.sum("x")), 6).alias("gini"))


@query("a12_mass_shares", f"WITH {BY_BRAND}, r AS (SELECT x, row_number() OVER w AS i, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(x) OVER () AS all_ FROM b WINDOW w AS (ORDER BY x DESC, p_brand)) SELECT round(sum(x) FILTER (i <= 5) / sum(x), 6) AS top5, count(*) FILTER (run - x < all_ / 2) AS half_mass FROM r")
def a12(spark, d):
    """Share of the five largest, and how many of the largest make up half: rows before which less than half has been seen."""
    placed = running(dense_index(brands(spark, d), F.desc("x"), "p_brand", name="i"), "x", "i", name="run")
    total = placed.agg(F.sum("x").alias("total"))
    both = placed.crossJoin(F.broadcast(total))  # one row
    return both.agg(F.round(F.sum(F.when(F.col("i") < 5, F.col("x"))) / F.max("total"), 6).alias("top5"), F.count(F.when(F.col("run") - F.col("x") < F.col("total") / 2, 1)).alias("half_mass"))


@query("a13_macro_average", "SELECT round(avg(m), 6) AS macro FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type) WHERE NOT isnan(m)")
def a13(spark, d):
    each = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return each.where(~F.isnan("m")).agg(F.round(F.avg("m"), 6).alias("macro"))


@query("a16_threshold_sweep", "SELECT t::DOUBLE AS tau, round(avg((c_acctbal < t)::INT), 6) AS drop_rate, round(avg(c_acctbal) FILTER (c_acctbal >= t), 4) AS kept_mean, round(avg(c_acctbal) FILTER (c_acctbal < t), 4) AS dropped_mean, round(avg((abs(c_acctbal - t) <= 500)::INT), 6) AS band FROM customer, (SELECT unnest([0, 1000, 2000, 3000, 4000, 5000, 6000]) AS t) GROUP BY t")
def a16(spark, d):
    """Drop rate, means and the share near the threshold, for a grid of thresholds."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in range(0, 7000, 1000)]))
    rows, x, tau = table(spark, d, "customer").select("c_acctbal", grid.alias("tau")), F.col("c_acctbal"), F.col("tau")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return rows.groupBy("tau").agg(share(x < tau).alias("drop_rate"), F.round(F.avg(F.when(x >= tau, x)), 4).alias("kept_mean"), F.round(F.avg(F.when(x < tau, x)), 4).alias("dropped_mean"), share(F.abs(x - tau) <= 500).alias("band"))


@query("a17_win_tally", "SELECT c_mktsegment AS baseline, sum((c_acctbal > 4500)::INT)::BIGINT AS wins, count(*) AS n, round(avg((c_acctbal > 4500)::INT), 6) AS accuracy FROM customer GROUP BY 1")
def a17(spark, d):
    win = F.when(F.col("c_acctbal") > 4500, 1).otherwise(0)
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("baseline")).agg(F.sum(win).alias("wins"), F.count("*").alias("n"), F.round(F.avg(win), 6).alias("accuracy"))


@query("a18_best_and_worst", "SELECT arg_max(k, m) AS best, arg_min(k, m) AS worst, arg_min(k, abs(m - 4500)) AS nearest FROM (SELECT c_mktsegment AS k, avg(c_acctbal) AS m FROM customer GROUP BY 1)")
def a18(spark, d):
    each = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("k")).agg(F.avg("c_acctbal").alias("m"))
    return each.agg(F.max_by("k", "m").alias("best"), F.min_by("k", "m").alias("worst"), F.min_by("k", F.abs(F.col("m") - 4500)).alias("nearest"))


@query("a24_top_decile_drops", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.9) AS cut FROM customer) SELECT round(avg((c_custkey % 10 < 3)::INT) FILTER (c_acctbal >= cut), 6) AS dropped_top, round(avg(c_acctbal) FILTER (c_custkey % 10 < 3), 4) AS mean_dropped, round(avg(c_acctbal) FILTER (c_custkey % 10 >= 3), 4) AS mean_kept FROM customer, q")
def a24(spark, d):
    rows = table(spark, d, "customer")
    cut = F.broadcast(rows.agg(F.percentile("c_acctbal", 0.9).alias("cut")))
    gone, x = F.col("c_custkey") % 10 < 3, F.col("c_acctbal")
    return rows.crossJoin(cut).agg(F.round(F.avg(F.when(x >= F.col("cut"), F.when(gone, 1.0).otherwise(0.0))), 6).alias("dropped_top"), F.round(F.avg(F.when(gone, x)), 4).alias("mean_dropped"), F.round(F.avg(F.when(~gone, x)), 4).alias("mean_kept"))


@query("a25_dispersion", """WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) AS b FROM customer), p AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer)
SELECT round((b - a) / m, 6) AS iqr_ratio, (SELECT round(count(*) FILTER (c_acctbal >= b AND c_custkey % 4 > 0)::DOUBLE / count(*) FILTER (c_acctbal >= b OR c_custkey % 4 > 0), 6) FROM customer) AS overlap, (SELECT round(avg(x) FILTER (p >= n - n // 4) / avg(x) FILTER (p < n // 4), 4) FROM p) AS spread FROM q""")
def a25(spark, d):
    """Interquartile range over the median, overlap of two top sets, and the top quarter's mean over the bottom quarter's."""
    rows = table(spark, d, "customer")
    q = F.broadcast(rows.agg(*[F.percentile("c_acctbal", p).alias(n) for n, p in (("a", 0.25), ("m", 0.5), ("b", 0.75))]))
    top, other = F.col("c_acctbal") >= F.col("b"), F.col("c_custkey") % 4 > 0
    placed = dense_index(rows.select("c_acctbal", "c_custkey"), "c_acctbal", "c_custkey", name="p")
    n, x = placed.count(), F.col("c_acctbal")
    spread = placed.agg(F.round(F.avg(F.when(F.col("p") >= n - n // 4, x)) / F.avg(F.when(F.col("p") < n // 4, x)), 4).alias("spread"))
    return rows.crossJoin(q).agg(F.round((F.max("b") - F.max("a")) / F.max("m"), 6).alias("iqr_ratio"), F.round(F.count(F.when(top & other, 1)) / F.count(F.when(top | other, 1)), 6).alias("overlap")).crossJoin(spread)


BEST = f"""r AS (SELECT item_id, {CONTENT} AS b FROM benchmark), q AS (SELECT conv_id, turn, {CONTENT} AS a FROM conversations WHERE role = 'user'),
j AS (SELECT conv_id, turn, max(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1)) AS best FROM q, r GROUP BY conv_id, turn)"""


def best_overlap(spark, d):
    """conv_id, turn, best: the greatest Jaccard of a user turn's content words with any reference text."""
    refs = table(spark, d, "benchmark").select(F.explode(T.content_tokens(F.col("text"))).alias("w"), "item_id", F.size(T.content_tokens(F.col("text"))).alias("nb"))
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.content_tokens(F.col("text")).alias("a"))
    shared = turns.select("conv_id", "turn", F.size("a").alias("na"), F.explode("a").alias("w")).join(refs, "w").groupBy("conv_id", "turn", "na", "item_id", "nb").agg(F.count("*").alias("k"))
    best = shared.groupBy("conv_id", "turn").agg(F.max(F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("best"))
    return turns.select("conv_id", "turn").join(best, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("best", F.lit(0.0)).alias("best"))


@query("j12_best_overlap", f"WITH {BEST} SELECT conv_id, turn, round(best, 6) AS best FROM j")
def j12(spark, d):
    return best_overlap(spark, d).withColumn("best", F.round("best", 6))


@query("a21_reference_overlap", f"""WITH {BEST}, w AS (SELECT avg(len(list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> ''))) AS w FROM conversations WHERE role = 'user'), h AS (SELECT unnest({CONTENT}) AS head FROM (SELECT text FROM benchmark)), c AS (SELECT head FROM h GROUP BY head ORDER BY count(*) DESC, head LIMIT 40),
s AS (SELECT avg((list_has_any({CONTENT}, (SELECT list(head) FROM c)))::INT) AS s FROM conversations WHERE role = 'user'), v AS (SELECT ln(1 + p_retailprice) AS v, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS p FROM part)
SELECT count(*) AS n, round(avg(best), 6) AS mean_best, count(*) FILTER (best >= 0.6) AS near_duplicates, (SELECT round(w, 6) FROM w) AS mean_words, (SELECT round(s, 6) FROM s) AS head_share, (SELECT round(sum(v) FILTER (p <= 60) / sum(v), 6) FROM v) AS top_volume FROM j""")
def a21(spark, d):
    """Overlap of a bank with the reference texts, its mean length, the share of it that names a head term, and the log volume of the 60 largest keywords."""
    overlap = best_overlap(spark, d).agg(F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean_best"), F.count(F.when(F.col("best") >= 0.6, 1)).alias("near_duplicates"))
    heads = table(spark, d, "benchmark").select(F.explode(T.content_tokens(F.col("text"))).alias("head")).groupBy("head").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "head").limit(40).agg(F.collect_list("head").alias("heads"))
    turns = table(spark, d, "conversations").where("role = 'user'").crossJoin(F.broadcast(heads))  # one row
    named = F.when(F.arrays_overlap(T.content_tokens(F.col("text")), F.col("heads")), 1.0).otherwise(0.0)
    own = turns.agg(F.round(F.avg(F.size(T.words(F.col("text")))), 6).alias("mean_words"), F.round(F.avg(named), 6).alias("head_share"))
    volume = F.log1p("p_retailprice")
    parts = table(spark, d, "part")
    top = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(60).agg(F.sum(volume).alias("t")).crossJoin(parts.agg(F.sum(volume).alias("all")))
    return overlap.crossJoin(own).crossJoin(top.select(F.round(F.col("t") / F.col("all"), 6).alias("top_volume")))


@query("j7_substring_join", "SELECT n_name AS form, count(*) AS n FROM nation JOIN documents ON contains(lower(text), lower(n_name)) GROUP BY 1 UNION ALL SELECT 'the', count(*) FROM documents WHERE contains(lower(text), 'the')")
def j7(spark, d):
    """Texts that hold one of a few forms; the forms are a small dimension."""
    forms = table(spark, d, "nation").select(F.col("n_name").alias("form")).unionByName(spark.createDataFrame([("the",)], "form string"))
    texts = table(spark, d, "documents").select(F.lower("text").alias("text"))
    return texts.join(F.broadcast(forms), F.contains("text", F.lower("form"))).groupBy("form").agg(F.count("*").alias("n"))


@query("w1_top_by_volume", "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def w1(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(50)


@query("w2_quota_per_seed", """WITH f AS (SELECT p_name AS kw, min(p_brand) AS seed FROM part WHERE length(p_name) <= 60 GROUP BY p_name), v AS (SELECT seed, kw, max(p_retailprice) AS volume FROM f JOIN part ON p_name = kw AND p_brand = seed GROUP BY 1, 2)
SELECT seed, kw, volume, p AS place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY volume DESC, kw) AS p FROM v) WHERE p <= 2""")
def w2(spark, d):
    """Each keyword goes to its first seed, each seed keeps its most popular ones (the relational form of the rule)."""
    parts = table(spark, d, "part").where(F.length("p_name") <= 60).select(F.col("p_name").alias("kw"), F.col("p_brand").alias("seed"), F.col("p_retailprice").alias("volume"))
    first = parts.groupBy("kw").agg(F.min("seed").alias("seed"))
    volumes = parts.join(first, ["kw", "seed"]).groupBy("seed", "kw").agg(F.max("volume").alias("volume"))
    return volumes.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("volume"), "kw")).cast("bigint")).where("place <= 2")


def quota_in_order(rows, quota: int):
    """The sequential rule itself: seeds in order, a keyword that an earlier seed took does not count towards the quota.

    ``rows`` has seed, kw, volume. Earlier seeds take ``quota`` keywords each at most, so of the k-th seed its first
    ``quota`` * k settle what it takes; these, a number that the seeds alone bound, are walked in one group.
    """

    def walk(pdf):
        taken, left = set(), {}
        keep = []
        for seed, kw in zip(pdf.seed, pdf.kw):
            ok = kw not in taken and left.get(seed, 0) < quota
            keep.append(ok)
            if ok:
                taken.add(kw)
                left[seed] = left.get(seed, 0) + 1
        return pdf[keep]

    each = rows.groupBy("seed", "kw").agg(F.max("volume").alias("volume"))
    order = dense_index(each.select("seed").distinct(), "seed", name="k")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("volume"), "kw"))
    most = order.count() * quota  # a bound for every seed, so that partitions drop rows before they are shuffled
    some = each.withColumn("p", place).where(F.col("p") <= most).join(order, "seed").where(F.col("p") <= quota * (F.col("k") + 1))
    return some.select("seed", "kw", "volume", F.lit(1).alias("one")).groupBy("one").applyInPandas(lambda pdf: walk(pdf.sort_values(["seed", "volume", "kw"], ascending=[True, False, True]))[["seed", "kw", "volume"]], "seed string, kw string, volume double")


@query("w2_quota_in_order", """WITH RECURSIVE o AS (SELECT p_brand AS seed, p_name AS kw, max(p_retailprice) AS volume FROM part WHERE length(p_name) <= 60 GROUP BY 1, 2), s AS (SELECT seed, row_number() OVER (ORDER BY seed) AS k FROM (SELECT DISTINCT seed FROM o)),
g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken, []::VARCHAR[] AS own UNION ALL SELECT k, list_concat(any_value(taken), list(kw) FILTER (p <= 2 AND kw IS NOT NULL)), coalesce(list(kw) FILTER (p <= 2 AND kw IS NOT NULL), [])
FROM (SELECT s.k, taken, o.kw, row_number() OVER (ORDER BY volume DESC NULLS LAST, kw) AS p FROM g JOIN s ON s.k = g.k + 1 LEFT JOIN o ON o.seed = s.seed AND NOT list_contains(taken, o.kw)) GROUP BY k)
SELECT seed, kw, volume FROM (SELECT k, unnest(own) AS kw FROM g) JOIN s USING (k) JOIN o USING (seed, kw)""")
def w2_in_order(spark, d):
    parts = table(spark, d, "part").where(F.length("p_name") <= 60)
    return quota_in_order(parts.select(F.col("p_brand").alias("seed"), F.col("p_name").alias("kw"), F.col("p_retailprice").alias("volume")), 2)


@query("w4_feature_order", "SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id % 2 = 0 AS half FROM (SELECT doc_id, len(string_split(text, ' ')) AS score FROM documents)")
def w4(spark, d):
    from quillbank.session import dense_index, running

    scored = table(spark, d, "documents").select("doc_id", F.size(F.split("text", " ")).alias("score"))
    return dense_index(scored, F.desc("score"), "doc_id", name="place").select("doc_id", (F.col("place") + 1).alias("place"), (F.col("doc_id") % 2 == 0).alias("half"))


@query("w5_prefix_metric", "WITH o AS (SELECT p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100)) SELECT n::BIGINT AS n, count(DISTINCT p_brand) AS covered FROM o, (SELECT unnest([10, 15, 20, 25, 50, 100]) AS n) WHERE pos <= n GROUP BY n")
def w5(spark, d):
    """One order serves every budget: brands covered by its first n."""
    first = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select("p_brand", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("pos"))
    return first.withColumn("n", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (10, 15, 20, 25, 50, 100)]))).where("pos <= n").groupBy("n").agg(F.count_distinct("p_brand").alias("covered"))


STRATA = """i AS (SELECT p_partkey AS id, 0.05::DOUBLE * (p_size % 12) AS a, p_retailprice AS b FROM part), k AS (SELECT * FROM i WHERE a > 0.15::DOUBLE), o AS (SELECT id, a, b, row_number() OVER (ORDER BY b, id) - 1 AS r, count(*) OVER () AS n FROM k),
e AS (SELECT s, max(b) AS edge FROM o, range(1, 6) x(s) WHERE r = floor(s / 6.0 * (n - 1)) GROUP BY s), t AS (SELECT id, a, (SELECT count(*) FROM e WHERE e.edge < o.b) AS stratum FROM o)"""


@query("w6_strata_round_robin", f"WITH {STRATA}, p AS (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY a DESC, id) AS round FROM t) SELECT id, stratum, round FROM p ORDER BY round, stratum LIMIT 50")
def w6(spark, d):
    """Informative items in six strata of difficulty, the best of each stratum in turn."""
    items = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (0.05 * (F.col("p_size") % 12)).alias("a"), F.col("p_retailprice").alias("b"))
    return strata_round_robin(items, 50)


def strata_round_robin(items, budget: int, least: float = 0.15, strata: int = 6):
    """id, stratum, round of ``budget`` items (id, a, b); all items take part where too few have a above ``least``."""
    from quillbank.session import dense_index, running

    able = items.where(F.col("a") > least)
    able = able if able.limit(budget).count() >= budget else items
    placed = dense_index(able, "b", "id", name="r")
    last = placed.agg(F.max("r")).first()[0] or 0
    wanted = [int(s / strata * last) for s in range(1, strata)]
    edges = F.broadcast(placed.where(F.col("r").isin(wanted)).agg(F.collect_list(F.struct("r", "b")).alias("e")))  # one row
    at = lambda r: F.get(F.filter("e", lambda x: x["r"] == r), F.lit(0))["b"]
    values = F.array(*map(at, wanted))
    told = placed.crossJoin(edges).withColumn("stratum", F.size(F.filter(values, lambda x: x < F.col("b"))).cast("bigint"))
    best = told.withColumn("round", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("a"), "id")).cast("bigint")).where(F.col("round") <= budget)
    return best.orderBy("round", "stratum").limit(budget).select("id", "stratum", "round")


@query("w7_weighted_round_robin", "WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS o FROM part GROUP BY 1), r AS (SELECT p_partkey AS id, o, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS round FROM part JOIN c USING (p_brand)) SELECT id, o AS cluster_place, round FROM r ORDER BY round, o LIMIT 50")
def w7(spark, d):
    parts = table(spark, d, "part")
    clusters = parts.groupBy("p_brand").agg(F.sum("p_retailprice").alias("w")).select("p_brand", F.row_number().over(Window.orderBy(F.desc("w"), "p_brand")).cast("bigint").alias("cluster_place"))
    placed = parts.withColumn("round", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("bigint")).where("round <= 50")
    return placed.join(F.broadcast(clusters), "p_brand").select(F.col("p_partkey").alias("id"), "cluster_place", "round").orderBy("round", "cluster_place").limit(50)


@query("w16_window_ranks", "SELECT p_partkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS rk, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)")
def w16(spark, d):
    by = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).cast("bigint").alias("rn"), F.rank().over(by).cast("bigint").alias("rk"), F.round(F.percent_rank().over(by), 6).alias("pr"))


@query("w17_framed_windows", "SELECT user_id, event_id, round(sum(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS run, round(max(value) OVER (w ROWS UNBOUNDED PRECEDING), 6) AS top, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w17(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = by.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(whole), 4).alias("run"), F.round(F.max("value").over(whole), 6).alias("top"), F.lag("event_type").over(by).alias("before"))


@query("set_union_all", "SELECT c_nationkey::BIGINT AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k")))


@query("set_union_distinct", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return union_all(spark, d).distinct()


@query("set_intersect", "SELECT DISTINCT p_size AS k FROM part WHERE p_brand = 'Brand#11' INTERSECT SELECT p_size FROM part WHERE p_brand = 'Brand#12'")
def intersect(spark, d):
    parts = table(spark, d, "part")
    return parts.where("p_brand = 'Brand#11'").select(F.col("p_size").alias("k")).intersect(parts.where("p_brand = 'Brand#12'").select("p_size"))


@query("set_except", "SELECT n_nationkey::BIGINT AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k")).subtract(table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").cast("bigint")))
