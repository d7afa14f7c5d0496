"""Queries over the numeric kernels: clusters, diversity, discriminators, item response."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.functions import text as T
from quillbank.operators import kernels as M
from quillbank.operators import nearest as K
from quillbank.operators import statistics as S
from quillbank.plans.registry import query, table
from quillbank.plans.vectors import VECTORS, vectors
from quillbank.session import dense_index


@query("v7_shuffle", """WITH RECURSIVE r AS (SELECT 24::BIGINT AS i, 3::BIGINT AS s, list(n_name ORDER BY n_nationkey) AS x FROM nation UNION ALL
SELECT i - 1, t, list_transform(x, lambda v, k: CASE WHEN k = i + 1 THEN x[j + 1] WHEN k = j + 1 THEN x[i + 1] ELSE v END) FROM (SELECT i, x, t, floor(xor(m, m >> 14) / 4294967296.0 * (i + 1))::BIGINT AS j FROM (
SELECT i, x, t, xor((a + ((xor(a, a >> 7)::HUGEINT * (a | 61)::HUGEINT) % 4294967296)::BIGINT) & 4294967295, a) AS m FROM (SELECT i, x, t, ((xor(t, t >> 15)::HUGEINT * (t | 1)::HUGEINT) % 4294967296)::BIGINT AS a FROM (SELECT i, x, (s + 1831565813) & 4294967295 AS t FROM r WHERE i > 0))))),
z AS (SELECT x FROM r WHERE i = 0) SELECT (unnest(range(1, len(x) + 1)) - 1)::BIGINT AS place, unnest(x) AS name FROM z""")
def v7(spark, d):
    """A seeded shuffle in sequence, for a short list; long ones are put in order by a draw for each id (w9, p2)."""
    names = [r[0] for r in table(spark, d, "nation").orderBy("n_nationkey").select("n_name").collect()]  # a list of 25
    return spark.createDataFrame([(k, names[i]) for k, i in enumerate(M.shuffled(len(names), 3))], "place bigint, name string")


@query("m1_spherical_kmeans")
def m1(spark, d):
    return M.kmeans(vectors(spark, d), 10)


def granularities(n: int) -> list[int]:
    """The k that are tried for n keywords: about the square root, between 10 and 24, and four less and more, within 8 and n / 3."""
    base = max(10, min(24, round(math.sqrt(n))))
    return [k for k in (base - 4, base, base + 4) if 8 <= k < n / 3]


@query("m2_granularity_scan")
def m2(spark, d):
    """Cohesion less a price for each cluster, over the k of ``granularities``; the best of them first."""
    v = vectors(spark, d).select("id", "v")
    n = v.count()
    ks = granularities(n)
    fits = M.fit_kmeans(v, [(k, 7) for k in ks])
    out = [(k, gain / n, gain / n - 0.004 * k) for k, (_, gain) in zip(ks, fits, strict=True)]
    return spark.createDataFrame(sorted(out, key=lambda x: -x[2]), "k bigint, cohesion double, score double")


@query("m3_euclidean_kmeans")
def m3(spark, d):
    return M.kmeans(vectors(spark, d), 10, cosine=False)


@query("m4_principal_directions")
def m4(spark, d):
    return M.principal(vectors(spark, d), 4)


@query("m5_vendi")
def m5(spark, d):
    return M.vendi(vectors(spark, d).select("id", "v", "cid"), "cid")


def styled(spark, d):
    """id, x (nine style features), y (the quality label)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array(*T.style_features(F.col("text"))).alias("x"))
    return docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id")


def scored(rows, model):
    """id and r, the probability that ``model`` gives to each row (id, x)."""

    def score(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(r=model(np.stack(pdf["x"].to_numpy())) if len(pdf) else [])

    return rows.select("id", "x").mapInPandas(score, "id bigint, r double")


@query("m6_logistic_regression")
def m6(spark, d):
    """The probability that a text is of the labelled class, by a discriminator fitted on a sample of both classes."""
    rows = styled(spark, d)
    some = M.sampled(rows, ["y"], M.DISCRIMINATOR_ROWS).orderBy("id").collect()
    return scored(rows, M.fit_logistic(np.array([r["x"] for r in some]), np.array([float(r["y"]) for r in some])))


@query("m7_realism")
def m7(spark, d):
    """Held-out AUC and MAUVE of the two classes, and the mean of r(q), refitted on all rows of the sample, over each whole class."""
    rows = styled(spark, d)
    auc, mauve, model = M.calibration(rows)
    means = scored(rows, model).join(rows.select("id", "y"), "id").agg(F.avg(F.when(F.col("y") == 1, F.col("r"))).alias("mean_real"), F.avg(F.when(F.col("y") == 0, F.col("r"))).alias("mean_other"))
    return means.select(F.lit(auc).alias("auc"), F.lit(mauve).alias("mauve"), "mean_real", "mean_other")


@query("m8_mauve")
def m8_mauve(spark, d):
    """The frontier's area over the kernel's own clusters of the pooled style features."""
    some = M.sampled(styled(spark, d), ["y"], M.DISCRIMINATOR_ROWS).orderBy("id").collect()
    return spark.createDataFrame([(len(some), M.mauve(np.array([r["x"] for r in some]), np.array([float(r["y"]) for r in some])))], "n bigint, mauve double")


POINTS = "t AS (SELECT x / 25.0::DOUBLE AS t FROM range(1, 25) r(x))"


@query("m8_divergence_frontier", f"""WITH {VECTORS}, h AS (SELECT cid, (count(*) FILTER (id % 3 = 0))::DOUBLE / (SELECT count(*) FROM e WHERE id % 3 = 0) AS p, (count(*) FILTER (id % 3 > 0))::DOUBLE / (SELECT count(*) FROM e WHERE id % 3 > 0) AS q FROM e GROUP BY cid), {POINTS},
c AS (SELECT t, exp(-5 * sum(CASE WHEN q > 0 THEN q * ln(q / (t * p + (1 - t) * q)) ELSE 0 END)) AS x, exp(-5 * sum(CASE WHEN p > 0 THEN p * ln(p / (t * p + (1 - t) * q)) ELSE 0 END)) AS y FROM h, t GROUP BY t),
o AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS i FROM c), z AS (SELECT 0 AS i, 0.0::DOUBLE AS x, (SELECT y FROM o WHERE i = 1) AS y UNION ALL SELECT i, x, y FROM o UNION ALL SELECT 25, 1.0, (SELECT y FROM o WHERE i = 24))
SELECT round(greatest(0, least(1, sum((b.x - a.x) * (a.y + b.y) / 2))), 6) AS mauve FROM z a JOIN z b ON b.i = a.i + 1""")
def m8(spark, d):
    """Area under the divergence frontier of two populations over given clusters."""
    side = lambda c: F.count(F.when(c, 1)).cast("double")
    counts = vectors(spark, d).groupBy("cid").agg(side(F.col("id") % 3 == 0).alias("p"), side(F.col("id") % 3 > 0).alias("q")).orderBy("cid").collect()  # a row for each cluster
    p, q = np.array([r["p"] for r in counts]), np.array([r["q"] for r in counts])
    return spark.createDataFrame([(round(M.frontier(p / p.sum(), q / q.sum()), 6),)], "mauve double")


#: Seeds of the repeated splits.
SPLIT_SEEDS = list(range(100, 120))


def gram_counts(rows):
    """id, y, size and grams (g: a dense number, n) of rows (id, y, tokens), for grams that three rows or more have."""
    each = rows.select("id", F.explode(T.grams(F.col("tokens"))).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))
    known = dense_index(each.groupBy("gram").agg(F.count("*").alias("df")).where("df >= 3"), "gram", name="g").select("gram", "g")
    lists = each.join(known, "gram").groupBy("id").agg(F.collect_list(F.struct("g", "n")).alias("grams"))
    none = F.array().cast("array<struct<g:bigint,n:bigint>>")
    return rows.select("id", "y", F.size("tokens").alias("size")).join(lists, "id", "left").select("id", "y", "size", F.coalesce("grams", none).alias("grams"))


@query("m9_repeated_discriminator")
def m9(spark, d):
    """AUC of twenty seeded splits for two featurisers: twelve other style features, and grams of the training fold's skeletons."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y")), "id")
    some = M.sampled(docs, ["y"], M.DISCRIMINATOR_ROWS)
    style = M.held_out_auc(some.select("id", "y", F.array(*T.style_features_2(F.col("text"))).alias("x")), SPLIT_SEEDS).withColumn("featuriser", F.lit("style"))
    grams = M.held_out_gram_auc(gram_counts(some.select("id", "y", T.skeleton(F.col("text")).alias("tokens"))), SPLIT_SEEDS).withColumn("featuriser", F.lit("grams"))
    return style.unionByName(grams).select("featuriser", "seed", "auc")


def responses(spark, d, takers: int = 60):
    """engine, item, taker, succ, trials: line items by brand and supplier, success being a return."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("ok"))
    universe = lines.groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(takers).select("l_suppkey")
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(F.broadcast(universe), "l_suppkey").join(brands, "l_partkey").groupBy(F.col("l_linestatus").alias("engine"), F.col("p_brand").alias("item"), F.col("l_suppkey").alias("taker")).agg(F.sum("ok").alias("succ"), F.count("*").alias("trials"))


@query("m10_item_response")
def m10(spark, d):
    return M.irt(responses(spark, d), "engine")


#: Bootstrap replicates, disjoint halvings and steps of a replicate's fit.
REPLICATES, HALVINGS, REPLICATE_STEPS = 200, 50, 1500


def top_quarter(a: np.ndarray) -> set[int]:
    return set(np.flatnonzero(a >= np.quantile(a, 0.75)).tolist())


def overlap(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a | b))


def ranks(x: np.ndarray) -> np.ndarray:
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def rho(x: np.ndarray, y: np.ndarray) -> float:
    a, b = ranks(x) - ranks(x).mean(), ranks(y) - ranks(y).mean()
    spread = math.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / spread) if spread else 0.0


@query("m11_irt_stability")
def m11(spark, d):
    """How far items' parameters hold over two rounds, over bootstraps of the takers and over disjoint halves of them.

    Rank agreement with the whole fit, its interval, overlap of the top quarters, the median item's interquartile range
    over its median, the top quarter's mean over the bottom quarter's, and the agreement of two halves.
    """
    cells = responses(spark, d).groupBy("item", "taker").agg(F.sum("succ").alias("succ"), F.sum("trials").alias("trials"))
    asked = [("whole", 0, 0)] + [("boot", k, 0) for k in range(REPLICATES)] + [("half", k, s) for k in range(HALVINGS) for s in (0, 1)]
    plan = spark.createDataFrame(asked, "kind string, rep bigint, side bigint").repartition(spark.sparkContext.defaultParallelism, "kind", "rep", "side")
    fits = M.irt_replicates(cells, plan, REPLICATE_STEPS).toPandas().sort_values(["kind", "rep", "side", "item"])  # items x replicates
    by = {key: (g["a"].to_numpy(), g["b"].to_numpy()) for key, g in fits.groupby(["kind", "rep", "side"])}
    a, b = by["whole", 0, 0]
    boots = [by["boot", k, 0] for k in range(REPLICATES)]
    ra, rb = np.array([rho(x, a) for x, _ in boots]), np.array([rho(y, b) for _, y in boots])
    items = np.array([x for x, _ in boots]).T
    middle = np.quantile(items, 0.5, axis=1)
    iqr = (np.quantile(items, 0.75, axis=1) - np.quantile(items, 0.25, axis=1)) / np.where(middle == 0, 1, middle)
    q = max(1, len(a) // 4)
    ordered = np.sort(items, axis=0)
    spread = ordered[-q:].mean(axis=0) / np.maximum(ordered[:q].mean(axis=0), 1e-9)
    halves = [(by["half", k, 0], by["half", k, 1]) for k in range(HALVINGS)]
    rounds = M.irt(responses(spark, d), "engine").toPandas().pivot(index="item", columns="engine", values=["a", "b"]).dropna()  # items x two rounds
    (a1, a2), (b1, b2) = ([rounds[c][k].to_numpy() for k in sorted(rounds[c].columns)][:2] for c in ("a", "b"))
    out = {
        "retest_rho_a": rho(a1, a2), "retest_rho_b": rho(b1, b2), "retest_top_quarter_jaccard": overlap(top_quarter(a1), top_quarter(a2)),
        "boot_rho_a": ra.mean(), "boot_rho_a_lo": np.quantile(ra, 0.025), "boot_rho_a_hi": np.quantile(ra, 0.975), "boot_rho_b": rb.mean(), "boot_rho_b_lo": np.quantile(rb, 0.025), "boot_rho_b_hi": np.quantile(rb, 0.975),
        "top_quarter_jaccard": np.mean([overlap(top_quarter(x), top_quarter(a)) for x, _ in boots]), "median_iqr_ratio": np.quantile(iqr, 0.5),
        "spread": spread.mean(), "spread_lo": np.quantile(spread, 0.025), "spread_hi": np.quantile(spread, 0.975),
        "half_rho_a": np.mean([rho(x[0], y[0]) for x, y in halves]), "half_rho_b": np.mean([rho(x[1], y[1]) for x, y in halves]),
    }
    return spark.createDataFrame([(k, float(v)) for k, v in out.items()], "figure string, value double")


#: Sizes and seeds of the independent clusterings, prefixes that are scored, and random orders that each is held against.
COVER_KS, COVER_SEEDS, COVER_STEPS, COVER_ORDERS = (12, 24, 40), (1, 2, 3), (10, 15, 20, 25), 10


@query("m12_independent_coverage")
def m12(spark, d):
    """Coverage of a bank's first n items, greedy order and the mean of random ones, in clusterings by two other encoders.

    The encoders are halves of the vectors, which the selection (on whole vectors) has not seen as such.
    """
    from quillbank.operators import select as Q

    v = vectors(spark, d)
    most = max(COVER_STEPS)
    greedy = Q.facility(v.select("id", "v", F.lit(0.0).alias("r")), K.centroids(v), most, 0.0).select("id", F.lit(-1).alias("order"), F.col("place").cast("int").alias("place"))
    drawn = v.select("id", F.explode(F.sequence(F.lit(0), F.lit(COVER_ORDERS - 1))).alias("order")).withColumn("u", F.xxhash64("id", "order"))
    some = drawn.withColumn("place", F.row_number().over(Window.partitionBy("order").orderBy("u", "id"))).where(F.col("place") <= most).select("id", "order", "place")
    bank = greedy.unionByName(some)
    out = []
    for encoder, (lo, n) in enumerate(((1, 32), (33, 32))):
        e = v.select("id", F.slice("v", lo, n).alias("v"))
        asked = [(k, 1000 * seed + k) for k in COVER_KS for seed in COVER_SEEDS]
        for (k, seed), (centroids, _) in zip(asked, M.fit_kmeans(e, asked, restarts=2), strict=True):
            out.append(M.assigned(e, centroids).select("id", "cid", F.lit(encoder).alias("encoder"), F.lit(k).alias("k"), F.lit(seed).alias("seed")))
    told = reduce(lambda a, b: a.unionByName(b), out)
    weight = told.groupBy("encoder", "k", "seed", "cid").agg(F.log1p(F.count("*")).alias("w"))
    total = weight.groupBy("encoder", "k", "seed").agg(F.sum("w").alias("total"))
    steps = F.explode(F.filter(F.array(*[F.lit(n) for n in COVER_STEPS]), lambda n: n >= F.col("place"))).alias("n")
    hit = told.join(F.broadcast(bank), "id").select("encoder", "k", "seed", "cid", "order", steps).distinct()  # most places in each of a few orders
    covered = hit.join(weight, ["encoder", "k", "seed", "cid"]).groupBy("encoder", "k", "seed", "order", "n").agg(F.sum("w").alias("w")).join(total, ["encoder", "k", "seed"]).withColumn("c", F.col("w") / F.col("total"))
    mean = lambda cond: F.avg(F.when(cond, F.col("c")))
    return covered.groupBy("encoder", "k", "n").agg(mean(F.col("order") < 0).alias("greedy"), mean(F.col("order") >= 0).alias("random")).select(*[F.col(c).cast("bigint").alias(c) for c in ("encoder", "k", "n")], "greedy", "random")


@query("m14_rater_sensitivity", "WITH a AS (SELECT doc_id, quality AS x, 1 - toxic AS y FROM labels), p AS (SELECT avg((x = y)::INT) AS po, avg(x) AS a, avg(y) AS b FROM a) SELECT round(po, 6) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa, (SELECT round(count(*) FILTER (x = 1 AND y = 1)::DOUBLE / count(*) FILTER (x = 1 OR y = 1), 6) FROM a) AS overlap FROM p")
def m14(spark, d):
    """How far two models' keep decisions agree, and the overlap of what they keep."""
    rows = table(spark, d, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y"))
    both, any_ = F.count(F.when((F.col("x") == 1) & (F.col("y") == 1), 1)), F.count(F.when((F.col("x") == 1) | (F.col("y") == 1), 1))
    return S.cohen_kappa(rows, "x", "y").crossJoin(rows.agg(F.round(both / any_, 6).alias("overlap")))
