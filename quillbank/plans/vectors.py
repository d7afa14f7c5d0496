"""Vector queries: similarity, nearest clusters, coverage, cohesion, scalar functions. Vectors are the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.operators import nearest as K
from quillbank.plans.registry import query, table

VECTORS = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS cid FROM embeddings)"
DOT = lambda a, b: f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"
CENTROIDS = VECTORS + """, m0 AS (SELECT cid, i, avg(x) AS m FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e) GROUP BY cid, i),
m1 AS (SELECT cid, list(m ORDER BY i) AS c, sqrt(sum(m * m)) AS n FROM m0 GROUP BY cid), k AS (SELECT cid, list_transform(c, lambda x: x / n) AS centroid, ln(1 + members) AS weight, members FROM m1 JOIN (SELECT cid, count(*) AS members FROM e GROUP BY cid) USING (cid))"""
NEAREST = CENTROIDS + """, s AS (SELECT id, e.cid AS own, k.cid, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * centroid[i])) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 12) AS sim FROM e, k),
a AS (SELECT id, own, cid, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cid) AS p FROM s) WHERE p = 1)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), N.as_doubles(F.col("embedding")).alias("v"), F.col("label").cast("bigint").alias("cid"))


@query("v1_vector_math", f"""WITH {VECTORS} SELECT a.id, round({DOT('a.v', 'b.v')}, 6) AS dot, round(sqrt({DOT('a.v', 'a.v')}), 6) AS norm, round({DOT('a.v', 'b.v')} / sqrt({DOT('a.v', 'a.v')} * {DOT('b.v', 'b.v')}), 6) AS cosine, round(a.v[1] + 2 * b.v[1], 6) AS added
FROM e a JOIN e b ON b.id = a.id + 1""")
def v1(spark, d):
    a = vectors(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    v, w = F.col("v"), F.col("w")
    return a.join(b, "id").select("id", F.round(N.dot(v, w), 6).alias("dot"), F.round(N.norm(v), 6).alias("norm"), F.round(N.cosine(v, w), 6).alias("cosine"), F.round(F.get(N.add(v, N.scale(w, 2.0)), F.lit(0)), 6).alias("added"))


@query("v2_mean_std", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY event_type")
def v2(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query("v3_logistic", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS sigmoid, round(CASE WHEN c_acctbal / 100 > 20 THEN c_acctbal / 100 ELSE ln(1 + exp(c_acctbal / 100)) END, 6) AS softplus FROM customer")
def v3(spark, d):
    z = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.round(N.sigmoid(z / 1000), 6).alias("sigmoid"), F.round(N.softplus(z / 100), 6).alias("softplus"))


@query("v4_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY event_type")
def v4(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(*[F.round(F.percentile("value", p), 6).alias(f"q{int(100 * p)}") for p in (0.25, 0.5, 0.9)])


@query("v5_cluster_similarity", f"WITH {CENTROIDS} SELECT a.cid AS a, b.cid AS b, round(greatest(0, {DOT('a.centroid', 'b.centroid')}), 6) AS sim FROM k a, k b")
def v5(spark, d):
    k = K.centroids(vectors(spark, d)).select("cid", "centroid")
    other = K.checked(k).select(F.col("cid").alias("b"), F.col("centroid").alias("c2"))  # clusters against clusters
    return k.crossJoin(other).select(F.col("cid").alias("a"), "b", F.round(F.greatest(F.lit(0.0), N.dot(F.col("centroid"), F.col("c2"))), 6).alias("sim"))


@query("v6_counter_rng", """WITH n AS (SELECT p_partkey AS i, (20260706 + p_partkey * 1831565813) & 4294967295 AS s FROM part), a AS (SELECT i, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM n),
m AS (SELECT i, xor((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)::BIGINT) & 4294967295, t) AS m FROM a) SELECT i, round(xor(m, m >> 14) / 4294967296.0, 9) AS u FROM m""")
def v6(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.round(N.uniform(F.lit(20260706), F.col("p_partkey")), 9).alias("u"))


@query("v8_fnv_hash", "SELECT p_name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: unicode(p_name[i])::BIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS h FROM part GROUP BY p_name")
def v8(spark, d):
    return table(spark, d, "part").select("p_name").distinct().select("p_name", N.fnv1a(F.col("p_name")).alias("h"))


@query("v9_zipf_volume", """WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank FROM part)
SELECT p_partkey, greatest(30, round(60000 / pow(rank + 1, 0.75) * CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE 0.05 + 0.35 * ((p_partkey * 37 % 101) / 101.0) END * exp(((p_partkey * 61 % 103) / 103.0 - 0.5) * 0.8)))::BIGINT AS volume FROM r""")
def v9(spark, d):
    from quillbank.session import dense_index

    ranked = dense_index(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.desc("p_retailprice"), "p_partkey", name="rank")
    key = F.col("p_partkey")
    return ranked.select("p_partkey", N.zipf_volume(F.col("rank"), key % 5 == 0, (key * 37 % 101) / 101.0, (key * 61 % 103) / 103.0).alias("volume"))


INFO = "a * a * (1 / (1 + exp(-a * (t - b)))) * (1 - 1 / (1 + exp(-a * (t - b))))"


@query("v10_test_information", f"WITH i AS (SELECT 0.3 + p_size / 25.0 AS a, (p_retailprice % 600) / 100 - 3 AS b FROM part), g AS (SELECT -3 + 0.25 * x AS t FROM range(0, 25) r(x)) SELECT round(t, 2) AS theta, round(sum({INFO}), 4) AS information FROM i, g GROUP BY t")
def v10(spark, d):
    items = table(spark, d, "part").select((0.3 + F.col("p_size") / 25.0).alias("a"), (F.col("p_retailprice") % 600 / 100 - 3).alias("b"))
    each = items.withColumn("theta", F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda x: -3 + 0.25 * x)))
    return each.groupBy(F.round("theta", 2).alias("theta")).agg(F.round(F.sum(N.item_information(F.col("a"), F.col("b"), F.col("theta"))), 4).alias("information"))


@query("j6_nearest_cluster", f"WITH {NEAREST} SELECT id, cid, round(sim, 6) AS sim FROM a")
def j6(spark, d):
    v = vectors(spark, d)
    return K.nearest(v.select("id", "v"), K.centroids(v)).withColumn("sim", F.round("sim", 6))


@query("j11_nearest_wrong_cluster", f"WITH {NEAREST}, w AS (SELECT id, cid, sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cid) AS p FROM s WHERE cid <> own) WHERE p = 1) SELECT id, cid, round(sim, 6) AS sim FROM w")
def j11(spark, d):
    v = vectors(spark, d)
    return K.nearest(v.select("id", "v", F.col("cid").alias("own")), K.centroids(v), exclude="own").withColumn("sim", F.round("sim", 6))


@query("m13_drift_power", f"WITH {NEAREST} SELECT round(avg(CASE WHEN sim < 0.3 THEN 1.0 ELSE 0 END) FILTER (cid = own), 6) AS own_rejected, round(avg(CASE WHEN sim < 0.3 THEN 1.0 ELSE 0 END) FILTER (cid <> own), 6) AS wrong_rejected FROM s")
def m13(spark, d):
    """Share of vectors that a similarity threshold rejects at their own cluster and at any other."""
    v = vectors(spark, d)
    k = K.checked(K.centroids(v).select(F.col("cid").alias("other"), "centroid"))
    sims = v.crossJoin(k).select((F.col("cid") == F.col("other")).alias("own"), F.round(N.cosine(F.col("v"), F.col("centroid")), 12).alias("sim"))
    share = lambda own: F.round(F.avg(F.when(F.col("own") == own, F.when(F.col("sim") < 0.3, 1.0).otherwise(0.0))), 6)
    return sims.agg(share(True).alias("own_rejected"), share(False).alias("wrong_rejected"))


@query("j2_own_similarity", f"WITH {CENTROIDS} SELECT id, e.cid, round({DOT('v', 'centroid')}, 6) AS sim FROM e JOIN k USING (cid)")
def j2(spark, d):
    v = vectors(spark, d)
    return v.join(K.checked(K.centroids(v)), "cid").select("id", "cid", F.round(N.dot(F.col("v"), F.col("centroid")), 6).alias("sim"))


@query("j1_item_assembly", f"WITH {CENTROIDS} SELECT e.id, e.cid, round(weight, 6) AS weight, p_name AS q FROM e JOIN k USING (cid) JOIN part ON p_partkey = e.id")
def j1(spark, d):
    v = vectors(spark, d)
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("q"))
    return v.join(K.centroids(v), "cid").join(parts, "id").select("id", "cid", F.round("weight", 6).alias("weight"), "q")


@query("a5_cluster_weight", f"WITH {CENTROIDS} SELECT cid, members, round(weight, 6) AS weight FROM k")
def a5(spark, d):
    return K.centroids(vectors(spark, d)).select("cid", "members", F.round("weight", 6).alias("weight"))


@query("a20_cohesion", f"WITH {CENTROIDS} SELECT cid, round(avg({DOT('v', 'centroid')}), 6) AS cohesion FROM e JOIN k USING (cid) GROUP BY cid")
def a20(spark, d):
    v = vectors(spark, d)
    return v.join(K.checked(K.centroids(v)), "cid").groupBy("cid").agg(F.round(F.avg(N.dot(F.col("v"), F.col("centroid"))), 6).alias("cohesion"))


@query("a10_histogram", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), f AS (SELECT 'from_zero' AS form, 16 AS bins, 0.0::DOUBLE AS a, hi AS b FROM s UNION ALL SELECT 'from_least', 30, lo, hi FROM s),
c AS (SELECT form, least(bins - 1, floor((value - a) / (b - a) * bins))::BIGINT AS bin, count(*) AS n FROM events, f GROUP BY 1, 2)
SELECT f.form, g.bin::BIGINT AS bin, round(a + (g.bin + 0.5) * (b - a) / bins, 6) AS mid, coalesce(n, 0) AS n FROM f JOIN range(0, 30) g(bin) ON g.bin < bins LEFT JOIN c ON c.form = f.form AND c.bin = g.bin""")
def a10(spark, d):
    """Equal-width bins, the last one closed, with their middles: 16 on [0, max] and 30 on [min, max]."""
    events = table(spark, d, "events")
    ends = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    form = lambda name, bins, a: F.struct(F.lit(name).alias("form"), F.lit(bins).alias("bins"), a.alias("a"), F.col("hi").alias("b"))
    forms = ends.select(F.explode(F.array(form("from_zero", 16, F.lit(0.0)), form("from_least", 30, F.col("lo")))).alias("f")).select("f.*")
    at = F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")) * F.col("bins"))).cast("bigint")
    counts = events.select("value").crossJoin(F.broadcast(forms)).groupBy("form", at.alias("bin")).agg(F.count("*").alias("n"))  # two rows
    spine = forms.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("i")).withColumn("bin", F.col("i").cast("bigint"))
    return spine.join(counts, ["form", "bin"], "left").select("form", "bin", F.round(F.col("a") + (F.col("bin") + 0.5) * (F.col("b") - F.col("a")) / F.col("bins"), 6).alias("mid"), F.coalesce("n", F.lit(0)).alias("n"))
