"""Selection queries: facility location, relevance against redundancy, k-center, sweeps. Items are the embeddings."""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.functions import text as T
from quillbank.operators import kernels as M
from quillbank.operators import nearest as K
from quillbank.operators import select as Q
from quillbank.operators import statistics as S
from quillbank.plans.probes import CORRELATION, ranked_sql
from quillbank.plans.registry import query, table
from quillbank.plans.text import LIST, TEMPLATES
from quillbank.plans.vectors import CENTROIDS, DOT, NEAREST, vectors
from quillbank.session import dense_index

BUDGET = 10
ITEMS = CENTROIDS + f""", items AS MATERIALIZED (SELECT id, any_value(v) AS v, any_value(0.01 * (id % 13))::DOUBLE AS r, list({DOT('v', 'centroid')} ORDER BY k.cid) AS sims FROM e, k GROUP BY id), w AS MATERIALIZED (SELECT list(weight ORDER BY cid) AS w FROM k)"""


def items(spark, d):
    v = vectors(spark, d)
    return v.select("id", "v", (0.01 * (F.col("id") % 13)).cast("double").alias("r")), K.centroids(v)


def greedy_sql(lam: float, budget: int = BUDGET, where: str = "true") -> str:
    """The greedy order among the items for which ``where`` holds."""
    gain = f"round(list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * greatest(0, greatest(0, sims[i]) - best[i]))) + {lam} * r, 9)"
    return f"""WITH RECURSIVE {ITEMS}, g AS (SELECT 0::BIGINT AS place, (SELECT list_transform(w, lambda x: 0.0::DOUBLE) FROM w) AS best, []::BIGINT[] AS sel, NULL::DOUBLE AS score
UNION ALL SELECT * FROM (SELECT place + 1, list_transform(range(1, len(w) + 1), lambda i: greatest(best[i], sims[i])), list_append(sel, id), {gain} AS s FROM g, items, w WHERE place < {budget} AND {where} AND NOT list_contains(sel, id) ORDER BY s DESC, id LIMIT 1))
SELECT place, sel[-1] AS id, round(score, 6) AS score FROM g WHERE place > 0"""


def drawn_sql(seed: int, ids: str = "SELECT vec_id AS i FROM embeddings") -> str:
    """i, u: the counter generator's number for each id of ``ids``."""
    return f"""(SELECT i, xor(m, m >> 14) / 4294967296.0 AS u FROM (SELECT i, xor((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)::BIGINT) & 4294967295, t) AS m FROM
(SELECT i, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM (SELECT i, ({seed} + i * 1831565813) & 4294967295 AS s FROM ({ids})))))"""


#: The seed of the holdout, and the share that is held out.
HOLDOUT_SEED, HOLDOUT = 20260707, 0.2
HELD_SQL = f"(SELECT i AS id FROM (SELECT i, row_number() OVER (ORDER BY u, i) - 1 AS p, count(*) OVER () AS n FROM {drawn_sql(HOLDOUT_SEED)}) WHERE p < floor({HOLDOUT} * n))"


def holdout(v):
    """id and whether it is held out: a fifth of the ids, by a seeded draw for each id."""
    placed = dense_index(v.select("id", N.uniform(F.lit(HOLDOUT_SEED), F.col("id")).alias("u")), "u", "id", name="p")
    return placed.select("id", (F.col("p") < math.floor(HOLDOUT * placed.count())).alias("held"))


def fanout_sql(name: str, offset: int = 0) -> str:
    """CTEs f_ and ``name`` (id, best, keep): a candidate's sub-queries are the next id % 7 vectors, from ``offset`` on."""
    return f"""{name}_f AS (SELECT id, own, unnest(range(1, id % 7 + 1)) + id + {offset} AS sub FROM (SELECT DISTINCT id, own FROM s)), {name}_b AS (SELECT f.id, max(t.sim) AS best FROM {name}_f f JOIN s t ON t.id = f.sub AND t.cid = f.own GROUP BY f.id),
{name} AS (SELECT i.id, coalesce(best, -1) AS best, coalesce(best, -1) >= 0.3 AS keep FROM (SELECT DISTINCT id FROM s) i LEFT JOIN {name}_b b USING (id))"""


def fanout(v, offset: int = 0):
    """id, best and keep: the best similarity of a candidate's sub-queries (none to six) to its own cluster; without any -1."""
    k = K.checked(K.centroids(v).select("cid", "centroid"))
    number = F.when(F.col("id") % 7 > 0, F.sequence(F.lit(1).cast("bigint"), F.col("id") % 7)).otherwise(F.array().cast("array<bigint>"))
    subs = v.select("id", "cid", F.explode(number).alias("j")).select("id", "cid", (F.col("id") + F.col("j") + offset).alias("sub"))
    near = subs.join(v.select(F.col("id").alias("sub"), F.col("v").alias("w")), "sub").join(k, "cid")
    best = near.groupBy("id").agg(F.max(F.round(N.cosine(F.col("w"), F.col("centroid")), 12)).alias("best"))
    return v.select("id").join(best, "id", "left").select("id", F.coalesce("best", F.lit(-1.0)).alias("best"), (F.coalesce("best", F.lit(-1.0)) >= 0.3).alias("keep"))


def bank(spark, d, budget: int = BUDGET):
    """place and id of the greedy bank."""
    pool, clusters = items(spark, d)
    return Q.facility(pool, clusters, budget).select("place", "id")


@query("a6_coverage", f"WITH {NEAREST}, c AS (SELECT DISTINCT cid FROM a JOIN ({greedy_sql(0.35)}) USING (id)) SELECT round(sum(weight) FILTER (cid IN (SELECT cid FROM c)) / sum(weight), 6) AS coverage FROM k")
def a6(spark, d, picks=None):
    """Weighted coverage of the clusters by the greedy bank (or by the ids of ``picks``)."""
    v = vectors(spark, d)
    k = K.centroids(v)
    chosen = v.select("id", "v").join(F.broadcast((bank(spark, d) if picks is None else picks).select("id")), "id")
    return K.coverage(K.nearest(chosen, k), k).select(F.round("coverage", 6).alias("coverage"))


@query("a7_intent_recall", f"WITH {NEAREST}, c AS (SELECT DISTINCT cid FROM a JOIN ({greedy_sql(0.35)}) USING (id)) SELECT round(sum(1 + id % 7) FILTER (cid IN (SELECT cid FROM c)) / sum(1 + id % 7), 6) AS recall FROM a WHERE id IN {HELD_SQL}")
def a7(spark, d, picks=None):
    """Share of the held-out keywords' volume whose nearest cluster the greedy bank (or ``picks``) covers."""
    v = vectors(spark, d)
    told = K.nearest(v.select("id", "v"), K.centroids(v))
    covered = told.join(F.broadcast((bank(spark, d) if picks is None else picks).select("id")), "id").select("cid").distinct().withColumn("hit", F.lit(1))
    held = told.join(holdout(v).where("held"), "id").withColumn("w", 1 + F.col("id") % 7).join(covered, "cid", "left")
    return held.agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("recall"))


@query("w13_objective", f"""WITH {CENTROIDS}, c AS (SELECT id, v, 0.01 * (id % 13) AS r FROM e JOIN ({greedy_sql(0.35)}) USING (id)), m AS (SELECT k.cid, any_value(weight) AS w, max(greatest(0, {DOT('v', 'centroid')})) AS best FROM k, c GROUP BY k.cid)
SELECT round((SELECT sum(w * best) FROM m) + 0.35 * (SELECT sum(r) FROM c), 6) AS objective""")
def w13(spark, d):
    """Facility-location value of the greedy bank: best similarity of each cluster, weighted, and the members' own scores."""
    v = vectors(spark, d)
    chosen = v.join(F.broadcast(bank(spark, d).select("id")), "id").select("id", "v", (0.01 * (F.col("id") % 13)).alias("r"))
    pairs = chosen.crossJoin(K.checked(K.centroids(v)))  # a bank of stated size against the clusters
    best = pairs.groupBy("cid", "weight").agg(F.max(F.greatest(F.lit(0.0), N.dot(F.col("v"), F.col("centroid")))).alias("best"))
    return best.agg(F.sum(F.col("weight") * F.col("best")).alias("f")).crossJoin(chosen.agg(F.sum("r").alias("r"))).select(F.round(F.col("f") + 0.35 * F.col("r"), 6).alias("objective"))


@query("w8_facility_location", greedy_sql(0.35))
def w8(spark, d):
    pool, clusters = items(spark, d)
    return Q.facility(pool, clusters, BUDGET).withColumn("score", F.round("score", 6))


NEAR = "list_max(list_transform(chosen, lambda c: list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * c[i]))))"


def chain_sql(first: str, later: str) -> str:
    return f"""WITH RECURSIVE {ITEMS}, g AS (SELECT 0::BIGINT AS place, []::DOUBLE[][] AS chosen, []::BIGINT[] AS sel, NULL::DOUBLE AS score
UNION ALL SELECT * FROM (SELECT place + 1, list_append(chosen, v), list_append(sel, id), round(CASE WHEN place = 0 THEN {first} ELSE {later} END, 9) AS s FROM g, items WHERE place < {BUDGET} AND NOT list_contains(sel, id) ORDER BY s DESC, id LIMIT 1))
SELECT place, sel[-1] AS id, round(score, 6) AS score FROM g WHERE place > 0"""


@query("w10_marginal_relevance", chain_sql("0.5 * list_max(sims)", f"0.5 * list_max(sims) - 0.5 * greatest(0, {NEAR})"))
def w10(spark, d):
    pool, clusters = items(spark, d)
    return Q.mmr(pool, clusters, BUDGET).withColumn("score", F.round("score", 6))


@query("w11_k_center", chain_sql("2 + list_max(sims)", f"-{NEAR}"))
def w11(spark, d):
    pool, clusters = items(spark, d)
    return Q.k_center(pool, clusters, BUDGET).withColumn("score", F.round("score", 6))


@query("w9_random_order", """WITH n AS (SELECT vec_id AS i, (20260706 + vec_id * 1831565813) & 4294967295 AS s FROM embeddings), a AS (SELECT i, ((xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT) % 4294967296)::BIGINT AS t FROM n),
m AS (SELECT i, xor((t + ((xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT) % 4294967296)::BIGINT) & 4294967295, t) AS m FROM a) SELECT i AS id, round(xor(m, m >> 14) / 4294967296.0, 9) AS u FROM m ORDER BY xor(m, m >> 14), i LIMIT 10""")
def w9(spark, d):
    return Q.random_order(items(spark, d)[0], BUDGET, 20260706).withColumn("u", F.round("u", 9))


@query("w12_cluster_representatives", f"WITH {CENTROIDS}, s AS (SELECT id, e.cid, round({DOT('v', 'centroid')}, 9) AS sim, id % 13 AS r FROM e JOIN k USING (cid)) SELECT cid, (SELECT id FROM s x WHERE x.cid = s.cid ORDER BY sim DESC, id LIMIT 1) AS medoid, (SELECT id FROM s x WHERE x.cid = s.cid ORDER BY r DESC, id LIMIT 1) AS most_realistic FROM s GROUP BY cid")
def w12(spark, d):
    """Of each cluster the member nearest to the centroid and the one of highest score."""
    v = vectors(spark, d)
    told = v.join(K.checked(K.centroids(v)), "cid").select("cid", "id", F.round(N.dot(F.col("v"), F.col("centroid")), 9).alias("sim"), (F.col("id") % 13).alias("r"))
    best = lambda c: F.max(F.struct(F.col(c), (-F.col("id")).alias("n")))
    return told.groupBy("cid").agg((-best("sim")["n"]).alias("medoid"), (-best("r")["n"]).alias("most_realistic"))


@query("w12_kmeans_representatives")
def w12_kmeans(spark, d):
    """As many clusters as the bank is large, and of each the member nearest to its centre and the one of highest score."""
    v = vectors(spark, d)
    centres = M.fit_kmeans(v.select("id", "v"), [(BUDGET, 7)], restarts=2)[0][0]
    held = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cid bigint, centroid array<double>")
    told = M.assigned(v.select("id", "v"), centres).join(v.select("id", "v"), "id").join(K.checked(held), "cid").select("cid", "id", F.round(N.cosine(F.col("v"), F.col("centroid")), 9).alias("sim"), (F.col("id") % 13).alias("r"))
    best = lambda c: F.max(F.struct(F.col(c), (-F.col("id")).alias("n")))
    return told.groupBy("cid").agg((-best("sim")["n"]).alias("medoid"), (-best("r")["n"]).alias("most_realistic"))


LAMBDAS = [0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 2.0]


@query("w14_lambda_sweep", f"""WITH {NEAREST}, p AS ({" UNION ALL ".join(f"SELECT {lam}::DOUBLE AS lam, place, id FROM ({greedy_sql(lam, 5)})" for lam in LAMBDAS)}),
c AS (SELECT lam, sum(weight) AS w FROM (SELECT DISTINCT lam, cid FROM p JOIN a USING (id)) JOIN k USING (cid) GROUP BY lam), h AS (SELECT id, cid, 1 + id % 7 AS w FROM a WHERE id IN {HELD_SQL}),
t AS (SELECT lam, sum(h.w) AS w FROM (SELECT DISTINCT lam, cid FROM p JOIN a USING (id)) JOIN h USING (cid) GROUP BY lam)
SELECT lam, string_agg(id, ',' ORDER BY place) AS ids, round(any_value(c.w) / (SELECT sum(weight) FROM k), 6) AS coverage, round(coalesce(any_value(t.w), 0) / (SELECT sum(w) FROM h), 6) AS recall, round(avg(0.01 * (id % 13)), 6) AS mean_r FROM p JOIN c USING (lam) LEFT JOIN t USING (lam) GROUP BY lam""")
def w14(spark, d):
    """A bank for each lambda, measured again: coverage, recall of the holdout and mean score."""
    v = vectors(spark, d)
    pool, clusters = items(spark, d)
    pool, model = pool.persist(), Q.model_of(clusters)
    picked = [(lam, k + 1, i) for lam in LAMBDAS for k, (i, _) in enumerate(Q.select(pool, Q.Facility(*model, lam), 5))]
    pool.unpersist()
    picks = F.broadcast(spark.createDataFrame(picked, "lam double, place bigint, id bigint"))
    told = K.nearest(v.select("id", "v"), clusters)
    hit = told.join(picks, "id").select("lam", "cid").distinct()
    total = clusters.agg(F.sum("weight").alias("total"))
    cover = hit.join(clusters.select("cid", "weight"), "cid").groupBy("lam").agg(F.sum("weight").alias("w")).crossJoin(F.broadcast(total)).select("lam", F.round(F.col("w") / F.col("total"), 6).alias("coverage"))
    held = told.join(holdout(v).where("held"), "id").groupBy("cid").agg(F.sum(1 + F.col("id") % 7).alias("w"))
    recalled = hit.join(held, "cid").groupBy("lam").agg(F.sum("w").alias("w")).crossJoin(F.broadcast(held.agg(F.sum("w").alias("all"))))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"].cast("string")), ",")
    banks = picks.groupBy("lam").agg(ids.alias("ids"), F.round(F.avg(0.01 * (F.col("id") % 13)), 6).alias("mean_r"))
    return banks.join(cover, "lam").join(recalled, "lam", "left").select("lam", "ids", "coverage", F.round(F.coalesce("w", F.lit(0)) / F.coalesce("all", F.lit(1)), 6).alias("recall"), "mean_r")


#: Granularities (None: a cluster for each keyword), and pairs of granularity and lambda.
GRAINS = [18, 30, 40, 60, None]
TRADES = [(18, 0.0), (18, 0.35), (40, 0.0), (40, 0.35), (40, 1.0), (None, 0.0), (None, 0.35), (None, 1.0)]


@query("w15_granularity_grid")
def w15(spark, d):
    """Banks re-selected over clusterings of several sizes and for pairs of size and lambda, weights scaled to one total; coverage of the given clusters."""
    v = vectors(spark, d)
    own = K.centroids(v)
    total = own.agg(F.sum("weight")).first()[0]
    ks = sorted({m for m, _ in TRADES if m} | {m for m in GRAINS if m})
    fits = dict(zip(ks, M.fit_kmeans(v.select("id", "v"), [(k, 7) for k in ks], restarts=3), strict=True))
    models = {}
    for k, (centres, _) in fits.items():
        size = {r["cid"]: r["n"] for r in M.assigned(v.select("id", "v"), centres).groupBy("cid").agg(F.count("*").alias("n")).collect()}
        weight = np.array([np.log1p(size.get(c, 0)) for c in range(k)])
        models[k] = centres, weight * total / weight.sum()
    pool = v.select("id", "v", (0.01 * (F.col("id") % 13)).cast("double").alias("r")).persist()
    n = pool.count()
    runs = [("grain", m, 0.35) for m in GRAINS] + [("trade", m, lam) for m, lam in TRADES]
    banks = {(m, lam): Q.select(pool, Q.Facility(*models[m], lam), 5) for m, lam in dict.fromkeys((m, lam) for _, m, lam in runs if m)}
    banks |= {(None, lam): bank for lam, bank in Q.select_each(pool, total, sorted({lam for _, m, lam in runs if m is None}), 5).items()}
    picked = [(kind, m or n, lam, k + 1, i, round(s, 6)) for kind, m, lam in runs for k, (i, s) in enumerate(banks[m, lam])]
    pool.unpersist()
    picks = spark.createDataFrame(picked, "grid string, clusters bigint, lam double, place bigint, id bigint, score double")
    told = K.nearest(v.select("id", "v").join(F.broadcast(picks.select("id").distinct()), "id"), own)
    hit = picks.join(told, "id").select("grid", "clusters", "lam", "cid").distinct().join(own.select("cid", "weight"), "cid")
    cover = hit.groupBy("grid", "clusters", "lam").agg(F.round(F.sum("weight") / total, 6).alias("coverage"))
    return picks.join(cover, ["grid", "clusters", "lam"])


KEPT_IDS = f"id IN (WITH {NEAREST}, {fanout_sql('kept')} SELECT id FROM kept WHERE keep)"
_INFORMATION = "pow(0.3 + (id % 50) / 25.0, 2)"


@query("p13_ablations", f"""SELECT 'full' AS variant, place, id FROM ({greedy_sql(0.35, 5, KEPT_IDS)}) UNION ALL SELECT 'without_filter', place, id FROM ({greedy_sql(0.35, 5)}) UNION ALL SELECT 'without_realism', place, id FROM ({greedy_sql(0.0, 5, KEPT_IDS)})
UNION ALL SELECT 'random', row_number() OVER (ORDER BY u, id), id FROM (SELECT i AS id, u FROM {drawn_sql(77)} ORDER BY u, i) WHERE {KEPT_IDS} QUALIFY row_number() OVER (ORDER BY u, id) <= 5
UNION ALL SELECT 'distilled', row_number() OVER (ORDER BY {_INFORMATION} DESC, id), id FROM ({greedy_sql(0.35, 10, KEPT_IDS)}) QUALIFY row_number() OVER (ORDER BY {_INFORMATION} DESC, id) <= 5""")
def p13(spark, d):
    """The full method and without its filter, its realism term, its selection (random), and with a distilled larger pool."""
    pool, clusters = items(spark, d)
    kept = pool.join(fanout(vectors(spark, d)).where("keep").select("id"), "id")
    pick = lambda name, some, lam: Q.facility(some, clusters, 5, lam).select(F.lit(name).alias("variant"), "place", "id")
    placed = lambda name, some, *by: some.select(F.lit(name).alias("variant"), F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("place"), "id").where("place <= 5")  # noqa: E731  some rows
    drawn = placed("random", Q.random_order(kept, 5, 77), "u", "id")
    information = F.pow(0.3 + F.col("id") % 50 / 25.0, F.lit(2))
    distilled = placed("distilled", Q.facility(kept, clusters, 10).select("id"), information.desc(), "id")
    return pick("full", kept, 0.35).unionByName(pick("without_filter", pool, 0.35)).unionByName(pick("without_realism", kept, 0.0)).unionByName(drawn).unionByName(distilled)


@query("p8_pool_then_bank", f"SELECT place, id, place <= 5 AS in_bank FROM ({greedy_sql(0.35)})")
def p8(spark, d):
    """The probed pool is the first of the greedy order, the bank its first half."""
    pool, clusters = items(spark, d)
    return Q.facility(pool, clusters, BUDGET).select("place", "id", (F.col("place") <= BUDGET // 2).alias("in_bank"))


BASELINE = 20
_NAMES = "SELECT p_partkey AS i FROM part"
_TOP = f"(SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place, p_name FROM part QUALIFY place <= {BASELINE})"
_SAMPLE = lambda seed: f"(SELECT row_number() OVER (ORDER BY u, i) AS place, p_name FROM {drawn_sql(seed, _NAMES)} JOIN part ON p_partkey = i QUALIFY place <= {BASELINE})"


@query("p12_baselines", f"""SELECT 'keyword' AS method, place, p_name AS q FROM {_TOP} UNION ALL SELECT 'naive', place, 'Could you tell me about ' || p_name || '?' FROM {_SAMPLE(21)}
UNION ALL SELECT 'template', place, replace({LIST(TEMPLATES)}[1 + ((place - 1) % 6)::INT], '{{}}', p_name) FROM {_SAMPLE(22)} UNION ALL SELECT 'forward', place, 'I need ' || p_name || ', what should I know?' FROM {_SAMPLE(23)}
UNION ALL SELECT 'generic', x, 'What are common questions about topic ' || x || '?' FROM range(1, {BASELINE} + 1) r(x) UNION ALL SELECT 'unfiltered', row_number() OVER (ORDER BY vec_id), 'candidate ' || vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id) <= {BASELINE}""")
def p12(spark, d):
    """Six baselines of one size: keywords by volume, rewrites, templates and forward questions of seeded samples, generic questions, candidates unfiltered.

    What a model would answer is made in its answers' form, a quoted line or a JSON array, and read by the same functions.
    """
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    place = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("place")  # noqa: E731  BASELINE rows
    top = parts.orderBy(F.desc("p_retailprice"), "p_partkey").limit(BASELINE).select(place(F.desc("p_retailprice"), "p_partkey"), "p_name")
    sample = lambda seed: parts.withColumn("u", N.uniform(F.lit(seed), F.col("p_partkey"))).orderBy("u", "p_partkey").limit(BASELINE).select(place("u", "p_partkey"), "p_name")
    answer = lambda before, after: T.unquoted_first_line(F.concat(F.lit('"' + before), "p_name", F.lit(after + '"')))
    shape = F.element_at(F.array(*map(F.lit, TEMPLATES)), ((F.col("place") - 1) % 6 + 1).cast("int"))
    listed = json.dumps([f"What are common questions about topic {k}?" for k in range(1, BASELINE + 11)])
    generic = spark.createDataFrame([("```json\n" + listed + "\n```",)], "raw string").select(F.posexplode(T.string_list(F.col("raw"), 6, None, BASELINE)).alias("at", "q"))
    candidates = table(spark, d, "embeddings").orderBy("vec_id").limit(BASELINE).select(place("vec_id"), F.concat(F.lit("candidate "), "vec_id").alias("q"))
    named = [
        ("keyword", top.select("place", F.col("p_name").alias("q"))),
        ("naive", sample(21).select("place", answer("Could you tell me about ", "?").alias("q"))),
        ("template", sample(22).select("place", F.replace(shape, F.lit("{}"), F.col("p_name")).alias("q"))),
        ("forward", sample(23).select("place", answer("I need ", ", what should I know?").alias("q"))),
        ("generic", generic.select((F.col("at") + 1).cast("bigint").alias("place"), "q")),
        ("unfiltered", candidates),
    ]
    return reduce(lambda a, b: a.unionByName(b), [rows.where(F.length("q") > 6).select(F.lit(name).alias("method"), "place", "q") for name, rows in named])


CURVES = f"""SELECT 'greedy' AS method, place, id FROM ({greedy_sql(0.35)}) UNION ALL SELECT 'random', row_number() OVER (ORDER BY u, i), i FROM {drawn_sql(55)} QUALIFY row_number() OVER (ORDER BY u, i) <= {BUDGET}
UNION ALL SELECT 'keyword', row_number() OVER (ORDER BY vec_id % 7 DESC, vec_id), vec_id FROM embeddings QUALIFY row_number() OVER (ORDER BY vec_id % 7 DESC, vec_id) <= {BUDGET}"""


@query("p11_coverage_curve", f"""WITH {NEAREST}, p AS ({CURVES}), h AS (SELECT method, n, cid FROM p JOIN a USING (id), range(1, {BUDGET} + 1) r(n) WHERE place <= n GROUP BY method, n, cid)
SELECT method, n, round(sum(weight) / (SELECT sum(weight) FROM k), 6) AS coverage FROM h JOIN k USING (cid) GROUP BY method, n""")
def p11(spark, d):
    """Weighted coverage of the clusters by the first n of three orders, greedy, random and by volume, for every budget."""
    pool, clusters = items(spark, d)
    place = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("bigint").alias("place")  # noqa: E731  BUDGET rows
    volume = pool.select("id", (F.col("id") % 7).alias("volume")).orderBy(F.desc("volume"), "id").limit(BUDGET)
    orders = {"greedy": Q.facility(pool, clusters, BUDGET).select("place", "id"), "random": Q.random_order(pool, BUDGET, 55).select(place("u", "id"), "id"), "keyword": volume.select(place(F.desc("volume"), "id"), "id")}
    picks = F.broadcast(reduce(lambda a, b: a.unionByName(b), [x.withColumn("method", F.lit(m)) for m, x in orders.items()]))
    near = K.nearest(pool.select("id", "v").join(picks.select("id").distinct(), "id"), clusters).join(picks, "id")
    budgets = near.withColumn("n", F.explode(F.sequence("place", F.lit(BUDGET).cast("bigint")))).select("method", "n", "cid").distinct()
    total = clusters.agg(F.sum("weight").alias("total"))
    covered = budgets.join(clusters.select("cid", "weight"), "cid").groupBy("method", "n").agg(F.sum("weight").alias("w"))
    return covered.crossJoin(F.broadcast(total)).select("method", "n", F.round(F.col("w") / F.col("total"), 6).alias("coverage"))


@query("p14_state", f"""WITH {NEAREST}, {fanout_sql('f')}, h AS (SELECT id FROM {HELD_SQL}), g AS ({greedy_sql(0.35, 10, KEPT_IDS)})
SELECT 'keywords' AS part, count(*) AS n, sum(id)::BIGINT AS ids FROM e UNION ALL SELECT 'holdout', count(*), sum(id)::BIGINT FROM h UNION ALL SELECT 'train', count(*), sum(id)::BIGINT FROM e WHERE id NOT IN (SELECT id FROM h)
UNION ALL SELECT 'clusters', count(*), sum(cid)::BIGINT FROM k UNION ALL SELECT 'kept', count(*), sum(id)::BIGINT FROM f WHERE keep UNION ALL SELECT 'dropped', count(*), sum(id)::BIGINT FROM f WHERE NOT keep
UNION ALL SELECT 'pool', count(*), sum(id)::BIGINT FROM g UNION ALL SELECT 'bank', count(*), sum(id)::BIGINT FROM g WHERE place <= 5""")
def p14(spark, d):
    """A run's state, rebuilt from its tables: every part with its size and the sum of its ids, so that two rebuilds can be told apart."""
    parts = state(spark, d)
    told = [x.agg(F.count("*").alias("n"), F.sum(x.columns[0]).cast("bigint").alias("ids")).select(F.lit(name).alias("part"), "n", "ids") for name, x in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), told)


def state(spark, d) -> dict:
    """The parts of a run by name, each rebuilt by the stage that makes it; no stage's result is asked for before it is used."""
    v = vectors(spark, d)
    pool, clusters = items(spark, d)
    split, scores = holdout(v), fanout(v)
    kept = scores.where("keep").select("id")
    picked = Q.facility(pool.join(kept, "id"), clusters, 10).select("id", "place")
    return {"keywords": v.select("id"), "holdout": split.where("held").select("id"), "train": split.where("NOT held").select("id"), "clusters": clusters.select("cid"), "kept": kept, "dropped": scores.where("NOT keep").select("id"), "pool": picked.select("id"), "bank": picked.where("place <= 5").select("id")}


@query("m14_fanout_sensitivity", f"""WITH {NEAREST}, {fanout_sql('x')}, {fanout_sql('y', 6)}, b AS (SELECT 0 AS g, id, x.best AS x, y.best AS y, x.keep::INT AS kx, y.keep::INT AS ky FROM x JOIN y USING (id)), v AS (SELECT * FROM b WHERE x > -1 AND y > -1),
r AS (SELECT {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('v', 'g')} GROUP BY g), p AS (SELECT avg((kx = ky)::INT) AS po, avg(kx) AS a, avg(ky) AS b FROM b),
ga AS ({greedy_sql(0.35, 5, KEPT_IDS)}), gb AS ({greedy_sql(0.35, 5, KEPT_IDS.replace(fanout_sql('kept'), fanout_sql('kept', 6)))})
SELECT (SELECT rho FROM r) AS rho, round(po, 6) AS agreement, round((po - (a * b + (1 - a) * (1 - b))) / (1 - (a * b + (1 - a) * (1 - b))), 6) AS kappa, (SELECT count(*) FROM ga JOIN gb USING (id)) AS bank_overlap FROM p""")
def m14_sensitivity(spark, d):
    """Two models' fan-outs of the same candidates: rank agreement of the scores, agreement and kappa of the decisions, overlap of the banks."""
    v = vectors(spark, d)
    pool, clusters = items(spark, d)
    x, y = fanout(v), fanout(v, 6)
    both = x.select("id", F.col("best").alias("x"), F.col("keep").cast("int").alias("kx")).join(y.select("id", F.col("best").alias("y"), F.col("keep").cast("int").alias("ky")), "id")
    rho = S.spearman(both.where("x > -1 AND y > -1"), [], "x", "y").select(F.round("r", 6).alias("rho"))
    banks = [Q.facility(pool.join(f.where("keep").select("id"), "id"), clusters, 5).select("id") for f in (x, y)]
    return rho.crossJoin(S.cohen_kappa(both, "kx", "ky")).crossJoin(banks[0].join(banks[1], "id").agg(F.count("*").alias("bank_overlap")))


@query("p15_bank_run", f"""WITH {NEAREST}, {fanout_sql('f')}, m AS (SELECT own % 3 AS vertical, count(*) AS keywords, count(DISTINCT own) AS clusters, round(avg((cid = own)::INT), 6) AS own_nearest, round(avg(sim), 6) AS mean_sim FROM a GROUP BY 1),
z AS (SELECT cid % 3 AS vertical, max(members) AS largest, min(members) AS smallest FROM k GROUP BY 1), d AS (SELECT e.cid % 3 AS vertical, round(avg((NOT keep)::INT), 6) AS drop_rate, round(avg(best) FILTER (keep), 6) AS kept_mean, round(avg(best) FILTER (NOT keep), 6) AS dropped_mean FROM f JOIN e USING (id) GROUP BY 1)
SELECT * FROM m JOIN z USING (vertical) JOIN d USING (vertical)""")
def p15(spark, d):
    """A real bank's run for each vertical in one pass: its clusters' figures and its filter's; the loop over verticals is a grouping key."""
    v = vectors(spark, d)
    clusters = K.centroids(v)
    told = K.nearest(v.select("id", "v"), clusters).join(v.select("id", F.col("cid").alias("own")), "id")
    same, vertical = F.when(F.col("cid") == F.col("own"), 1.0).otherwise(0.0), (F.col("own") % 3).alias("vertical")
    sizes = clusters.groupBy((F.col("cid") % 3).alias("vertical")).agg(F.max("members").alias("largest"), F.min("members").alias("smallest"))
    scores = fanout(v).join(v.select("id", "cid"), "id").groupBy((F.col("cid") % 3).alias("vertical"))
    drops = scores.agg(F.round(F.avg(F.when(~F.col("keep"), 1.0).otherwise(0.0)), 6).alias("drop_rate"), F.round(F.avg(F.when(F.col("keep"), F.col("best"))), 6).alias("kept_mean"), F.round(F.avg(F.when(~F.col("keep"), F.col("best"))), 6).alias("dropped_mean"))
    whole = told.groupBy(vertical).agg(F.count("*").alias("keywords"), F.count_distinct("own").alias("clusters"), F.round(F.avg(same), 6).alias("own_nearest"), F.round(F.avg("sim"), 6).alias("mean_sim"))
    return whole.join(sizes, "vertical").join(drops, "vertical")
