"""Citation-log queries: folds, universes, visibility, agreement, drift. The log is the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.operators import probe, statistics as S
from quillbank.plans.registry import query, table

LOG = "l AS (SELECT user_id AS q, event_type AS engine, CAST(json_extract_string(props, '$.k') AS BIGINT) AS domain, event_id AS rep, ts FROM events)"
UNIVERSE = LOG + ", u AS (SELECT domain FROM l WHERE domain IS NOT NULL GROUP BY domain HAVING count(DISTINCT q) >= 5 ORDER BY count(DISTINCT q) DESC, domain LIMIT 60)"
VISIBLE = UNIVERSE + """, t AS (SELECT engine, count(*) AS trials FROM l GROUP BY engine), c AS (SELECT engine, domain, count(*) AS n FROM l JOIN u USING (domain) GROUP BY engine, domain),
v AS (SELECT engine, domain, coalesce(n, 0) AS n, trials, coalesce(n, 0) / trials AS rate FROM t CROSS JOIN u LEFT JOIN c USING (engine, domain))"""
ROUNDS = UNIVERSE + """, r AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS round FROM l), t AS (SELECT engine, round, count(*) AS trials FROM r GROUP BY engine, round),
c AS (SELECT engine, round, domain, count(*) AS n FROM r JOIN u USING (domain) GROUP BY engine, round, domain),
v AS (SELECT engine, round, domain, coalesce(n, 0) / trials AS rate FROM t CROSS JOIN u LEFT JOIN c USING (engine, round, domain)),
b AS (SELECT a.engine, a.domain, a.rate AS x, z.rate AS y FROM v a JOIN v z ON a.engine = z.engine AND a.domain = z.domain AND a.round = 1 AND z.round = 2)"""


def ranked_sql(source: str, keys: str, x: str = "x", y: str = "y") -> str:
    by = f"PARTITION BY {keys} " if keys else ""
    part = lambda c: f"PARTITION BY {keys + ', ' if keys else ''}{c}"
    return f"(SELECT *, rank() OVER ({by}ORDER BY {x}) + (count(*) OVER ({part(x)}) - 1) / 2 AS rx, rank() OVER ({by}ORDER BY {y}) + (count(*) OVER ({part(y)}) - 1) / 2 AS ry FROM {source})"


CORRELATION = lambda x, y: f"round(coalesce(covar_pop({x}, {y}) / nullif(sqrt(var_pop({x}) * var_pop({y})), 0), 0), 6)"


def log(spark, d):
    events = table(spark, d, "events")
    return events.select(F.col("user_id").alias("q"), F.col("event_type").alias("engine"), F.get_json_object("props", "$.k").cast("bigint").alias("domain"), F.col("event_id").alias("rep"), "ts")


def in_rounds(spark, d):
    return log(spark, d).withColumn("round", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), 1).otherwise(2))


def two_rounds(spark, d):
    """engine, domain, x and y: the rates of both rounds."""
    rows = in_rounds(spark, d)
    rates = probe.visibility(rows, probe.universe(rows), ("engine", "round"))
    return rates.groupBy("engine", "domain").agg(F.max(F.when(F.col("round") == 1, F.col("rate"))).alias("x"), F.max(F.when(F.col("round") == 2, F.col("rate"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


@query("a1_probe_fold", f"WITH {LOG} SELECT q, engine, domain, count(*) AS n, any_value(t.trials) AS trials FROM l JOIN (SELECT q, engine, count(*) AS trials FROM l GROUP BY q, engine) t USING (q, engine) WHERE domain IS NOT NULL GROUP BY q, engine, domain")
def a1(spark, d):
    rows = log(spark, d)
    return probe.fold(rows).join(probe.trials(rows), ["q", "engine"])


@query("a2_universe", f"WITH {LOG} SELECT domain, count(DISTINCT q) AS queries FROM l WHERE domain IS NOT NULL GROUP BY domain HAVING count(DISTINCT q) >= 5 ORDER BY queries DESC, domain LIMIT 60")
def a2(spark, d):
    return probe.universe(log(spark, d))


GRID_SQL = f"""WITH {UNIVERSE}, g AS (SELECT q, engine, count(*) AS trials FROM l GROUP BY q, engine), f AS (SELECT q, engine, domain, count(*) AS n FROM l GROUP BY q, engine, domain)
SELECT q, engine, domain, coalesce(n, 0) AS succ, trials FROM g CROSS JOIN (SELECT domain FROM l WHERE domain IS NOT NULL GROUP BY domain HAVING count(DISTINCT q) >= 5 ORDER BY count(DISTINCT q) DESC, domain LIMIT 10) LEFT JOIN f USING (q, engine, domain)"""


@query("j5_response_grid", GRID_SQL)
def j5(spark, d):
    rows = log(spark, d)
    return probe.response_grid(rows, probe.universe(rows, most=10))


@query("a3_pooled_responses", f"SELECT q, domain, sum(succ)::BIGINT AS succ, sum(trials)::BIGINT AS trials FROM ({GRID_SQL}) GROUP BY q, domain")
def a3(spark, d):
    return j5(spark, d).groupBy("q", "domain").agg(F.sum("succ").alias("succ"), F.sum("trials").alias("trials"))


@query("a4_visibility", f"WITH {VISIBLE} SELECT engine, domain, n, trials, round(rate, 6) AS rate FROM v")
def a4(spark, d):
    rows = log(spark, d)
    return probe.visibility(rows, probe.universe(rows)).withColumn("rate", F.round("rate", 6))


@query("w3_top_domains", f"WITH {VISIBLE}, p AS (SELECT engine, domain, round(rate, 6) AS rate, row_number() OVER (PARTITION BY engine ORDER BY rate DESC, domain) AS place FROM v) SELECT * FROM p WHERE place <= 5")
def w3(spark, d):
    rows = log(spark, d)
    rates = probe.visibility(rows, probe.universe(rows)).select("engine", "domain", "rate")
    return probe.top_k(rates, ["engine"], 5, F.desc("rate"), "domain").withColumn("rate", F.round("rate", 6))


@query("j3_in_universe", f"WITH {UNIVERSE} SELECT engine, count(*) AS n FROM l WHERE domain IN (SELECT domain FROM u) GROUP BY engine")
def j3(spark, d):
    rows = log(spark, d)
    return rows.join(F.broadcast(probe.universe(rows)), "domain", "left_semi").groupBy("engine").agg(F.count("*").alias("n"))


@query("j4_not_kept", f"WITH {LOG} SELECT DISTINCT q FROM l WHERE q NOT IN (SELECT q FROM l WHERE engine = 'purchase' AND domain <= 3)")
def j4(spark, d):
    rows = log(spark, d)
    return rows.select("q").distinct().join(rows.where("engine = 'purchase' AND domain <= 3").select("q").distinct(), "q", "left_anti")


@query("j8_round_zip", f"WITH {ROUNDS} SELECT engine, domain, round(x, 6) AS x, round(y, 6) AS y FROM b")
def j8(spark, d):
    return two_rounds(spark, d).select("engine", "domain", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("j9_merged_engines", f"WITH {LOG} SELECT q, 'shop' AS side, count(*) AS n FROM l WHERE engine IN ('purchase', 'view') GROUP BY q UNION ALL SELECT q, 'other', count(*) FROM l WHERE engine NOT IN ('purchase', 'view') GROUP BY q")
def j9(spark, d):
    rows, shop = log(spark, d), F.col("engine").isin("purchase", "view")
    count = lambda cond, side: rows.where(cond).groupBy("q").agg(F.count("*").alias("n")).select("q", F.lit(side).alias("side"), "n")
    return count(shop, "shop").unionByName(count(~shop, "other"))


PAIRED = f"{VISIBLE}, pairs AS (SELECT a.engine AS e1, z.engine AS e2, a.domain, a.rate AS x, z.rate AS y FROM v a JOIN v z ON a.domain = z.domain AND a.engine < z.engine)"


def engine_pairs(spark, d):
    rows = log(spark, d)
    v = probe.visibility(rows, probe.universe(rows))
    a, b = v.select(F.col("engine").alias("e1"), "domain", F.col("rate").alias("x")), v.select(F.col("engine").alias("e2"), "domain", F.col("rate").alias("y"))
    return a.join(b, "domain").where("e1 < e2")


@query("j10_engine_pairs", f"WITH {PAIRED} SELECT e1, e2, {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('pairs', 'e1, e2')} GROUP BY e1, e2")
def j10(spark, d):
    return S.spearman(engine_pairs(spark, d), ["e1", "e2"], "x", "y").select("e1", "e2", F.round("r", 6).alias("rho"))


@query("r14_retest", f"""WITH {ROUNDS}, s AS (SELECT engine, {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('b', 'engine')} GROUP BY engine),
k AS (SELECT a.engine, sum(sign(a.x - z.x) * sign(a.y - z.y)) AS s, sum(abs(sign(a.x - z.x))) AS px, sum(abs(sign(a.y - z.y))) AS py FROM b a JOIN b z ON a.engine = z.engine AND a.domain < z.domain GROUP BY a.engine)
SELECT engine, rho, round(coalesce(s / nullif(sqrt(px * py::DOUBLE), 0), 0), 6) AS tau FROM s JOIN k USING (engine)""")
def r14(spark, d):
    both = two_rounds(spark, d)
    rho = S.spearman(both, ["engine"], "x", "y").select("engine", F.round("r", 6).alias("rho"))
    return rho.join(S.kendall(both, ["engine"], "domain", "x", "y").select("engine", F.round("tau", 6).alias("tau")), "engine")


@query("a14_support_overlap", f"""WITH {LOG}, a AS (SELECT domain, count(*) AS n FROM l WHERE engine = 'click' AND domain IS NOT NULL GROUP BY domain), b AS (SELECT domain, count(*) AS n FROM l WHERE engine = 'view' AND domain IS NOT NULL GROUP BY domain),
s AS (SELECT 0 AS g, a.n AS x, b.n AS y FROM a JOIN b USING (domain)), r AS (SELECT {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('s', 'g')} GROUP BY g)
SELECT count(a.n) AS n_a, count(b.n) AS n_b, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS shared, round(count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) / count(*), 6) AS jaccard,
round(coalesce(sum(a.n) FILTER (b.n IS NOT NULL), 0) / sum(a.n), 6) AS mass_a, round(coalesce(sum(b.n) FILTER (a.n IS NOT NULL), 0) / sum(b.n), 6) AS mass_b, (SELECT rho FROM r) AS rho FROM a FULL JOIN b USING (domain)""")
def a14(spark, d):
    """Both engines' whole supports: sizes, what they share, its share of either's citations and its rank agreement."""
    rows = log(spark, d).where("domain IS NOT NULL")
    a = rows.where("engine = 'click'").groupBy("domain").agg(F.count("*").alias("na"))
    b = rows.where("engine = 'view'").groupBy("domain").agg(F.count("*").alias("nb"))
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    part = lambda c: F.round(F.coalesce(F.sum(F.when(both, F.col(c))), F.lit(0)) / F.sum(c), 6)
    sizes = a.join(b, "domain", "full").agg(F.count("na").alias("n_a"), F.count("nb").alias("n_b"), F.count(F.when(both, 1)).alias("shared"), F.round(F.count(F.when(both, 1)) / F.count(F.lit(1)), 6).alias("jaccard"), part("na").alias("mass_a"), part("nb").alias("mass_b"))
    return sizes.crossJoin(S.spearman(a.join(b, "domain"), [], "na", "nb").select(F.round("r", 6).alias("rho")))


@query("a15_source_mix", f"""WITH {LOG}, r AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS round FROM l), t AS (SELECT engine, round, domain, row_number() OVER (PARTITION BY engine, round ORDER BY count(*) DESC, domain) AS p FROM r WHERE domain IS NOT NULL GROUP BY engine, round, domain),
f AS (SELECT engine, round, string_agg(domain, ',' ORDER BY p) AS top5 FROM t WHERE p <= 5 GROUP BY engine, round)
SELECT engine, round::BIGINT AS round, count(*) AS answers, count(DISTINCT domain) AS domains, round(sum(CASE WHEN domain < 9 THEN 1 ELSE 0 END) / count(domain), 6) AS listed_share, round(count(domain) / count(*), 6) AS per_answer, any_value(top5) AS top5 FROM r LEFT JOIN f USING (engine, round) GROUP BY engine, round""")
def a15(spark, d):
    """By engine and round: answers, distinct domains, the share of nine listed ones, domains for each answer and the five most cited."""
    rows = in_rounds(spark, d).withColumn("round", F.col("round").cast("bigint"))
    by = ["engine", "round"]
    mix = rows.groupBy(*by).agg(F.count("*").alias("answers"), F.count_distinct("domain").alias("domains"), F.round(F.sum(F.when(F.col("domain") < 9, 1).otherwise(0)) / F.count("domain"), 6).alias("listed_share"), F.round(F.count("domain") / F.count("*"), 6).alias("per_answer"))
    counts = rows.where("domain IS NOT NULL").groupBy(*by, "domain").agg(F.count("*").alias("n"))
    first = counts.withColumn("p", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "domain"))).where("p <= 5")
    top = first.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "domain"))), lambda x: x["domain"].cast("string")), ",").alias("top5"))
    return mix.join(top, by, "left")


@query("a22_citations_per_query", f"""WITH {LOG}, p AS (SELECT q, engine, count(DISTINCT domain) AS n FROM l GROUP BY q, engine), h AS (SELECT engine, string_agg(n || ':' || c, ' ' ORDER BY n) AS histogram FROM (SELECT engine, n, count(*) AS c FROM p GROUP BY engine, n) GROUP BY engine),
w AS (SELECT avg(m) AS m FROM (SELECT avg(n) AS m FROM p GROUP BY q)) SELECT engine, round(avg(n), 6) AS mean, max(n) AS most, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) AS empty, any_value(histogram) AS histogram, round(any_value(w.m), 6) AS query_mean FROM p JOIN h USING (engine), w GROUP BY engine""")
def a22(spark, d):
    """Distinct domains for each query and engine: mean, most, the share without any and the histogram; and the mean over queries of their engines' means."""
    per = log(spark, d).groupBy("q", "engine").agg(F.count_distinct("domain").alias("n"))
    whole = per.groupBy("engine").agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.round(F.avg(F.when(F.col("n") == 0, 1.0).otherwise(0.0)), 6).alias("empty"))
    bars = per.groupBy("engine", "n").agg(F.count("*").alias("c")).groupBy("engine").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "c"))), lambda x: F.concat_ws(":", x["n"].cast("string"), x["c"].cast("string"))), " ").alias("histogram"))
    means = per.groupBy("q").agg(F.avg("n").alias("m")).agg(F.round(F.avg("m"), 6).alias("query_mean"))
    return whole.join(bars, "engine").crossJoin(F.broadcast(means))  # one row


@query("a23_call_accounting", f"WITH {LOG}, r AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS round FROM l) SELECT round::BIGINT AS round, count(DISTINCT engine) AS engines, count(DISTINCT q) AS queries, count(*) AS calls FROM r GROUP BY round")
def a23(spark, d):
    return in_rounds(spark, d).groupBy(F.col("round").cast("bigint").alias("round")).agg(F.count_distinct("engine").alias("engines"), F.count_distinct("q").alias("queries"), F.count("*").alias("calls"))


@query("a19_ledger", "SELECT event_type AS tag, count(*) AS calls, round(sum(value), 4) AS cost FROM events GROUP BY event_type")
def a19(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"))


@query("r6_round_jaccard", f"""WITH {LOG}, r AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS round FROM l WHERE domain IS NOT NULL), p AS (SELECT q, domain, bool_or(round = 1) AS a, bool_or(round = 2) AS b FROM r GROUP BY q, domain)
SELECT q, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM p GROUP BY q""")
def r6(spark, d):
    sets = in_rounds(spark, d).groupBy("q").agg(F.collect_set(F.when(F.col("round") == 1, F.col("domain"))).alias("a"), F.collect_set(F.when(F.col("round") == 2, F.col("domain"))).alias("b"))
    return sets.select("q", F.round(S.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard")).where("jaccard IS NOT NULL")


STEPS, ORDERS = [10, 25, 50, 75, 100], 25


@query("r16_efficiency_curve", f"""WITH {UNIVERSE}, r1 AS (SELECT * FROM l WHERE ts < TIMESTAMP '2024-01-16'), p AS (SELECT q, count(DISTINCT domain) AS k FROM l GROUP BY q), m AS (SELECT count(*) AS m FROM p),
o AS (SELECT -1::BIGINT AS s, q, row_number() OVER (ORDER BY k DESC, q) - 1 AS pos FROM p UNION ALL SELECT s.x, q, row_number() OVER (PARTITION BY s.x ORDER BY (q * 7919 + s.x * 104729) % 100003, q) - 1 FROM p, range(0, {ORDERS}) s(x)),
steps AS (SELECT n FROM (SELECT unnest({STEPS}) AS n), m WHERE n <= m), truth AS (SELECT u.domain, count(l.domain) AS y FROM u LEFT JOIN l ON l.domain = u.domain AND ts >= TIMESTAMP '2024-01-16' GROUP BY u.domain),
c AS (SELECT q, domain, count(*) AS c FROM r1 JOIN u USING (domain) GROUP BY q, domain), part AS (SELECT s, n, domain, sum(c) AS c FROM c JOIN o USING (q) JOIN steps ON pos < n GROUP BY s, n, domain),
b AS (SELECT g.s, steps.n, truth.domain, coalesce(c, 0) AS x, y FROM (SELECT DISTINCT s FROM o) g CROSS JOIN steps CROSS JOIN truth LEFT JOIN part p ON p.s = g.s AND p.n = steps.n AND p.domain = truth.domain),
rho AS (SELECT s, n, {CORRELATION('rx', 'ry')} AS rho FROM {ranked_sql('b', 's, n')} GROUP BY s, n),
k AS (SELECT a.s, a.n, sum(sign(a.x - z.x) * sign(a.y - z.y)) AS s_, sum(abs(sign(a.x - z.x))) AS px, sum(abs(sign(a.y - z.y))) AS py FROM b a JOIN b z ON a.s = z.s AND a.n = z.n AND a.domain < z.domain GROUP BY a.s, a.n),
e AS (SELECT s, n, rho, round(coalesce(s_ / nullif(sqrt(px * py::DOUBLE), 0), 0), 6) AS tau FROM rho JOIN k USING (s, n))
SELECT n::BIGINT AS n, any_value(rho) FILTER (s = -1) AS rho, any_value(tau) FILTER (s = -1) AS tau, round(avg(rho) FILTER (s >= 0), 6) AS random_rho, round(avg(tau) FILTER (s >= 0), 6) AS random_tau FROM e GROUP BY n""")
def r16(spark, d):
    """Domain ranking of the first n queries in round 1 against round 2's from all: the most informative first, and the mean of random orders."""
    from quillbank.session import dense_index

    rows = in_rounds(spark, d)
    domains = F.broadcast(probe.universe(rows).select("domain"))
    queries = rows.groupBy("q").agg(F.count_distinct("domain").alias("k"))
    first = dense_index(queries, F.desc("k"), "q", name="pos").select(F.lit(-1).cast("bigint").alias("s"), "q", "pos")
    steps = [n for n in STEPS if n <= first.count()]
    drawn = queries.select("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ORDERS - 1).cast("bigint"))).alias("s")).withColumn("h", (F.col("q") * 7919 + F.col("s") * 104729) % 100003)
    some = drawn.withColumn("pos", F.row_number().over(Window.partitionBy("s").orderBy("h", "q")) - 1).where(F.col("pos") < max(steps, default=0)).select("s", "q", "pos")
    order = first.where(F.col("pos") < max(steps, default=0)).unionByName(some)  # as many queries as the largest step, for each order
    truth = rows.where("round = 2").join(domains, "domain").groupBy("domain").agg(F.count("*").alias("y"))
    truth = probe.universe(rows).select("domain").join(truth, "domain", "left").select("domain", F.coalesce("y", F.lit(0)).alias("y"))
    cited = rows.where("round = 1").join(domains, "domain").groupBy("q", "domain").agg(F.count("*").alias("c"))
    at = F.explode(F.filter(F.array(*[F.lit(n) for n in steps]).cast("array<bigint>"), lambda n: n > F.col("pos"))).alias("n")
    part = cited.join(F.broadcast(order), "q").select("s", "domain", "c", at).groupBy("s", "n", "domain").agg(F.sum("c").alias("x"))
    spine = truth.select("domain", "y", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(ORDERS - 1).cast("bigint"))).alias("s")).select("*", F.explode(F.array(*[F.lit(n) for n in steps]).cast("array<bigint>")).alias("n"))
    both = spine.join(part, ["s", "n", "domain"], "left").select("s", "n", "domain", F.coalesce("x", F.lit(0)).alias("x"), "y")
    told = S.spearman(both, ["s", "n"], "x", "y").join(S.kendall(both, ["s", "n"], "domain", "x", "y"), ["s", "n"]).select("s", "n", F.round("r", 6).alias("rho"), F.round("tau", 6).alias("tau"))
    own, others = (lambda c: F.max(F.when(F.col("s") == -1, F.col(c)))), (lambda c: F.round(F.avg(F.when(F.col("s") >= 0, F.col(c))), 6))
    return told.groupBy("n").agg(own("rho").alias("rho"), own("tau").alias("tau"), others("rho").alias("random_rho"), others("tau").alias("random_tau"))
