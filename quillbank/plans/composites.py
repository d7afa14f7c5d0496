"""Stages, sources and sinks as queries."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.functions import text as T
from quillbank.operators import kernels as M
from quillbank.operators import nearest as K
from quillbank.operators import statistics as S
from quillbank.plans.registry import query, table
from quillbank.plans.selection import BUDGET, HELD_SQL, a6, a7, bank, drawn_sql, fanout, fanout_sql, holdout
from quillbank.plans.text import COLLAPSED, FIRST_TURN, LIST
from quillbank.plans.vectors import NEAREST, VECTORS, vectors
from quillbank.session import dense_index, running
from quillbank.sources import files
from quillbank.streaming import visibility


@query("p1_keyword_bank", "WITH k AS (SELECT p_name AS kw, min(p_partkey) AS first_id, min(p_brand) AS seed, max(p_size)::BIGINT AS volume FROM part WHERE length(p_name) <= 60 GROUP BY p_name) SELECT kw, first_id, seed, volume, round(ln(1 + volume), 6) AS logvol, CASE WHEN seed IN ('Brand#1', 'Brand#2') THEN 'N' ELSE 'I' END AS intent FROM k")
def p1(spark, d):
    parts = table(spark, d, "part").where(F.length("p_name") <= 60)
    bank = parts.groupBy(F.col("p_name").alias("kw")).agg(F.min("p_partkey").alias("first_id"), F.min("p_brand").alias("seed"), F.max("p_size").cast("bigint").alias("volume"))
    return bank.withColumn("logvol", F.round(F.log1p("volume"), 6)).withColumn("intent", F.when(F.col("seed").isin("Brand#1", "Brand#2"), "N").otherwise("I"))


@query("p2_holdout_split", f"SELECT vec_id AS id, CASE WHEN vec_id IN {HELD_SQL} THEN 'holdout' ELSE 'train' END AS split FROM embeddings")
def p2(spark, d):
    """A fifth of the bank is held out, the first in the order of a seeded draw for each id."""
    return holdout(vectors(spark, d)).select("id", F.when(F.col("held"), "holdout").otherwise("train").alias("split"))


@query("p3_reference_pool", f"""SELECT DISTINCT t AS q FROM (SELECT {COLLAPSED} AS t FROM {FIRST_TURN}) WHERE length(t) BETWEEN 12 AND 220 AND regexp_full_match(t, '[\\x00-\\x7E]*') AND len(string_split(t, ' ')) >= 3""")
def p3(spark, d):
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    clean = turns.select(T.collapse(F.col("text")).alias("q"))
    return clean.where(T.is_prompt(F.col("q")) & (F.size(F.split("q", " ")) >= 3)).distinct()


@query("p4_intent_clusters", f"WITH {NEAREST} SELECT k.cid, any_value(members) AS members, round(any_value(weight), 6) AS weight, min(a.id) AS first_member, count(a.id) AS nearest_members FROM k JOIN a ON a.cid = k.cid GROUP BY k.cid")
def p4(spark, d):
    v = vectors(spark, d)
    k = K.centroids(v)
    told = K.nearest(v.select("id", "v"), k).groupBy("cid").agg(F.min("id").alias("first_member"), F.count("*").alias("nearest_members"))
    return k.join(told, "cid").select("cid", "members", F.round("weight", 6).alias("weight"), "first_member", "nearest_members")


PERSONAS, SCENARIOS, FUNNELS = ["beginner", "expert", "parent", "buyer"], ["research", "comparison", "problem", "purchase"], ["awareness", "consideration", "decision"]
#: Candidates that are aimed at, questions that a job asks for, and the seed of the jobs' draws.
TARGET, PER_JOB, JOB_SEED = 1000, 5, 20260711
_JOBS = f"WITH {VECTORS}, c AS (SELECT cid, row_number() OVER (ORDER BY cid) - 1 AS pos, count(*) OVER () AS m FROM (SELECT DISTINCT cid FROM e)), n AS (SELECT *, greatest(3, ceil(greatest(6, ceil({TARGET} / m)) / {PER_JOB}))::BIGINT AS jobs FROM c), j AS (SELECT cid, job, pos * jobs + job AS k FROM n, range(0, 1000) r(job) WHERE job < jobs)"
_DRAW = lambda place: drawn_sql(JOB_SEED, f"SELECT 3 * x + {place} AS i FROM range(0, 4000) r(x)")


@query("p5_generation_jobs", f"""{_JOBS} SELECT cid, job, {LIST(PERSONAS)}[1 + floor(a.u * 4)::INT] AS persona, {LIST(SCENARIOS)}[1 + floor(b.u * 4)::INT] AS scenario, {LIST(FUNNELS)}[1 + least(2, floor(c.u * 3))::INT] AS funnel, {PER_JOB}::BIGINT AS n
FROM j JOIN {_DRAW(1)} a ON a.i = 3 * k + 1 JOIN {_DRAW(2)} b ON b.i = 3 * k + 2 JOIN {_DRAW(3)} c ON c.i = 3 * k + 3""")
def p5(spark, d):
    """The prompts' parameters: jobs for each cluster as their number asks, each with three draws from one seeded sequence."""
    clusters = dense_index(vectors(spark, d).select("cid").distinct(), "cid", name="at")
    per = max(6, math.ceil(TARGET / max(1, clusters.count())))
    number = max(3, math.ceil(per / PER_JOB))
    jobs = clusters.select("cid", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(number - 1).cast("bigint"))).alias("job"))
    draw = lambda place: N.uniform(F.lit(JOB_SEED), 3 * (F.col("at") * number + F.col("job")) + place)
    pick = lambda xs, place: F.element_at(F.array(*map(F.lit, xs)), (1 + F.least(F.lit(len(xs) - 1), F.floor(draw(place) * len(xs)))).cast("int"))
    return jobs.select("cid", "job", pick(PERSONAS, 1).alias("persona"), pick(SCENARIOS, 2).alias("scenario"), pick(FUNNELS, 3).alias("funnel"), F.lit(PER_JOB).cast("bigint").alias("n"))


@query("p6_fanout_filter", f"WITH {NEAREST}, {fanout_sql('f')} SELECT id, round(best, 6) AS cycle_sim, keep FROM f")
def p6(spark, d):
    """A candidate is kept if the best of its sub-queries, none to six, comes near its cluster; none: -1."""
    return fanout(vectors(spark, d)).select("id", F.round("best", 6).alias("cycle_sim"), "keep")


@query("p7_realism_calibration")
def p7(spark, d):
    """r(q) of every candidate text (those not labelled as good) against the pool of good ones, with the calibration's figures."""
    from quillbank.plans.kernels import scored, styled

    rows = styled(spark, d)
    auc, mauve, model = M.calibration(rows)
    return scored(rows.where("y = 0"), model).select("id", F.round("r", 9).alias("r"), F.lit(auc).alias("auc"), F.lit(mauve).alias("mauve"))


@query("p9_probe_calls", "SELECT event_type AS engine, count(DISTINCT user_id) AS queries, count(*) AS calls, count(*) FILTER (json_extract_string(props, '$.k') IS NULL) AS failed FROM events GROUP BY event_type")
def p9(spark, d):
    """Calls and failed ones, which stay in the table and are counted rather than skipped."""
    failed = F.get_json_object("props", "$.k").isNull()
    return table(spark, d, "events").groupBy(F.col("event_type").alias("engine")).agg(F.count_distinct("user_id").alias("queries"), F.count("*").alias("calls"), F.count(F.when(failed, 1)).alias("failed"))


@query("p10_quality_bundle")
def p10(spark, d):
    """Coverage, recall, diversity, MAUVE and AUC of the greedy bank; its queries' texts are held against the users' first turns."""
    v = vectors(spark, d)
    order = bank(spark, d, 50)
    chosen, first = F.broadcast(order.select("id")), order.where(F.col("place") <= BUDGET)  # the first picks of a longer order are those of a shorter one
    own = v.join(chosen, "id").select("id", "v", F.lit(0).cast("bigint").alias("bank"))
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")).join(chosen, "id").withColumn("y", F.lit(0))
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text")).select(F.col("conv_id").alias("id"), "text", F.lit(1).alias("y"))
    auc, mauve, _ = M.calibration(texts.unionByName(turns).where("text IS NOT NULL").select("id", F.array(*T.style_features(F.col("text"))).alias("x"), "y"))
    return a6(spark, d, first).crossJoin(a7(spark, d, first)).crossJoin(M.vendi(own, "bank").select("n", "vendi")).select("*", F.lit(mauve).alias("mauve"), F.lit(auc).alias("auc"))


_KIT = "k AS (SELECT 'A' || lpad(CAST(row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) AS VARCHAR), 6, '0') AS item, doc_id, CASE WHEN quality = 1 THEN 'H' ELSE 'M' END AS answer, toxic FROM labels)"


def kit(spark, d):
    """item, doc_id, answer (the key) and toxic, in an order that tells nothing of the class."""
    placed = dense_index(table(spark, d, "labels"), F.col("doc_id") * 7919 % 10007, "doc_id", name="p")
    return placed.select(F.concat(F.lit("A"), F.lpad((F.col("p") + 1).cast("string"), 6, "0")).alias("item"), "doc_id", F.when(F.col("quality") == 1, "H").otherwise("M").alias("answer"), "toxic")


@query("p16_blinded_kit", f"WITH {_KIT} SELECT item, doc_id, answer FROM k")
def p16(spark, d):
    """Items in an order that tells nothing of their class, with their key."""
    return kit(spark, d).select("item", "doc_id", "answer")


@query("p16_kit_analysis", f"""WITH {_KIT}, a AS (SELECT item, k.answer AS truth, toxic, r.x AS annotator, CASE WHEN (doc_id + r.x) % 9 = 0 THEN '?' WHEN (doc_id * 31 + r.x * 7) % (2 + r.x) = 0 THEN CASE WHEN k.answer = 'H' THEN 'm' ELSE 'h ' END ELSE lower(k.answer) END AS said FROM k, range(1, 4) r(x)),
v AS (SELECT *, upper(trim(said)) AS s FROM a WHERE upper(trim(said)) IN ('H', 'M')) SELECT 'annotator' AS part, annotator::VARCHAR AS name, count(*) AS n, round(avg((s = truth)::INT), 6) AS share FROM v GROUP BY annotator
UNION ALL SELECT 'source', CASE WHEN truth = 'H' THEN 'real' WHEN toxic = 1 THEN 'toxic' ELSE 'other' END, count(*), round(avg((s = 'H')::INT), 6) FROM v GROUP BY 2""")
def p16_analysis(spark, d):
    """Annotators' filled-in sheets, written and read as quoted CSV, against the key: each one's accuracy, and how often each source was taken for a person.

    Answers that are neither H nor M, in any case and with blanks around, do not count.
    """
    key = kit(spark, d)
    sheets = key.select("item", "doc_id", "answer", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("annotator"))
    wrong = (F.col("doc_id") * 31 + F.col("annotator") * 7) % (2 + F.col("annotator")) == 0
    said = F.when((F.col("doc_id") + F.col("annotator")) % 9 == 0, "?").when(wrong, F.when(F.col("answer") == "H", "m").otherwise("h ")).otherwise(F.lower("answer"))
    path = files.scratch_path(spark)
    files.write_csv(sheets.select("item", "annotator", said.alias("said")), path)
    filled = files.read_csv(spark, path, "item string, annotator int, said string").withColumn("s", F.upper(F.trim("said"))).where(F.col("s").isin("H", "M"))
    told = filled.join(key, "item")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias("share")
    source = F.when(F.col("answer") == "H", "real").when(F.col("toxic") == 1, "toxic").otherwise("other")
    by_annotator = told.groupBy(F.col("annotator").cast("string").alias("name")).agg(F.count("*").alias("n"), share(F.col("s") == F.col("answer"))).withColumn("part", F.lit("annotator"))
    by_source = told.groupBy(source.alias("name")).agg(F.count("*").alias("n"), share(F.col("s") == "H")).withColumn("part", F.lit("source"))
    return by_annotator.unionByName(by_source).select("part", "name", "n", "share")


#: Topics of the taxonomy, and queries that one answer covers.
TOPICS, ANSWERED = 40, 25
_ASKED = f"q AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS p, length(text) % {TOPICS + 1} AS t1, length(text) * 7 % {TOPICS + 3} AS t2 FROM {FIRST_TURN}), b AS (SELECT *, p // {ANSWERED} AS batch FROM q)"


@query("p17_taxonomy_coverage", f"""WITH {_ASKED}, ok AS (SELECT * FROM b WHERE batch % 5 <> 3), a AS (SELECT conv_id, list_slice(list_filter([t1, t2], lambda x: x >= 1 AND x <= {TOPICS}), 1, 2) AS topics FROM ok),
h AS (SELECT DISTINCT unnest(topics) AS topic FROM a), w AS (SELECT x AS topic, 1 + x % 9 AS weight FROM range(1, {TOPICS} + 1) r(x))
SELECT (SELECT count(*) FROM a) AS judged, (SELECT count(*) FROM h) AS families, round((SELECT sum(weight) FROM w JOIN h USING (topic)) / (SELECT sum(weight) FROM w), 6) AS weighted, round((SELECT avg((len(topics) = 0)::INT) FROM a), 6) AS off_taxonomy""")
def p17(spark, d):
    """Weight of the topics that a bank's queries were assigned to, at most two each, by answers for 25 queries at a time.

    An answer whose list has another number of entries than its batch has queries is discarded with its whole batch.
    """
    turns = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    placed = dense_index(turns.select("conv_id", (F.length("text") % (TOPICS + 1)).alias("t1"), (F.length("text") * 7 % (TOPICS + 3)).alias("t2")), "conv_id", name="p")
    batch = F.floor(F.col("p") / ANSWERED)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p", "t1", "t2"))), lambda x: F.array(x["t1"], x["t2"]))
    asked = placed.groupBy(batch.alias("batch")).agg(F.count("*").alias("n"), listed.alias("told"))  # at most ANSWERED rows each
    worded = F.when(F.col("batch") % 5 == 3, F.to_json(F.slice("told", F.lit(2), F.lit(ANSWERED)))).otherwise(F.concat(F.lit("The topics are "), F.to_json("told"), F.lit(".")))
    read = F.from_json(T.fenced_json(F.col("raw")), "array<array<int>>")
    answers = asked.select("n", worded.alias("raw")).select("n", read.alias("topics")).where(F.size("topics") == F.col("n"))
    legal = answers.select(F.explode("topics").alias("t")).select(F.slice(F.filter("t", lambda x: (x >= 1) & (x <= TOPICS)), 1, 2).alias("t"))
    weights = spark.range(1, TOPICS + 1).select(F.col("id").cast("int").alias("topic"), (1 + F.col("id") % 9).alias("weight"))
    hit = legal.select(F.explode("t").alias("topic")).distinct().withColumn("hit", F.lit(1))
    share = weights.join(hit, "topic", "left").agg(F.count("hit").alias("families"), F.round(F.sum(F.when(F.col("hit") == 1, F.col("weight")).otherwise(0)) / F.sum("weight"), 6).alias("weighted"))
    return legal.agg(F.count("*").alias("judged"), F.round(F.avg(F.when(F.size("t") == 0, 1.0).otherwise(0.0)), 6).alias("off_taxonomy")).crossJoin(share)


#: Texts that one judging answer covers.
JUDGED = 25
_JUDGED = f"""j AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'real' WHEN toxic = 1 THEN 'toxic' ELSE 'other' END AS src, length(text) % 101 AS score, row_number() OVER (ORDER BY (doc_id * 7919) % 10007, doc_id) - 1 AS p FROM labels JOIN documents USING (doc_id)),
ok AS (SELECT * FROM j WHERE (p // {JUDGED}) % 7 <> 2)"""


def judged(spark, d):
    """doc_id, src and score, read from answers for 25 texts at a time; an answer of another length than its batch does not count."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", F.length("text").alias("size")), "doc_id")
    src = F.when(F.col("quality") == 1, "real").when(F.col("toxic") == 1, "toxic").otherwise("other")
    placed = dense_index(rows.select("doc_id", src.alias("src"), (F.col("size") % 101).alias("score")), F.col("doc_id") * 7919 % 10007, "doc_id", name="p")
    ordered = F.sort_array(F.collect_list(F.struct("p", "doc_id", "src", "score")))
    asked = placed.groupBy(F.floor(F.col("p") / JUDGED).alias("batch")).agg(ordered.alias("texts"))  # at most JUDGED rows each
    numbers = F.transform("texts", lambda x: x["score"])
    worded = F.when(F.col("batch") % 7 == 2, F.to_json(F.slice(numbers, F.lit(2), F.lit(JUDGED)))).otherwise(F.concat(F.lit("```json\n"), F.to_json(numbers), F.lit("\n```")))
    read = asked.select("texts", F.from_json(T.fenced_json(worded), "array<double>").alias("scores")).where(F.size("scores") == F.size("texts"))
    each = read.select(F.explode(F.arrays_zip("texts", "scores")).alias("x"))
    return each.select("x.texts.doc_id", "x.texts.src", F.col("x.scores").alias("score"))


@query("p18_judge_report", f"""WITH {_JUDGED}, s AS (SELECT DISTINCT src FROM ok WHERE src <> 'real'), u AS (SELECT s.src, doc_id, score, (ok.src = 'real')::INT AS y FROM ok JOIN s ON ok.src = 'real' OR ok.src = s.src), p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score, doc_id) AS place FROM u),
a AS (SELECT src, round((sum(place) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM p GROUP BY src) SELECT src, count(*) AS n, round(avg(score), 6) AS mean_score, any_value(auc) AS auc FROM ok LEFT JOIN a USING (src) GROUP BY src""")
def p18(spark, d):
    """Each source's judged texts: how many, their mean score, and the AUC of the real ones against them."""
    rows = judged(spark, d)
    others = rows.where("src <> 'real'").select(F.col("src").alias("against")).distinct()
    real = rows.where("src = 'real'").crossJoin(F.broadcast(others)).withColumn("y", F.lit(1))  # a few sources
    both = real.select("against", "doc_id", "score", "y").unionByName(rows.where("src <> 'real'").select(F.col("src").alias("against"), "doc_id", "score", F.lit(0).alias("y")))
    auc = S.auc(both, ["against"], "score", "y", "doc_id").select(F.col("against").alias("src"), F.round("auc", 6).alias("auc"))
    return rows.groupBy("src").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).join(auc, "src", "left")


@query("p18_pair_tally", f"""WITH {_JUDGED}, r AS (SELECT doc_id, score, row_number() OVER (ORDER BY doc_id) AS i FROM j WHERE src = 'real'), o AS (SELECT src, doc_id, score, row_number() OVER (PARTITION BY src ORDER BY doc_id) AS i FROM j WHERE src <> 'real'),
p AS (SELECT o.src, (r.doc_id + o.doc_id) % 2 = 0 AS first, r.score AS a, o.score AS b FROM r JOIN o USING (i)) SELECT src AS baseline, count(*) AS n, sum((a > b)::INT)::BIGINT AS wins FROM p WHERE a <> b GROUP BY src""")
def p18_pairs(spark, d):
    """Real texts in pairs with those of each other source, sides by a draw, and how often the answer's letter names the real one."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.length("text") % 101).alias("score")), "doc_id")
    src = F.when(F.col("quality") == 1, "real").when(F.col("toxic") == 1, "toxic").otherwise("other")
    rows = rows.select("doc_id", src.alias("src"), "score")
    real = dense_index(rows.where("src = 'real'").select(F.col("doc_id").alias("real_id"), F.col("score").alias("a")), "real_id", name="i")
    sides = [dense_index(rows.where(F.col("src") == name), "doc_id", name="i") for name in ("toxic", "other")]
    pairs = sides[0].unionByName(sides[1]).join(real, "i").withColumn("first", (F.col("real_id") + F.col("doc_id")) % 2 == 0)
    better = F.when(F.col("a") > F.col("score"), F.col("first")).when(F.col("a") < F.col("score"), ~F.col("first"))
    raw = F.when(better, " a.").when(~better, "B, as it rambles").otherwise("neither")
    told = pairs.select("src", "first", T.letter_verdict(raw).alias("letter")).where("letter IS NOT NULL")
    return told.groupBy(F.col("src").alias("baseline")).agg(F.count("*").alias("n"), F.sum(F.when((F.col("letter") == "A") == F.col("first"), 1).otherwise(0)).cast("bigint").alias("wins"))


@query("io1_cached_answers", "SELECT conv_id * 100 + turn AS key, text AS answer, 'cache' AS origin FROM conversations WHERE role = 'assistant' AND conv_id % 3 > 0 UNION ALL SELECT conv_id * 100 + turn, upper(role), 'fetch' FROM conversations WHERE role = 'assistant' AND conv_id % 3 = 0")
def io1(spark, d):
    """Answers from the cache table; a source is asked for the missing prompts alone (here a stand-in names the role)."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").withColumn("key", F.col("conv_id") * 100 + F.col("turn"))
    cache = rows.where("conv_id % 3 > 0").select("key", F.col("text").alias("answer"), F.lit("cache").alias("origin"))
    return files.cached_fetch(rows, cache, "key", lambda missing: missing.select("key", F.lit("ASSISTANT").alias("answer"), F.lit("fetch").alias("origin")))


#: Texts that one call of the encoder takes.
ENCODED = 96


@query("io2_cached_embeddings", "SELECT vec_id AS id, vec_id % 4 > 0 AS cached, round(CASE WHEN vec_id % 4 > 0 THEN embedding[1] ELSE (vec_id * 37 % 101) / 101.0 END, 6)::DOUBLE AS first, CASE WHEN vec_id % 4 > 0 THEN 0 ELSE 1 END::BIGINT AS in_batch FROM embeddings")
def io2(spark, d):
    """Vectors from the cache; the encoder (a stand-in that reads the id) is asked for the missing ones alone, 96 at a time."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    cache = rows.where("id % 4 > 0").select("id", F.lit(True).alias("cached"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.lit(0).cast("bigint").alias("in_batch"))

    def encode(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), ENCODED):
                part = pdf.iloc[lo : lo + ENCODED]
                yield part.assign(cached=False, first=(part.id * 37 % 101 / 101.0).round(6), in_batch=int(len(part) <= ENCODED))

    return files.cached_fetch(rows, cache, "id", lambda missing: missing.mapInPandas(encode, "id bigint, cached boolean, first double, in_batch bigint"))


@query("io3_distinct_citations", "SELECT engine, q, len(list_distinct(ks)) AS domains, len(ks) AS citations FROM (SELECT event_type AS engine, user_id AS q, list(json_extract_string(props, '$.k')) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS ks FROM events GROUP BY 1, 2)")
def io3(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("engine"), F.col("user_id").alias("q")).agg(F.count_distinct(k).alias("domains"), F.count(k).alias("citations"))


@query("io4_url_union", "SELECT page_id, list_distinct([url, regexp_replace(url, '[?#].*$', '')]) AS urls FROM pages".replace("list_distinct([url, regexp_replace(url, '[?#].*$', '')]) AS urls", "CASE WHEN url = regexp_replace(url, '[?#].*$', '') THEN url ELSE url || ' ' || regexp_replace(url, '[?#].*$', '') END AS urls"))
def io4(spark, d):
    """Cited URLs of two lists as one, each once, order kept."""
    both = F.array_distinct(F.concat(F.array("url"), F.array(F.regexp_replace("url", "[?#].*$", ""))))
    return table(spark, d, "pages").select("page_id", F.concat_ws(" ", both).alias("urls"))


@query("io5_retried_calls", """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 400 WHEN c_custkey % 8 > 5 THEN 429 ELSE 200 END AS status, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 8 > 5 THEN NULL ELSE 'answer ' || c_custkey END AS body,
CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE least(6, c_custkey % 8 + 1) END::INT AS attempts, CASE WHEN c_custkey % 13 = 0 THEN 0.0 ELSE pow(2, least(5, c_custkey % 8)) - 1 END::DOUBLE AS waited FROM customer""")
def io5(spark, d):
    """Calls that are tried again after growing waits while the service is busy; a bad request fails at once."""

    def service(key: int, attempt: int):
        if key % 13 == 0:
            return 400, None
        return (429, None) if attempt < key % 8 else (200, f"answer {key}")

    return files.called(table(spark, d, "customer").select("c_custkey"), "c_custkey", service, sleep=False)


#: Cents that may be spent, and microseconds between two calls of a limited service.
BUDGET_CENTS, GAP = 200_000, 3_300_000


@query("io6_budget_cap", f"WITH c AS (SELECT event_type, round(value * 100)::BIGINT AS cents, coalesce(sum(round(value * 100)::BIGINT) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM events) SELECT event_type AS tag, count(*) FILTER (spent < {BUDGET_CENTS}) AS made, count(*) FILTER (spent >= {BUDGET_CENTS}) AS refused, coalesce(sum(cents) FILTER (spent < {BUDGET_CENTS}), 0)::BIGINT AS cents FROM c GROUP BY 1")
def io6(spark, d):
    """Calls in order of time are made for as long as what was spent before them is below the budget."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    spent = running(table(spark, d, "events").select("event_type", "ts", "event_id", cents.alias("cents")), "cents", "ts", "event_id", name="up_to")
    made = F.col("up_to") - F.col("cents") < BUDGET_CENTS
    return spent.groupBy(F.col("event_type").alias("tag")).agg(F.count(F.when(made, 1)).alias("made"), F.count(F.when(~made, 1)).alias("refused"), F.sum(F.when(made, F.col("cents")).otherwise(0)).alias("cents"))


@query("io7_rate_limit", f"WITH o AS (SELECT event_id, epoch_us(ts) AS came, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) SELECT event_id, (i * {GAP} + max(came - i * {GAP}) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS starts_us FROM o")
def io7(spark, d):
    """When each call starts if two are at least 3.3 seconds apart: a call waits for its turn or starts as it comes.

    The i-th start is the greatest of (arrival j) + (i - j) gaps over all j up to i, a running maximum.
    """
    placed = dense_index(table(spark, d, "events").select("event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), "ts", "event_id", name="i")
    ahead = running(placed.withColumn("lead", F.col("at") - F.col("i") * GAP), "lead", "i", how="max", name="most")
    return ahead.select("event_id", (F.col("i") * GAP + F.col("most")).alias("starts_us"))


@query("io18_settings", """WITH l AS (SELECT 'KEY_' || (c_custkey % 97) AS key, c_mktsegment || c_custkey AS value, c_custkey AS line FROM customer WHERE c_custkey % 10 > 0), f AS (SELECT key, arg_max(value, line) AS value FROM l GROUP BY key), p AS (SELECT 'KEY_' || (n_nationkey * 4) AS key, n_name AS value FROM nation)
SELECT key, value FROM p UNION ALL SELECT key, value FROM f WHERE key NOT IN (SELECT key FROM p)""")
def io18(spark, d):
    """Settings from KEY=VALUE lines, which never override those that are there."""
    key = F.concat(F.lit("KEY_"), F.col("c_custkey") % 97)
    line = F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("# "), key)).otherwise(F.concat(F.lit(" "), key, F.lit(' = "'), "c_mktsegment", "c_custkey", F.lit('"')))
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("at"), line.alias("value"))
    present = table(spark, d, "nation").select(F.concat(F.lit("KEY_"), F.col("n_nationkey") * 4).alias("key"), F.col("n_name").alias("value"))
    return files.settings(lines, present)


@query("io19_raw_dumps", "SELECT event_type AS backend, event_id, props AS raw FROM events")
def io19(spark, d):
    """Raw answers as JSON, a folder for each backend, read back with their backend."""
    path = files.scratch_path(spark)
    table(spark, d, "events").select(F.col("event_type").alias("backend"), "event_id", F.col("props").alias("raw")).write.partitionBy("backend").json(path)
    return spark.read.schema("event_id bigint, raw string, backend string").json(path).select("backend", "event_id", "raw")


#: Rows of a page, and accepted rows at which the scan stops.
PAGE, WANTED = 100, 150


@query("io8_paged_json", f"""WITH o AS (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations), a AS (SELECT *, p // {PAGE} AS page, row_number() OVER (ORDER BY p) AS k FROM o WHERE role = 'user')
SELECT page::BIGINT AS page, conv_id, turn FROM a WHERE k <= {WANTED}""")
def io8(spark, d):
    """Pages of a hundred rows as they were landed, by offset, read in order until enough accepted rows are there."""
    rows = dense_index(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", name="p")
    path = files.scratch_path(spark)
    rows.withColumn("page", F.floor(F.col("p") / PAGE)).repartition("page").write.partitionBy("page").json(path)
    return files.paged_scan(spark, path, "p bigint, conv_id bigint, turn bigint, role string", "role = 'user'", WANTED).select("page", "conv_id", "turn")


@query("io11_json_round_trip", "SELECT doc_id, text, lang FROM documents")
def io11(spark, d):
    path = files.scratch_path(spark)
    files.write_json(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return files.read_json(spark, path, "doc_id bigint, text string, lang string")


@query("io12_csv_round_trip", "SELECT doc_id, text FROM documents")
def io12(spark, d):
    path = files.scratch_path(spark)
    files.write_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    return files.read_csv(spark, path, "doc_id bigint, text string")


@query("io14_spend_by_tag", "SELECT event_type || ':' || (user_id % 3) AS tag, count(*) AS calls, round(sum(value), 4) AS cost, round(sum(sum(value)) OVER (), 3) AS total FROM events GROUP BY 1")
def io14(spark, d):
    tag = F.concat_ws(":", "event_type", (F.col("user_id") % 3).cast("string"))
    each = table(spark, d, "events").groupBy(tag.alias("tag")).agg(F.count("*").alias("calls"), F.sum("value").alias("c"))
    return each.select("tag", "calls", F.round("c", 4).alias("cost"), F.round(F.sum("c").over(Window.partitionBy()), 3).alias("total"))


@query("io15_latex_table", "SELECT c_mktsegment || ' & ' || count(*) || ' & ' || max(c_custkey) || ' \\\\' AS line FROM customer GROUP BY c_mktsegment")
def io15(spark, d):
    return files.latex_rows(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last")))


@query("io16_plot_series", "SELECT (p_size)::BIGINT AS x, count(*) AS y, p_size || ' ' || count(*) AS line FROM part GROUP BY p_size")
def io16(spark, d):
    series = table(spark, d, "part").groupBy(F.col("p_size").cast("bigint").alias("x")).agg(F.count("*").alias("y"))
    return series.withColumn("line", F.concat_ws(" ", "x", "y"))


@query("io17_macros", r"SELECT name, value, '\newcommand{\' || name || '}{' || value || '}' AS line FROM (SELECT 'bankCustomers' AS name, CAST(count(*) AS VARCHAR) AS value FROM customer UNION ALL SELECT 'bankLastKey', CAST(max(c_custkey) AS VARCHAR) FROM customer)")
def io17(spark, d):
    return files.macro_rows(table(spark, d, "customer").agg(F.count("*").alias("customers"), F.max("c_custkey").alias("last_key")), "bank")


@query("io20_bounded_map", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS at, c_custkey, CASE WHEN c_custkey % 50 <> 0 THEN c_custkey * 2 END AS doubled, CASE WHEN c_custkey % 50 = 0 THEN 'ValueError: no answer for ' || c_custkey END AS error FROM customer")
def io20(spark, d):
    """A worker over partitions, whose number bounds what runs at once; results keep their input's place, a failure its error."""

    def worker(key: int) -> int:
        if key % 50 == 0:
            raise ValueError(f"no answer for {key}")
        return key * 2

    placed = dense_index(table(spark, d, "customer").select("c_custkey"), "c_custkey", name="at")
    return files.bounded_map(placed.select("at", "c_custkey"), "c_custkey", worker, "doubled bigint").select("at", "c_custkey", "doubled", "error")


@query("s1_streamed_visibility", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS engine, count(*) AS answers, count(json_extract_string(props, '$.k')) AS citations, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS domain_sum FROM events GROUP BY 1, 2")
def s1(spark, d):
    return visibility.run_available(spark, d)
