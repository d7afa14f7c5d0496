"""Near-duplicate documents by min-max hashing.

A sketch keeps both the least and the greatest value of a document's shingle set under each of PERMUTATIONS permutations,
so each hash evaluation gives two signature values. BANDS bands of ROWS values become bucket keys: two sets of similarity
0.8 miss each other with probability (1 - 0.8^6)^48, below 5e-7. Equal sets are one class from the start, so copies never
meet in a bucket. From there on:

* Rounds of stars: every bucket whose members are not yet in one component picks some members as centres, and the others
  of other components are held against them on their full sets. Verified links join components. A bucket costs its size,
  not its square.
* What is still apart in a shared bucket is settled exactly by prefix filtering: sets whose rarest shingles do not meet
  cannot be similar. Only pairs of different components that share such a shingle are verified, so no link is lost.

All sets, buckets, links and components stay in tables. Joins are sort-merge joins at every size, so that the plan does not
change as tables grow and adaptive execution can split hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.llm.shared import LOWER, UPPER, cut, mix64, read, ship

PERMUTATIONS, ROWS = 144, 6
BANDS = 2 * PERMUTATIONS // ROWS
#: Centres that a bucket picks in each round of stars: most groups are whole after one, the rest takes several at once.
STARS = (1, 5)
#: Shingles that are sketched together, so that they stay in a core's cache.
BLOCK = 100_000

_seeded = np.random.default_rng(20240229)
MULTIPLY = _seeded.integers(0, 2**32, PERMUTATIONS, np.uint32) | np.uint32(1)
ADD = _seeded.integers(0, 2**32, PERMUTATIONS, np.uint32)
BAND_WEIGHTS = _seeded.integers(0, 2**63, (BANDS, ROWS), np.uint64) | np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words as sorted 64-bit hashes; a shorter text is one shingle, without words none."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width * 0xD1B54A32D192ED03 % 2**64))
    for j in range(width):
        out = out * POWER + each[j : j + n]
    return np.unique(mix64(out))


def sketch(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart, and the bucket keys (0 for empty sets), a row for each set."""
    sums, keys = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    lo = 0
    while lo < len(full):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[full[lo:]]), BLOCK, "right")))
        block = full[lo:hi]
        flat = np.concatenate([sets[i] for i in block])
        starts = np.cumsum(sizes[block]) - sizes[block]
        sums[block, 0] = np.add.reduceat(flat, starts)
        sums[block, 1] = np.add.reduceat(mix64(flat ^ POWER), starts)
        short = (flat >> np.uint64(32)).astype(np.uint32)
        least, most = np.empty((2, PERMUTATIONS, len(block)), np.uint32)
        value = np.empty_like(short)
        for k in range(PERMUTATIONS):
            np.multiply(short, MULTIPLY[k], out=value)
            np.add(value, ADD[k], out=value)
            np.minimum.reduceat(value, starts, out=least[k])
            np.maximum.reduceat(value, starts, out=most[k])
        signature = np.concatenate([least, most]).T.reshape(len(block), BANDS, ROWS).astype(np.uint64)
        keys[block] = mix64((signature * BAND_WEIGHTS).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * POWER)
        lo = hi
    return sums, keys


#: 128 bits of a row's doc_id and text, never null: equal rows share a key, other rows have their own.
ROW = ["_minmax_row_a", "_minmax_row_b"]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({ROW[0]: F.xxhash64("doc_id", "text"), ROW[1]: F.xxhash64(F.lit(1), "doc_id", "text")})


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sketched(docs: DataFrame, width: int) -> DataFrame:
    """The columns of ``docs`` but text, n_shingles, a, b (a set's sums) and keys, an array of bucket keys."""
    ship(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sets = [shingle_set(t.as_py(), width) for t in part.column("text")]
                sums, keys = sketch(sets)
                sizes = np.array([len(s) for s in sets], np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), _long(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(sizes), _long(sums[:, 0]), _long(sums[:, 1]), listed], names=[*others, "n_shingles", "a", "b", "keys"])

    kept = "".join(f"`{c}` bigint, " for c in others)
    return docs.mapInArrow(run, kept + "n_shingles bigint, a bigint, b bigint, keys array<bigint>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """node and shingles, the full set."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                sets = [shingle_set(t.as_py(), width) for t in part.column("text")]
                ends = np.cumsum([0] + [len(s) for s in sets])
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(flat))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node bigint, shingles array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that can be reached, for every node of ``edges`` (u, v) that is not its own root.

    Alternating large-star and small-star steps; each iteration is cut, and ends when no edge changes.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after joining the components that ``links`` (u, v: labels) connect."""
    found = components(links)
    return cut(labels.join(found.select(F.col("node").alias("label"), "root").hint("merge"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (x, y, ...) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("_xs"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("_ys"))
    both = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y").withColumn("_shared", F.size(F.array_intersect("_xs", "_ys")).cast("long"))
    return both.where(100 * F.col("_shared") >= percent * (F.size("_xs") + F.size("_ys") - F.col("_shared"))).select(*pairs.columns)


def _any(df: DataFrame) -> bool:
    return bool(df.take(1))


def _apart(members: DataFrame, labels: DataFrame, stars: int) -> DataFrame:
    """Members (key, node, label) of the buckets that hold more than one component, with ``stars`` centres and their labels."""
    told = members.join(labels.hint("merge"), "node")
    centre = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), F.col("node").alias("node"), F.col("label").alias("label")))
    split = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *[centre(k).alias(f"c{k}") for k in range(stars)]).where("lo <> hi")
    return told.join(split.select("key", F.array(*[f"c{k}" for k in range(stars)]).alias("centres")).hint("merge"), "key")


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, u, v: their labels) of different components among ``nodes`` that share one of their rarest shingles.

    With shingles in one order for all, two sets of the given similarity share one of the first n - ceil(t n) + 1. The
    order is by how many of these sets hold a shingle, so those that one set has alone come first and match nothing.
    At the first shingle that two sets share, what is left of either bounds their intersection from above; a row on which
    that bound is too low is not the first shared one of a similar pair, and is not made. Every pair of different
    components has a member outside the shingle's most common component; that side leads.
    """
    each = sets.join(nodes.hint("merge"), "node", "left_semi").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    # Written, as the tables below: a join whose sides are both dealt anew can be split where one shingle is very common.
    often = cut(each.groupBy("s").agg(F.count("*").alias("f")).where("f > 1"))
    need = F.expr(f"CAST(n - CAST(ceil(n * {percent} / 100.0D) AS INT) + 1 AS INT)")
    rare = each.join(often.hint("merge"), "s", "left").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("f", F.lit(1).cast("bigint")).alias("f"), "s"))).alias("all"))
    first = rare.select("node", "n", F.posexplode(F.slice("all", F.lit(1), need)).alias("at", "x")).where("x.f > 1").select("node", "n", (F.col("n") - F.col("at")).alias("left"), "x.s")
    posted = cut(first.join(labels.hint("merge"), "node"))
    main = cut(posted.groupBy("s", "label").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "label")).alias("m"), F.count("*").alias("labels")).where("labels > 1").select("s", F.col("m.label").alias("main")))
    some = cut(posted.join(main.hint("merge"), "s"))
    lead = some.where("label <> main").select("s", F.col("node").alias("x"), F.col("label").alias("u"), F.col("n").alias("nx"), F.col("left").alias("lx"), "main")
    other = some.select("s", F.col("node").alias("y"), F.col("label").alias("v"), F.col("n").alias("ny"), F.col("left").alias("ly"))
    enough = (100 + percent) * F.least("lx", "ly") >= percent * (F.col("nx") + F.col("ny"))  # intersection >= t / (1 + t) of both sizes
    fits = (F.col("u") != F.col("v")) & enough & ((F.col("v") == F.col("main")) | (F.col("x") < F.col("y")))
    return lead.join(other.hint("merge"), "s").where(fits).select("x", "y", "u", "v").distinct()


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, ROW, n_shingles and component_id of each row of ``docs`` (doc_id, text, ROW); null where a set is empty.

    Rows with equal sets are one class from the start, and classes are told apart by their sets, not by a doc_id, so rows
    that share an id but not a text do not link.
    """
    known = cut(_sketched(docs, width))
    holder = F.min(F.struct(*ROW))  # a row that has the set
    classes = known.where("n_shingles > 0").groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("first"), holder.alias("holder"), F.any_value("keys").alias("keys"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    placed = classes.select(F.explode("keys").alias("key"), "node")
    shared = placed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = cut(placed.join(shared.hint("merge"), "key"))
    nodes = cut(members.select("node").distinct())
    holders = classes.join(nodes.hint("merge"), "node").select("node", "holder.*")
    texts = docs.join(holders.hint("merge"), ROW).select("node", "text")
    sets = cut(_sets(texts, width).dropDuplicates(["node"]))  # a row that is repeated gives its set again
    labels = nodes.select("node", F.col("node").alias("label"))
    for stars in STARS:
        apart = _apart(members, labels, stars).select(F.col("node").alias("x"), F.col("label").alias("u"), F.explode("centres").alias("c"))
        pairs = apart.select("x", F.col("c.node").alias("y"), "u", F.col("c.label").alias("v")).where("u <> v").distinct()
        links = cut(_verified(pairs, sets, percent).select("u", "v").distinct())
        if not _any(links):
            break
        labels = _relabel(labels, links)
    rest = cut(_apart(members, labels, 1).select("node").distinct())
    if _any(rest):
        pairs = cut(_prefix_pairs(rest, sets, labels, percent))
        links = cut(_verified(pairs, sets, percent).select("u", "v").distinct())
        if _any(links):
            labels = _relabel(labels, links)
    named = classes.select("n_shingles", "a", "b", "node", "first").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least.hint("merge"), "label").select("n_shingles", "a", "b", "component_id")
    return known.select("doc_id", *ROW, "n_shingles", "a", "b").join(named.hint("merge"), ["n_shingles", "a", "b"], "left").select("doc_id", *ROW, "n_shingles", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are not read).

    Texts without words, null or empty, have no shingles and are linked with nothing. Equal texts are linked. Rows that
    repeat a doc_id with the same text fall into one component; rows that repeat it with other texts are documents of
    their own. doc_id is cast to a long; a row without one takes part by its text but gets a null kept. component_id is
    the least doc_id of the component; kept holds for the rows that carry it.
    """
    found = _grouped(_keyed(docs.select(F.col("doc_id").cast("long"), "text")), width, percent)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of each group of near duplicates, with all their columns.

    Rows are removed by doc_id and text together, so another text of the same id stays. Rows without a doc_id stay, and
    rows that repeat both the id and the text that stay.
    """
    keyed = _keyed(docs.withColumn("_minmax_own_id", F.col("doc_id")).withColumn("doc_id", F.col("doc_id").cast("long")))
    found = _grouped(keyed.select("doc_id", "text", *ROW), width, percent)
    gone = cut(found.where("n_shingles > 0 AND doc_id <> component_id").select(*ROW).distinct())
    return keyed.join(gone.hint("merge"), ROW, "left_anti").withColumn("doc_id", F.col("_minmax_own_id")).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


_WORDS = f"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^ \\t-\\r]+'), [])"
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
