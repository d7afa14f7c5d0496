"""Rank statistics and agreement as DataFrame operators grouped by any keys.

Undefined values follow one rule each, stated where they arise: a correlation with a constant side is 0, the AUC with one
class is 0.5, the Jaccard of two empty sets is null.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbank.session import dense_index, ship


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """num / den; ``empty`` where den is 0 or null."""
    out = num / F.nullif(den, F.lit(0))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank of ``value`` within the keys; ties share their mean rank.

    Without keys the order of all values is made by range partitions: a value's ranks are the mean of its rows' places.
    """
    if not keys:
        placed = dense_index(df.select(value), value, name="_rank").groupBy(value).agg(((F.min("_rank") + F.max("_rank")) / 2 + 1).alias(name))
        return df.join(placed.withColumnRenamed(value, "_v"), F.col(value).eqNullSafe(F.col("_v"))).drop("_v")
    by = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(name, F.rank().over(by.orderBy(value)) + (ties - 1) / 2)


def pearson_of(x: str, y: str) -> Column:
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.coalesce(F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(pearson_of(x, y).alias("r"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return pearson(ranked, keys, "_rx", "_ry")


def kendall(df: DataFrame, keys: list[str], item: str, x: str, y: str) -> DataFrame:
    """tau-b: over all pairs of each group's items, for groups of some hundred (domains, engines); without keys over all rows."""
    if not keys:
        return _kendall_of_all(df, x, y)
    a = df.select(*keys, F.col(item).alias("_i"), F.col(x).alias("_x1"), F.col(y).alias("_y1"))
    b = df.select(*keys, F.col(item).alias("_j"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    dx, dy = F.signum(F.col("_x1") - F.col("_x2")), F.signum(F.col("_y1") - F.col("_y2"))
    pairs = a.join(b, keys).where("_i < _j").select(*keys, dx.alias("dx"), dy.alias("dy"))
    sums = pairs.groupBy(*keys).agg(F.sum(F.col("dx") * F.col("dy")).alias("_s"), F.sum(F.abs("dx")).alias("_px"), F.sum(F.abs("dy")).alias("_py"))
    return sums.select(*keys, ratio(F.col("_s"), F.sqrt(F.col("_px") * F.col("_py"))).alias("tau"))


def inversions(values: np.ndarray) -> int:
    """Pairs of places of which the earlier has the greater value."""
    if len(values) <= 64:
        return int(np.triu(values[:, None] > values[None, :], 1).sum())
    first, second = values[: len(values) // 2], values[len(values) // 2 :]
    across = len(first) * len(second) - int(np.searchsorted(np.sort(first), second, "right").sum())
    return inversions(first) + inversions(second) + across


#: Rows of a block of places, at least, and blocks at most.
BLOCK_ROWS, BLOCKS = 100_000, 1_000


def _kendall_of_all(df: DataFrame, x: str, y: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row: tau-b without making pairs. Rows without x or y take no part.

    Each row has a place by (x, y) and one by y; discordant pairs are the inversions between the two orders. They are
    counted inside blocks of the first order, inside blocks of the second, and from the sizes of the blocks' meets.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    placed = dense_index(dense_index(rows, "_x", "_y", name="_p"), "_y", "_p", name="_q")
    n = placed.count()
    size = max(block_rows, -(-n // BLOCKS))
    both = placed.select("_p", "_q", F.floor(F.col("_p") / size).alias("_a"), F.floor(F.col("_q") / size).alias("_b"))

    def inside(order: str, value: str):
        def count(table: pa.Table) -> pa.Table:
            return pa.table({"n": pa.array([inversions(table.sort_by(order).column(value).to_numpy())], pa.int64())})

        return count

    first = both.groupBy("_a").applyInArrow(inside("_p", "_q"), "n bigint")
    second = both.groupBy("_b").applyInArrow(inside("_q", "_a"), "n bigint")
    discordant = int(first.unionByName(second).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    meets = np.zeros((-(-n // size), -(-n // size)))
    for r in both.groupBy("_a", "_b").agg(F.count("*").alias("n")).collect():  # BLOCKS squared at most
        meets[r["_a"], r["_b"]] = r["n"]
    before = np.vstack([np.zeros((1, meets.shape[1])), meets.cumsum(axis=0)[:-1]]) if n else meets  # earlier blocks of the first order
    later = before[:, ::-1].cumsum(axis=1)[:, ::-1] - before  # and later ones of the second
    discordant += int((meets * later).sum())
    ties = lambda *c: rows.groupBy(*c).agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.expr("t * (t - 1) DIV 2")), F.lit(0))).first()[0]
    pairs, tx, ty, txy = n * (n - 1) // 2, ties("_x"), ties("_y"), ties("_x", "_y")
    spread = math.sqrt((pairs - tx) * (pairs - ty))
    return df.sparkSession.createDataFrame([((pairs - tx - ty + txy - 2 * discordant) / spread if spread else 0.0,)], "tau double")


def auc(df: DataFrame, keys: list[str], score: str, label: str, order: str) -> DataFrame:
    """Mann-Whitney AUC from 1-based places by score, ``order`` deciding ties; 0.5 where a class is missing."""
    if keys:
        placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(score, order)))
    else:  # one order of all rows: by range partitions, not in one task
        placed = dense_index(df, score, order, name="_place").withColumn("_place", F.col("_place") + 1)
    pos, all_ = F.sum(label).cast("double"), F.count(F.lit(1)).cast("double")
    sums = F.sum(F.when(F.col(label) == 1, F.col("_place")).otherwise(0)).cast("double")
    value = (sums - pos * (pos + 1) / 2) / F.nullif(pos * (all_ - pos), F.lit(0.0))
    return placed.groupBy(*keys).agg(F.coalesce(value, F.lit(0.5)).alias("auc"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two 0/1 raters beyond chance; 1 where chance alone agrees everywhere."""
    one = df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return one.select(F.round("po", 6).alias("agreement"), F.round(F.coalesce((F.col("po") - chance) / F.nullif(1 - chance, F.lit(0.0)), F.lit(1.0)), 6).alias("kappa"))


def krippendorff(df: DataFrame, item: str, value: str) -> DataFrame:
    """Nominal alpha from long ratings; items with one rating take no part; null ratings are missing."""
    each = df.where(F.col(value).isNotNull()).groupBy(item, value).agg(F.count(F.lit(1)).cast("double").alias("c"))
    sized = each.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.collect_list(F.struct(F.col(value).alias("v"), "c")).alias("cs")).where("m > 1")
    disagree = sized.agg(F.sum((F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1)).alias("d"), F.sum("m").alias("n"))
    margin = sized.select(F.explode("cs").alias("x")).groupBy("x.v").agg(F.sum("x.c").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("tt"))
    both = disagree.crossJoin(margin)  # one row each
    expected = (F.col("n") * F.col("n") - F.col("tt")) / (F.col("n") - 1)
    return both.select(F.round(F.coalesce(1 - F.col("d") / F.nullif(expected, F.lit(0.0)), F.lit(1.0)), 6).alias("alpha"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def holm(df: DataFrame, p: str, order: str) -> DataFrame:
    """``df`` with ``adjusted``: the running maximum of (m - k) p, at most 1. For the few tests of a report."""
    by = Window.orderBy(p, order)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(by) + 1) * F.col(p))
    return df.withColumn("_s", step).withColumn("adjusted", F.max("_s").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def spearman_brown(r: Column) -> Column:
    return ratio(2 * r, 1 + r)


def disattenuated(rho: Column, r1: Column, r2: Column) -> Column:
    return rho / F.sqrt(F.greatest(F.lit(1e-6), r1 * r2))


#: A unit's side in random split b: the parity of (unit * SIDE[0] + b * SIDE[1]) mod SIDE[2].
SIDE = (7919, 104729, 1009)


@functools.lru_cache(1)
def _first_side() -> np.ndarray:
    """Row u, column c: 1 where (u * SIDE[0] + c) mod SIDE[2] is even."""
    c = np.arange(SIDE[2])
    return ((c[:, None] * SIDE[0] + c[None]) % SIDE[2] % 2 == 0).astype(np.float64)


def random_halves(cells: DataFrame, splits: int) -> DataFrame:
    """g, b, domain, x and y: what either half of the units cites of each domain, for ``splits`` random halvings.

    ``cells`` has g, unit (an integer), domain and n. A unit's sides follow from its remainder by SIDE[2], and so units of
    one remainder are one; a task then holds the remainders of one domain, whatever the number of units and domains.
    """
    ship(cells.sparkSession)
    kind = cells.schema["g"].dataType.simpleString()
    at = np.arange(splits) * SIDE[1] % SIDE[2]

    def run(table: pa.Table) -> pa.Table:
        n = np.zeros(SIDE[2])
        n[table.column("u").to_numpy()] = table.column("n").to_numpy()  # whole numbers, exact in a double
        x = np.rint(n @ _first_side()).astype(np.int64)[at]
        key = {c: pa.array([table.column(c)[0].as_py()] * splits, table.schema.field(c).type) for c in ("g", "domain")}
        return pa.table({"g": key["g"], "b": np.arange(splits), "domain": key["domain"], "x": x, "y": np.int64(n.sum()) - x})

    known = F.when(F.col("unit").isNotNull(), F.col("n")).otherwise(0)  # without a unit on neither side
    parts = cells.select("g", F.pmod(F.coalesce(F.col("unit").cast("bigint"), F.lit(0)), F.lit(SIDE[2])).alias("u"), F.col("domain").cast("bigint").alias("domain"), known.cast("bigint").alias("n"))
    summed = parts.groupBy("g", "domain", "u").agg(F.sum("n").alias("n"))
    return summed.groupBy("g", "domain").applyInArrow(run, f"g {kind}, b bigint, domain bigint, x bigint, y bigint")
