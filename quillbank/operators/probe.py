"""Citation logs: folds, domain universes, completed grids and visibility, in long form.

A log has q (query), engine, rep, domain and ts; one row is one answer that cites one domain. Trials are answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold(log: DataFrame) -> DataFrame:
    """q, engine, domain, n: how often each domain was cited."""
    return log.where("domain IS NOT NULL").groupBy("q", "engine", "domain").agg(F.count("*").alias("n"))


def trials(log: DataFrame) -> DataFrame:
    return log.groupBy("q", "engine").agg(F.count("*").alias("trials"))


def universe(log: DataFrame, min_queries: int = 5, most: int = 60) -> DataFrame:
    """The domains that enough queries cite, the most cited first; of equals the one that sorts first."""
    counts = log.where("domain IS NOT NULL").groupBy("domain").agg(F.count_distinct("q").alias("queries"))
    return counts.where(F.col("queries") >= min_queries).orderBy(F.desc("queries"), "domain").limit(most)


def visibility(log: DataFrame, domains: DataFrame, keys: tuple[str, ...] = ("engine",)) -> DataFrame:
    """Citations over trials of every domain of the universe within the keys, 0 where it is never cited."""
    domains = F.broadcast(domains.select("domain"))  # bounded by the universe
    total = log.groupBy(*keys).agg(F.count("*").alias("trials"))
    cited = log.join(domains, "domain").groupBy(*keys, "domain").agg(F.count("*").alias("n"))
    grid = total.crossJoin(domains)  # each key with each domain of the universe, by definition
    return grid.join(cited, [*keys, "domain"], "left").select(*keys, "domain", F.coalesce("n", F.lit(0)).alias("n"), "trials", (F.coalesce("n", F.lit(0)) / F.col("trials")).alias("rate"))


def response_grid(log: DataFrame, domains: DataFrame) -> DataFrame:
    """q, engine, domain, succ, trials for every query, engine and domain of the universe."""
    grid = trials(log).crossJoin(F.broadcast(domains.select("domain")))
    return grid.join(fold(log), ["q", "engine", "domain"], "left").select("q", "engine", "domain", F.coalesce("n", F.lit(0)).alias("succ"), "trials")


def top_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The first k rows of each key with their place, by a total order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")).where(F.col("place") <= k)
