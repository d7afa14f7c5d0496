"""Nearest cluster, coverage and recall over vectors (id, v) and clusters (cid, centroid, weight).

Clusters are a model of bounded size: they go to the executors behind a check of their number, as one matrix, and the
vectors pass by it in Arrow batches. Beyond the bound the same argmax is a join and an aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbank.functions import numbers as N
from quillbank.session import ship

#: Clusters times dimensions that are sent to executors at most (64 MB of doubles).
MODEL_CELLS = 8_000_000


def checked(clusters: DataFrame) -> DataFrame:
    """``clusters`` marked for a broadcast where their centroids have at most MODEL_CELLS numbers, else as they are."""
    cells = clusters.select(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    return F.broadcast(clusters) if cells <= MODEL_CELLS else clusters


def centroids(vectors: DataFrame, label: str = "cid", value: str = "v") -> DataFrame:
    """cid, centroid (unit mean), weight = ln(1 + members), members."""
    each = vectors.select(label, F.posexplode(value).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    mean = each.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    size = vectors.groupBy(label).agg(F.count("*").alias("members"))
    return mean.join(size, label).select(F.col(label).alias("cid"), N.normalize(F.col("c")).alias("centroid"), F.log1p("members").alias("weight"), "members")


def nearest(vectors: DataFrame, clusters: DataFrame, exclude: str | None = None) -> DataFrame:
    """id, cid, sim: the cluster of greatest cosine to each vector, of equals the least cid.

    ``exclude`` names a column of ``vectors``, a cid that is not to be chosen. Zero vectors have similarity 0 to all.
    """
    ship(vectors.sparkSession)
    cells = clusters.select(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
    if cells > MODEL_CELLS:
        return _nearest_by_join(vectors, clusters, exclude)
    held = clusters.select("cid", "centroid").orderBy("cid").collect()
    ids, matrix = np.array([r["cid"] for r in held], np.int64), np.array([r["centroid"] for r in held], np.float64)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if len(matrix) else matrix

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            column = batch.column("v")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            sim = (x / np.where(length > 0, length, 1)) @ matrix.T
            if exclude:
                sim[ids[None, :] == np.array(batch.column(exclude).to_pylist(), object)[:, None]] = -np.inf
            sim = np.round(sim, 12)  # ties within rounding go to the least cid
            best = sim.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids[best]), pa.array(sim[np.arange(len(best)), best])], names=["id", "cid", "sim"])

    return vectors.select("id", N.as_doubles(F.col("v")).alias("v"), *([exclude] if exclude else [])).mapInArrow(run, "id bigint, cid bigint, sim double")


def _nearest_by_join(vectors: DataFrame, clusters: DataFrame, exclude: str | None) -> DataFrame:
    pairs = vectors.crossJoin(clusters.select("cid", "centroid"))  # a stated model against all rows
    pairs = pairs.where(F.col("cid") != F.col(exclude)) if exclude else pairs
    sim = F.round(N.cosine(N.as_doubles(F.col("v")), F.col("centroid")), 12)
    best = pairs.groupBy("id").agg(F.max(F.struct(sim.alias("s"), (-F.col("cid")).alias("c"))).alias("b"))
    return best.select("id", (-F.col("b.c")).cast("bigint").alias("cid"), F.col("b.s").alias("sim"))


def coverage(chosen: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: weight of the clusters that ``chosen`` (cid) has, over all weight."""
    hit = clusters.join(chosen.select("cid").distinct().withColumn("hit", F.lit(1)), "cid", "left")
    return hit.agg((F.sum(F.when(F.col("hit") == 1, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("coverage"))
