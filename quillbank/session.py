"""Session settings and the places that operators need from a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in ``spark.checkpoint.dir``; a local folder serves only where the session names none."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def dense_index(df: DataFrame, *order, name: str = "id") -> DataFrame:
    """``df`` with 0, 1, 2 ... in the given total order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; each partition's count, one number each, gives the offset of the next.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part bigint, _offset bigint")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + within).drop("_at", "_offset", "_part")


def running(df: DataFrame, value: str, *order, how: str = "sum", name: str = "running") -> DataFrame:
    """``df`` with the sum or the greatest of ``value`` up to each row in the given total order, without one task for all rows.

    As ``dense_index``: range partitions, one total for each of them, and a window inside each.
    """
    placed = checkpointed(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    fold = F.sum if how == "sum" else F.max
    totals = sorted((r["_part"], r["t"]) for r in placed.groupBy("_part").agg(fold(value).alias("t")).collect())
    before, total = [], None
    for part, t in totals:
        before.append((part, total))
        total = t if total is None else total if t is None else total + t if how == "sum" else max(total, t)
    kind = "bigint" if df.schema[value].dataType.simpleString() in ("int", "bigint") else "double"
    table = df.sparkSession.createDataFrame(before or [(0, None)], f"_part bigint, _before {kind}")
    own = fold(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    both = placed.withColumn(name, own).join(F.broadcast(table), "_part")
    out = F.when(F.col("_before").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("_before")).otherwise(F.col("_before") + F.col(name) if how == "sum" else F.greatest("_before", name))
    return both.withColumn(name, out).drop("_at", "_part", "_before")
