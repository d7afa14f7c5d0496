"""The fold of a citation log as a stream: counts by day and engine, with late rows and repeats held to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbank.sources import files


def daily_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, engine, answers and the sum of domains, from rows (event_id, ts, event_type, props); an event counts once."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    domain = F.get_json_object("props", "$.k").cast("bigint")
    return rows.groupBy(F.window("ts", "1 day").alias("w"), F.col("event_type").alias("engine")).agg(F.count("*").alias("answers"), F.count(domain).alias("citations"), F.sum(domain).alias("domain_sum"))


def run_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events that are there now, through the stream, as a table.

    Each micro-batch appends the windows it changed to a table in the shared scratch folder, where the query's checkpoint
    is too; a window's last row counts. A batch that is run again after a failure appends equal rows under its number.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    path = files.scratch_path(spark)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}/rows")

    running = daily_counts(stream).writeStream.foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    running.awaitTermination()
    changed = spark.read.parquet(f"{path}/rows")
    last = changed.groupBy("w", "engine").agg(F.max_by(F.struct("answers", "citations", "domain_sum"), "batch").alias("x"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "engine", "x.*")
