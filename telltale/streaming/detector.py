"""The hourly detector on a stream: event-time windows and a watermark, then the batch operators on what is complete."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telltale.scratch import Scratch


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Mean value of each event type and hour; state of an hour goes when the watermark has passed it."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return timed.groupBy(F.window("t", "1 hour"), F.col("event_type").alias("series")).agg(F.avg("value").alias("value")).select("series", F.col("window.start").cast("timestamp_ntz").alias("ts"), "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Active periods of each user: rows no more than `gap` apart."""
    timed = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", late)
    return timed.groupBy(F.session_window("t", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n", "total")


def run(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Starts a query that works off what is there and ends; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet(folder)


def replayed(rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make (a stream to a stream) gives for a finite table (network, ts, ...) played as a stream to its end.

    A row ten years behind the last, with its texts and nothing else, lets the watermark pass all others and is itself
    never passed. It is of a known network, because Spark leaves rows that a later join can't match out below the watermark.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    texts = [c for c, t in rows.dtypes if t == "string"]
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts"), *[F.max_by(c, "ts").alias(c) for c in texts])
    end = last.select(*[F.col(c).cast(t).alias(c) if c in [*texts, "ts"] else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
    source = scratch.cut(rows.unionByName(end))
    out = make(spark.readStream.schema(source.schema).parquet(source.scratch_path))
    run(out, f"{scratch.dir}/told", f"{scratch.dir}/progress").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{scratch.dir}/told")
