"""The stage log of jobs in batch, and windowed counts of events; jobs.py has the log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_log(events: DataFrame) -> DataFrame:
    """One row for each job and stage of a log (job_id, key, state, detail, ts, seq).

    The last state, the last detail that is not empty, seconds since the first sighting, and the
    stage's place by first sighting.
    """
    detail = F.nullif(F.col("detail"), F.lit(""))
    out = events.groupBy("job_id", "key").agg(
        F.max_by("state", F.struct("ts", "seq")).alias("state"),
        F.max_by(detail, F.when(detail.isNotNull(), F.struct("ts", "seq"))).alias("detail"),
        F.min(F.struct("ts", "seq")).alias("_first"),
        F.max("ts").alias("_last"),
    )
    seconds = F.unix_micros(F.col("_last").cast("timestamp")) - F.unix_micros(F.col("_first.ts").cast("timestamp"))
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("_first"))
    return out.withColumn("seconds", F.round(seconds / 1e6, 2)).withColumn("place", place).drop("_first", "_last")


def job_progress(log: DataFrame) -> DataFrame:
    """job_id, finished, stages: how many stages are done or skipped."""
    return log.groupBy("job_id").agg(F.count_if(F.col("state").isin("done", "skipped")).alias("finished"), F.count(F.lit(1)).alias("stages"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows; late rows go after the watermark."""
    of = events.withWatermark("ts", late) if events.isStreaming else events
    return of.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: rows less than `gap` apart."""
    of = events.withWatermark("ts", late) if events.isStreaming else events
    return of.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
