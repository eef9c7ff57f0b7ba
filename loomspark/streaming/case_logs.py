"""Case logs that arrive as files: the batch operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.dedup import task_key
from loomspark.sources.readers import CASE_LOG


def stream_case_logs(spark: SparkSession, path: str, schema: str = CASE_LOG, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def distinct_failures(logs: DataFrame, watermark: str = "1 hour", time: str = "seen_at") -> DataFrame:
    """Failed cases with a task, each once within the watermark: state is dropped as time goes on."""
    failed = logs.where(~F.coalesce("pass_at_1", F.lit(False)) & (F.coalesce("prompt", F.lit("")) != "") & (F.coalesce("tests", F.lit("")) != ""))
    if time not in failed.columns:
        failed = failed.withColumn(time, F.current_timestamp())
    return failed.withColumn("task_key", task_key(F.col("prompt"), F.col("tests"))).withWatermark(time, watermark).dropDuplicatesWithinWatermark(["task_key"])


def error_rates(logs: DataFrame, window: str = "10 minutes", watermark: str = "1 hour", time: str = "seen_at") -> DataFrame:
    """Cases and passes per benchmark and window of time."""
    return logs.withWatermark(time, watermark).groupBy(F.window(time, window), "benchmark").agg(F.count("*").alias("total"), F.count_if("pass_at_1").alias("passed"))
