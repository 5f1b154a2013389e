"""Screening votes as a stream: late and repeated ones, and a running state for the reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.functions import text as X


def read_votes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def distinct_votes(votes: DataFrame, late: str = "30 days") -> DataFrame:
    """Each decision_id once, as long as its repetition arrives within ``late``."""
    return votes.withColumn("received_at", F.col("received_at").cast("timestamp")).where("decision_id IS NOT NULL").withWatermark("received_at", late).dropDuplicatesWithinWatermark(["decision_id"])


def daily(votes: DataFrame) -> DataFrame:
    """(window, reviewer, label, n): votes by day of receipt."""
    return votes.groupBy(F.window("received_at", "1 day"), "reviewer", X.label(F.col("decision")).alias("label")).agg(F.count("*").alias("n"))
