"""Constraints as frames of their violations: empty where they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, known: DataFrame, key: str = "corpus_id", name: str = "unknown id") -> DataFrame:
    return df.select(key).distinct().join(known.select(key).distinct(), key, "left_anti").select(F.lit(name).alias("check"), F.col(key).cast("string").alias("what"))


def repeated(df: DataFrame, key: str = "corpus_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("check"), F.col(key).cast("string").alias("what"))


def size_is(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where(F.col("n") != n).select(F.lit("size").alias("check"), F.col("n").cast("string").alias("what"))


def partition_of(parts: DataFrame, whole: DataFrame, key: str = "corpus_id") -> DataFrame:
    """Ids that a split lost, made up, or dealt twice."""
    return not_in(whole, parts, key, "lost").union(not_in(parts, whole, key, "made up")).union(repeated(parts, key))


def overlap(ratings: DataFrame) -> DataFrame:
    """A row if no unit was rated by two raters."""
    n = ratings.groupBy("unit").agg(F.countDistinct("rater").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    return n.where("n < 2").select(F.lit("no overlap").alias("check"), F.col("n").cast("string").alias("what"))


def unreadable(decisions: DataFrame) -> DataFrame:
    return decisions.where("corpus_id IS NULL").select(F.lit("unreadable file").alias("check"), F.col("file").alias("what")).distinct()


def require(violations: DataFrame, most: int = 10) -> None:
    """Raises with the first examples unless there are no violations."""
    if rows := violations.limit(most).collect():
        raise ValueError("; ".join(f"{r[0]}: {r[1]}" for r in rows))
