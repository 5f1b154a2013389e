"""Global positions without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.session import cut, partitions


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds ``name``, the position of each row in the given order, from 1. The order must have no ties.

    Rows are spread by ranges of the order and sorted there; what is counted together is a row per partition.
    """
    d = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    d = cut(d.withColumn("__at", F.monotonically_increasing_id()))  # the partition above bit 33, the place in it below
    d = d.withColumn("__p", F.shiftright("__at", 33))
    n = d.groupBy("__p").agg(F.count("*").alias("n"))
    before = n.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return d.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__p", "__at", "__b")


def ranked_within(df: DataFrame, name: str, group: str, *order: Column | str) -> DataFrame:
    """Adds ``name``, the position of each row within its group, from 1; a group may hold any share of the rows."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("n"))
    before = n.select("__g", F.coalesce(F.sum("n").over(W.orderBy("__g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return ranked(df, name, group, *order).join(before, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col(name) - F.col("__before")).drop("__g", "__before")
