"""CSV, JSON and the stats document."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOGUE = ("source_record_id", "source_db", "source_file", "status", "corpus_id", "cluster_size", "type", "year", "doi", "title", "authors", "venue")


def catalogue(rows: DataFrame) -> DataFrame:
    """The catalogue of ``golden.disposition`` rows, lists joined and missing values empty."""
    r = rows.withColumn("source_record_id", F.format_string("S%05d", "idx")).withColumn("corpus_id", F.format_string("C%04d", "cid")).withColumn("cluster_size", F.col("n_in_cluster")).withColumn("authors", F.array_join("authors", "; "))
    return r.select(*(c if c == "cluster_size" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CATALOGUE))


def guard(df: DataFrame, path: str, force: bool) -> None:
    """Raises where there is something at the path already, unless ``force``: it may hold somebody's work."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not force and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileExistsError(f"{path} exists; pass force=True to overwrite it")


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    guard(df, path, force)
    flat = df.select(*(F.array_join(c, "; ").alias(c) if k.startswith("array<string") else F.col(c) for c, k in df.dtypes))
    flat.write.mode("overwrite").csv(path, header=True, escape='"', quote='"', emptyValue="")


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    """One JSON object per line; lists stay lists."""
    guard(df, path, force)
    df.write.mode("overwrite").json(path)


def upsert_stats(path: str, block: str, values: dict) -> dict:
    """Sets one block of the stats document, a small JSON file beside the reports, and keeps the others."""
    stats = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            stats = json.load(f)
    stats[block] = values
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(stats, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.new", path)
    return stats
