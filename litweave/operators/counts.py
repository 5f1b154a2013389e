"""Counts, shares, coverage, pivots and rankings of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.functions import text as X


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def combos(df: DataFrame, array: str, name: str = "combo") -> DataFrame:
    """Counts by the members of an array, joined in their order."""
    return df.groupBy(F.array_join(array, " + ").alias(name)).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, *fields: str) -> DataFrame:
    """(field, total, missing, pct): how many rows have each field; an empty one is missing."""
    kinds = dict(df.dtypes)
    empty = lambda c: ~F.coalesce(F.size(c) > 0, F.lit(False)) if kinds[c].startswith("array") else F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    one = df.agg(F.count("*").alias("total"), *(F.count_if(empty(c)).alias(c) for c in fields))
    return one.unpivot(["total"], list(fields), "field", "missing").select("field", "total", "missing", X.pct(F.col("total") - F.col("missing"), F.col("total")).alias("pct"))


def by_disposition(df: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, identified, removed, retained) and a row Total."""
    g = df.groupBy(key).agg(F.count("*").alias("identified"), F.count_if(F.col(status) == "duplicate-removed").alias("removed"), F.count_if(F.col(status) == "retained").alias("retained"))
    return g.union(g.agg(F.lit("Total"), F.sum("identified"), F.sum("removed"), F.sum("retained")))


def code_counts(df: DataFrame, prefix: str, codes: str = "codes", decision: str | None = None) -> DataFrame:
    """(code, n, share): rows with each code that begins with ``prefix``, as a share of all rows of the decision."""
    d = df if decision is None else df.where(F.col("decision") == decision)
    each = d.select(F.explode(F.array_distinct(codes)).alias("code")).where(F.col("code").startswith(prefix)).groupBy("code").agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(d.agg(F.count("*").alias("all")))).select("code", "n", X.pct(F.col("n"), F.col("all")).alias("share"))  # one row of totals


def labelled(counts: DataFrame, labels: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``label`` to counts by code, from (code, label); an unknown code has an empty one."""
    return counts.join(labels.select(F.col("code").alias(code), "label").dropDuplicates([code]), code, "left").withColumn("label", F.coalesce("label", F.lit("")))


def retrieval(df: DataFrame) -> DataFrame:
    """One row of counts of (kind, decision, hidden): what was sought, acquired, and set before reading, and why."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    k, d = F.col("kind"), F.col("decision")
    return df.agg(
        F.count("*").alias("sought"), n(d == "not_retrieved").alias("not_retrieved"), n((d == "exclude") & F.col("hidden")).alias("preset_by_note"), n((d == "exclude") & ~F.col("hidden")).alias("preset_by_pages"), n(k == "acquired").alias("acquired"),
        n(k != "acquired").alias("marked_not_retrievable"), n(k == "format").alias("not_full_paper"), n(k == "no_access").alias("no_access"), n(k == "unexplained").alias("unexplained"),
    )


def uncoded(df: DataFrame, prefix: str, codes: str = "codes") -> DataFrame:
    none = F.array().cast("array<string>")
    return df.agg(F.count_if(~F.exists(F.coalesce(codes, none), lambda c: c.startswith(prefix))).alias("n"))


def reviewer_rates(df: DataFrame) -> DataFrame:
    """(reviewer, screened, included, rate) and a row Total."""
    g = df.groupBy("reviewer").agg(F.count("*").alias("screened"), F.count_if(F.col("decision") == "include").alias("included"))
    g = g.union(g.agg(F.lit("Total"), F.sum("screened"), F.sum("included")))
    return g.withColumn("rate", X.pct(F.col("included"), F.col("screened")))


def pivot(df: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """Counts of the given values of ``by`` for each key, zero where there are none."""
    return df.groupBy(key).agg(*(F.count_if(F.col(by) == v).alias(v) for v in values))


def reasons(df: DataFrame, order: tuple[str, ...] = ("E1", "E2", "E5", "E4", "E3", "E6")) -> DataFrame:
    """(reason, n, position): counts in the order of the checks; unknown codes come last, at 99."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("reason"))
    return df.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).withColumn("position", F.when(at > 0, at).otherwise(99).cast("int"))


def top(df: DataFrame, key: str, order: str, k: int = 20) -> DataFrame:
    """(key, n): the most frequent values; of equal ones the one seen first by ``order``."""
    g = df.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return g.orderBy(F.desc("n"), "at").limit(k).drop("at")


def mode(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key; of equal ones the first seen."""
    g = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    m = g.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("at"))).alias("s"))
    return m.select(key, f"s.{value}", "s.n")


def document_frequency(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def stats_long(**frames: DataFrame) -> DataFrame:
    """(metric, dim, value) of frames that have one label column and one count each."""
    out = None
    for metric, df in frames.items():
        dim, value = df.columns[:2]
        f = df.select(F.lit(metric).alias("metric"), F.col(dim).cast("string").alias("dim"), F.col(value).cast("double").alias("value"))
        out = f if out is None else out.union(f)
    return out
