"""Agreement between raters: confusion matrix, Cohen's kappa, Krippendorff's alpha, the gate, what to reconcile.

Ratings come as (unit, rater, label). Where a rater rated a unit more than once, give the last rating only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.functions import text as X


def common(ratings: DataFrame, raters: int) -> DataFrame:
    """Ratings of the units that all raters rated."""
    n = ratings.groupBy("unit").agg(F.countDistinct("rater").alias("n")).where(F.col("n") == raters)
    return ratings.join(n.select("unit"), "unit", "left_semi")


def paired(ratings: DataFrame, a: str, b: str) -> DataFrame:
    """(unit, l1, l2) of the units both raters rated."""
    p = ratings.where(F.col("rater").isin(a, b)).groupBy("unit").agg(F.max(F.when(F.col("rater") == a, F.col("label"))).alias("l1"), F.max(F.when(F.col("rater") == b, F.col("label"))).alias("l2"))
    return p.where("l1 IS NOT NULL AND l2 IS NOT NULL")


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(l1, <label>..., total): counts with zero cells, and a total row."""
    spark = pairs.sparkSession
    rows = spark.createDataFrame([(x,) for x in labels], "l1 string")
    counts = pairs.groupBy("l1").pivot("l2", list(labels)).agg(F.count(F.lit(1)))
    full = rows.join(F.broadcast(counts), "l1", "left").select("l1", *(F.coalesce(F.col(x), F.lit(0)).alias(x) for x in labels))
    full = full.withColumn("total", sum((F.col(x) for x in labels), F.lit(0)))
    return full.union(full.agg(F.lit("total"), *(F.sum(x) for x in (*labels, "total"))))


def cohen(pairs: DataFrame) -> DataFrame:
    """One row: n, po, pe, kappa, se, lo, hi, band. kappa is NaN where chance alone would agree always."""
    cells = pairs.groupBy("l1", "l2").agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("l1") == F.col("l2"), F.col("n")).otherwise(0)).alias("same"))
    r1 = cells.groupBy(F.col("l1").alias("l")).agg(F.sum("n").alias("r1"))
    r2 = cells.groupBy(F.col("l2").alias("l")).agg(F.sum("n").alias("r2"))
    e = r1.join(r2, "l").agg(F.coalesce(F.sum(F.col("r1") * F.col("r2")), F.lit(0)).alias("e"))
    k = n.crossJoin(F.broadcast(e)).where("n > 0").select("n", (F.col("same") / F.col("n")).alias("po"), (F.col("e") / (F.col("n") * F.col("n"))).alias("pe"))  # one row each
    one = F.col("pe") == 1
    k = k.withColumn("kappa", F.when(one, F.lit(float("nan"))).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe"))))
    k = k.withColumn("se", F.when(one, F.lit(float("nan"))).otherwise(F.sqrt(F.try_divide(F.col("po") * (1 - F.col("po")), F.col("n") * (1 - F.col("pe")) * (1 - F.col("pe"))))))
    k = k.withColumn("lo", F.col("kappa") - F.col("se") * 1.96).withColumn("hi", F.when(F.isnan("kappa"), F.col("kappa")).otherwise(F.least(F.lit(1.0), F.col("kappa") + F.col("se") * 1.96)))
    return k.withColumn("band", X.kappa_band(F.col("kappa")))


def krippendorff(ratings: DataFrame) -> DataFrame:
    """One row: total, observed, expected, alpha; nominal, any number of raters, units with one rating don't count;
    alpha is NULL where nothing can disagree."""
    c = ratings.where("label IS NOT NULL").groupBy("unit", "label").agg(F.count("*").alias("n"))
    m = c.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m > 1")
    do = m.agg(F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    lab = c.join(m.select("unit"), "unit", "left_semi").groupBy("label").agg(F.sum("n").alias("nc")).agg(F.sum("nc").alias("t"), F.sum(F.col("nc") * F.col("nc")).alias("s"))
    a = do.crossJoin(F.broadcast(lab)).where("total > 1")  # one row each
    a = a.select("total", (F.col("d") / F.col("total")).alias("observed"), ((F.col("t") * F.col("t") - F.col("s")) / (F.col("total") * (F.col("total") - 1))).alias("expected"))
    return a.withColumn("alpha", 1 - F.try_divide("observed", F.nullif("expected", F.lit(0.0))))


def raw_agreement(ratings: DataFrame) -> DataFrame:
    """(units, agreed, share): units on which all ratings are equal."""
    u = ratings.groupBy("unit").agg(F.countDistinct("label").alias("n"))
    return u.agg(F.count("*").alias("units"), F.count_if(F.col("n") == 1).alias("agreed")).withColumn("share", F.try_divide("agreed", "units"))


def binary(ratings: DataFrame) -> DataFrame:
    """maybe counts as include."""
    return ratings.withColumn("label", F.when(F.col("label") == "maybe", "include").otherwise(F.col("label")))


def gate(ratings: DataFrame, a: str, b: str, least: float = 0.8) -> DataFrame:
    """(kappa, verdict) on the binary labels: PASS, REDO, or not computable."""
    k = cohen(paired(binary(ratings), a, b)).select("kappa")
    return k.withColumn("verdict", F.when(F.isnan("kappa"), "not computable").when(F.col("kappa") >= least, "PASS").otherwise("REDO"))


def gate_of(ratings: DataFrame, least: float = 0.8) -> DataFrame:
    """(measure, value, verdict) of all raters, on the binary labels of the units all of them rated: Cohen's kappa of two
    raters, Krippendorff's alpha of three or more. A row per rater comes to the driver."""
    raters = [r[0] for r in ratings.select("rater").where("rater IS NOT NULL").distinct().orderBy("rater").collect()]
    if len(raters) < 2:
        raise ValueError("agreement takes two raters at least")
    if len(raters) == 2:
        g = gate(ratings, *raters, least)
        return g.select(F.lit("kappa").alias("measure"), F.col("kappa").alias("value"), "verdict")
    a = krippendorff(binary(common(ratings, len(raters)))).select(F.lit("alpha").alias("measure"), F.col("alpha").alias("value"))
    return a.withColumn("verdict", F.when(F.col("value").isNull(), "not computable").when(F.col("value") >= least, "PASS").otherwise("REDO"))


def to_reconcile(ratings: DataFrame) -> DataFrame:
    """(unit, labels): units with different labels or any maybe."""
    u = ratings.groupBy("unit").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return u.where((F.size("labels") > 1) | F.array_contains("labels", "maybe"))


def disputed_codes(codes: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """(code1, code2, n): the most frequent pairs of codes (unit, rater, code) on which two raters differ."""
    x, y = (codes.where(F.col("rater") == r).select("unit", F.coalesce("code", F.lit("-")).alias(n)) for r, n in ((a, "code1"), (b, "code2")))
    return x.join(y, "unit").where("code1 <> code2").groupBy("code1", "code2").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code1", "code2").limit(k)


def rates(ratings: DataFrame) -> DataFrame:
    """(n, rate, extreme): share of inclusions of all ratings; extreme under 0.1 or over 0.9."""
    r = ratings.agg(F.count("*").alias("n"), F.avg((F.col("label") == "include").cast("double")).alias("rate"))
    return r.withColumn("extreme", ~F.col("rate").between(0.1, 0.9))
