"""RIS exports as DataFrames, parsed with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.functions import text as X


def read_ris(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec, tags array<struct<tag, v>>): one row per record, tags in their order.

    Line ends may be mixed; lines that are no tag and empty values are skipped; ER closes a record, and what follows the
    last one without ER is a record as well. Records are numbered from 0 within their file. Each file is one task: an
    export is a few MB, and the files are read in parallel.
    """
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("pos", "line"))
    tagged = lines.select("file", "pos", F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?(.*)$", 1).alias("tag"), F.trim(F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?(.*)$", 2)).alias("v")).where("tag <> ''")
    before = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    numbered = tagged.withColumn("rec", F.coalesce(F.sum((F.col("tag") == "ER").cast("int")).over(before), F.lit(0))).where("tag <> 'ER' AND v <> ''")
    return numbered.groupBy("file", "rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag", "v"))), lambda x: F.struct(x.tag.alias("tag"), x.v.alias("v"))).alias("tags"))


def _of(tag: str) -> Column:
    return F.transform(F.filter("tags", lambda x: x.tag == tag), lambda x: x.v)


def values(*tags: str) -> Column:
    return F.concat(*map(_of, tags))


def first(*tags: str) -> Column:
    return F.coalesce(*(F.get(_of(t), F.lit(0)) for t in tags))


def project(raw: DataFrame) -> DataFrame:
    """Source records of parsed RIS records, without ``idx`` and ``source_db``; texts without character references and tags."""
    doi = first("DO", "DI")
    clean = lambda *tags: X.clean_text(first(*tags))
    return raw.select(
        "file", "rec", X.fix_type(first("TY")).alias("type"), clean("TI", "T1").alias("title"), X.clean_texts(values("AU", "A1")).alias("authors"), X.year_of(first("PY", "Y1", "DA")).alias("year"),
        X.norm_doi(doi).alias("doi"), X.norm_doi(doi, False).alias("doi_raw"), clean("T2", "JO", "JA", "T3").alias("venue"), first("VL", "VO").alias("volume"), first("IS").alias("issue"),
        first("SP").alias("start_page"), first("EP").alias("end_page"), clean("PB").alias("publisher"), clean("AB", "N2").alias("abstract"), X.clean_texts(values("KW")).alias("keywords"),
        first("UR", "L2").alias("url"), first("SN").alias("issn"), F.when(first("TY") == "BOOK", first("SN")).alias("isbn"), X.clean_texts(values("N1")).alias("notes"), first("DB").alias("db"),
    )
