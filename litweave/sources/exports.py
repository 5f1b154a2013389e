"""Several exports as one table of source records, and the pipeline's other inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.functions import text as X
from litweave.sources import bibtex, ris

DECISIONS = "kind string, reviewer_id string, decisions array<struct<corpus_id:string,decision:string,codes:array<string>,title:string,reason:string>>, reviewers array<string>, records array<struct<corpus_id:string,title:string,votes:map<string,string>,final:string,reason:string>>, agreed array<struct<corpus_id:string,final:string>>"


def dominant_db(raw: DataFrame) -> DataFrame:
    """(file, db): the most frequent database name of each file; of equally frequent ones the first seen."""
    n = raw.where("db IS NOT NULL").groupBy("file", "db").agg(F.count("*").alias("n"), F.min("rec").alias("at"))
    return n.groupBy("file").agg(F.max_by("db", F.struct("n", -F.col("at"))).alias("db"))


def read_exports(spark: SparkSession, ris_paths: list[str] = (), bib_paths: list[str] = (), ris_name: str = "ieee", ris_db: str = "IEEE Xplore", bib_db: str = "ACM Digital Library") -> DataFrame:
    """Source records of all files: RIS first, then BibTeX, each in the order of file and record; ``idx`` from 1.

    A RIS file whose name begins with ``ris_name`` is from ``ris_db``, another from its most frequent database name.
    Numbering is by the records before each file, so no global sort gathers the rows.
    """
    parts = []
    if ris_paths:
        r = ris.project(ris.read_ris(spark, list(ris_paths)))
        name = F.lower(F.element_at(F.split("file", "/"), -1))
        r = r.join(dominant_db(r).withColumnRenamed("db", "own"), "file", "left")
        parts.append(r.withColumn("source_db", F.when(name.startswith(ris_name), ris_db).otherwise(F.coalesce("own", F.lit("unknown")))).drop("own").withColumn("part", F.lit(0)))
    if bib_paths:
        parts.append(bibtex.project(bibtex.read_bibtex(spark, list(bib_paths))).withColumn("source_db", F.lit(bib_db)).withColumn("part", F.lit(1)))
    if not parts:
        raise ValueError("no export files given")
    all_ = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    files = all_.groupBy("part", "file").agg(F.count("*").alias("n"))
    offset = files.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "file", "before")  # a row per file
    within = F.row_number().over(W.partitionBy("part", "file").orderBy("rec"))
    numbered = all_.join(offset, ["part", "file"]).withColumn("idx", F.col("before") + within)
    return numbered.withColumn("source_file", F.element_at(F.split("file", "/"), -1)).drop("part", "before", "file", "rec", "db")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')


def read_decisions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, corpus_id, decision, reviewer, codes, reason, authoritative) of screeners' files and of resolutions.

    A file is a resolution if it says so or has both ``records`` and ``agreed``; a file that is neither gives a row with
    a NULL id, which ``checks.unreadable`` reports.
    """
    f = spark.read.schema(DECISIONS).option("multiLine", True).json(paths).withColumn("file", F.input_file_name())
    resolution = (F.coalesce(F.col("kind"), F.lit("")) == "resolution") | (F.col("records").isNotNull() & F.col("agreed").isNotNull())
    none = F.array().cast("array<string>")
    plain = f.where(~resolution).select("file", F.explode_outer("decisions").alias("d"), "reviewer_id").select("file", "d.corpus_id", "d.decision", F.col("reviewer_id").alias("reviewer"), F.coalesce("d.codes", none).alias("codes"), "d.reason", F.lit(False).alias("authoritative"))
    settled = f.where(resolution).select("file", F.explode(F.concat(F.coalesce(F.transform("records", lambda r: F.struct(r.corpus_id.alias("id"), r.final.alias("f"), r.reason.alias("why"))), F.array()), F.coalesce(F.transform("agreed", lambda r: F.struct(r.corpus_id.alias("id"), r.final.alias("f"), F.lit(None).cast("string").alias("why"))), F.array()))).alias("d"), F.array_join("reviewers", "+").alias("reviewer"))
    return plain.union(settled.select("file", "d.id", "d.f", "reviewer", none, "d.why", F.lit(True)))


def read_rater_csv(spark: SparkSession, path: str) -> DataFrame:
    """(rater, corpus_id, label): the columns ``reviewer_*`` of a rating sheet, unpivoted. Where the id of the record is
    missing, the number of the item takes its place."""
    sheet = read_csv(spark, path)
    raters = [c for c in sheet.columns if c.startswith("reviewer_") and not c.endswith("_reason")]
    if len(raters) < 2:
        raise ValueError(f"{path}: a sheet has two columns reviewer_* at least")
    ids = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("corpus_id", "item") if c in sheet.columns))
    return sheet.withColumn("corpus_id", ids).unpivot(["corpus_id"], raters, "rater", "label")


def read_rater_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(rater, corpus_id, label, codes, title) of raters' files: the last decision of each record that has a label, codes
    in capitals, and the first title given for it. A file without a name of its rater is named by itself; a name that
    more than one file gives has the file's added but for the first of them."""
    f = spark.read.schema(DECISIONS).option("multiLine", True).json(paths).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    f = f.select("file", F.coalesce(F.nullif("reviewer_id", F.lit("")), "file").alias("name"), "decisions")
    first = f.groupBy("name").agg(F.min("file").alias("first"))
    f = f.join(first, "name").withColumn("rater", F.when(F.col("file") == F.col("first"), F.col("name")).otherwise(F.concat("name", F.lit(" ("), "file", F.lit(")"))))
    d = f.select("file", "rater", F.posexplode("decisions").alias("at", "d")).select("file", "rater", "at", "d.*").withColumn("label", X.label(F.col("decision"))).where("label IS NOT NULL AND corpus_id <> ''")
    title = d.where("title <> ''").groupBy("corpus_id").agg(F.min_by("title", F.struct("file", "at")).alias("title"))
    codes = F.transform(F.coalesce("codes", F.array().cast("array<string>")), F.upper)
    last = d.groupBy("rater", "corpus_id").agg(F.max_by("label", "at").alias("label"), F.max_by(codes, F.col("at")).alias("codes"))
    return last.join(title, "corpus_id", "left").select("rater", "corpus_id", "label", "codes", "title")


def discover(spark: SparkSession, path: str, pattern: str = "*.json", skip: tuple[str, ...] = ("agreement_%", "split_manifest.json", "fulltext_corpus.json")) -> DataFrame:
    """(path, length) of the files of a folder by name, without those to skip."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    for s in skip:
        files = files.where(~name.like(s.replace("_", r"\_")))
    return files
