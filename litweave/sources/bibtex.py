"""BibTeX exports as DataFrames. Nested braces need a scanner, so a file is parsed by a Python function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litweave.functions import text as X

#: Record types of entry types.
TYPES = {"article": "JOUR", "inproceedings": "CONF", "conference": "CONF", "proceedings": "CONF", "book": "BOOK", "inbook": "CHAP", "incollection": "CHAP", "phdthesis": "THES", "mastersthesis": "THES", "techreport": "RPRT"}


def _closing(s: str, at: int) -> int:
    """Where the brace that opens at ``at`` is closed; the end of the text if it isn't."""
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "{") - (s[i] == "}")
        if depth == 0:
            return i
    return len(s)


def _next_field(s: str, at: int) -> int:
    """The place after the next comma outside braces and quotes; the end of the text if there is none."""
    depth, quoted = 0, False
    for i in range(at, len(s)):
        if s[i] == '"' and not depth:
            quoted = not quoted
        elif not quoted:
            depth += (s[i] == "{") - (s[i] == "}")
            if s[i] == "," and depth <= 0:
                return i + 1
    return len(s)


def fields(body: str) -> dict[str, str]:
    """name = {nested}, "quoted" or bare values; names in lower case, the last of a name counts. Of values joined by
    ``#`` the first one counts; a name may hold any sign but ``=`` and a comma."""
    out: dict[str, str] = {}
    at = 0
    while (eq := body.find("=", at)) >= 0:
        name = body[at:eq].rpartition(",")[2].strip().lower()
        at = eq + 1
        while at < len(body) and body[at].isspace():
            at += 1
        if body[at : at + 1] == "{":
            end = _closing(body, at)
            value, at = body[at + 1 : end], end + 1
        elif body[at : at + 1] == '"':
            end = body.find('"', at + 1)
            end = len(body) if end < 0 else end
            value, at = body[at + 1 : end], end + 1
        else:
            end = body.find(",", at)
            end = len(body) if end < 0 else end
            value, at = body[at:end], end
        if name:
            out[name] = " ".join(value.split())
        at = _next_field(body, at)
    return out


def entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of each entry; comments, preambles and string definitions are skipped."""
    out, at = [], 0
    while m := re.compile(r"@\s*(\w+)\s*\{").search(text, at):
        end = _closing(text, m.end() - 1)
        if m[1].lower() not in ("comment", "preamble", "string"):
            key, _, body = text[m.end() : end].partition(",")
            out.append((m[1].lower(), key.strip(), fields(body)))
        at = end + 1
    return out


def read_bibtex(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec, etype, bibkey, fields map<string,string>)."""

    def run(frames):
        for pdf in frames:
            rows = [(f, i, *e) for f, t in zip(pdf["file"], pdf["value"]) for i, e in enumerate(entries(t))]
            yield pd.DataFrame(rows, columns=["file", "rec", "etype", "bibkey", "fields"])

    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, "file string, rec int, etype string, bibkey string, fields map<string,string>")


def project(raw: DataFrame) -> DataFrame:
    """Source records of parsed entries, without ``idx`` and ``source_db``; texts without LaTeX, character references and
    tags. A single page has no last one; the key and the series are notes."""
    f = lambda *names: X.first_of(*(F.col("fields")[n] for n in names))
    plain = lambda *names: X.clean_text(f(*names))
    clean = lambda *names: X.clean_text(X.clean_latex(f(*names)))
    pages = F.split(F.regexp_replace(plain("pages"), "[\u2013\u2014]", "-"), "-+")
    empty = F.array().cast("array<string>")
    some = lambda c: F.coalesce(F.filter(c, lambda x: x != ""), empty)
    listed = lambda name, by: some(X.clean_texts(F.transform(F.split(f(name), by), X.clean_latex)))
    doi = f("doi", "url")
    return raw.select(
        "file", "rec", X.lookup(F.col("etype"), TYPES, F.lit("GEN")).alias("type"), clean("title").alias("title"), listed("author", r"\s+and\s+").alias("authors"),
        F.coalesce(X.year_of(f("year")), X.year_of(f("issue_date"))).alias("year"), X.norm_doi(doi).alias("doi"), X.norm_doi(doi, False).alias("doi_raw"), clean("booktitle", "journal", "series").alias("venue"),
        plain("volume").alias("volume"), plain("number").alias("issue"), F.trim(F.get(pages, F.lit(0))).alias("start_page"), F.when(F.size(pages) > 1, F.trim(F.try_element_at(pages, F.lit(-1)))).alias("end_page"), clean("publisher").alias("publisher"),
        clean("abstract").alias("abstract"), listed("keywords", r"[;,]\s*").alias("keywords"), plain("url").alias("url"), plain("issn").alias("issn"), plain("isbn").alias("isbn"),
        some(F.array(F.concat(F.lit("BibTeX key: "), "bibkey"), F.concat(F.lit("series: "), clean("series")))).alias("notes"), F.lit(None).cast("string").alias("db"),
    )
