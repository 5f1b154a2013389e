"""RIS out: the fixed order of tags, optional ones only where there is a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.sinks.tables import guard

#: Tags and columns of the variants, in their order; a star marks repeated tags.
FULL = (("TY", "type"), ("AU*", "authors"), ("TI", "title"), ("PY", "year"), ("T2", "venue"), ("VL", "volume"), ("IS", "issue"), ("SP", "start_page"), ("EP", "end_page"), ("PB", "publisher"), ("DO", "doi"), ("UR", "url"), ("SN", "issn"), ("AB", "abstract"), ("KW*", "keywords"), ("DB", "source_db"), ("ID", "id"), ("N1*", "notes"))
PLAIN = tuple(x for x in FULL if x[0] not in ("SN", "N1*"))
FULLTEXT = (("TY", "type"), ("ID", "id"), *(x for x in PLAIN if x[0] not in ("TY", "ID", "KW*", "DB")))


def _line(tag: str):
    return lambda x: F.concat(F.lit(f"{tag}  - "), F.regexp_replace(x, r"\s*[\r\n]+\s*", " "))


def ris_text(df: DataFrame, tags: tuple[tuple[str, str], ...] = FULL, extra_notes: Column | None = None) -> Column:
    """One record as text, ER and a blank line included. Columns the frame lacks are left out; ``extra_notes`` is an
    array of provenance notes (what was absorbed, the place in a sample, who screened it)."""
    kinds = dict(df.dtypes)
    some = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
    lines = []
    for tag, c in tags:
        if c in kinds:
            v = some(F.coalesce(F.col(c), F.array().cast("array<string>"))) if tag[-1] == "*" else some(F.array(F.col(c).cast("string")))
            lines.append(F.transform(v, _line(tag.rstrip("*"))))
    if extra_notes is not None:
        lines.append(F.transform(some(extra_notes), lambda x: F.concat(F.lit("N1  - "), x)))
    return F.concat(F.array_join(F.concat(*lines), "\n"), F.lit("\nER  - \n"))


def write_ris(df: DataFrame, path: str, tags: tuple[tuple[str, str], ...] = FULL, order: str | None = None, extra_notes: Column | None = None, force: bool = False) -> None:
    guard(df, path, force)
    out = df.orderBy(order) if order else df
    out.select(ris_text(out, tags, extra_notes).alias("value")).write.mode("overwrite").text(path)
