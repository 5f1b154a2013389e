"""Normalisers of bibliographic text as Column functions: built-ins wherever Spark has them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from litweave.functions.udfs import html_unescape, html_unescape_all, nfkd_fold

#: LaTeX escapes and what they stand for.
ESCAPES = {
    r"\&": "&", r"\%": "%", r"\_": "_", r"\#": "#", r"\$": "$", r"\{": "{", r"\}": "}",
    r"\textemdash": "—", r"\textendash": "–", r"\textquotesingle": "'", r"\ldots": "…", r"\textbackslash": "\\", r"\ ": " ",
}
#: Words that say nothing about a title.
STOP = "a an the of on in for with and or to from by at as is are be using via toward towards".split()
#: Labels of record types in one export format.
TYPE_LABELS = {
    "label.ris.referencetype.book_chapter": "CHAP", "label.ris.referencetype.book": "BOOK",
    "label.ris.referencetype.conference_paper": "CONF", "label.ris.referencetype.article": "JOUR",
}
#: Spellings of screening labels.
LABELS = {
    "i": "include", "include": "include", "inc": "include", "1": "include", "keep": "include", "yes": "include", "y": "include", "true": "include",
    "e": "exclude", "exclude": "exclude", "exc": "exclude", "0": "exclude", "discard": "exclude", "no": "exclude", "n": "exclude", "false": "exclude",
    "m": "maybe", "maybe": "maybe", "?": "maybe", "unsure": "maybe",
}
#: Names of record types.
TYPES = {"CONF": "Conference paper", "JOUR": "Journal article", "BOOK": "Book", "CHAP": "Book chapter", "STD": "Standard", "THES": "Thesis", "RPRT": "Report", "GEN": "Other"}


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    found = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[c]
    return found if default is None else F.coalesce(found, default)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def clean_latex(c: Column) -> Column:
    """Accent macros give their letter, known escapes what they stand for, other macros a blank; braces go."""
    c = F.regexp_replace(c, r"""\\[`'"^~=.vuHcdbkr]\s*\{?([A-Za-z])\}?""", "$1")
    for k, v in ESCAPES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"\\[A-Za-z]+", " "), r"[{}]", ""))


def clean_text(c: Column) -> Column:
    """Character references first, then tags, so an escaped tag goes as well."""
    return squeeze(F.regexp_replace(html_unescape(c), r"<[^>]+>", ""))


def clean_texts(c: Column) -> Column:
    """``clean_text`` of every element of a list."""
    return F.transform(html_unescape_all(c), lambda x: squeeze(F.regexp_replace(x, r"<[^>]+>", "")))


def norm_title(c: Column) -> Column:
    """Lower-case ASCII words without LaTeX, markup, accents and inline formulas."""
    c = F.lower(nfkd_fold(clean_text(clean_latex(c))))
    return squeeze(F.regexp_replace(F.regexp_replace(c, r"\$[^$]*\$", " "), r"[^a-z0-9 ]+", " "))


def ascii_key(c: Column) -> Column:
    """Lower-case ASCII letters and digits in words; accents are not folded."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]+", " "))


def text_key(c: Column) -> Column:
    """Lower-case letters (with their marks) and digits of any script in words; a text without a word is its own key."""
    k = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(k != "", F.concat(F.lit("w "), k)).otherwise(F.concat(F.lit("t "), c))


def title_tokens(norm: Column) -> Column:
    """Distinct words of more than two letters that aren't stop words."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


def norm_doi(c: Column, fold: bool = True) -> Column:
    """The first DOI in a text without closing punctuation; NULL if there is none."""
    d = F.regexp_replace(F.regexp_extract(clean_text(clean_latex(c)), r"(?i)10\.\d{4,9}/\S+", 0), r"""[.,;)\]}>'"]+$""", "")
    return blank_to_null(F.lower(d) if fold else d)


def surname(c: Column) -> Column:
    """What stands before the comma, else the last word; of the clean text, folded, letters only."""
    c = clean_text(clean_latex(c))
    last = F.when(c.contains(","), F.substring_index(c, ",", 1)).otherwise(F.element_at(F.split(F.trim(c), r"(?U)\s+"), -1))
    return F.regexp_replace(F.lower(nfkd_fold(last)), r"[^a-z]", "")


def year_of(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"(?:19|20)\d{2}", 0))


def fix_type(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.coalesce(t, F.lit("")) == "", "GEN").otherwise(lookup(F.lower(t), TYPE_LABELS, F.upper(t)))


def precolon(c: Column) -> Column:
    """A system's name before a colon: up to 22 characters without a blank."""
    head = F.trim(F.substring_index(c, ":", 1))
    return F.when(c.contains(":") & F.length(head).between(1, 22) & ~head.contains(" "), head)


def label(c: Column) -> Column:
    """include, exclude or maybe; NULL for what is none of them."""
    return lookup(F.lower(F.trim(c)), LABELS)


def n_pages(start: Column, end: Column) -> Column:
    a, b = (F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")) for x in (start, end))
    return F.when(b >= a, b - a + 1)


def keywords(c: Column, most: int = 12) -> Column:
    """The first keywords of a list that was stringified."""
    return F.slice(F.regexp_extract_all(c, F.lit(r"'([^']+)'"), F.lit(1)), 1, most)


def link(doi: Column, title: Column, base: str = "https://doi.org/", search: str = "https://scholar.google.com/scholar?q=") -> Column:
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit(base), doi)).otherwise(F.concat(F.lit(search), F.url_encode(F.coalesce(title, F.lit("")))))


def record_id(letter: str, width: int, n: Column) -> Column:
    return F.format_string(f"{letter}%0{width}d", n)


def et_al(names: Column, most: int = 3) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, most), "; "), F.when(F.size(names) > most, " et al.").otherwise(""))


def retrieval_kind(status: Column, note: Column) -> Column:
    s, n = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(note, F.lit("")))
    return F.when(s == "acquired", "acquired").when(n.rlike(r"short|abstract|demo|wip|work.in.progress|poster"), "format").when(F.trim(n) != "", "no_access").otherwise("unexplained")


def preset(kind: Column, pages: Column) -> Column:
    """What is decided before reading: (decision, reason, hidden); NULL if nothing is."""
    made = lambda d, r, h: F.struct(F.lit(d).alias("decision"), F.lit(r).cast("string").alias("primary_reason"), F.lit(h).alias("hidden"))
    return F.when(kind == "format", made("exclude", "E1", True)).when(kind.isin("no_access", "unexplained"), made("not_retrieved", None, True)).when(pages <= 4, made("exclude", "E1", False))


def pair_band(asim: Column, ratio: Column, same_system: Column) -> Column:
    return (
        F.when(asim >= 0.9, "ALMOST CERTAIN").when(asim >= 0.6, "LIKELY").when((ratio >= 0.85) | same_system, "LIKELY").when(asim < 0.35, "DISTINCT").otherwise("UNCLEAR")
    )


def pair_score(asim: Column, ratio: Column) -> Column:
    return F.coalesce(asim, F.lit(0.0)) * 0.6 + ratio * 0.4


def kappa_band(k: Column) -> Column:
    c = F.when(F.isnan(k) | k.isNull(), "worse than chance")
    for least, name in ((0.9, "almost perfect"), (0.8, "strong"), (0.6, "moderate"), (0.4, "weak"), (0.21, "minimal"), (0.0, "none")):
        c = c.when(k >= least, name)
    return c.otherwise("worse than chance")


def retraction(norm: Column) -> Column:
    return F.regexp_extract(norm, r"^(retracted|retraction notice|erratum|corrigendum|correction to|withdrawn)", 1)


def pct(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a * F.lit(100.0), b), 1)


def type_label(c: Column) -> Column:
    return lookup(c, TYPES, c)


def first_of(*cs: Column) -> Column:
    return F.coalesce(*(blank_to_null(c) for c in cs))
