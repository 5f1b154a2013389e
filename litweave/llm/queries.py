"""The pN_ queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import functions as F

from litweave.llm import components as _components
from litweave.llm import linkage as _linkage
from litweave.llm import lookalike as _lookalike
from litweave.llm import markup as _markup
from litweave.llm import mix as _mix
from litweave.llm import names as _names
from litweave.llm import neardup as _neardup
from litweave.llm import split as _split
from litweave.llm import survive as _survive
from litweave.llm import tokens as _tokens
from litweave.session import table


def _descriptions(spark, d):
    corpus = table(spark, d, "final_corpus").select(F.col("cid").alias("id"), "title", F.col("authors").alias("people"), "year", "doi", "venue", F.col("start_page").alias("pages"))
    venue = F.coalesce(F.nullif(F.trim("booktitle"), F.lit("")), F.col("journal"))
    bib = table(spark, d, "bib_entries").select(F.col("bibkey").alias("id"), "title", F.split("author", r"(?i)\s+and\s+").alias("people"), "year", "doi", venue.alias("venue"), "pages")
    return corpus, bib


def p1_matches(spark, d):
    return _linkage.match(*_descriptions(spark, d)).select(F.col("c").alias("cid"), F.col("b").alias("bibkey"), F.round("confidence", 3).alias("confidence"))


def p1_found(spark, d):
    return _linkage.best(_linkage.match(*_descriptions(spark, d))).select(F.col("c").alias("cid"), F.col("b").alias("bibkey"))


def p2_found(spark, d):
    return _markup.found(table(spark, d, "final_corpus"))


def p2_texts(spark, d):
    return _markup.cleaned(table(spark, d, "final_corpus")).select("cid", "field", "text", "kinds")


def p2_blocks(spark, d):
    texts = _markup.cleaned(table(spark, d, "final_corpus"))
    return texts.select("cid", "field", F.posexplode("blocks").alias("pos", "b")).select("cid", "field", "pos", "b.kind", "b.level", "b.text", "b.label")


def p3_found(spark, d):
    return _neardup.similar_pairs(table(spark, d, "final_corpus"))


def p3_classes(spark, d):
    """One row per record with a long enough abstract: its class, and how many other classes that is linked with."""
    members, links = _neardup.similar_classes(table(spark, d, "final_corpus"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias("cid"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p4_found(spark, d):
    return _components.record_groups(table(spark, d, "source_records"), table(spark, d, "link_edges"), table(spark, d, "final_corpus"))


def p5_mentions(spark, d):
    return _names.mentions(table(spark, d, "final_corpus"), table(spark, d, "author_register"))


def p5_found(spark, d):
    return p5_mentions(spark, d).where("name <> full_name").select("cid", "pos", "author_id")


def _membership(spark, d):
    return _survive.catalogue_membership(table(spark, d, "catalogue_rows"))


def p6_found(spark, d):
    found = _survive.survivors(table(spark, d, "source_records"), _membership(spark, d))
    return found.select(F.expr("try_cast(substr(corpus_id, 2) AS bigint)").alias("cid"), "field", "idx")


def p6_records(spark, d):
    return _survive.surviving_records(table(spark, d, "source_records"), _membership(spark, d))


def p7_found(spark, d):
    return _lookalike.found(table(spark, d, "final_corpus"))


def p7_texts(spark, d):
    return _lookalike.normalized(table(spark, d, "final_corpus"))


def p8_ids(spark, d):
    return _tokens.encode(table(spark, d, "documents"))


def p9_found(spark, d):
    return _mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].where("short").select("source")


def p9_shares(spark, d):
    return _mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_copies(spark, d):
    return _mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p10_found(spark, d):
    return _split.split(table(spark, d, "documents"), with_text=False).where(F.col("piece") == 1).select("doc_id")


def p10_pieces(spark, d):
    return _split.split(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_matches, p2_found, p2_texts, p2_blocks, p3_found, p3_classes, p4_found, p5_found, p5_mentions, p6_found, p6_records, p7_found, p7_texts, p8_ids, p9_found, p9_shares, p9_copies, p10_found, p10_pieces)}
ORACLE: dict[str, str] = {
    "p6_found": r"""
WITH m AS (SELECT DISTINCT corpus_id, CAST(substr(source_record_id, 2) AS BIGINT) AS idx FROM catalogue_rows),
s AS (SELECT DISTINCT idx, doi, abstract, keywords, venue, exported_at FROM source_records),
g AS (SELECT * FROM m JOIN s USING (idx) WHERE corpus_id IN (SELECT corpus_id FROM m GROUP BY 1 HAVING count(DISTINCT idx) > 1)),
k AS (SELECT corpus_id, idx, exported_at, 'keywords' AS field, lower(trim(unnest(keywords))) AS x FROM g),
x AS (
  SELECT corpus_id, idx, exported_at, 'abstract' AS field, abstract AS x, length(abstract) AS full_ FROM g
  UNION ALL SELECT corpus_id, idx, exported_at, 'venue', venue, length(venue) FROM g
  UNION ALL SELECT corpus_id, idx, exported_at, 'doi', doi, 1 FROM g WHERE regexp_matches(doi, '(?i)10\.[0-9]{4,9}(/|%2F)[^\s/]+')
  UNION ALL SELECT corpus_id, idx, exported_at, field, any_value(x), count(DISTINCT x) FROM k WHERE x NOT IN ('', 'n/a') GROUP BY ALL),
v AS (
  SELECT * FROM x WHERE x IS NOT NULL AND regexp_matches(x, '[A-Za-z0-9]') AND (field = 'doi' OR length(x) > 200 OR
    NOT regexp_matches(lower(x), '^\W*(n/a|none|unknown|no abstract|no title|not specified|abstract not)\b|\b(has no abstract|(is|could) not (be )?(available|loaded))\b')))
SELECT CAST(substr(corpus_id, 2) AS BIGINT) AS cid, field, idx FROM v
QUALIFY row_number() OVER (PARTITION BY corpus_id, field ORDER BY full_ DESC, exported_at DESC) = 1""",
    "p4_found": """
WITH RECURSIVE k AS (SELECT DISTINCT idx FROM source_records),
e AS (
  SELECT src_idx AS u, dst_idx AS v FROM link_edges WHERE src_idx IN (SELECT idx FROM k) AND dst_idx IN (SELECT idx FROM k)
  UNION SELECT list_min(merged_idxs), unnest(merged_idxs) FROM final_corpus),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
r AS (SELECT DISTINCT u AS idx, u AS other FROM b UNION SELECT r.idx, b.v FROM r JOIN b ON r.other = b.u)
SELECT idx, min(other) AS group_idx FROM r GROUP BY idx""",
}
