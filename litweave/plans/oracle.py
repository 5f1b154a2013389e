"""SQL that gives the rows of the core's queries, where plain SQL can."""

from __future__ import annotations

from litweave.functions.text import LABELS, STOP, TYPES

_LABEL = "CASE " + " ".join(f"WHEN lower(trim(decision)) = '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_TYPE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPES.items()) + " ELSE type END"
_STOP = ", ".join(f"'{w}'" for w in STOP)
_YEAR = "CASE WHEN trim(year) <> '' THEN year ELSE 'unknown' END"


def _key(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _tokens(k: str) -> str:
    return f"list_distinct(list_filter(string_split({k}, ' '), lambda w: length(w) > 2 AND w NOT IN ({_STOP})))"


_VOTES = f"""votes AS (
  SELECT corpus_id, reviewer, decision, decision_id, codes, reason FROM (
    SELECT *, row_number() OVER (PARTITION BY corpus_id, reviewer ORDER BY decided_at DESC NULLS LAST, decision_id DESC) AS rn FROM (
      SELECT DISTINCT ON (decision_id) decision_id, corpus_id, reviewer, {_LABEL} AS decision, codes, reason, decided_at FROM screen_decisions ORDER BY decision_id, received_at DESC NULLS LAST, decided_at DESC NULLS LAST)
    WHERE decision IS NOT NULL AND corpus_id IS NOT NULL AND reviewer IS NOT NULL) WHERE rn = 1)"""
_CORPUS = "corpus AS (SELECT printf('C%04d', cid) AS corpus_id, * FROM final_corpus)"
_PAIRED = "p AS (SELECT a.corpus_id, a.decision AS l1, b.decision AS l2 FROM votes a JOIN votes b USING (corpus_id) WHERE a.reviewer = 'screener_1' AND b.reviewer = 'screener_2')"
_RECORDS = "r AS (SELECT DISTINCT ON (idx) * FROM source_records ORDER BY idx, ingested_at DESC NULLS LAST, exported_at DESC NULLS LAST)"
_LATEST = "cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_record_id ORDER BY updated_at DESC NULLS LAST, status DESC) AS rn FROM catalogue_rows) WHERE rn = 1)"
_DUP = f"""t AS (SELECT doc_id, source, n_chars, md5({_key("coalesce(text, '')")}) AS k FROM documents),
dup AS (SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY k ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS keeper, count(*) OVER (PARTITION BY k) AS n_in_cluster FROM t)"""
_MERGED = f"""m0 AS (SELECT *, max(reviewer = 'adjudicator') OVER (PARTITION BY corpus_id) AS top FROM votes),
m1 AS (SELECT *, first_value(decision) OVER (PARTITION BY corpus_id ORDER BY decision_id) AS won, count(DISTINCT decision) OVER (PARTITION BY corpus_id) > 1 AS conflict FROM m0 WHERE (reviewer = 'adjudicator') = top),
merged AS (SELECT corpus_id, won AS decision, reviewer, top AS authoritative, conflict FROM m1 WHERE decision = won QUALIFY row_number() OVER (PARTITION BY corpus_id ORDER BY decision_id DESC) = 1)"""
_ALLOC = f"""s AS (SELECT {_YEAR} AS stratum, count(*) AS n, min(cid) AS at_ FROM final_corpus GROUP BY 1),
tot AS (SELECT sum(n) AS total, round_even(sum(n) * 0.1::DOUBLE, 0) AS target FROM s),
x AS (SELECT s.*, n * target / total AS exact_, target FROM s, tot),
b AS (SELECT *, floor(exact_) AS base, exact_ - floor(exact_) AS rest, target - sum(floor(exact_)) OVER () AS left_ FROM x),
q AS (SELECT stratum, n, CAST(base + (row_number() OVER (ORDER BY rest DESC, at_) <= left_)::INT AS BIGINT) AS quota FROM b)"""
_DEAL = f"dealt AS (SELECT cid, {_YEAR} AS year, row_number() OVER (PARTITION BY {_YEAR} ORDER BY md5('20260928-' || cid), cid) AS turn FROM final_corpus)"
_SOME = lambda c: f"coalesce({c} <> '', false)"
_GOLD = f"""{_LATEST}, {_RECORDS},
cl AS (SELECT CAST(substr(source_record_id, 2) AS BIGINT) AS idx, CAST(substr(corpus_id, 2) AS BIGINT) AS root FROM cat),
g AS (SELECT r.*, cl.root, row_number() OVER (PARTITION BY root ORDER BY NOT {_SOME('doi')}, NOT {_SOME('abstract')}, NOT coalesce(len(keywords) > 0, false), NOT coalesce(len(authors) > 0, false), NOT {_SOME('venue')}, NOT {_SOME('start_page')},
  -length(coalesce(abstract, '')), CASE source_db WHEN 'ACM Digital Library' THEN 0 WHEN 'IEEE Xplore' THEN 1 WHEN 'Scopus' THEN 2 ELSE 9 END, idx) AS k FROM r JOIN cl USING (idx)),
gold AS (SELECT root, min_by(idx, k) AS idx, count(*) AS n_in_cluster, array_to_string(list_sort(list_distinct(list(source_db))), ' + ') AS found_in, array_to_string(list_sort(list(idx)), ',') AS merged_idxs,
  {', '.join(f"CASE WHEN max(CASE WHEN k = 1 THEN {c} END) <> '' THEN max(CASE WHEN k = 1 THEN {c} END) ELSE min_by({c}, idx) FILTER (WHERE {c} <> '') END AS {c}" for c in ('year', 'doi', 'venue'))}, max(CASE WHEN k = 1 THEN title END) AS title,
  md5(arg_min(coalesce(abstract, chr(0)), (-coalesce(length(abstract), -1)) * 1000000 + k)) AS abstract, arg_min(coalesce(len(keywords), -1), (-coalesce(len(keywords), -1)) * 1000000 + k) AS nk, bool_or(abstract IS NOT NULL) AS has FROM g GROUP BY root)"""
_NUMBERED = f"""{_GOLD}, num AS (SELECT row_number() OVER (ORDER BY CASE WHEN year <> '' THEN year ELSE '0000' END, {_key("coalesce(title, '')")}, root) AS cid, * FROM gold)"""
_MISSING = lambda c, e: f"SELECT '{c}' AS field, count(*) AS total, count(*) FILTER (WHERE {e}) AS missing, round((count(*) - count(*) FILTER (WHERE {e})) * 100.0::DOUBLE / count(*), 1) AS pct FROM final_corpus"

SQL: dict[str, str] = {
    "norm_key_profile": f"SELECT doc_id, length({_key('text')}) AS n, len({_tokens(_key('text'))}) AS n_tokens, md5({_key('text')}) AS key FROM documents",
    "exact_dup_disposition": f"WITH {_DUP} SELECT *, CASE WHEN doc_id = keeper THEN 'retained' ELSE 'duplicate-removed' END AS status FROM dup",
    "dup_identification": f"""WITH {_DUP}, i AS (SELECT coalesce(source, '-') AS source, count(*) AS identified, count(*) FILTER (WHERE doc_id <> keeper) AS removed, count(*) FILTER (WHERE doc_id = keeper) AS retained FROM dup GROUP BY 1)
SELECT * FROM i UNION ALL SELECT 'Total', sum(identified)::BIGINT, sum(removed)::BIGINT, sum(retained)::BIGINT FROM i""",
    "dup_cluster_sizes": f"WITH {_DUP} SELECT n_in_cluster, count(*) AS n FROM dup WHERE doc_id = keeper GROUP BY 1",
    "catalogue_identification": f"""WITH {_LATEST}, i AS (SELECT source_db, count(*) AS identified, count(*) FILTER (WHERE status = 'duplicate-removed') AS removed, count(*) FILTER (WHERE status = 'retained') AS retained FROM cat GROUP BY 1)
SELECT * FROM i UNION ALL SELECT 'Total', sum(identified)::BIGINT, sum(removed)::BIGINT, sum(retained)::BIGINT FROM i""",
    "cluster_sizes": "SELECT size, count(*) AS n FROM (SELECT corpus_id, count(DISTINCT source_record_id) AS size FROM catalogue_rows GROUP BY 1) GROUP BY 1",
    "found_in_combos": "SELECT array_to_string(list_sort(list_distinct(found_in)), ' + ') AS combo, count(*) AS n FROM final_corpus GROUP BY 1",
    "pages": r"SELECT cid, CASE WHEN e >= s THEN e - s + 1 END AS n_pages FROM (SELECT cid, CASE WHEN regexp_full_match(start_page, '\d+') THEN CAST(start_page AS BIGINT) END AS s, CASE WHEN regexp_full_match(end_page, '\d+') THEN CAST(end_page AS BIGINT) END AS e FROM final_corpus)",
    "system_names": "SELECT cid, s AS system FROM (SELECT cid, trim(split_part(title, ':', 1), ' ') AS s FROM final_corpus WHERE contains(title, ':')) WHERE length(s) BETWEEN 1 AND 22 AND NOT contains(s, ' ')",
    "year_histogram": f"SELECT year, n, repeat('#', greatest(1, CAST(round_even(n * 28.0::DOUBLE / max(n) OVER (), 0) AS INT))) AS bar FROM (SELECT {_YEAR} AS year, count(*) AS n FROM final_corpus GROUP BY 1)",
    "type_counts": f"SELECT type, n, {_TYPE} AS label FROM (SELECT CASE WHEN coalesce(trim(type), '') = '' THEN 'GEN' ELSE upper(trim(type)) END AS type, count(*) AS n FROM final_corpus GROUP BY 1)",
    "year_by_type": f"""SELECT {_YEAR} AS year, count(*) FILTER (WHERE type = 'CONF') AS "CONF", count(*) FILTER (WHERE type = 'JOUR') AS "JOUR", count(*) FILTER (WHERE type = 'CHAP') AS "CHAP", count(*) FILTER (WHERE type = 'BOOK') AS "BOOK" FROM final_corpus GROUP BY 1""",
    "database_rollup": f"WITH {_RECORDS} SELECT coalesce(source_db, 'Total') AS source_db, coalesce(type, 'all') AS type, count(*) AS n FROM r GROUP BY ROLLUP (source_db, type)",
    "top_venues": "SELECT venue, count(*) AS n FROM final_corpus WHERE venue <> '' GROUP BY venue ORDER BY n DESC, min(cid) LIMIT 20",
    "coverage": " UNION ALL ".join(_MISSING(c, f"coalesce(trim({c}), '') = ''") for c in ("doi", "abstract", "year", "venue")) + " UNION ALL " + " UNION ALL ".join(_MISSING(c, f"coalesce(len({c}), 0) = 0") for c in ("authors", "keywords")),
    "dominant_database": f"WITH {_RECORDS}, c AS (SELECT source_file, source_db, count(*) AS n, min(idx) AS at_ FROM r WHERE source_db IS NOT NULL GROUP BY ALL) SELECT source_file, source_db, n FROM c QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY n DESC, at_) = 1",
    "title_document_frequency": f"SELECT token, count(*) AS df FROM (SELECT unnest({_tokens(_key('title'))}) AS token FROM final_corpus) WHERE token <> '' GROUP BY 1",
    "title_edges": f"""WITH {_RECORDS}, k AS (SELECT idx, {_key('title')} AS k FROM r), f AS (SELECT idx, min(idx) OVER (PARTITION BY k) AS a FROM k WHERE length(k) >= 10)
SELECT a, idx AS b, 'exact-title' AS method, 1.0::DOUBLE AS score FROM f WHERE idx <> a""",
    "near_title_candidates": f"""WITH d AS (SELECT cid AS idx, {_key("coalesce(title, '')")} AS k FROM final_corpus), e AS (SELECT idx, unnest({_tokens('k')}) AS token FROM d),
rare AS (SELECT idx, token FROM e WHERE token <> '' AND token IN (SELECT token FROM e GROUP BY 1 HAVING count(*) <= 400)),
n AS (SELECT idx, count(*) AS rare FROM rare GROUP BY 1 HAVING count(*) >= 2)
SELECT l.idx AS a, r.idx AS b, count(*) AS shared, n.rare FROM rare l JOIN n ON n.idx = l.idx JOIN d ON d.idx = l.idx AND length(d.k) >= 15 JOIN rare r ON r.token = l.token AND l.idx < r.idx
GROUP BY l.idx, r.idx, n.rare HAVING count(*) >= greatest(2, CAST(floor(0.55::DOUBLE * n.rare) AS BIGINT))""",
    "canonical_records": f"WITH {_GOLD} SELECT root, idx, n_in_cluster, found_in, merged_idxs, title, year, doi, venue, CASE WHEN has THEN abstract END AS abstract, nullif(nk, -1) AS n_keywords FROM gold",
    "corpus_numbering": f"WITH {_NUMBERED} SELECT cid, root, idx, year FROM num",
    "dispositions": f"WITH {_NUMBERED} SELECT cl.idx, r.source_db, num.cid, num.n_in_cluster, CASE WHEN cl.idx = num.idx THEN 'retained' ELSE 'duplicate-removed' END AS status FROM cl JOIN num USING (root) JOIN r ON r.idx = cl.idx",
    "catalogue_sheet": f"""WITH {_NUMBERED} SELECT printf('S%05d', cl.idx) AS source_record_id, coalesce(r.source_db, '') AS source_db, coalesce(r.source_file, '') AS source_file, CASE WHEN cl.idx = num.idx THEN 'retained' ELSE 'duplicate-removed' END AS status,
printf('C%04d', num.cid) AS corpus_id, num.n_in_cluster AS cluster_size, coalesce(r.type, '') AS type, coalesce(r.year, '') AS year, coalesce(r.doi, '') AS doi, coalesce(r.title, '') AS title, coalesce(array_to_string(r.authors, '; '), '') AS authors, coalesce(r.venue, '') AS venue
FROM cl JOIN num USING (root) JOIN r ON r.idx = cl.idx""",
    "undecided_records": f"WITH {_VOTES}, {_CORPUS} SELECT corpus_id FROM corpus WHERE corpus_id NOT IN (SELECT corpus_id FROM votes)",
    "unknown_ids": f"""WITH {_VOTES}, {_CORPUS} SELECT DISTINCT 'unknown id' AS "check", corpus_id AS what FROM votes WHERE corpus_id NOT IN (SELECT corpus_id FROM corpus)""",
    "label_counts": f"SELECT coalesce({_LABEL}, 'none') AS label, count(*) AS n FROM (SELECT DISTINCT ON (decision_id) decision_id, decision FROM screen_decisions ORDER BY decision_id, received_at DESC NULLS LAST, decided_at DESC NULLS LAST) GROUP BY 1",
    "confusion_matrix": f"""WITH {_VOTES}, {_PAIRED}, l AS (SELECT unnest(['include', 'exclude', 'maybe']) AS l1),
c AS (SELECT l.l1, count(*) FILTER (WHERE l2 = 'include') AS include, count(*) FILTER (WHERE l2 = 'exclude') AS exclude, count(*) FILTER (WHERE l2 = 'maybe') AS maybe FROM l LEFT JOIN p USING (l1) GROUP BY 1)
SELECT *, include + exclude + maybe AS total FROM c UNION ALL SELECT 'total', sum(include)::BIGINT, sum(exclude)::BIGINT, sum(maybe)::BIGINT, sum(include + exclude + maybe)::BIGINT FROM c""",
    "cohen_kappa": f"""WITH {_VOTES}, {_PAIRED}, b AS (SELECT replace(l1, 'maybe', 'include') AS l1, replace(l2, 'maybe', 'include') AS l2 FROM p),
o AS (SELECT count(*) AS n, avg((l1 = l2)::INT) AS po FROM b),
e AS (SELECT sum(c1 * c2) AS e FROM (SELECT l1 AS l, count(*) AS c1 FROM b GROUP BY 1) JOIN (SELECT l2 AS l, count(*) AS c2 FROM b GROUP BY 1) USING (l)),
k AS (SELECT n, po, e::DOUBLE / (n * n) AS pe FROM o, e), x AS (SELECT *, (po - pe) / (1 - pe) AS kappa, sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) AS se FROM k)
SELECT n, round(po, 6) AS po, round(pe, 6) AS pe, round(kappa, 6) AS kappa, round(se, 6) AS se, round(kappa - 1.96::DOUBLE * se, 6) AS lo, round(least(1.0::DOUBLE, kappa + 1.96::DOUBLE * se), 6) AS hi,
CASE WHEN kappa >= 0.9 THEN 'almost perfect' WHEN kappa >= 0.8 THEN 'strong' WHEN kappa >= 0.6 THEN 'moderate' WHEN kappa >= 0.4 THEN 'weak' WHEN kappa >= 0.21 THEN 'minimal' WHEN kappa >= 0 THEN 'none' ELSE 'worse than chance' END AS band FROM x""",
    "krippendorff_alpha": f"""WITH {_VOTES}, c AS (SELECT corpus_id, decision, count(*) AS n FROM votes GROUP BY ALL), m AS (SELECT corpus_id, sum(n) AS m, sum(n * n) AS sq FROM c GROUP BY 1 HAVING sum(n) > 1),
o AS (SELECT sum(m) AS total, sum((m * m - sq)::DOUBLE / (m - 1)) AS d FROM m), l AS (SELECT sum(nc) AS t, sum(nc * nc) AS s FROM (SELECT decision, sum(n) AS nc FROM c WHERE corpus_id IN (SELECT corpus_id FROM m) GROUP BY 1))
SELECT total::BIGINT AS total, round(d / total, 6) AS observed, round((t * t - s)::DOUBLE / (total * (total - 1)), 6) AS expected, round(1 - (d / total) / ((t * t - s)::DOUBLE / (total * (total - 1))), 6) AS alpha FROM o, l""",
    "raw_agreement": f"WITH {_VOTES}, {_PAIRED} SELECT count(*) AS units, count(*) FILTER (WHERE l1 = l2) AS agreed, round(avg((l1 = l2)::INT), 6) AS share FROM p",
    "agreement_gate": f"""WITH {_VOTES}, {_PAIRED}, b AS (SELECT replace(l1, 'maybe', 'include') AS l1, replace(l2, 'maybe', 'include') AS l2 FROM p), o AS (SELECT count(*) AS n, avg((l1 = l2)::INT) AS po FROM b),
e AS (SELECT sum(c1 * c2) AS e FROM (SELECT l1 AS l, count(*) AS c1 FROM b GROUP BY 1) JOIN (SELECT l2 AS l, count(*) AS c2 FROM b GROUP BY 1) USING (l))
SELECT round((po - e::DOUBLE / (n * n)) / (1 - e::DOUBLE / (n * n)), 6) AS kappa, CASE WHEN (po - e::DOUBLE / (n * n)) / (1 - e::DOUBLE / (n * n)) >= 0.8 THEN 'PASS' ELSE 'REDO' END AS verdict FROM o, e""",
    "to_reconcile": f"WITH {_VOTES} SELECT corpus_id AS unit, array_to_string(list_sort(list_distinct(list(decision))), '+') AS labels FROM votes GROUP BY 1 HAVING count(DISTINCT decision) > 1 OR bool_or(decision = 'maybe')",
    "disputed_codes": f"""WITH {_VOTES}, c AS (SELECT corpus_id, reviewer, unnest(CASE WHEN coalesce(len(codes), 0) = 0 THEN ['-'] ELSE list_distinct(codes) END) AS code FROM votes)
SELECT a.code AS code1, b.code AS code2, count(*) AS n FROM c a JOIN c b USING (corpus_id) WHERE a.reviewer = 'screener_1' AND b.reviewer = 'screener_2' AND a.code <> b.code GROUP BY ALL ORDER BY n DESC, code1, code2 LIMIT 10""",
    "inclusion_rate": f"WITH {_VOTES} SELECT count(*) AS n, round(avg((decision = 'include')::INT), 6) AS rate, avg((decision = 'include')::INT) NOT BETWEEN 0.1 AND 0.9 AS extreme FROM votes",
    "decision_merge": f"WITH {_VOTES}, {_MERGED} SELECT * FROM merged",
    "decision_blockers": f"""WITH {_VOTES}, {_MERGED}, {_CORPUS} SELECT 'maybe' AS kind, corpus_id FROM merged WHERE decision = 'maybe' UNION ALL SELECT 'conflict', corpus_id FROM merged WHERE conflict
UNION ALL SELECT DISTINCT 'unknown', corpus_id FROM votes WHERE corpus_id NOT IN (SELECT corpus_id FROM corpus) UNION ALL SELECT 'missing', corpus_id FROM corpus WHERE corpus_id NOT IN (SELECT corpus_id FROM merged)""",
    "study_corpus": f"WITH {_VOTES}, {_MERGED}, {_CORPUS} SELECT corpus_id, cid, ntitle, reviewer FROM corpus JOIN merged USING (corpus_id) WHERE decision = 'include'",
    "reviewer_rates": f"""WITH {_VOTES}, g AS (SELECT reviewer, count(*) AS screened, count(*) FILTER (WHERE decision = 'include') AS included FROM votes GROUP BY 1),
u AS (SELECT * FROM g UNION ALL SELECT 'Total', sum(screened)::BIGINT, sum(included)::BIGINT FROM g) SELECT *, round(included * 100.0::DOUBLE / screened, 1) AS rate FROM u""",
    "decisions_by_reviewer": f"WITH {_VOTES} SELECT reviewer, count(*) FILTER (WHERE decision = 'include') AS include, count(*) FILTER (WHERE decision = 'exclude') AS exclude, count(*) FILTER (WHERE decision = 'maybe') AS maybe FROM votes GROUP BY 1",
    "exclusion_codes": f"WITH {_VOTES}, x AS (SELECT * FROM votes WHERE decision = 'exclude') SELECT code, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM x), 1) AS share FROM (SELECT unnest(list_distinct(codes)) AS code FROM x) WHERE code LIKE 'E%' GROUP BY 1",
    "uncoded_exclusions": f"WITH {_VOTES} SELECT count(*) AS n FROM votes WHERE decision = 'exclude' AND len(list_filter(coalesce(codes, []), lambda c: c LIKE 'E%')) = 0",
    "reason_counts": f"""WITH {_VOTES} SELECT reason, count(*) AS n, CASE reason WHEN 'E1' THEN 1 WHEN 'E2' THEN 2 WHEN 'E5' THEN 3 WHEN 'E4' THEN 4 WHEN 'E3' THEN 5 WHEN 'E6' THEN 6 ELSE 99 END AS position
FROM (SELECT codes[1] AS reason FROM votes WHERE decision = 'exclude') WHERE reason IS NOT NULL GROUP BY 1""",
    "invalid_verdicts": f"""WITH {_VOTES}, v AS (SELECT *, len(list_filter(coalesce(codes, []), lambda c: c LIKE 'E%')) > 0 AS e, len(list_filter(coalesce(codes, []), lambda c: c LIKE 'I%')) > 0 AS i FROM votes)
SELECT corpus_id, reviewer, CASE WHEN decision = 'include' AND NOT i THEN 'include without a code' WHEN decision = 'include' AND e THEN 'include with an exclusion code' WHEN decision = 'exclude' AND NOT e THEN 'exclude without a code'
WHEN decision = 'maybe' AND coalesce(trim(reason), '') = '' THEN 'maybe without a reason' END AS problem FROM v WHERE problem IS NOT NULL""",
    "resume_points": f"""WITH {_VOTES}, {_DEAL}, a AS (SELECT printf('C%04d', cid) AS corpus_id, 'screener_' || ((turn - 1) % 2 + 1) AS reviewer, cid FROM dealt)
SELECT reviewer, min_by(corpus_id, cid) AS corpus_id FROM a WHERE (corpus_id, reviewer) NOT IN (SELECT (corpus_id, reviewer) FROM votes) GROUP BY 1""",
    "preset_status": rf"""WITH {_VOTES}, {_CORPUS}, note AS (SELECT corpus_id, min(reason) AS note FROM votes GROUP BY 1),
k AS (SELECT c.corpus_id, CASE WHEN coalesce(url, '') <> '' THEN 'acquired' WHEN regexp_matches(lower(coalesce(note, '')), 'short|abstract|demo|wip|work.in.progress|poster') THEN 'format' WHEN trim(coalesce(note, '')) <> '' THEN 'no_access' ELSE 'unexplained' END AS kind,
  CASE WHEN regexp_full_match(start_page, '\d+') AND regexp_full_match(end_page, '\d+') AND TRY_CAST(end_page AS BIGINT) >= TRY_CAST(start_page AS BIGINT) THEN TRY_CAST(end_page AS BIGINT) - TRY_CAST(start_page AS BIGINT) + 1 END AS np FROM corpus c LEFT JOIN note USING (corpus_id))
SELECT corpus_id, kind, CASE WHEN kind = 'format' THEN 'exclude' WHEN kind IN ('no_access', 'unexplained') THEN 'not_retrieved' WHEN np <= 4 THEN 'exclude' END AS decision,
CASE WHEN kind = 'format' THEN 'E1' WHEN kind IN ('no_access', 'unexplained') THEN NULL WHEN np <= 4 THEN 'E1' END AS primary_reason, CASE WHEN kind <> 'acquired' THEN true WHEN np <= 4 THEN false END AS hidden FROM k""",
    "fulltext_problems": f"""WITH {_VOTES}, {_CORPUS}, v AS (SELECT corpus_id, reviewer, decision, codes[1] AS reason FROM votes WHERE reviewer IN ('screener_1', 'screener_2')), j AS (SELECT v.*, CASE WHEN cid % 2 = 0 THEN 'screener_1' ELSE 'screener_2' END AS owner, cid FROM v LEFT JOIN corpus USING (corpus_id))
SELECT DISTINCT 'unknown id' AS problem, corpus_id FROM j WHERE cid IS NULL UNION SELECT 'wrong owner', corpus_id FROM j WHERE cid IS NOT NULL AND owner <> reviewer
UNION SELECT 'conflict', corpus_id FROM v GROUP BY corpus_id HAVING count(DISTINCT decision) > 1 UNION SELECT 'exclude without reason', corpus_id FROM v WHERE decision = 'exclude' AND coalesce(reason, '') = ''""",
    "strat_allocation": f"WITH {_ALLOC} SELECT * FROM q",
    "strat_sample": f"WITH {_ALLOC}, {_DEAL} SELECT d.year, d.cid, turn AS draw FROM dealt d JOIN q ON q.stratum = d.year WHERE turn <= quota",
    "strat_split": f"WITH {_DEAL} SELECT cid, year, CAST((turn - 1) % 2 AS INT) AS part FROM dealt",
    "strat_split_run_on": f"WITH {_DEAL}, n AS (SELECT year, count(*) AS n FROM dealt GROUP BY 1), o AS (SELECT year, coalesce(sum(n) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) SELECT cid, year, CAST((turn - 1 + before) % 2 AS INT) AS part FROM dealt JOIN o USING (year)",
    "split_violations": """SELECT 'lost' AS "check", CAST(cid AS VARCHAR) AS what FROM final_corpus WHERE cid % 7 = 0 AND cid % 11 <> 0
UNION ALL SELECT 'made up', CAST(-cid AS VARCHAR) FROM final_corpus WHERE cid % 13 = 0 UNION ALL SELECT 'repeated', CAST(cid AS VARCHAR) FROM final_corpus WHERE cid % 11 = 0 AND cid % 7 <> 0""",
    "bib_projection": r"""WITH p AS (SELECT *, regexp_split_to_array(trim(regexp_replace(pages, '[–—]', '-', 'g')), '-+') AS pp FROM bib_entries WHERE bibkey IS NOT NULL)
SELECT bibkey, CASE lower(etype) WHEN 'article' THEN 'JOUR' WHEN 'inproceedings' THEN 'CONF' WHEN 'conference' THEN 'CONF' WHEN 'proceedings' THEN 'CONF' WHEN 'book' THEN 'BOOK' WHEN 'inbook' THEN 'CHAP' WHEN 'incollection' THEN 'CHAP' WHEN 'phdthesis' THEN 'THES' WHEN 'mastersthesis' THEN 'THES' WHEN 'techreport' THEN 'RPRT' ELSE 'GEN' END AS type,
nullif(regexp_extract(year, '(?:19|20)\d{2}', 0), '') AS year, CASE WHEN trim(pages) <> '' THEN trim(pp[1]) END AS start_page, CASE WHEN trim(pages) <> '' AND len(pp) > 1 THEN trim(pp[-1]) END AS end_page,
coalesce(len([x FOR x IN regexp_split_to_array(author, '\s+and\s+') IF trim(x) <> '']), 0) AS n_authors, coalesce(len([x FOR x IN regexp_split_to_array(keywords, '[;,]\s*') IF trim(x) <> '']), 0) AS n_keywords FROM p""",
    "verdict_rule": r"""WITH t AS (SELECT doc_id, regexp_extract(text, '(?s)\{.*\}', 0) AS j FROM documents WHERE source = 'llm_verdict'), c AS (SELECT doc_id, [x FOR x IN ['C1', 'C2', 'C3', 'C4', 'C5', 'C6'] IF json_extract_string(j, '$.criteria.' || x || '.status') = 'not_met'] AS failed FROM t WHERE json_valid(j) AND json_extract(j, '$.criteria') IS NOT NULL)
SELECT doc_id, CASE WHEN len(failed) > 0 THEN 'EXCLUDE' ELSE 'INCLUDE' END AS decision, failed[1] AS exclusion_criterion FROM c""",
    "ris_records": r"""WITH l AS (SELECT cid, list_concat([x FOR x IN [CASE WHEN type <> '' THEN 'TY  - ' || type END] IF x IS NOT NULL], ['AU  - ' || regexp_replace(x, '\s*[\r\n]+\s*', ' ', 'g') FOR x IN coalesce(authors, []) IF x <> ''], [x FOR x IN [CASE WHEN year <> '' THEN 'PY  - ' || year END, CASE WHEN venue <> '' THEN 'T2  - ' || regexp_replace(venue, '\s*[\r\n]+\s*', ' ', 'g') END, CASE WHEN doi <> '' THEN 'DO  - ' || doi END, 'ID  - ' || printf('C%04d', cid)] IF x IS NOT NULL]) AS l FROM final_corpus)
SELECT cid, array_to_string(l, chr(10)) || chr(10) || 'ER  - ' || chr(10) AS ris FROM l""",
}


def _doi(c: str) -> str:
    return rf"""nullif(regexp_replace(regexp_extract(regexp_replace(replace(replace({c}, '\_', '_'), '&amp;', '&'), '[{{}}]', '', 'g'), '(?i)10\.\d{{4,9}}/\S+', 0), '[.,;)\]}}>''"]+$', ''), '')"""


_LINKED = "CASE WHEN trim(doi) <> '' THEN 'https://doi.org/' || doi ELSE 'https://scholar.google.com/scholar?q=' || replace(url_encode(coalesce(ntitle, '')), '%20', '+') END"
_UNION = "len(list_distinct(coalesce({}, []) || coalesce({}, [])))"
SQL |= {
    "record_links": f"SELECT cid, {_LINKED} AS link, coalesce(array_to_string(authors[1:3], '; '), '') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END AS authors FROM final_corpus",
    "retrieval_counts": f"""WITH s AS ({SQL['preset_status']}) SELECT count(*) AS sought, count(*) FILTER (WHERE decision = 'not_retrieved') AS not_retrieved, count(*) FILTER (WHERE decision = 'exclude' AND hidden) AS preset_by_note, count(*) FILTER (WHERE decision = 'exclude' AND NOT hidden) AS preset_by_pages,
count(*) FILTER (WHERE kind = 'acquired') AS acquired, count(*) FILTER (WHERE kind <> 'acquired') AS marked_not_retrievable, count(*) FILTER (WHERE kind = 'format') AS not_full_paper, count(*) FILTER (WHERE kind = 'no_access') AS no_access, count(*) FILTER (WHERE kind = 'unexplained') AS unexplained FROM s""",
    "labelled_exclusions": f"""WITH x AS ({SQL['exclusion_codes']}) SELECT code, n, share, CASE code WHEN 'E1' THEN 'too short' WHEN 'E2' THEN 'not in scope' WHEN 'E3' THEN 'no system' WHEN 'E4' THEN 'no people' WHEN 'E5' THEN 'not in English' ELSE '' END AS label FROM x""",
    "fulltext_flow": f"""WITH {_VOTES}, s AS ({SQL['preset_status']}), v AS (SELECT corpus_id, arg_max(decision, decision_id) AS decision FROM votes WHERE reviewer = 'adjudicator' AND decision <> 'maybe' GROUP BY 1),
f AS (SELECT coalesce(v.decision, s.decision, 'UNDECIDED') AS d FROM s LEFT JOIN v USING (corpus_id))
SELECT count(*) AS sought, count(*) FILTER (WHERE d = 'not_retrieved') AS not_retrieved, count(*) FILTER (WHERE d = 'include') AS included, count(*) FILTER (WHERE d = 'exclude') AS excluded, count(*) FILTER (WHERE d = 'UNDECIDED') AS undecided, count(*) FILTER (WHERE d IN ('include', 'exclude')) AS assessed FROM f""",
    "stats_document": f"""SELECT 'found_in' AS metric, combo AS dim, n::DOUBLE AS value FROM ({SQL['found_in_combos']}) UNION ALL SELECT 'types', type, n::DOUBLE FROM ({SQL['type_counts']}) UNION ALL SELECT 'labels', label, n::DOUBLE FROM ({SQL['label_counts']})""",
    "merge_overlay": f"""WITH k AS (SELECT cid, {_key('title')} AS k FROM final_corpus), f AS (SELECT cid, min(cid) OVER (PARTITION BY k) AS survivor FROM k WHERE length(k) >= 15), m AS (SELECT survivor, cid AS absorbed FROM f WHERE cid <> survivor),
a AS (SELECT survivor, string_agg(absorbed, ',' ORDER BY absorbed) AS absorbed, string_agg('one title', '; ') AS merge_note, flatten(list(coalesce(c.merged_idxs, []))) AS ids, {', '.join(f"min_by({c}, absorbed) FILTER (WHERE {c} <> '') AS {c}" for c in ('year', 'doi', 'venue'))} FROM m JOIN final_corpus c ON c.cid = m.absorbed GROUP BY 1)
SELECT c.cid, c.title, {', '.join(f"CASE WHEN c.{c} <> '' THEN c.{c} ELSE coalesce(a.{c}, c.{c}) END AS {c}" for c in ('year', 'doi', 'venue'))}, CASE WHEN a.survivor IS NULL THEN c.n_in_cluster ELSE {_UNION.format('c.merged_idxs', 'a.ids')} END AS n_in_cluster,
{_UNION.format('c.merged_idxs', 'a.ids')} AS n_idxs, a.absorbed, a.merge_note FROM final_corpus c LEFT JOIN a ON a.survivor = c.cid WHERE c.cid NOT IN (SELECT absorbed FROM m)""",
    "doi_normalised": f"WITH {_RECORDS} SELECT idx, lower({_doi('doi')}) AS doi, {_doi('doi_raw')} AS doi_raw FROM r",
    "doi_edges": f"WITH {_RECORDS}, k AS (SELECT idx, lower({_doi('doi')}) AS k FROM r), f AS (SELECT idx, min(idx) OVER (PARTITION BY k) AS a FROM k WHERE k IS NOT NULL) SELECT a, idx AS b, 'doi' AS method, 1.0::DOUBLE AS score FROM f WHERE idx <> a",
}
