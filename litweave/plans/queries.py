"""Queries of the core, one for each operator, over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from litweave.functions import text as X
from litweave.operators import agreement, checks, counts, golden, linkage, reconcile, sampling
from litweave.session import cut, table
from litweave.sinks import ris as ris_sink
from litweave.sinks import tables
from litweave.sources import bibtex

SEED = 20260928
QUERIES: dict = {}
#: What linking looks at.
LINKED = ("title", "authors", "year", "doi")


def query(f):
    QUERIES[f.__name__] = f
    return f


def _corpus(spark, d):
    return table(spark, d, "final_corpus").withColumn("corpus_id", X.record_id("C", 4, F.col("cid")))


def _records(spark, d, *cols):
    """Source records, each as it arrived last; of ``cols`` only, if any are named."""
    r = table(spark, d, "source_records").where("idx IS NOT NULL")
    rest = [c for c in r.columns if c != "idx" and (not cols or c in cols)]
    return r.groupBy("idx").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "exported_at")).alias("s")).select("idx", "s.*")


def _catalogue(spark, d):
    """The latest row of each source record."""
    c = table(spark, d, "catalogue_rows")
    return c.groupBy("source_record_id").agg(F.max(F.struct("updated_at", "status", "corpus_id", "source_db", "source_file", "type", "cluster_size")).alias("s")).select("source_record_id", "s.*")


def _decisions(spark, d):
    """Votes, each as it was received last."""
    v = table(spark, d, "screen_decisions").where("decision_id IS NOT NULL")
    return reconcile.latest(v, ("decision_id",), "received_at", "decided_at")


def _votes(spark, d):
    """Votes with a known label, each decision once, the last of each record and reviewer."""
    v = _decisions(spark, d).withColumn("decision", X.label(F.col("decision"))).where("decision IS NOT NULL AND corpus_id IS NOT NULL AND reviewer IS NOT NULL")
    return reconcile.latest(v)


def _ratings(spark, d):
    return _votes(spark, d).select(F.col("corpus_id").alias("unit"), F.col("reviewer").alias("rater"), F.col("decision").alias("label"))


def _merged(spark, d):
    v = _votes(spark, d).withColumn("authoritative", F.col("reviewer") == "adjudicator").withColumn("seq", F.col("decision_id"))
    return v, reconcile.merge(v)


@query
def norm_key_profile(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.ascii_key(F.col("text")).alias("k"))
    return t.select("doc_id", F.length("k").alias("n"), F.size(X.title_tokens(F.col("k"))).alias("n_tokens"), F.md5("k").alias("key"))


def _disposition(t):
    g = t.groupBy("k").agg(F.min_by("doc_id", F.struct((-F.coalesce("n_chars", F.lit(-1))).alias("n"), "doc_id")).alias("keeper"), F.count("*").alias("n_in_cluster"))
    return t.join(g, "k").select("doc_id", "source", "keeper", "n_in_cluster", F.when(F.col("doc_id") == F.col("keeper"), "retained").otherwise("duplicate-removed").alias("status"))


@query
def exact_dup_disposition(spark, d):
    """Texts of equal ASCII letters and digits, as the SQL has it: which document stays, which go.

    Texts without any (other scripts, NULL, empty) are one group here; ``text_dup_disposition`` compares whole texts.
    """
    return _disposition(table(spark, d, "documents").select("doc_id", "source", "n_chars", F.md5(X.ascii_key(F.coalesce("text", F.lit("")))).alias("k")))


@query
def text_dup_disposition(spark, d):
    """Equal texts but for case and punctuation, in any script: which document stays, which go. A NULL text equals none."""
    key = F.coalesce(F.md5(X.text_key(F.col("text"))), F.concat(F.lit("id "), F.col("doc_id").cast("string")))
    return _disposition(table(spark, d, "documents").select("doc_id", "source", "n_chars", key.alias("k")))


@query
def dup_identification(spark, d):
    return counts.by_disposition(exact_dup_disposition(spark, d).withColumn("source", F.coalesce("source", F.lit("-"))), "source")


@query
def dup_cluster_sizes(spark, d):
    return counts.count_by(exact_dup_disposition(spark, d).where("status = 'retained'"), "n_in_cluster")


@query
def catalogue_identification(spark, d):
    return counts.by_disposition(_catalogue(spark, d), "source_db")


@query
def cluster_sizes(spark, d):
    per = _catalogue(spark, d).groupBy("corpus_id").agg(F.count("*").alias("size"))
    return counts.count_by(per, "size")


@query
def found_in_combos(spark, d):
    return counts.combos(table(spark, d, "final_corpus").withColumn("found_in", F.array_sort(F.array_distinct("found_in"))), "found_in")


@query
def doi_normalised(spark, d):
    return _records(spark, d).select("idx", X.norm_doi(F.col("doi")).alias("doi"), X.norm_doi(F.col("doi_raw"), False).alias("doi_raw"))


@query
def title_normalised(spark, d):
    return table(spark, d, "final_corpus").select("cid", X.norm_title(F.col("title")).alias("ntitle"))


@query
def surnames(spark, d):
    a = table(spark, d, "final_corpus").select(F.explode("authors").alias("a")).where("a IS NOT NULL")
    return counts.count_by(a.select(X.surname(F.col("a")).alias("surname")), "surname")


@query
def pages(spark, d):
    return table(spark, d, "final_corpus").select("cid", X.n_pages(F.col("start_page"), F.col("end_page")).alias("n_pages"))


@query
def system_names(spark, d):
    return table(spark, d, "final_corpus").select("cid", X.precolon(F.col("title")).alias("system")).where("system IS NOT NULL")


@query
def record_links(spark, d):
    return table(spark, d, "final_corpus").select("cid", X.link(X.blank_to_null(F.col("doi")), F.col("ntitle")).alias("link"), X.et_al(F.coalesce("authors", F.array().cast("array<string>"))).alias("authors"))


@query
def year_histogram(spark, d):
    y = table(spark, d, "final_corpus").select(F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown")).alias("year"))
    return sampling.bars(counts.count_by(y, "year"), "n")


@query
def type_counts(spark, d):
    return counts.count_by(table(spark, d, "final_corpus").select(X.fix_type(F.col("type")).alias("type")), "type").withColumn("label", X.type_label(F.col("type")))


@query
def year_by_type(spark, d):
    c = table(spark, d, "final_corpus").withColumn("year", F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown")))
    return counts.pivot(c, "year", "type", ["CONF", "JOUR", "CHAP", "BOOK"])


@query
def database_rollup(spark, d):
    r = _records(spark, d).rollup("source_db", "type").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("source_db", F.lit("Total")).alias("source_db"), F.coalesce("type", F.lit("all")).alias("type"), "n")


@query
def top_venues(spark, d):
    return counts.top(table(spark, d, "final_corpus"), "venue", "cid")


@query
def coverage(spark, d):
    return counts.coverage(table(spark, d, "final_corpus"), "doi", "abstract", "year", "authors", "keywords", "venue")


@query
def dominant_database(spark, d):
    return counts.mode(_records(spark, d), "source_file", "source_db", "idx")


@query
def title_document_frequency(spark, d):
    t = table(spark, d, "final_corpus").select(X.title_tokens(X.ascii_key(F.col("title"))).alias("tokens"))
    return counts.document_frequency(t).where("token <> ''")


@query
def doi_edges(spark, d):
    r = _records(spark, d).select("idx", X.norm_doi(F.col("doi")).alias("doi"))
    return linkage.doi_edges(r).select("a", "b", "method", "score")


@query
def title_edges(spark, d):
    r = _records(spark, d).select("idx", X.ascii_key(F.col("title")).alias("ntitle"))
    return linkage.title_edges(r).select("a", "b", "method", "score")


def _tokened(spark, d):
    t = table(spark, d, "final_corpus").select(F.col("cid").alias("idx"), X.ascii_key(F.coalesce("title", F.lit(""))).alias("ntitle"))
    return t.withColumn("tokens", F.filter(X.title_tokens(F.col("ntitle")), lambda w: w != ""))


@query
def near_title_candidates(spark, d):
    return linkage.token_candidates(_tokened(spark, d))


@query
def record_clusters(spark, d):
    return linkage.link(_records(spark, d, *LINKED))[0]


@query
def link_counts(spark, d):
    return counts.count_by(linkage.link(_records(spark, d, *LINKED))[1], "method")


@query
def flagged_pairs(spark, d):
    return linkage.link(_records(spark, d, *LINKED))[2]


def _clusters(spark, d):
    c = _catalogue(spark, d).select(F.expr("try_cast(substr(source_record_id, 2) AS bigint)").alias("idx"), F.expr("try_cast(substr(corpus_id, 2) AS bigint)").alias("root"))
    return c.where("idx IS NOT NULL AND root IS NOT NULL")


@query
def canonical_records(spark, d):
    c = golden.canonical(_records(spark, d), _clusters(spark, d))
    return c.select("root", "idx", "n_in_cluster", F.array_join("found_in", " + ").alias("found_in"), F.array_join(F.transform("merged_idxs", lambda x: x.cast("string")), ",").alias("merged_idxs"), "title", "year", "doi", "venue", F.md5("abstract").alias("abstract"), F.size("keywords").alias("n_keywords"))


@query
def corpus_numbering(spark, d):
    c = golden.canonical(_records(spark, d), _clusters(spark, d)).withColumn("ntitle", X.ascii_key(F.coalesce("title", F.lit(""))))
    return golden.number(c).select("cid", "root", "idx", "year")


@query
def dispositions(spark, d):
    c = cut(corpus_numbering_input(spark, d))
    return golden.disposition(_records(spark, d).select("idx", "source_db"), c)


def corpus_numbering_input(spark, d):
    c = golden.canonical(_records(spark, d), _clusters(spark, d)).withColumn("ntitle", X.ascii_key(F.coalesce("title", F.lit(""))))
    return golden.number(c).select("cid", "idx", "n_in_cluster", "merged_idxs")


@query
def catalogue_sheet(spark, d):
    r = _records(spark, d)
    return tables.catalogue(golden.disposition(r, cut(corpus_numbering_input(spark, d))))


@query
def merge_overlay(spark, d):
    """Records of one title (but for case and punctuation) merged into the first of them."""
    c = table(spark, d, "final_corpus").select("cid", "title", "authors", "year", "doi", "venue", "abstract", "keywords", "n_in_cluster", "found_in", "merged_idxs", "type")
    k = c.select("cid", X.ascii_key(F.col("title")).alias("k")).where("length(k) >= 15")
    first = k.groupBy("k").agg(F.min("cid").alias("survivor"), F.count("*").alias("n")).where("n > 1")
    merges = k.join(first, "k").where("cid <> survivor").select("survivor", F.col("cid").alias("absorbed"), F.lit("one title").alias("why"))
    out = golden.overlay(c, cut(merges))
    return out.select("cid", "title", "year", "doi", "venue", "n_in_cluster", F.size("merged_idxs").alias("n_idxs"), F.array_join(F.transform("absorbed_cids", lambda x: x.cast("string")), ",").alias("absorbed"), "merge_note")


@query
def worksheet(spark, d):
    c = table(spark, d, "final_corpus").select(F.col("cid").alias("idx"), "title", "abstract", X.ascii_key(F.coalesce("title", F.lit(""))).alias("ntitle"))
    c = c.withColumn("tokens", F.filter(X.title_tokens(F.col("ntitle")), lambda w: w != ""))
    return linkage.number_pairs(linkage.worksheet_pairs(c))


@query
def undecided_records(spark, d):
    return _corpus(spark, d).select("corpus_id").join(_votes(spark, d), "corpus_id", "left_anti")


@query
def unknown_ids(spark, d):
    return checks.not_in(_votes(spark, d), _corpus(spark, d))


@query
def label_counts(spark, d):
    v = _decisions(spark, d)
    return counts.count_by(v.select(F.coalesce(X.label(F.col("decision")), F.lit("none")).alias("label")), "label")


@query
def confusion_matrix(spark, d):
    return agreement.confusion(agreement.paired(_ratings(spark, d), "screener_1", "screener_2"), ("include", "exclude", "maybe"))


@query
def cohen_kappa(spark, d):
    k = agreement.cohen(agreement.paired(agreement.binary(_ratings(spark, d)), "screener_1", "screener_2"))
    return k.select("n", *(F.round(c, 6).alias(c) for c in ("po", "pe", "kappa", "se", "lo", "hi")), "band")


@query
def krippendorff_alpha(spark, d):
    return agreement.krippendorff(_ratings(spark, d)).select("total", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")))


@query
def raw_agreement(spark, d):
    r = agreement.raw_agreement(agreement.common(_ratings(spark, d).where(F.col("rater").isin("screener_1", "screener_2")), 2))
    return r.withColumn("share", F.round("share", 6))


@query
def agreement_gate(spark, d):
    return agreement.gate(_ratings(spark, d), "screener_1", "screener_2").withColumn("kappa", F.round("kappa", 6))


@query
def to_reconcile(spark, d):
    return agreement.to_reconcile(_ratings(spark, d)).select("unit", F.array_join("labels", "+").alias("labels"))


@query
def disputed_codes(spark, d):
    c = _votes(spark, d).select(F.col("corpus_id").alias("unit"), F.col("reviewer").alias("rater"), F.explode_outer(F.array_distinct("codes")).alias("code"))
    return agreement.disputed_codes(c, "screener_1", "screener_2")


@query
def inclusion_rate(spark, d):
    return agreement.rates(_ratings(spark, d)).withColumn("rate", F.round("rate", 6))


@query
def decision_merge(spark, d):
    return _merged(spark, d)[1].select("corpus_id", "decision", "reviewer", "authoritative", "conflict")


@query
def decision_blockers(spark, d):
    v, m = _merged(spark, d)
    return reconcile.blockers(m, v, _corpus(spark, d).select("corpus_id"))


@query
def study_corpus(spark, d):
    return reconcile.study(_corpus(spark, d).select("corpus_id", "cid", "ntitle"), _merged(spark, d)[1]).select("corpus_id", "cid", "ntitle", "reviewer")


@query
def reviewer_rates(spark, d):
    return counts.reviewer_rates(_votes(spark, d))


@query
def decisions_by_reviewer(spark, d):
    return counts.pivot(_votes(spark, d), "reviewer", "decision", ["include", "exclude", "maybe"])


@query
def exclusion_codes(spark, d):
    return counts.code_counts(_votes(spark, d), "E", decision="exclude")


@query
def uncoded_exclusions(spark, d):
    return counts.uncoded(_votes(spark, d).where("decision = 'exclude'"), "E")


@query
def reason_counts(spark, d):
    v = _votes(spark, d).where("decision = 'exclude'").select(F.get("codes", F.lit(0)).alias("reason"))
    return counts.reasons(v)


@query
def invalid_verdicts(spark, d):
    return reconcile.invalid_verdicts(_votes(spark, d))


@query
def resume_points(spark, d):
    a = sampling.hash_split(_corpus(spark, d).withColumn("year", F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown"))), "cid", "year", 2, SEED)
    a = a.select("corpus_id", F.concat(F.lit("screener_"), (F.col("part") + 1).cast("string")).alias("reviewer"), F.col("cid").alias("position"))
    return reconcile.resume(a, _votes(spark, d))


@query
def preset_status(spark, d):
    """Retrieval status of each record from whether it has a link, with the first reviewer's reason as the note."""
    note = _votes(spark, d).groupBy("corpus_id").agg(F.min("reason").alias("note"))
    c = _corpus(spark, d).join(note, "corpus_id", "left")
    kind = X.retrieval_kind(F.when(F.coalesce("url", F.lit("")) != "", "Acquired").otherwise("Not acquired"), F.col("note"))
    c = c.withColumn("kind", kind).withColumn("preset", X.preset(F.col("kind"), X.n_pages(F.col("start_page"), F.col("end_page"))))
    return c.select("corpus_id", "kind", "preset.decision", "preset.primary_reason", "preset.hidden")


@query
def fulltext_flow(spark, d):
    c = preset_status(spark, d).select("corpus_id", F.when(F.col("decision").isNotNull(), F.struct("decision", "primary_reason", "hidden")).alias("preset"))
    v = _votes(spark, d).where("reviewer = 'adjudicator' AND decision <> 'maybe'").select("corpus_id", "decision", F.get("codes", F.lit(0)).alias("primary_reason"), F.col("decision_id").alias("seq"))
    return reconcile.flow(reconcile.fulltext(c, v))


@query
def fulltext_problems(spark, d):
    c = _corpus(spark, d).select("corpus_id", F.when(F.col("cid") % 2 == 0, "screener_1").otherwise("screener_2").alias("assigned_to"))
    v = _votes(spark, d).where("reviewer IN ('screener_1', 'screener_2')").select("corpus_id", F.col("reviewer").alias("screener"), "decision", F.get("codes", F.lit(0)).alias("primary_reason"))
    return reconcile.fulltext_problems(c, v)


@query
def verdict_rule(spark, d):
    t = table(spark, d, "documents").where("source = 'llm_verdict'")
    m = F.from_json(F.regexp_extract("text", r"(?s)\{.*\}", 0), "criteria map<string,struct<status:string,reason:string>>")
    v = t.select("doc_id", F.transform_values(m["criteria"], lambda k, x: x.status).alias("c")).where("c IS NOT NULL")
    return v.select("doc_id", reconcile.verdict(F.col("c")).alias("v")).select("doc_id", "v.decision", "v.exclusion_criterion")


@query
def strat_allocation(spark, d):
    c = table(spark, d, "final_corpus").withColumn("year", F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown")))
    return sampling.allocation(c, "year", F.col("cid"))


@query
def strat_sample(spark, d):
    c = table(spark, d, "final_corpus").select("cid", F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown")).alias("year"))
    return sampling.hash_sample(c, "cid", "year", sampling.allocation(c, "year", F.col("cid")), SEED)


@query
def strat_split(spark, d):
    c = table(spark, d, "final_corpus").select("cid", F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown")).alias("year"))
    return sampling.hash_split(c, "cid", "year", 2, SEED)


@query
def strat_split_run_on(spark, d):
    c = table(spark, d, "final_corpus").select("cid", F.coalesce(X.blank_to_null(F.col("year")), F.lit("unknown")).alias("year"))
    return sampling.hash_split(c, "cid", "year", 2, SEED, run_on=True)


@query
def split_violations(spark, d):
    """What is wrong with a split from which every seventh record was taken, in which every eleventh was dealt twice, and
    to which numbers of no record were added."""
    parts = strat_split(spark, d).select("cid")
    made = parts.where("cid % 7 <> 0").union(parts.where("cid % 11 = 0")).union(parts.where("cid % 13 = 0").select(-F.col("cid")))
    return checks.partition_of(made, table(spark, d, "final_corpus"), "cid")


@query
def bib_projection(spark, d):
    """The entries' table as parsed entries, projected as those of a file are."""
    b = table(spark, d, "bib_entries")
    names = ("title", "author", "year", "doi", "booktitle", "journal", "pages", "publisher", "keywords")
    raw = b.select(F.lit("-").alias("file"), F.lit(0).alias("rec"), F.lower("etype").alias("etype"), "bibkey", F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names)).alias("fields"))
    p = bibtex.project(raw)
    return p.select(F.substring(F.get("notes", F.lit(0)), 13, 1000).alias("bibkey"), "type", "year", "start_page", "end_page", F.size("authors").alias("n_authors"), F.size("keywords").alias("n_keywords"))


@query
def retrieval_counts(spark, d):
    return counts.retrieval(preset_status(spark, d))


@query
def labelled_exclusions(spark, d):
    """Exclusion codes with their labels; the labels are a parameter table."""
    labels = spark.createDataFrame([(f"E{i}", t) for i, t in enumerate(("too short", "not in scope", "no system", "no people", "not in English"), 1)], "code string, label string")
    return counts.labelled(exclusion_codes(spark, d), labels)


@query
def ris_records(spark, d):
    c = table(spark, d, "final_corpus").withColumn("id", X.record_id("C", 4, F.col("cid")))
    tags = (("TY", "type"), ("AU*", "authors"), ("PY", "year"), ("T2", "venue"), ("DO", "doi"), ("ID", "id"))
    return c.select("cid", ris_sink.ris_text(c, tags).alias("ris"))


@query
def stats_document(spark, d):
    return counts.stats_long(found_in=found_in_combos(spark, d), types=type_counts(spark, d).select("type", "n"), labels=label_counts(spark, d))
