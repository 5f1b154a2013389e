"""Decisions of several reviewers into one per record, with everything that stands in the way of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.functions import text as X


def merge(decisions: DataFrame) -> DataFrame:
    """(corpus_id, decision, reviewer, codes, reason, authoritative, conflict): one row per record.

    ``decisions`` has corpus_id, decision, reviewer, codes, reason, authoritative and ``seq``, the order they were read
    in. An adjudicated decision beats a plain one; among those of the winning rank the first decision stands, details
    come from the last row that agrees with it, and ``conflict`` says that they differ. Unlike a merge row by row, a
    later plain row that agrees never takes the adjudicated mark away.
    """
    d = decisions.where("decision IS NOT NULL AND corpus_id IS NOT NULL")
    top = F.struct(F.col("authoritative"), -F.col("seq"))
    best = d.groupBy("corpus_id").agg(F.max_by("decision", top).alias("decision"), F.max("authoritative").alias("authoritative"))
    same = d.alias("d").join(best.alias("b"), "corpus_id").where("d.authoritative = b.authoritative")
    own = F.col("d.decision") == F.col("b.decision")
    return same.groupBy("corpus_id", F.col("b.decision").alias("decision"), F.col("b.authoritative").alias("authoritative")).agg(
        F.max_by(F.when(own, F.struct("reviewer", "codes", "reason")), F.when(own, F.col("seq"))).alias("s"), (F.countDistinct("d.decision") > 1).alias("conflict")
    ).select("corpus_id", "decision", "s.reviewer", "s.codes", "s.reason", "authoritative", "conflict")


def latest(decisions: DataFrame, key: tuple[str, ...] = ("corpus_id", "reviewer"), at: str = "decided_at", tie: str = "decision_id") -> DataFrame:
    """The last row of each key; of equally late ones the highest ``tie``."""
    rest = [c for c in decisions.columns if c not in key]
    got = decisions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("s"))
    return got.select(*key, "s.*")


def blockers(merged: DataFrame, decisions: DataFrame, corpus: DataFrame, allow_partial: bool = False) -> DataFrame:
    """(kind, corpus_id) of everything that stops a study corpus: maybe, conflict, missing, unknown."""
    out = merged.where("decision = 'maybe'").select(F.lit("maybe").alias("kind"), "corpus_id").union(merged.where("conflict").select(F.lit("conflict"), "corpus_id"))
    out = out.union(decisions.select("corpus_id").where("corpus_id IS NOT NULL").distinct().join(corpus, "corpus_id", "left_anti").select(F.lit("unknown"), "corpus_id"))
    return out if allow_partial else out.union(corpus.select("corpus_id").join(merged, "corpus_id", "left_anti").select(F.lit("missing"), "corpus_id"))


def study(corpus: DataFrame, merged: DataFrame, decision: str = "include") -> DataFrame:
    return corpus.join(merged.where(F.col("decision") == decision).select("corpus_id", "reviewer", "codes", "reason"), "corpus_id")


def invalid_verdicts(d: DataFrame, phase: str = "agreement") -> DataFrame:
    """(corpus_id, reviewer, problem): include needs an I code and no E, exclude an E code, maybe a reason; in the
    screening phase there is no maybe."""
    has = lambda p: F.exists(F.coalesce("codes", F.array().cast("array<string>")), lambda c: c.startswith(p))
    kind = F.col("decision")
    problem = (
        F.when((kind == "include") & ~has("I"), "include without a code").when((kind == "include") & has("E"), "include with an exclusion code").when((kind == "exclude") & ~has("E"), "exclude without a code")
        .when((kind == "maybe") & F.lit(phase == "screening"), "maybe in screening").when((kind == "maybe") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "maybe without a reason").when(kind.isNull(), "no label")
    )
    return d.withColumn("problem", problem).where("problem IS NOT NULL").select("corpus_id", "reviewer", "problem")


def fulltext(corpus: DataFrame, decisions: DataFrame) -> DataFrame:
    """(corpus_id, decision, primary_reason, source): a reader's last decision, else what was preset, else UNDECIDED.

    ``corpus`` has corpus_id and preset struct<decision,primary_reason,hidden>; ``decisions`` corpus_id, decision,
    primary_reason, seq.
    """
    last = decisions.groupBy("corpus_id").agg(F.max_by(F.struct("decision", "primary_reason"), "seq").alias("d"))
    j = corpus.join(last, "corpus_id", "left")
    return j.select(
        "corpus_id", F.coalesce("d.decision", "preset.decision", F.lit("UNDECIDED")).alias("decision"), F.when(F.col("d.decision").isNotNull(), F.col("d.primary_reason")).otherwise(F.col("preset.primary_reason")).alias("primary_reason"),
        F.when(F.col("d.decision").isNotNull(), "reader").when(F.col("preset.decision").isNotNull(), "preset").otherwise("none").alias("source"),
    )


def fulltext_problems(corpus: DataFrame, decisions: DataFrame) -> DataFrame:
    """(problem, corpus_id): unknown id, wrong owner, several decisions, exclusion without a reason. ``corpus`` has
    corpus_id and assigned_to, ``decisions`` corpus_id, screener, decision, primary_reason."""
    d = decisions.join(corpus.select("corpus_id", "assigned_to"), "corpus_id", "left")
    unknown = decisions.join(corpus, "corpus_id", "left_anti").select(F.lit("unknown id").alias("problem"), "corpus_id")
    owner = d.where("assigned_to <> screener").select(F.lit("wrong owner"), "corpus_id")
    several = decisions.groupBy("corpus_id").agg(F.countDistinct("decision").alias("n")).where("n > 1").select(F.lit("conflict"), "corpus_id")
    bare = decisions.where("decision = 'exclude' AND coalesce(primary_reason, '') = ''").select(F.lit("exclude without reason"), "corpus_id")
    return unknown.union(owner).union(several).union(bare).distinct()


def flow(full: DataFrame) -> DataFrame:
    """One row of counts: sought, not_retrieved, assessed, included, excluded, undecided."""
    is_ = lambda x: F.count_if(F.col("decision") == x)
    return full.agg(F.count("*").alias("sought"), is_("not_retrieved").alias("not_retrieved"), is_("include").alias("included"), is_("exclude").alias("excluded"), is_("UNDECIDED").alias("undecided")).withColumn("assessed", F.col("included") + F.col("excluded"))


def flow_source(fulltext_: Column, retrieval: Column, complete: Column) -> Column:
    """Which figure of the flow holds: full text once it is complete, else retrieval, else none yet."""
    return F.coalesce(F.when(complete, fulltext_), retrieval)


def verdict(criteria: Column, order: tuple[str, ...] = ("C1", "C2", "C3", "C4", "C5", "C6")) -> Column:
    """struct<decision, exclusion_criterion> of a map criterion -> status: EXCLUDE if any isn't met, by the first one."""
    failed = F.filter(F.array(*map(F.lit, order)), lambda c: criteria[c] == "not_met")
    return F.struct(F.when(F.size(failed) > 0, "EXCLUDE").otherwise("INCLUDE").alias("decision"), F.get(failed, F.lit(0)).alias("exclusion_criterion"))


def skim(steps: list[str], passed: Column) -> Column:
    """The first step of an ordered check that failed in a map step -> passed; NULL if none did."""
    return F.get(F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.coalesce(passed[s], F.lit(True))), F.lit(0))


def year_in_range(year: Column, lo: int = 2018, hi: int = 2026) -> Column:
    return X.year_of(year).try_cast("int").between(lo, hi)


def resume(assigned: DataFrame, decisions: DataFrame) -> DataFrame:
    """(reviewer, corpus_id): where each reviewer goes on, the first assigned record without a decision."""
    return assigned.join(decisions.select("corpus_id", "reviewer"), ["corpus_id", "reviewer"], "left_anti").groupBy("reviewer").agg(F.min_by("corpus_id", "position").alias("corpus_id"))
