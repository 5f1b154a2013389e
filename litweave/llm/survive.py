"""Problem 6: the best value of every field of each duplicate group.

One aggregation over the groups takes, for each field, the maximum of a struct (genuine, fullness, exported_at,
source rank, idx): all it shuffles are a few numbers of each record. The values are fetched for the survivors only.

What stands in for a missing value is told by what it says, not looked up: it has no letters; or all its words say that
something is missing, or name the field; or its first sentence says of a field or record that it isn't there. Besides,
an abstract that many unrelated groups hold is none of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litweave.session import cut

FIELDS = ("doi", "abstract", "keywords", "venue")
#: Fields in which one value can't be genuine in many unrelated groups; a venue can be, and so can a keyword.
UNIQUE = ("abstract",)
#: Words for what is missing, what a record consists of, and what joins the two.
ABSENT = "no not none non nil null nan na unknown unspecified undefined unavailable missing absent empty blank pending tba tbd tbc announced appear forthcoming untitled"
NOUN = "abstract abstracts summary description venue journal title doi identifier keyword keywords information metadata details text record entry item field value data database source"
JOIN = "a an the this that is was are were has have had be been to yet for in of available applicable given specified provided assigned found supplied recorded listed entered known here"
#: What a sentence says of a value that isn't there.
SAYS = (
    r"\b(?:(?:not|never|no longer|cannot|could ?n[o']t|can ?not) (?:be |been |yet |currently |publicly )*(?:available|loaded|found|retrieved|displayed|shown|provided|given|supplied|accessible|accessed|recorded|included|present|known|specified)"
    rf"|(?:is|are|was|were) (?:currently )?(?:unavailable|missing|absent)|(?:has|have|had|comes|come|without) (?:no |an? |any )+(?:{'|'.join(NOUN.split())})|no \w+ (?:is |was |could be )?(?:available|found|provided|given|supplied))\b"
)
SOURCE_RANK = {"ACM Digital Library": 3, "IEEE Xplore": 2, "Scopus": 1}


def _stand_in() -> str:
    one = lambda *words: rf"\b(?:{'|'.join(' '.join(words).split())})\b"
    run = lambda word: rf"{word}(?:[^\p{{L}}\p{{N}}]+{word})*"
    said = [r"0+|x+|n[./ ]?a", run(one(NOUN)), rf"(?=.*{one(ABSENT)}){run(one(ABSENT, NOUN, JOIN))}"]
    told = rf"(?=[^.!?;]*{one(NOUN)})[^.!?;]*{SAYS}.*"
    return rf"(?isU)^[^\p{{L}}\p{{N}}]*(?:(?:{'|'.join(said)})?[^\p{{L}}\p{{N}}]*|{told})$"


STAND_IN = _stand_in()


def genuine(c: Column) -> Column:
    """Neither NULL nor blank nor a stand-in. Never NULL.

    Stand-ins: no letter or digit; zeros; repeated x; ``n/a`` with stops or a slash between; nothing but words of absence
    and joining words or names of fields (and at least one of the former, or names of fields alone); a first sentence that
    says of a field or record that it isn't there. None has more than 300 characters.
    """
    return F.coalesce(F.when(F.length(F.trim(c)) > 300, c.rlike(r"[\p{L}\p{N}]")).otherwise(~c.rlike(STAND_IN)), F.lit(False))


def genuine_doi(c: Column) -> Column:
    """Has prefix, slash and suffix, whatever stands around them; a percent-encoded slash is one."""
    return F.coalesce(c.rlike(r"(?iU)10\.\d{4,9}(?:\.\d+)*(?:/|%2F)[^\s/{}<>]*\w"), F.lit(False))


def fullness(field: str) -> Column:
    """How full a genuine value is; NULL if it isn't genuine."""
    c = F.col(field)
    if field == "doi":
        return F.when(genuine_doi(c), F.lit(1))
    if field == "keywords":
        n = F.size(F.array_distinct(F.transform(F.filter(c, genuine), lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))))
        return F.when(n > 0, n)
    return F.when(genuine(c), F.char_length(c))


def survivors(records: DataFrame, membership: DataFrame, fields: tuple[str, ...] = FIELDS, many: int = 20, share: float = 0.005) -> DataFrame:
    """(corpus_id, field, idx): the record each field of each group comes from.

    ``records`` has idx, source_db, exported_at and the fields; ``membership`` (corpus_id, idx). Only groups of at least
    two different records give rows, and only fields in which some record has a genuine value. Repeated rows of either
    table don't matter; rows with a NULL key are no members. Ties in fullness go to the latest ``exported_at`` (NULL is
    the earliest), then to the better source, then to the lowest idx.

    A value of a field of ``UNIQUE`` that at least ``many`` groups hold, and a ``share`` of all pairs of a group and one
    of its values, stands in for a missing one; there can't be more than 1 / ``share`` of them.
    """
    rank = F.coalesce(F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv))[F.col("source_db")], F.lit(0))
    unique = [f for f in UNIQUE if f in fields]
    full = records.where("idx IS NOT NULL").select("idx", F.col("exported_at").alias("at"), rank.alias("rank"), *(fullness(f).alias(f) for f in fields), *(F.xxhash64(F.lower(F.trim(F.col(f)))).alias(f"{f}_said") for f in unique))
    measured = full.select(
        "idx", *(F.struct(F.col(f).isNotNull().alias("ok"), F.col(f).alias("full"), "at", "rank", (-F.col("idx")).alias("neg")).alias(f) for f in fields), *(F.when(F.col(f).isNotNull(), F.col(f"{f}_said")).alias(f"{f}_said") for f in unique)
    )
    members = membership.select("corpus_id", F.col("idx").cast("long").alias("idx")).where("corpus_id IS NOT NULL AND idx IS NOT NULL").distinct()
    held = cut(members.join(measured, "idx"))
    for f in unique:
        each = held.select(F.col(f"{f}_said").alias("said"), "corpus_id").where("said IS NOT NULL").distinct()
        n = each.groupBy("said").agg(F.count("*").alias("n")).where(F.col("n") >= many)
        common = [r["said"] for r in n.where(F.col("n") >= share * each.count()).collect()]  # at most 1 / share
        if common:
            ok = F.col(f)["ok"] & ~F.col(f"{f}_said").isin(common)
            held = held.withColumn(f, F.col(f).withField("ok", F.coalesce(ok, F.lit(False))))
    best = held.groupBy("corpus_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), *(F.max(f).alias(f) for f in fields)).where("lo < hi")
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f)["ok"].alias("ok"), (-F.col(f)["neg"]).alias("idx")) for f in fields)))
    return best.select("corpus_id", each.alias("s")).where("s.ok").select("corpus_id", "s.field", "s.idx")


def surviving_records(records: DataFrame, membership: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row per group: corpus_id, and for each field its surviving value and ``<field>_idx``, the record it is from.

    A field without a genuine value is NULL in both. Groups as in ``survivors``. Of a record that arrived more than once
    (and differs), the values of the arrival with the latest ``ingested_at`` are given, where there is such a column.
    """
    chosen = survivors(records, membership, fields)
    late = F.struct(*(F.col(c) for c in ("ingested_at",) if c in records.columns), F.xxhash64(*fields))
    values = records.where("idx IS NOT NULL").join(chosen.select("idx").distinct(), "idx", "left_semi").groupBy("idx").agg(F.max_by(F.struct(*fields), late).alias("v")).select("idx", "v.*")
    got = chosen.join(values, "idx")
    return got.groupBy("corpus_id").agg(
        *(F.max(F.when(F.col("field") == f, F.struct("idx", f)))[f].alias(f) for f in fields), *(F.max(F.when(F.col("field") == f, F.col("idx"))).alias(f"{f}_idx") for f in fields)
    )


def catalogue_membership(catalogue: DataFrame) -> DataFrame:
    """(corpus_id, idx) of the rows of a catalogue whose record ids are S and a number; other ids are no members."""
    return catalogue.select("corpus_id", F.expr("try_cast(regexp_extract(source_record_id, '^S([0-9]+)$', 1) AS bigint)").alias("idx"))
