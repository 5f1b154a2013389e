import datetime as dt

import pytest
from pyspark.sql import functions as F

from litweave.llm import survive

SAID = [
    "Venue information is not available for this record in the source database", "The abstract of this contribution is not available in this database; please see the page of the publisher for the complete text.",
    "An abstract could not be loaded for this record. Please try again later, or contact the help desk of your library if the problem persists.", "This record has no abstract.", "[No abstract available]", "(no title)", "N/A", "n.a.", "none", "-", "…", "000", "XXX",
    "Not specified", "TBA", "to be announced", "Abstract", "Abstract unavailable", "No description was provided for this item", " ", "", "The summary of this entry is missing",
]
GENUINE = [
    "Presents the front matter of the volume.", "Naval Architecture", "Journal of Missing Data Methods", "Unknown Territory", "x-ray imaging", "No Strings Attached", "NA62", "Nature", "0.5 mm layers", "Data in Brief", "None of the Above: Refusals in Surveys", "虚拟现实",
    "Existing systems are not available to novices; we build one.", "This abstract machine has no registers. " + "We prove it complete. " * 20,
]


@pytest.mark.parametrize("values, want", [(SAID, False), (GENUINE, True)])
def test_stand_ins_are_told_by_what_they_say(spark, values, want):
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", survive.genuine(F.col("v")).alias("g")).collect()
    assert [r["v"] for r in got if r["g"] != want] == []


def test_null_is_no_value(spark):
    assert [r[0] for r in spark.createDataFrame([(None,)], "v string").select(survive.genuine(F.col("v"))).collect()] == [False]


def test_an_abstract_of_many_groups_is_none_of_theirs(spark):
    """But one that a huge group repeats is, and so is a venue that all have."""
    at = dt.datetime(2026, 1, 1)
    rows, members = [], []
    for i in range(120):
        rows.append((i, at + dt.timedelta(minutes=i), "Ask your librarian for a summary of the work" if i % 2 else f"Short {i}", "One Venue"))
        members.append((f"C{i // 2}", i))
    for i in range(1000, 1100):
        rows.append((i, at + dt.timedelta(minutes=i), "The abstract of the huge group", "One Venue"))
        members.append(("C9999", i))
    r = spark.createDataFrame(rows, "idx bigint, exported_at timestamp, abstract string, venue string").withColumn("source_db", F.lit(None).cast("string")).withColumn("corpus_id", F.lit("clash"))
    m = spark.createDataFrame(members, "corpus_id string, idx bigint")
    got = {(x["corpus_id"], x["field"]): x["idx"] for x in survive.survivors(r, m, ("abstract", "venue")).collect()}
    assert got == {(f"C{k}", "abstract"): 2 * k for k in range(60)} | {(f"C{k}", "venue"): 2 * k + 1 for k in range(60)} | {("C9999", "abstract"): 1099, ("C9999", "venue"): 1099}


def test_the_latest_arrival_is_given(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, at, at, "V"), (1, at, at + dt.timedelta(days=3), "V of late"), (1, at, None, "V first"), (2, at, at, None)]
    r = spark.createDataFrame(rows, "idx bigint, exported_at timestamp, ingested_at timestamp, venue string").withColumn("source_db", F.lit("Scopus"))
    got = survive.surviving_records(r, spark.createDataFrame([("C1", 1), ("C1", 2)], "corpus_id string, idx bigint"), ("venue",)).collect()
    assert [tuple(x) for x in got] == [("C1", "V of late", 1)]
