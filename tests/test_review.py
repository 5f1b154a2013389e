import math

import pytest
from pyspark.sql import functions as F

from litweave.operators import agreement, checks, counts, reconcile, sampling


def pairs(spark, cells):
    rows = [(f"{a}{b}{i}", a, b) for (a, b), n in cells.items() for i in range(n)]
    return spark.createDataFrame(rows, "unit string, l1 string, l2 string")


def test_kappa(spark):
    k = agreement.cohen(pairs(spark, {("i", "i"): 21, ("i", "e"): 4, ("e", "i"): 9, ("e", "e"): 16})).first()
    assert k["po"] == pytest.approx(0.74) and k["pe"] == pytest.approx(0.5) and k["kappa"] == pytest.approx(0.48) and k["band"] == "weak"
    same = agreement.cohen(pairs(spark, {("i", "i"): 5})).first()
    assert math.isnan(same["kappa"]) and same["band"] == "worse than chance"
    assert agreement.cohen(pairs(spark, {})).count() == 0


def ratings(spark, rows):
    return spark.createDataFrame(rows, "unit string, rater string, label string")


def test_alpha_with_three_raters(spark):
    r = ratings(spark, [("1", "a", "x"), ("1", "b", "x"), ("1", "c", "x"), ("2", "a", "x"), ("2", "b", "y"), ("3", "a", "y"), ("3", "b", "y"), ("4", "a", "x")])
    a = agreement.krippendorff(r).first()
    do, de = 2 / 7, (49 - 16 - 9) / (7 * 6)
    assert a["total"] == 7 and a["observed"] == pytest.approx(do) and a["alpha"] == pytest.approx(1 - do / de)
    assert agreement.krippendorff(ratings(spark, [("1", "a", "x"), ("1", "b", "x")])).first()["alpha"] is None


def test_reconcile_and_matrix(spark):
    r = ratings(spark, [("1", "a", "include"), ("1", "b", "include"), ("2", "a", "include"), ("2", "b", "exclude"), ("3", "a", "maybe"), ("3", "b", "maybe")])
    assert {x["unit"] for x in agreement.to_reconcile(r).collect()} == {"2", "3"}
    m = {x["l1"]: (x["include"], x["exclude"], x["maybe"], x["total"]) for x in agreement.confusion(agreement.paired(r, "a", "b"), ("include", "exclude", "maybe")).collect()}
    assert m == {"include": (1, 1, 0, 2), "exclude": (0, 0, 0, 0), "maybe": (0, 0, 1, 1), "total": (1, 1, 1, 3)}
    assert checks.overlap(r).count() == 0 and checks.overlap(r.where("rater = 'a'")).count() == 1


def test_allocation_matches_the_plain_one(spark):
    sizes = [("2018", 24), ("2019", 36), ("2020", 35), ("2021", 5), ("2022", 1)]
    rows = [(s, i + 100 * k) for k, (s, n) in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "year string, id bigint")
    got = {r["stratum"]: r["quota"] for r in sampling.allocation(df, "year", "id").collect()}
    assert got == sampling.allocate(sizes) and sum(got.values()) == 10
    assert sampling.allocate([("a", 5), ("b", 20)]) == {"a": 0, "b": 2}  # 2.5 goes to the even number


def test_splits(spark):
    strata = {"a": list("12345"), "b": list("678")}
    reset = sampling.seeded_split(strata, ["x", "y"], 1)
    assert len(reset["x"]) == 5 and len(sampling.seeded_split(strata, ["x", "y"], 1, True)["x"]) == 4
    df = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "id bigint, s string")
    n = {r["part"]: r["count"] for r in sampling.hash_split(df, "id", "s", 2, 1).groupBy("part").count().collect()}
    assert n == {0: 5, 1: 3}
    run = sampling.hash_split(df, "id", "s", 2, 1, run_on=True)
    assert {r["count"] for r in run.groupBy("part").count().collect()} == {4}
    assert checks.partition_of(run, df, "id").count() == 0
    picked, _ = sampling.seeded_sample(strata, {"a": 2, "b": 1}, 5)
    assert len(picked) == 3 and picked == sampling.seeded_sample(strata, {"a": 2, "b": 1}, 5)[0]


def test_merge_precedence(spark):
    d = spark.createDataFrame(
        [("C1", "include", "a", ["I1"], None, False, 1), ("C1", "exclude", "z", ["E1"], None, True, 2), ("C2", "include", "a", [], None, False, 3), ("C2", "exclude", "b", [], None, False, 4), ("C3", "include", "a", [], None, False, 5), ("C3", "include", "b", ["I2"], None, False, 6)],
        "corpus_id string, decision string, reviewer string, codes array<string>, reason string, authoritative boolean, seq bigint",
    )
    got = {r["corpus_id"]: (r["decision"], r["reviewer"], r["conflict"]) for r in reconcile.merge(d).collect()}
    assert got == {"C1": ("exclude", "z", False), "C2": ("include", "a", True), "C3": ("include", "b", False)}
    corpus = spark.createDataFrame([("C1",), ("C2",), ("C4",)], "corpus_id string")
    assert {tuple(r) for r in reconcile.blockers(reconcile.merge(d), d, corpus).collect()} == {("conflict", "C2"), ("unknown", "C3"), ("missing", "C4")}
    assert reconcile.merge(d.limit(0)).count() == 0


def test_verdict_and_skim(spark):
    df = spark.sql("SELECT map('C1', 'met', 'C4', 'not_met', 'C2', 'not_met') AS m, map('s1', true, 's2', false) AS p")
    r = df.select(reconcile.verdict(F.col("m")).alias("v"), reconcile.skim(["s1", "s2", "s3"], F.col("p")).alias("s")).first()
    assert (r["v"]["decision"], r["v"]["exclusion_criterion"], r["s"]) == ("EXCLUDE", "C2", "s2")


def test_counts(spark):
    df = spark.createDataFrame([("a", ["E1", "E1", "I2"], "exclude"), ("b", None, "exclude"), ("a", ["E1"], "include")], "reviewer string, codes array<string>, decision string")
    assert [tuple(r) for r in counts.code_counts(df, "E", decision="exclude").collect()] == [("E1", 1, 50.0)]
    assert counts.uncoded(df, "E").first()[0] == 1
    assert {(r["reviewer"], r["screened"], r["rate"]) for r in counts.reviewer_rates(df).collect()} == {("a", 2, 50.0), ("b", 1, 0.0), ("Total", 3, 33.3)}
    cov = {r["field"]: r["missing"] for r in counts.coverage(df, "codes", "reviewer").collect()}
    assert cov == {"codes": 1, "reviewer": 0}
