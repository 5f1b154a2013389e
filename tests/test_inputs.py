import json

import pytest
from pyspark.sql import functions as F

from litweave.functions import text as X
from litweave.operators import agreement, counts, golden
from litweave.sinks import report, ris as ris_sink, tables
from litweave.sources import bibtex, exports, ris


def test_ris_texts_are_cleaned(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - CONF\nTI  - A &amp; B <i>x</i>  y\nAU  - Garc&iacute;a, <b>J.</b>\nAU  - Roe, K.\nAB  - &lt;p&gt;Text&lt;/p&gt;\nKW  - R&amp;D\nT2  - V &amp; W\nPB  - P&amp;Q\nN1  - <u>n</u>\nER  - \n")
    r = ris.project(ris.read_ris(spark, str(tmp_path / "a.ris"))).first()
    assert (r["title"], r["authors"], r["abstract"], r["keywords"], r["venue"], r["publisher"], r["notes"]) == ("A & B x y", ["García, J.", "Roe, K."], "Text", ["R&D"], "V & W", "P&Q", ["n"])


@pytest.mark.parametrize(
    "body, want",
    [
        ('title = "A" # b, year = 2020', {"title": "A", "year": "2020"}),
        ("x.y = {v}, year = 2020", {"x.y": "v", "year": "2020"}),
        ("title = {A {B, C} = D}, year=2020,", {"title": "A {B, C} = D", "year": "2020"}),
        ('title = {A} # {, B} , note = "x = y, z", year = 1', {"title": "A", "note": "x = y, z", "year": "1"}),
        ("title = , year = 2", {"title": "", "year": "2"}),
        ("title = {open", {"title": "open"}),
        ("no fields", {}),
        ("", {}),
    ],
)
def test_bibtex_fields(body, want):
    assert bibtex.fields(body) == want


def test_bibtex_projection(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@inproceedings{k1, title={{A} \\& B &lt;i&gt;}, author={Garc{\\'i}a, J. and {Roe}, K.}, pages={7}, series={S \\& T}, booktitle={P}}\n@book{k2, pages={1--9}, number={3}}")
    a, b = bibtex.project(bibtex.read_bibtex(spark, str(tmp_path / "a.bib"))).orderBy("rec").collect()
    assert (a["title"], a["authors"], a["start_page"], a["end_page"], a["notes"]) == ("A & B", ["Garcia, J.", "Roe, K."], "7", None, ["BibTeX key: k1", "series: S & T"])
    assert (b["type"], b["start_page"], b["end_page"], b["issue"], b["notes"], b["authors"]) == ("BOOK", "1", "9", "3", ["BibTeX key: k2"], [])


def test_surnames_of_marked_names(spark):
    names = ["Garc&iacute;a, J.", "J. {\\'A}lvarez", "<b>Roe</b>", None, ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "a string").select(X.surname(F.col("a"))).collect()]
    assert got[:3] == ["garcia", "alvarez", "roe"] and not any(got[3:])


def test_rater_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"reviewer_id": "r1", "decisions": [{"corpus_id": "C1", "decision": "inc", "codes": ["i1"], "title": "T"}, {"corpus_id": "C1", "decision": "no", "codes": ["e2"], "title": "U"}, {"corpus_id": "", "decision": "yes"}, {"corpus_id": "C2", "decision": "what"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"reviewer_id": "r1", "decisions": [{"corpus_id": "C1", "decision": "y"}]}))
    (tmp_path / "c.json").write_text(json.dumps({"decisions": [{"corpus_id": "C3", "decision": "?"}]}))
    got = {(r["rater"], r["corpus_id"], r["label"], tuple(r["codes"]), r["title"]) for r in exports.read_rater_json(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("r1", "C1", "exclude", ("E2",), "T"), ("r1 (b.json)", "C1", "include", (), "T"), ("c.json", "C3", "maybe", (), None)}
    (tmp_path / "s.csv").write_text("item,corpus_id,reviewer_1,reviewer_2\n7,,yes,no\n8,C8,no,no\n")
    assert {r["corpus_id"] for r in exports.read_rater_csv(spark, str(tmp_path / "s.csv")).collect()} == {"7", "C8"}
    (tmp_path / "one.csv").write_text("item,reviewer_1\n7,yes\n")
    with pytest.raises(ValueError, match="two"):
        exports.read_rater_csv(spark, str(tmp_path / "one.csv"))


def test_gate_of_three_raters_is_alpha(spark):
    rows = [(str(u), r, v) for u, vs in enumerate(("iii", "eee", "iie", "eee", "iii")) for r, v in zip("abc", vs)] + [("9", "a", "i")]
    df = spark.createDataFrame(rows, "unit string, rater string, label string").replace({"i": "include", "e": "exclude"}, subset=["label"])
    g = agreement.gate_of(df).first()
    want = agreement.krippendorff(df.where("unit <> '9'")).first()["alpha"]
    assert (g["measure"], g["verdict"]) == ("alpha", "REDO") and g["value"] == pytest.approx(want)
    assert agreement.gate_of(df.where("rater <> 'c'")).first()["measure"] == "kappa"
    with pytest.raises(ValueError):
        agreement.gate_of(df.where("rater = 'a'"))


def test_chains_of_merges_go_to_the_last_survivor(spark):
    rows = [(1, "A", None, None, [10], 1), (2, "B", "2020", None, [20, 21], 2), (3, "C", "2021", "text", [30], 1), (4, "D", "2022", None, [40], 1)]
    c = spark.createDataFrame([(i, t, y, a, ids, n, [f"db{i}"], ["k"] * i) for i, t, y, a, ids, n in rows], "cid bigint, title string, year string, abstract string, merged_idxs array<bigint>, n_in_cluster bigint, found_in array<string>, keywords array<string>")
    m = spark.createDataFrame([(1, 2, "x"), (2, 3, "y"), (1, 77, "gone")], "survivor bigint, absorbed bigint, why string")
    got = {r["cid"]: r for r in golden.overlay(c, m).collect()}
    assert sorted(got) == [1, 4]
    r = got[1]
    assert (r["title"], r["year"], r["abstract"], r["merged_idxs"], r["n_in_cluster"], r["found_in"], r["absorbed_cids"], len(r["keywords"])) == ("A", "2020", "text", [10, 20, 21, 30], 4, ["db1", "db2", "db3"], [2, 3], 3)
    assert (got[4]["n_in_cluster"], got[4]["absorbed_cids"]) == (1, None)
    with pytest.raises(ValueError, match="circle"):
        golden.overlay(c, spark.createDataFrame([(1, 2, "x"), (2, 1, "y")], "survivor bigint, absorbed bigint, why string"))
    with pytest.raises(ValueError, match="survivor"):
        golden.overlay(c, spark.createDataFrame([(99, 2, "x")], "survivor bigint, absorbed bigint, why string"))


def test_sinks_overwrite_only_if_told(spark, tmp_path):
    df = spark.createDataFrame([("a", "T")], "id string, title string")
    for write in (tables.write_csv, tables.write_json, ris_sink.write_ris):
        p = str(tmp_path / write.__name__)
        write(df, p)
        with pytest.raises(FileExistsError):
            write(df, p)
        write(df, p, force=True)


def test_labels_counts_and_reports(spark, tmp_path):
    n = spark.createDataFrame([("E1", 3), ("E9", 1)], "code string, n bigint")
    labels = spark.createDataFrame([("E1", "too short"), ("E2", "other")], "code string, label string")
    named = counts.labelled(n, labels)
    assert {(r["code"], r["label"]) for r in named.collect()} == {("E1", "too short"), ("E9", "")}
    kinds = spark.createDataFrame([("acquired", None, None), ("format", "exclude", True), ("acquired", "exclude", False), ("no_access", "not_retrieved", True)], "kind string, decision string, hidden boolean")
    assert counts.retrieval(kinds).first().asDict() == {"sought": 4, "not_retrieved": 1, "preset_by_note": 1, "preset_by_pages": 1, "acquired": 2, "marked_not_retrievable": 2, "not_full_paper": 1, "no_access": 1, "unexplained": 0}
    text = report.screening_report("1 May 2026", 10, 4, n, named)
    assert "**6**" in text and "| E1" in text and "## Reasons" in text and "By year" not in text
    assert "interim, 2 undecided" in report.fulltext_report("1 May", {"sought": 9, "not_retrieved": 1, "assessed": 6, "excluded": 4, "included": 2, "undecided": 2}, named)
    assert "`C0007`" in report.merge_report("1 May", 3, spark.createDataFrame([(1, 7, "same")], "survivor bigint, absorbed bigint, why string"))
    assert "Duplicates removed: **1,006**" in report.corpus_report("1 May", 3269, 2263, by_code=n)
    tee = report.Tee(str(tmp_path / "r_{at}.txt"), most=1)
    tee.write(["a", "b"])
    tee.close()
    assert open(tee.path).read() == "a\nb\n" and "{at}" not in tee.path
