from litweave.sources import bibtex, exports, ris

RIS = "\ufeffTY  - CONF\r\nAU  - Ada, B.\r\nA1  - Late, C.\r\nAU  - Bee, D.\r\nTI  - First\r\n a continuation\r\nDO  - https://doi.org/10.1234/ABC.1.\r\nPY  - 2024/05\r\nKW  - \r\nKW  - one\r\nER  - \n\rTY  - book\nTI  - Second\nSN  - 99\nER  - \nTY  - JOUR\nT1  - Third without end\nDB  - Scopus"
BIB = "@comment{x}\n@string{a = {b}}\n@article{k1, title={A {Nested} Title}, author={Doe, J. and Roe, K.}, pages={1--9}, year=2023, keywords=\"a; b, c\", title={Last Title}}\n@misc{k2,\n note={{deep {er}}}, url={https://doi.org/10.5555/x}}\n@inproceedings{k3, booktitle={P"


def test_ris_mixed_line_ends(spark, tmp_path):
    (tmp_path / "ieee_1.ris").write_bytes(RIS.encode())
    rows = ris.project(ris.read_ris(spark, str(tmp_path / "ieee_1.ris"))).orderBy("rec").collect()
    assert [r["title"] for r in rows] == ["First", "Second", "Third without end"]
    assert rows[0]["authors"] == ["Ada, B.", "Bee, D.", "Late, C."]
    assert (rows[0]["doi"], rows[0]["doi_raw"], rows[0]["year"], rows[0]["keywords"]) == ("10.1234/abc.1", "10.1234/ABC.1", "2024", ["one"])
    assert rows[1]["type"] == "BOOK" and rows[1]["issn"] == "99" and rows[2]["isbn"] is None


def test_ris_missing_end_fuses(spark, tmp_path):
    (tmp_path / "x.ris").write_text("TY  - CONF\nTI  - A\nTY  - JOUR\nTI  - B\nER  - \n")
    rows = ris.project(ris.read_ris(spark, str(tmp_path / "x.ris"))).collect()
    assert len(rows) == 1 and rows[0]["title"] == "A"


def test_bibtex(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    rows = bibtex.project(bibtex.read_bibtex(spark, str(tmp_path / "a.bib"))).orderBy("rec").collect()
    assert [r["title"] for r in rows] == ["Last Title", None, None]
    assert rows[0]["authors"] == ["Doe, J.", "Roe, K."] and (rows[0]["start_page"], rows[0]["end_page"]) == ("1", "9")
    assert rows[0]["keywords"] == ["a", "b", "c"] and rows[1]["doi"] == "10.5555/x" and rows[2]["venue"] == "P"


def test_union_numbers_and_attributes(spark, tmp_path):
    (tmp_path / "ieee_1.ris").write_text("TY  - CONF\nTI  - A\nER  - \n")
    (tmp_path / "scopus.ris").write_text("TY  - CONF\nTI  - B\nDB  - Scopus\nER  - \nTY  - CONF\nTI  - C\nER  - \n")
    (tmp_path / "acm.bib").write_text("@article{k, title={D}}")
    t = str(tmp_path)
    rows = exports.read_exports(spark, [f"{t}/*.ris"], [f"{t}/*.bib"]).orderBy("idx").collect()
    assert [(r["idx"], r["title"], r["source_db"]) for r in rows] == [(1, "A", "IEEE Xplore"), (2, "B", "Scopus"), (3, "C", "Scopus"), (4, "D", "ACM Digital Library")]


def test_decision_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kind":"decisions","reviewer_id":"r1","decisions":[{"corpus_id":"C1","decision":"include","codes":["I1"]}]}')
    (tmp_path / "b.json").write_text('{"reviewers":["r1","r2"],"records":[{"corpus_id":"C2","final":"exclude","reason":"x"}],"agreed":[{"corpus_id":"C3","final":"include"}]}')
    got = {(r["corpus_id"], r["decision"], r["reviewer"], r["authoritative"]) for r in exports.read_decisions(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("C1", "include", "r1", False), ("C2", "exclude", "r1+r2", True), ("C3", "include", "r1+r2", True)}


def test_rater_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('item,corpus_id,reviewer_1,reviewer_2,reviewer_1_reason\n1,C1,yes,"no",x\n')
    got = {tuple(r) for r in exports.read_rater_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {("C1", "reviewer_1", "yes"), ("C1", "reviewer_2", "no")}
    assert exports.discover(spark, str(tmp_path), "*.csv").count() == 1
