import json

from litweave.sinks import report, ris, tables
from litweave.sources import ris as source


def test_ris_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "CONF", ["A, B.", None, ""], "T\nx", "2020", "10.1234/x", None)], "id bigint, type string, authors array<string>, title string, year string, doi string, venue string")
    ris.write_ris(df, str(tmp_path / "o"))
    r = source.project(source.read_ris(spark, str(tmp_path / "o" / "*.txt"))).first()
    assert (r["type"], r["authors"], r["title"], r["year"], r["doi"]) == ("CONF", ["A, B."], "T x", "2020", "10.1234/x")


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"", ["x", "y"]), (None, None)], "t string, k array<string>")
    tables.write_csv(df, str(tmp_path / "c"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()} == {('a,"b"', "x; y"), (None, None)}
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    p = str(tmp_path / "stats.json")
    tables.upsert_stats(p, "a", {"n": 1})
    tables.upsert_stats(p, "b", {"n": 2})
    assert json.load(open(p)) == {"a": {"n": 1}, "b": {"n": 2}}


def test_reports():
    t = report.markdown_table([["a", 1200], ["bb", 3]], ["k", "n"])
    assert t.split("\n")[2] == "| a  | 1,200 |"
    flow = [("identified\nn = 3", "removed: 1"), ("screened", None)]
    assert "---> removed: 1" in report.text_flow(flow) and report.svg_flow(flow).startswith("<svg")
