import pytest
from pyspark.sql import functions as F

from litweave.functions import text as X
from litweave.functions.udfs import seq_ratio


def run(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_titles(spark):
    got = run(spark, X.norm_title, "Caf\\'{e} {N}aïve $x^2$ &lt;b&gt;Bold&lt;/b&gt;", "Straße & Ørsted", "", None, "\\cite{a} X")
    assert got == ["cafe naive bold", "stra e rsted", "", None, "itea x"]
    assert run(spark, lambda c: X.title_tokens(c), "the virtual virtual of ab reality") == [["virtual", "reality"]]


def test_doi(spark):
    assert run(spark, X.norm_doi, "https://doi.org/10.1145/ABC.9).", "\\url{10.12345/x}", "none", None, "10.12/x") == ["10.1145/abc.9", "10.12345/x", None, None, None]


def test_small_ones(spark):
    assert run(spark, X.surname, "O'Neil, Ann", "Ann  Müller", "Ø") == ["oneil", "muller", ""]
    assert run(spark, X.year_of, "in 2021-22", "1899", None) == ["2021", None, None]
    assert run(spark, X.fix_type, "label.ris.referencetype.article", "conf", "", None) == ["JOUR", "CONF", "GEN", "GEN"]
    assert run(spark, X.precolon, "Sys: a title", "A long one: x", "no colon") == ["Sys", None, None]
    assert run(spark, X.label, " YES ", "0", "?", "other", None) == ["include", "exclude", "maybe", None, None]
    assert run(spark, X.keywords, "['a b', 'c']") == [["a b", "c"]]
    assert run(spark, X.retraction, "retraction notice to x", "x") == ["retraction notice", ""]


def test_pages_and_presets(spark):
    df = spark.createDataFrame([("1", "4", "Acquired", None), ("9", "3", "Not acquired", "short paper"), ("a", "b", "Not acquired", "paywall"), ("1", "9", "Acquired", ""), ("1", "9", None, None)], "s string, e string, st string, n string")
    k = df.select(X.n_pages(F.col("s"), F.col("e")).alias("p"), X.retrieval_kind(F.col("st"), F.col("n")).alias("k"))
    got = k.select("p", "k", X.preset(F.col("k"), F.col("p")).alias("x")).collect()
    assert [(r["p"], r["k"], r["x"] and r["x"]["decision"]) for r in got] == [(4, "acquired", "exclude"), (None, "format", "exclude"), (None, "no_access", "not_retrieved"), (9, "acquired", None), (9, "unexplained", "not_retrieved")]


def test_bands(spark):
    df = spark.createDataFrame([(float("nan"),), (0.95,), (0.8,), (0.3,), (-0.1,), (None,)], "k double")
    assert [r[0] for r in df.select(X.kappa_band(F.col("k"))).collect()] == ["worse than chance", "almost perfect", "strong", "minimal", "worse than chance", "worse than chance"]
    p = spark.createDataFrame([(None, 0.9, False), (0.95, 0.1, False), (0.2, 0.5, True), (0.2, 0.5, False), (0.5, 0.5, False)], "a double, r double, s boolean")
    assert [r[0] for r in p.select(X.pair_band(F.col("a"), F.col("r"), F.col("s"))).collect()] == ["LIKELY", "ALMOST CERTAIN", "LIKELY", "DISTINCT", "UNCLEAR"]


def test_ratio_is_directed(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(seq_ratio("a", "b")).collect()]
    assert got[0] == pytest.approx(0.75) and got[1] is None and got[2] == 1.0
