import random
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from litweave.operators import linkage
from litweave.plans import queries

DESC = "idx bigint, title string, authors array<string>, year string, doi string"


def similar(rows, most, whole):
    """All pairs of records against the rule, without any bound."""
    df = Counter(w for _, _, k in rows for w in k)
    out = set()
    for a, x, k in rows:
        rare = {w for w in k if df[w] <= most}
        for b, y, m in rows:
            if a < b and len(x) >= 15:
                both = len(set(k) & set(m))
                enough = len(rare) >= 2 and len(rare & set(m)) >= max(2, int(0.55 * len(rare))) or whole and len(k) >= 2 and both >= max(2, int(0.55 * len(k)))
                if enough and ((r := SequenceMatcher(None, x, y).ratio()) >= 0.9 or both / (len(k) + len(m) - both) >= 0.85):
                    out.add((a, b, both / (len(k) + len(m) - both), r))
    return out


def test_bounds_lose_no_similar_pair(spark):
    rng = random.Random(11)
    words = [w + x for w in ("virtual", "haptic", "zebra", "quiz", "jazzy", "gaze", "eee", "kickflip", "12345") for x in ("", "s", "er", "ab 77")]
    titles = []
    for _ in range(70):
        t = " ".join(rng.sample(words, rng.randrange(1, 9)))
        titles.append(t)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            titles.append(rng.choice([t[:at] + rng.choice("aeqz ") + t[at + 1 :], t[:at] + t[at + 1 :], " ".join(sorted(t.split())), t, t + " " + rng.choice(words)]))
    df = linkage.derive(spark.createDataFrame([(i, t, ["Doe, J."], "2020", "") for i, t in enumerate(titles)], DESC))
    rows = [(r["idx"], r["ntitle"], r["tokens"]) for r in df.collect()]
    for most, whole in ((400, True), (40, True), (40, False), (0, True)):
        found = {(r["a"], r["b"], r["jac"], r["ratio"]) for r in linkage.fuzzy_pairs(df, most, whole).collect()}
        assert found == similar(rows, most, whole) and len(found) > 30


def test_no_candidates_and_no_unused_columns_go_to_disk(spark, monkeypatch):
    """Of titles of one pattern nearly all pairs are candidates; what is stored or shuffled has a row per token at most, and no texts."""
    rng = random.Random(5)
    kinds = [[f"{c}{rng.choice('bdfgklmnpr')}{v}{c}{i}" for i in range(12)] for c, v in zip("stvwxz", "aeioua")]
    titles = [" ".join(["immersive training of skills with feedback", *(rng.choice(k) for k in kinds)]) for _ in range(300)]
    records = spark.createDataFrame([(i, t, ["Doe, J."], "2020", "", "abstract") for i, t in enumerate(titles)], DESC + ", abstract string")
    cut, stored = linkage.cut, []

    def kept(df):
        out = cut(df)
        stored.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(linkage, "cut", kept)
    linkage.link(records)
    assert not any("abstract" in c for c, _ in stored)
    titles = linkage.derive(records).groupBy("ntitle").agg(F.min("idx").alias("t"), F.max("idx").alias("last"), F.count("*").alias("rows")).withColumn("tokens", linkage._tokens(F.col("ntitle")))
    plan = linkage.similar_titles(titles)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "MapInPandas" in above and "Exchange" not in above and max(n for _, n in stored) <= 12 * 300


def read_by(monkeypatch, spark, query):
    """The columns that a query hands to linking."""
    seen = []
    link = linkage.link
    monkeypatch.setattr(linkage, "link", lambda records, *a: seen.append(set(records.columns)) or link(records.limit(0), *a))
    queries.QUERIES[query](spark, "/root/testdata/sf0.001")
    return seen


def test_link_counts_reads_what_linking_looks_at(spark, monkeypatch):
    assert read_by(monkeypatch, spark, "link_counts") == [{"idx", "title", "authors", "year", "doi"}]


def test_record_clusters_reads_what_linking_looks_at(spark, monkeypatch):
    assert read_by(monkeypatch, spark, "record_clusters") == [{"idx", "title", "authors", "year", "doi"}]
