from pyspark.sql import functions as F

from litweave.operators import linkage


def test_similar_titles_of_frequent_words_are_found(spark):
    words = "virtual reality training surgery immersive learning display haptic".split()
    titles = [" ".join(words), " ".join([*words, "study"])] + [f"{w} {x}{i} {y}{i}" for i, w in enumerate(words) for x, y in (("alpha", "beta"), ("gamma", "delta"), ("kappa", "omega"))]
    rows = [(i, t, ["Doe, J."], "2020", "") for i, t in enumerate(titles)]
    df = linkage.derive(spark.createDataFrame(rows, "idx bigint, title string, authors array<string>, year string, doi string"))
    at = lambda **kw: {(r["a"], r["b"]) for r in linkage.fuzzy_pairs(df, **kw).collect()}
    assert at(most=3) == at(most=400, whole=False) == {(0, 1)}
    assert at(most=3, whole=False) == set()


def test_whole_mode_equals_the_rule_without_a_limit(spark):
    import random

    rng = random.Random(3)
    words = [f"word{i}" for i in range(14)]
    titles = [" ".join(rng.sample(words, rng.randrange(1, 8))) for _ in range(150)]
    rows = [(i, t, ["Doe, J."], "2020", "") for i, t in enumerate(titles + titles[:20])]
    df = linkage.derive(spark.createDataFrame(rows, "idx bigint, title string, authors array<string>, year string, doi string")).select("*", F.lit(1).alias("one"))
    at = lambda **kw: sorted(map(tuple, linkage.fuzzy_pairs(df, **kw).collect()))
    assert at(most=0) == at(most=10_000, whole=False) != []
