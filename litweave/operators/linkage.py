"""Duplicate links between source records: by DOI, by title, by similar titles; and their clusters."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.functions import text as X
from litweave.functions.udfs import seq_ratio
from litweave.operators.graph import components
from litweave.operators.order import ranked
from litweave.session import cut, partitions


def _tokens(norm: Column) -> Column:
    return F.filter(X.title_tokens(norm), lambda w: w != "")


def derive(records: DataFrame) -> DataFrame:
    """Adds ntitle, tokens and surnames."""
    r = records.withColumn("ntitle", X.norm_title(F.coalesce("title", F.lit(""))))
    names = r.select("idx", F.explode("authors").alias("a")).groupBy("idx").agg(F.collect_set(X.surname(F.col("a"))).alias("surnames"))
    return r.withColumn("tokens", _tokens(F.col("ntitle"))).join(names, "idx", "left").withColumn("surnames", F.coalesce(F.filter("surnames", lambda s: s != ""), F.array().cast("array<string>")))


def star_edges(df: DataFrame, key: str, where: Column, method: str) -> DataFrame:
    """(a, b, method, score, note): the least record of each key to each other one. A hot key stays a star: n - 1 rows."""
    rows = df.where(where).select(F.col(key).alias("k"), "idx")
    least = rows.groupBy("k").agg(F.min("idx").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(least, "k").where("idx <> a").select("a", F.col("idx").alias("b"), F.lit(method).alias("method"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("note"))


def doi_edges(df: DataFrame) -> DataFrame:
    return star_edges(df, "doi", F.coalesce(F.col("doi"), F.lit("")) != "", "doi")


def title_edges(df: DataFrame) -> DataFrame:
    return star_edges(df, "ntitle", F.length("ntitle") >= 10, "exact-title")


def rare_tokens(df: DataFrame, most: int = 400) -> DataFrame:
    """(idx, token) of the tokens at most ``most`` records have; a row stands for ``rows`` records where it has that column."""
    each = df.select("idx", F.col("rows") if "rows" in df.columns else F.lit(1).alias("rows"), F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.sum("rows").alias("df")).where(F.col("df") <= most).select("token")
    return each.drop("rows").join(rare, "token")


def token_candidates(df: DataFrame, most: int = 400) -> DataFrame:
    """(a, b, shared, rare): a < b, where b shares enough of a's rare tokens: at least two and 0.55 of them."""
    rare = rare_tokens(df, most)
    n = rare.groupBy("idx").agg(F.count("*").alias("rare")).where("rare >= 2")
    left = rare.join(n, "idx").join(df.where(F.length("ntitle") >= 15).select("idx"), "idx", "left_semi").select("token", F.col("idx").alias("a"), "rare")
    right = rare.select("token", F.col("idx").alias("b"))
    pairs = left.join(right, "token").where("a < b").groupBy("a", "b", "rare").agg(F.count("*").alias("shared"))
    return pairs.where("shared >= greatest(2, cast(floor(0.55D * rare) AS bigint))").select("a", "b", "shared", "rare")


#: How many times each character of a normalised title is counted by itself, in three longs of bits; what is over counts together.
COUNTED = ({"e": 12, "t": 10, "a": 10, "n": 11, "o": 9, "l": 7, "v": 3}, {"i": 11, "r": 9, "s": 9, "c": 6, "d": 6, "m": 5, "g": 5, "p": 5, "h": 5}, {" ": 12, "u": 5, "f": 4, "b": 3, "w": 3, "y": 3, "k": 3, "x": 2, "q": 2, "z": 2, "j": 2})
#: Pairs of one token that a task looks at.
PAIRS = 200_000_000


def _ones(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _counted(norm: Column, most: dict[str, int]) -> Column:
    """A long with as many bits for a character as the title has of it, up to ``most``."""
    bits, at = F.lit(0).cast("long"), 0
    for c, m in most.items():
        n = F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit("")))
        bits, at = bits + (_ones(F.least(n, F.lit(m))) - 1) * F.lit(1 << at).cast("long"), at + m
    return bits


def _longest_common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of the table being the bits of a number."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _compared(most: int, whole: bool):
    """Of pairs at a token of t, those at the first they share that share enough tokens and are similar: (t, u, jac, ratio)."""

    def run(frames):
        for pdf in frames:
            rows, last, words, order = [], None, [], ""
            for t, u, at, rare, n, nu, a, b, places in pdf[["t", "u", "at", "rare", "n", "nu", "ta", "tb", "places"]].itertuples(index=False, name=None):
                if t != last:
                    each, last = a.split(" "), t
                    words = [each[int(i) - 1] for i in places.split(" ")]
                other = set(b.split(" "))
                if not other.isdisjoint(words[:at]):
                    continue
                both = sum(w in other for w in words)
                few = sum(w in other for w in words[:rare])
                if not (whole and n >= 2 and both >= max(2, int(n * 0.55))) and not (rare >= 2 and few >= max(2, int(0.55 * rare))):
                    continue
                jac, size = both / (n + nu - both), len(a) + len(b)
                if jac < 0.85 and (min(len(a), len(b)) * 2 < size * 0.9 or 2.0 * _longest_common(a, b) / size < 0.9):
                    continue
                ratio = SequenceMatcher(None, a, b).ratio()
                if ratio >= 0.9 or jac >= 0.85:
                    rows.append((t, u, jac, ratio))
            yield pd.DataFrame(rows, columns=["t", "u", "jac", "ratio"])

    return run


def similar_titles(titles: DataFrame, most: int = 400, whole: bool = True) -> DataFrame:
    """(t, u, jac, ratio) of distinct titles that share enough tokens and are similar; ``titles`` are (t, last, rows, ntitle, tokens).

    Enough are, of t's tokens that at most ``most`` records have, at least two and 0.55; or, if ``whole``, of all its tokens. One of
    the rarest n - need + 1 is common then: these meet all tokens of u but its most frequent one, as two are common. A pair is kept at its rarest common token only; tokens with
    many pairs are dealt to several tasks. Pairs are compared where they meet, by bounds first, and only similar ones leave the task.
    """
    each = titles.select("t", "rows", F.explode("tokens").alias("token"))
    freq = each.groupBy("token").agg(F.sum("rows").alias("df"))
    sets = each.select("t", "token").join(freq.hint("merge"), "token").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    sets = sets.withColumn("rare", F.size(F.filter("s", lambda x: x["df"] <= most))).withColumn("n", F.size("s"))
    need = lambda n: F.greatest(F.lit(2), F.floor(F.col(n) * F.lit(0.55)).cast("int"))
    first = lambda n: F.when(F.col(n) >= 2, F.col(n) - need(n) + 1).otherwise(0)
    reach = F.when(F.length("ntitle") >= 15, F.greatest(first("rare"), first("n") if whole else F.lit(0))).otherwise(0)
    places = F.array_join(F.transform("s.token", lambda w: F.array_position(F.split("ntitle", " "), w).cast("string")), " ")
    sets = sets.join(titles.select("t", "last", "ntitle").hint("merge"), "t").select("t", "last", "ntitle", "rare", "n", reach.alias("reach"), places.alias("places"), F.transform("s.token", lambda w: F.xxhash64(w)).alias("k"))
    sets = cut(sets.withColumn("some", F.aggregate("k", F.lit(0).cast("long"), lambda s, h: s.bitwiseOR(_ones(F.pmod(h, F.lit(64)))))))
    left = sets.where("reach > 0").select("t", "ntitle", "places", "rare", "n", "some", F.posexplode(F.slice("k", F.lit(1), F.col("reach"))).alias("at", "w"))
    right = sets.select(F.col("t").alias("u"), "last", "ntitle", F.col("n").alias("nu"), F.col("some").alias("some_"), F.explode(F.slice("k", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0)))).alias("w"))
    hot = left.groupBy("w").agg(F.count("*").alias("x")).join(right.groupBy("w").agg(F.count("*").alias("y")).hint("merge"), "w")
    hot = F.broadcast(cut(hot.select("w", F.ceil(F.col("x") * F.col("y") / PAIRS).cast("int").alias("parts")).where("parts > 1")))  # few: each has PAIRS pairs
    parts = F.coalesce("parts", F.lit(1))
    tasks = 2 * partitions(titles.sparkSession)

    def dealt(df, norm, p):
        df = df.withColumnRenamed("ntitle", norm).repartition(tasks, "w", "part").withColumn(f"l{p}", F.length(norm))
        for i, m in enumerate(COUNTED):
            df = df.withColumn(f"c{i}{p}", _counted(F.col(norm), m))
        return df.withColumn(f"over{p}", F.col(f"l{p}") - sum(F.bit_count(f"c{i}{p}") for i in range(len(COUNTED))))

    x = dealt(left.join(hot, "w", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"), "ta", "a")
    y = dealt(right.join(hot, "w", "left").withColumn("part", F.pmod(F.xxhash64("u"), parts).cast("int")).drop("parts"), "tb", "b")
    chars = sum((F.bit_count(F.col(f"c{i}a").bitwiseAND(F.col(f"c{i}b"))) for i in range(len(COUNTED))), F.least("overa", "overb"))
    tokens = F.bit_count(F.col("some").bitwiseAND(F.col("some_"))) + F.col("n") - F.bit_count("some")
    total = (F.col("la") + F.col("lb")).cast("double")
    alike = (F.least("la", "lb") * 2 >= total * 0.9 - 1e-6) & (chars * 2 >= total * 0.9 - 1e-6)
    near = alike | (tokens * F.lit(1.85) >= (F.col("n") + F.col("nu")) * F.lit(0.85) - 1e-6)
    pairs = x.join(y.hint("merge"), ["w", "part"]).where((F.col("t") != F.col("u")) & (F.col("t") < F.col("last")) & near)
    kind = titles.schema["t"].dataType.simpleString()
    return pairs.select("t", "u", "at", "rare", "n", "nu", "ta", "tb", "places").mapInPandas(_compared(most, whole), f"t {kind}, u {kind}, jac double, ratio double")


def titled(df: DataFrame) -> DataFrame:
    """Adds t and last, the least and the greatest record of the title, and rows, the number of its records."""
    w = W.partitionBy("ntitle")
    return df.withColumns({"t": F.min("idx").over(w), "last": F.max("idx").over(w), "rows": F.count("*").over(w)})


def fuzzy_pairs(df: DataFrame, most: int = 400, whole: bool = True) -> DataFrame:
    """(a, b, jac, ratio, guarded, linked) of the candidates whose titles are similar.

    Candidates are those by rare tokens, the reference's rule, and unless ``whole`` is False those by all tokens, so that none is
    lost as tokens grow frequent. Equal titles are compared once.
    """
    of = df if "t" in df.columns else cut(titled(df))
    titles = of.where("idx = t").select("t", "last", "rows", "ntitle", _tokens(F.col("ntitle")).alias("tokens"))
    p = similar_titles(titles, most, whole)
    equal = titles.where("last > t AND length(ntitle) >= 15 AND size(tokens) >= 2")
    if not whole:
        rare = rare_tokens(titles.select(F.col("t").alias("idx"), "tokens", "rows"), most).groupBy("idx").agg(F.count("*").alias("n")).where("n >= 2")
        equal = equal.join(rare.select(F.col("idx").alias("t")), "t", "left_semi")
    p = cut(p.union(equal.select("t", "t", F.lit(1.0), F.lit(1.0))))
    ends = p.select("t").union(p.select("u")).distinct()
    of = cut(of.select("idx", "t", "surnames", "year", X.retraction(F.col("ntitle")).alias("mark")).join(ends.hint("merge"), "t"))
    side = lambda t, p: of.select(F.col("t").alias(t), F.col("idx").alias(p), F.col("surnames").alias(f"s{p}"), F.col("year").alias(f"y{p}"), F.col("mark").alias(f"m{p}")).hint("merge")
    p = p.join(side("t", "a"), "t").join(side("u", "b"), "u").where("a < b")
    people = (F.size("sa") == 0) | (F.size("sb") == 0) | F.arrays_overlap("sa", "sb")
    ya, yb = F.col("ya").try_cast("int"), F.col("yb").try_cast("int")
    year = F.coalesce(F.abs(ya - yb) <= 1, F.lit(True))
    guarded = F.col("ma") != F.col("mb")
    linked = ~guarded & (((F.col("ratio") >= 0.97) | (F.col("jac") >= 0.95)) & (people | year) | (F.col("ratio") >= 0.9) & people & year)
    return p.select("a", "b", "jac", "ratio", guarded.alias("guarded"), linked.alias("linked"))


def link(records: DataFrame, most: int = 400, whole: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clusters (idx, root) of all records, the edges (a, b, method, score, note), and the flagged near misses (a, b,
    ratio, jac): similar pairs that were not accepted and ended in different clusters. ``whole`` as in ``fuzzy_pairs``."""
    df = cut(titled(derive(records.select("idx", "title", "authors", "year", "doi")).select("idx", "year", "doi", "ntitle", "surnames")))
    fuzzy = cut(fuzzy_pairs(df, most, whole))
    edges = doi_edges(df).union(title_edges(df)).union(fuzzy.where("linked").select("a", "b", F.lit("fuzzy"), F.col("ratio"), F.lit(None).cast("string")))
    found = components(edges)
    clusters = df.select("idx").join(found, F.col("idx") == F.col("id"), "left").select("idx", F.coalesce("root", "idx").alias("root"))
    ra, rb = clusters.select(F.col("idx").alias("a"), F.col("root").alias("ra")), clusters.select(F.col("idx").alias("b"), F.col("root").alias("rb"))
    flagged = fuzzy.where("NOT linked").join(ra, "a").join(rb, "b").where("ra <> rb").select("a", "b", "ratio", "jac", "guarded")
    return clusters, edges, flagged


def worksheet_pairs(corpus: DataFrame, most: int = 400) -> DataFrame:
    """Pairs of canonical records (cid) for a human to judge: scored, banded, numbered; idx is the cid here.

    Columns: pair, a, b, jac, ratio, asim, same_system, band, score. Abstracts are compared on their first 3,000
    normalised characters, as the worksheet is defined.
    """
    rare = rare_tokens(corpus, most)
    near = rare.select("token", F.col("idx").alias("a")).join(rare.select("token", F.col("idx").alias("b")), "token").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where("shared >= 2")
    side = lambda p: corpus.select(F.col("idx").alias(p), F.col("ntitle").alias(f"n{p}"), F.col("tokens").alias(f"k{p}"), F.lower(X.precolon(F.col("title"))).alias(f"s{p}"), F.substring(X.ascii_key(F.col("abstract")), 1, 3000).alias(f"x{p}"))
    p = near.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("ka", "kb"))
    p = p.withColumn("jac", both / (F.size("ka") + F.size("kb") - both)).withColumn("same_system", F.coalesce(F.col("sa") == F.col("sb"), F.lit(False)))
    la, lb = F.length("na"), F.length("nb")
    p = p.where((F.col("same_system") & (F.col("jac") >= 0.45)) | (F.least(la, lb) * 2 >= (la + lb) * F.lit(0.65)))
    p = p.withColumn("ratio", seq_ratio("na", "nb")).where("ratio >= 0.65D OR (same_system AND jac >= 0.45D)")
    p = p.withColumn("asim", F.when((F.length("xa") > 0) & (F.length("xb") > 0), seq_ratio("xa", "xb")))
    return p.withColumn("band", X.pair_band(F.col("asim"), F.col("ratio"), F.col("same_system"))).withColumn("score", X.pair_score(F.col("asim"), F.col("ratio"))).select("a", "b", "jac", "ratio", "asim", "same_system", "band", "score")


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs in the order of band, then falling score, then ids, numbered P001 and on."""
    order = F.array_position(F.array(*map(F.lit, ("ALMOST CERTAIN", "LIKELY", "UNCLEAR", "DISTINCT"))), F.col("band"))
    p = ranked(pairs.withColumn("__o", order).withColumn("__s", -F.col("score")), "__n", "__o", "__s", "a", "b")
    return p.withColumn("pair", X.record_id("P", 3, F.col("__n"))).drop("__o", "__s", "__n")
