"""Problem 4: consolidating pairwise matches into groups by pruning to seeds.

Rounds of two steps, each a few joins and aggregations on keys. *Selection*: every vertex tells its neighbours and itself
the least identifier among them. *Pruning*: a vertex links what it was told to the least of it, and drops out if nobody
named it; it then hangs below that least one in a forest. What is left is a graph of the candidates only, which shrinks
by a constant factor or more in each round. The roots of the forest are the seeds; their identifiers flow down it, one
level of rounds at a time, last round first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.session import cut


def list_edges(df: DataFrame, column: str) -> DataFrame:
    """(u, v): a star around the least member of each list, so a list of n members gives n - 1 edges. NULLs are skipped."""
    members = F.array_distinct(F.filter(F.col(column), lambda x: x.isNotNull()))
    return df.select(members.alias("m")).where(F.size("m") > 1).select(F.array_min("m").alias("u"), F.explode("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every vertex of an edge (u, v) between two different identifiers, with the least identifier it reaches.

    Directions, repeated edges, loops and edges with a NULL end don't matter. Roots are rows too (id = root). An empty
    table gives an empty result; other columns are not read. A vertex with very many neighbours is aggregated before the
    shuffle, and joins on it are split by adaptive execution.
    """
    kind = edges.schema["u"].dataType
    e = edges.select("u", F.col("v").cast(kind).alias("v")).where("u <> v")
    e = cut(e.union(e.select("v", "u")).distinct())
    forest: list[DataFrame] = []  # of each round: (parent, child)
    while not e.isEmpty():
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        told = cut(e.join(least, "u").select(F.col("v").alias("u"), "m").union(least.select("u", "m")).distinct())
        best = told.groupBy("u").agg(F.min("m").alias("least"), F.max((F.col("m") == F.col("u")).cast("int")).alias("named"), F.count("*").alias("n"))
        best = cut(best)
        forest.append(best.where("named = 0").select(F.col("least").alias("parent"), F.col("u").alias("child")))
        e = told.join(best.where("n > 1").select("u", "least"), "u").where("m <> least").select(F.col("m").alias("u"), F.col("least").alias("v"))
        e = cut(e.union(e.select("v", "u")).distinct())
    if not forest:
        return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    children = reduce(DataFrame.unionByName, (f.select("child") for f in forest))
    roots = reduce(DataFrame.unionByName, (f.select("parent") for f in forest)).distinct().join(children, F.col("parent") == F.col("child"), "left_anti")
    known = cut(roots.select(F.col("parent").alias("id"), F.col("parent").alias("root")))
    for level in reversed(forest):
        below = level.join(known, F.col("parent") == F.col("id")).select(F.col("child").alias("id"), "root")
        known = cut(known.union(below))
    return known


def record_groups(records: DataFrame, edges: DataFrame, lists: DataFrame, idx: str = "idx", src: str = "src_idx", dst: str = "dst_idx", column: str = "merged_idxs") -> DataFrame:
    """(idx, group_idx) of every record whose group has at least two: linked by pairs, by lists, or through others.

    A pair with an end that is NULL or no record links nothing. NULLs in lists are skipped; a list member that is no
    record holds its list together, but is no row and no ``group_idx``. Repeated rows don't matter.
    """
    known = records.select(F.col(idx).alias("k")).where("k IS NOT NULL").distinct()
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v").distinct()
    pairs = pairs.join(known, F.col("u") == F.col("k"), "left_semi").join(known, F.col("v") == F.col("k"), "left_semi")
    found = cut(components(pairs.union(list_edges(lists, column))).join(known, F.col("id") == F.col("k"), "left_semi"))
    groups = found.groupBy("root").agg(F.min("id").alias("group_idx"), F.max("id").alias("hi")).where("group_idx < hi").select("root", "group_idx")
    return found.join(groups, "root").select(F.col("id").alias("idx"), "group_idx")
