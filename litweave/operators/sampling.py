"""Allocation, stratified samples and splits. Draws that must repeat published ones run on the driver over ids; the
scalable ones order by a hash."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.operators.order import ranked, ranked_within


def allocate(sizes: list[tuple[str, int]], fraction: float = 0.1) -> dict[str, int]:
    """Largest remainders: the target, rounded half to even, over strata in their order; leftovers to the biggest
    remainders, the first stratum among equals."""
    total = sum(n for _, n in sizes)
    target = round(total * fraction)
    exact = [(s, n * target / total if total else 0.0) for s, n in sizes]
    out = {s: int(x) for s, x in exact}
    for s, _ in sorted(exact, key=lambda x: -(x[1] - int(x[1])))[: target - sum(out.values())]:
        out[s] += 1
    return out


def allocation(df: DataFrame, stratum: str, order: Column | str, fraction: float = 0.1) -> DataFrame:
    """(stratum, n, quota): the same as ``allocate``, as a plan. Strata come in the order of the least ``order``; there
    is a row per stratum after the first aggregation."""
    s = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    every = W.partitionBy(F.lit(1))
    s = s.withColumn("total", F.sum("n").over(every)).withColumn("target", F.bround(F.col("total") * F.lit(fraction)).cast("bigint"))
    exact = F.col("n") * F.col("target") / F.col("total")
    s = s.withColumn("base", F.floor(exact)).withColumn("rest", exact - F.col("base")).withColumn("left", F.col("target") - F.sum("base").over(every))
    turn = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.col("rest").desc(), "at"))
    return s.withColumn("quota", F.col("base") + (turn <= F.col("left")).cast("int")).select("stratum", "n", "quota")


def seeded_sample(strata: dict[str, list[str]], quotas: dict[str, int], seed: int) -> tuple[list[str], random.Random]:
    """Ids drawn from each stratum in turn by Python's generator, put in order, then shuffled by the same one; the
    generator goes on."""
    rng = random.Random(seed)
    picked = sorted(x for s, ids in strata.items() for x in rng.sample(ids, quotas.get(s, 0)))
    rng.shuffle(picked)
    return picked, rng


def seeded_split(strata: dict[str, list[str]], names: list[str], seed: int, run_on: bool = False) -> dict[str, list[str]]:
    """Ids dealt in turn after a shuffle of each stratum. The dealer begins anew with each stratum, or runs on."""
    rng, out, turn = random.Random(seed), {n: [] for n in names}, 0
    for ids in strata.values():
        ids = list(ids)
        rng.shuffle(ids)
        if not run_on:
            turn = 0
        for x in ids:
            out[names[turn % len(names)]].append(x)
            turn += 1
    return out


def _by_hash(id_: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_).cast("string")))


def hash_sample(df: DataFrame, id_: str, stratum: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Rows of each stratum up to its quota (stratum, quota), in the order of a hash of seed and id."""
    q = quotas.select(F.col("stratum").alias(stratum), "quota")
    return ranked_within(df.withColumn("__h", _by_hash(id_, seed)), "draw", stratum, "__h", id_).join(q, stratum).where("draw <= quota").drop("quota", "__h")


def hash_split(df: DataFrame, id_: str, stratum: str, k: int, seed: int, run_on: bool = False) -> DataFrame:
    """Adds part, 0..k-1: rows dealt in the order of a hash within their stratum; the dealer begins anew with each
    stratum, or runs on from the strata before."""
    d = df.withColumn("__h", _by_hash(id_, seed))
    d = ranked(d, "turn", stratum, "__h", id_) if run_on else ranked_within(d, "turn", stratum, "__h", id_)
    return d.withColumn("part", F.pmod(F.col("turn") - 1, F.lit(k)).cast("int")).drop("turn", "__h")


def bars(df: DataFrame, n: str, width: int = 28) -> DataFrame:
    """Adds bar: hashes in proportion to the largest count, one at least. For reports: a row per bar."""
    return df.withColumn("bar", F.repeat(F.lit("#"), F.greatest(F.lit(1), F.bround(F.col(n) * width / F.max(n).over(W.partitionBy(F.lit(1)))).cast("int"))))
