"""Problem 9: mixing sources to target weights by balanced sampling.

A source that must give a target share of all tokens gives each of its documents ``base`` times, and a part ``pi`` of
them once more. That part is drawn by the cube method: all documents start with the inclusion probability ``pi``, and are
moved, a few at a time, along the null space of the constraints (number of documents, tokens) until each is 0 or 1. So
both totals stay where they are but for the last two documents of a source, the landing.

The flight runs over blocks: each task moves the documents it reads and keeps at most two undecided ones per source;
these meet again in fewer blocks, until one block per source is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.llm.tokens import count_tokens
from litweave.session import cut

FANIN, EPS = 64, 1e-9


def flight(ids: list, tokens: list[int], pis: list[float], rng: np.random.Generator, landing: bool = False) -> list[tuple[int, float]]:
    """(position, inclusion) of each unit: 0, 1, or, for at most two units unless ``landing``, something between."""
    out: list[tuple[int, float]] = []
    live: list[list] = []
    draws = iter(rng.random(2 * len(ids) + 4).tolist())

    def move(u: list[float]) -> None:
        up = min(((1 - x[1]) if c > 0 else -x[1]) / c for x, c in zip(live, u) if abs(c) > EPS)
        down = min((x[1] if c > 0 else x[1] - 1) / c for x, c in zip(live, u) if abs(c) > EPS)
        step = up if next(draws) * (up + down) < down else -down
        for x, c in zip(live, u):
            x[1] += step * c
        for x in [x for x in live if not EPS < x[1] < 1 - EPS]:
            out.append((x[0], float(round(x[1]))))
            live.remove(x)

    for i, (t, p) in enumerate(zip(tokens, pis)):
        if not EPS < p < 1 - EPS:
            out.append((i, float(round(p))))
            continue
        live.append([i, p, t])
        if len(live) == 3:  # one more than constraints: the null space has a direction
            a, b, c = (x[2] for x in live)
            move([c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0])
            while len(live) == 2 and live[0][2] == live[1][2]:
                move([1.0, -1.0])
    if landing:
        while len(live) > 1:  # give up the tokens, keep the number
            move([1.0, -1.0])
        while live:
            move([1.0])
    return out + [(x[0], x[1]) for x in live]


def _fly(pdf: pd.DataFrame, seed: int, landing: bool) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
    rng = np.random.default_rng([seed, len(pdf), abs(hash(int(pdf["id"].iloc[0]))) % (1 << 32)])
    got = flight(pdf["id"].tolist(), pdf["n_tokens"].tolist(), pdf["pi"].tolist(), rng, landing)
    pi = np.empty(len(pdf))
    for i, p in got:
        pi[i] = p
    return pdf.assign(pi=pi)


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 20260928, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Copies of each document, and the shares reached.

    ``docs`` has an integer key, a text and a ``source``; ``targets`` is a parameter table of a few rows with
    ``source, target_share, max_repeats``. The size to reach is the tokens of all of ``docs``, sources without a target
    included. First result: (key, source, copies) of every document whose source has a target, 0 copies included; no
    document has more than ``max_repeats``. Second: per target ``source, target_share, max_repeats, n_docs, tokens,
    wanted_tokens, used_tokens, actual_share, short``; ``short`` where ``max_repeats`` times the tokens are less than
    the share wanted, a source without documents having none.

    NULL keys and NULL sources count for the size only. Repeated keys are documents of their own. A NULL share or
    repeat is 0. Repeated targets of one source: the largest holds. Empty texts may be drawn and weigh nothing.
    """
    spark = docs.sparkSession
    targets = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.max(F.coalesce("target_share", F.lit(0.0)).cast("double")).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0)).cast("long")).alias("max_repeats")
    )
    counts = cut(count_tokens(docs, [key, "source"], text, path).withColumnRenamed(key, "id"))
    sums = {r["source"]: (r["n"], r["t"]) for r in counts.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).join(F.broadcast(targets), "source", "left_semi").collect()}
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    plan, rows = {}, []
    for r in targets.collect():  # as many rows as targets were given
        n, t = sums.get(r["source"], (0, 0))
        wanted, most = r["target_share"] * total, r["max_repeats"]
        ratio = min(wanted / t if t else 0.0, float(most))
        base = int(ratio)
        plan[r["source"]] = (base, ratio - base)
        rows.append((r["source"], r["target_share"], most, n, t, wanted, bool(most * t < wanted)))
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats long, n_docs long, tokens long, wanted_tokens double, short boolean")
    bases = spark.createDataFrame([(s, b, p) for s, (b, p) in plan.items()], "source string, base long, pi double")

    part = "id " + counts.schema["id"].dataType.simpleString() + ", source string, n_tokens long, base long, pi double"
    state = counts.where(F.col("id").isNotNull()).join(F.broadcast(bases), "source").select("id", "source", "n_tokens", "base", "pi")

    def first(frames):
        for pdf in frames:  # a block is an Arrow batch
            for _, own in pdf.groupby("source", sort=True):
                yield _fly(own, seed, False)

    blocks = max(1, counts.rdd.getNumPartitions())
    state = cut(state.mapInPandas(first, part))
    blocks, done, turn = 4 * blocks, [], 0
    between = (F.col("pi") > EPS) & (F.col("pi") < 1 - EPS)
    while True:
        done.append(state.where(~between))
        blocks, turn = -(-blocks // FANIN), turn + 1
        landing = blocks == 1

        def again(pdf):
            return _fly(pdf.drop(columns="block"), seed + 1, landing)

        state = cut(
            state.where(between)
            .withColumn("block", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(blocks)))
            .groupBy("source", "block")
            .applyInPandas(again, part)
        )
        if blocks == 1:
            break
    drawn = state
    for d in done:
        drawn = drawn.unionByName(d)
    copies = drawn.select(F.col("id").alias(key), "source", (F.col("base") + F.round("pi").cast("long")).alias("copies"), "n_tokens")
    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("used_tokens"))
    report = wanted.join(F.broadcast(used), "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0)))
    used_total = report.agg(F.sum("used_tokens")).first()[0] or 0
    report = report.select(
        "source", "target_share", "max_repeats", "n_docs", "tokens", "wanted_tokens", "used_tokens",
        (F.col("used_tokens") / F.lit(float(used_total) or 1.0)).alias("actual_share"), "short",
    )
    return copies.drop("n_tokens"), report
