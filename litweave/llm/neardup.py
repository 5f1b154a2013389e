"""Problem 3: near-duplicate records by a chosen-path similarity join.

Every record is a set of word sequences. Tokens of a set are sampled by minima of hashes all sets share: two sets sample
the same one with a probability of their similarity. Some samples, the roots, are the runs of the join: sets with a
common one share a bucket. Others are a signature of a byte each. A bucket that is large is split again on a few samples
of the signature, chosen by the path so far, so a pair comes down several ways; small ones are compared whole. There are
as many roots as the target recall takes. Buckets larger than a task should hold are split by the cluster before tasks
take over, and what stays large at the last level is compared whole too, in blocks: nothing is capped.

In a bucket, the samples that two signatures have in common sort out pairs; the rest is verified on the whole sets.
Records with equal sets are one class and take part once.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.llm.markup import clean
from litweave.session import Stored, cut

WORDS = re.compile(r"[^\W_]+")
SAMPLES, WAYS, DEPTH = 64, 3, 4  # of the signature; on which a bucket is split; how often at most
POOL = SAMPLES // DEPTH  # each level splits on samples of its own
A, B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WORD: dict[str, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * A
    x = (x ^ (x >> np.uint64(27))) * B
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORDS.findall(text.lower())


def shingles(ws: list[str], n: int) -> np.ndarray:
    """Sorted distinct hashes of the sequences of n words; of fewer words, the one they make."""
    if not ws:
        return np.empty(0, np.uint64)
    if len(_WORD) > 1_000_000:
        _WORD.clear()
    for w in ws:
        if w not in _WORD:
            _WORD[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([_WORD[w] for w in ws], np.uint64)
    n = min(n, len(ws))
    out = np.zeros(len(ws) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(31) + h[k : len(ws) - n + 1 + k])
    return np.unique(out)


def minima(flat: np.ndarray, starts: np.ndarray, first: int, count: int) -> np.ndarray:
    """A row per set (they begin at ``starts`` in ``flat``, none is empty): the least product with each multiplier."""
    by = mixed(np.arange(first + 1, first + count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(starts), count), np.uint64)
    ends = np.append(starts[1:], len(flat))
    at = 0
    while at < len(starts):  # as many sets at a time as stay in the cache
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + 32_768, side="right")))
        part, own = flat[starts[at] : ends[to - 1]], starts[at:to] - starts[at]
        for k in range(count):
            out[at:to, k] = np.minimum.reduceat(part * by[k], own)
        at = to
    return out


@lru_cache(maxsize=16)
def plan(threshold: float, recall: float) -> tuple[int, int]:
    """Roots, and the least number of equal samples of a pair: a pair at the threshold is missed with at most
    1 - recall, a tenth of that for too few equal samples. How many are equal is binomial, in all and in the samples of
    each level; what is left of a pair's ways down follows from that, through all levels."""
    binomial = lambda n: np.array([math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(n + 1)])
    missed = np.cumsum(binomial(SAMPLES))
    least = int(np.searchsorted(missed, (1 - recall) / 10, side="right"))
    down, chance = np.ones(1), np.ones(1)
    for _ in range(DEPTH):
        down = 1 - (1 - np.outer(np.arange(POOL + 1) / POOL, down).ravel()) ** WAYS
        chance = np.outer(binomial(POOL), chance).ravel()
    for roots in range(1, 1000):
        if chance @ (1 - threshold * down) ** roots <= (1 - recall) * 0.9:
            return roots, least
    raise ValueError("no number of roots gives this recall")


def record_sets(df: DataFrame, key: str, text: str, extra: str | None, n: int, min_words: int, roots: int) -> DataFrame:
    """(id, class, s, samples, roots): the sets of the records whose text has at least ``min_words`` words; ``extra`` is
    put before the text. NULLs are empty. Sets of one ``class`` are equal."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keep, sets = [], []
            for k, (x, t) in enumerate(zip(batch.column("x").to_pylist(), batch.column("t").to_pylist())):
                ws = words(clean(t)[0])
                if len(ws) < max(1, min_words):
                    continue
                keep.append(k)
                sets.append(shingles((words(clean(x)[0]) if x else []) + ws, n))
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            low = minima(flat, ends[:-1], 0, SAMPLES + roots)
            samples = (mixed(low[:, :SAMPLES]) >> np.uint64(56)).astype(np.uint8)
            paths = mixed(low[:, SAMPLES:] + np.arange(roots, dtype=np.uint64))
            lists = lambda flat, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep, pa.int32())), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), lists(flat, ends), pa.array([r.tobytes() for r in samples], pa.binary()), lists(paths.reshape(-1), np.arange(len(sets) + 1) * roots)],
                ["id", "class", "s", "samples", "roots"],
            )

    x = F.col(extra) if extra else F.lit(None).cast("string")
    texts = df.select(F.col(key).alias("id"), x.alias("x"), F.col(text).alias("t")).where("id IS NOT NULL AND t IS NOT NULL")
    return texts.mapInArrow(run, f"id {kind}, class binary, s array<bigint>, samples binary, roots array<bigint>")


def way(seeds: np.ndarray, level: int, w: int) -> np.ndarray:
    """The sample on which buckets are split the ``w``-th way."""
    return level * POOL + ((seeds % np.uint64(POOL)).astype(np.int64) + w * (POOL // WAYS)) % POOL


def leaves(samples: np.ndarray, group: np.ndarray, level: np.ndarray, most: int) -> list[np.ndarray]:
    """Positions of the rows of each bucket to compare whole. ``group`` has the bucket of each row, rows of one
    following each other, and ``level`` how often it was split; all buckets of a level are split at once."""
    done: list[np.ndarray] = []
    rows, key = np.empty(0, np.int64), np.empty(0, np.uint64)
    for at in range(DEPTH + 1):
        new = np.flatnonzero(level == at)
        rows, key = np.append(rows, new), np.append(key, group[new])
        if not len(rows):
            continue
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        size = np.diff(np.append(starts, len(key)))
        split = (size > most) & (at < DEPTH)
        of = np.repeat(np.arange(len(size)), size)
        down, into, work = [], [], np.zeros(len(size))
        big = split[of]
        if big.any():
            r, seeds, parent = rows[big], key[big], of[big]
            for w in range(WAYS):
                k = way(seeds, at, w)
                value = samples[r, k]
                child = mixed(seeds ^ ((k * 256 + value + 1).astype(np.uint64) * B))
                _, first, back, n = np.unique(child, return_index=True, return_inverse=True, return_counts=True)
                work += np.bincount(parent[first], n.astype(float) ** 2, minlength=len(size))
                keep = n[back] > 1
                down.append((r[keep], parent[keep]))
                into.append(child[keep])
        split &= work < size.astype(float) ** 2
        done += [rows[a : a + n] for a, n in zip(starts[~split].tolist(), size[~split].tolist()) if n > 1]
        ok = [split[parent] for _, parent in down]
        rows = np.concatenate([np.empty(0, np.int64), *(r[o] for (r, _), o in zip(down, ok))])
        key = np.concatenate([np.empty(0, np.uint64), *(c[o] for c, o in zip(into, ok))])
    return done


def compare(samples: np.ndarray, buckets: list[np.ndarray], least: int, small: int = 64, batch: int = 400_000):
    """Positions (i, j) of the pairs in each bucket with ``least`` equal samples, some repeatedly, in batches."""
    got: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    few = [b for b in buckets if len(b) <= small]
    if few:
        rows = np.concatenate(few)
        of = np.repeat(np.arange(len(few)), [len(b) for b in few])
        for d in range(1, max(map(len, few))):  # each row against the d-th after it
            at = np.flatnonzero(of[:-d] == of[d:])
            for x in range(0, len(at), batch):
                i, j = rows[at[x : x + batch]], rows[at[x : x + batch] + d]
                ok = np.count_nonzero(samples[i] == samples[j], axis=1) >= least
                got.append((i[ok], j[ok]))
                held += int(ok.sum())
            if held > batch:
                yield tuple(map(np.concatenate, zip(*got)))
                got, held = [], 0
    for rows in buckets:
        if len(rows) > small:
            own = samples[rows]
            for x in range(0, len(rows), 256):  # a block against itself and all after it
                for y in range(x, len(rows), 256):
                    same = np.count_nonzero(own[x : x + 256, None, :] == own[None, y : y + 256, :], axis=2)
                    i, j = np.nonzero(same >= least)
                    i, j = i + x, j + y
                    got.append((rows[i[i < j]], rows[j[i < j]]))
                    held += len(i)
                if held > batch:
                    yield tuple(map(np.concatenate, zip(*got)))
                    got, held = [], 0
    if got:
        yield tuple(map(np.concatenate, zip(*got)))


def candidate_pairs(sets: DataFrame, least: int, most: int = 24, task: int = 5_000) -> DataFrame:
    """(a, b), a < b: pairs of ids that came down to one bucket and have ``least`` equal samples.

    Buckets of more than ``most`` are split, down to ``DEPTH`` levels, if that leaves fewer pairs to compare. While a
    bucket has more than ``task`` rows, its splitting is a step of the cluster; below, the task that holds it does it. A
    bucket of more rows that can't be split is laid out in blocks.
    """
    kind = sets.schema["id"].dataType.simpleString()
    rows, ready = sets.select("id", "samples", F.explode("roots").alias("bucket")), []
    for level in range(DEPTH + 1):
        at = [F.lit(level).alias("level"), F.lit(0).alias("side")]
        hot = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > task))
        if hot.isEmpty():
            ready.append(rows.select("id", "samples", "bucket", *at))
            break
        ready.append(rows.join(hot, "bucket", "left_anti").select("id", "samples", "bucket", *at))
        big = rows.join(hot, "bucket")
        ways = F.array(*(F.lit(level * POOL) + F.pmod(F.pmod("bucket", F.lit(POOL)) + w * (POOL // WAYS), F.lit(POOL)) for w in range(WAYS)))
        if level < DEPTH:
            down = big.select("id", "samples", "bucket", "n", F.explode(ways).alias("k"))
            down = down.select("id", "samples", F.col("bucket").alias("parent"), "n", F.xxhash64("bucket", "k", F.substring("samples", F.col("k").cast("int") + 1, F.lit(1))).alias("bucket"))
            work = down.groupBy("parent", "n", "bucket").agg(F.count("*").alias("m")).groupBy("parent", "n").agg(F.sum(F.col("m") * F.col("m").cast("double")).alias("work"))
            dense = cut(work.where(F.col("work") >= F.col("n") * F.col("n").cast("double")).select(F.col("parent").alias("bucket")))
            rows = down.join(dense.withColumnRenamed("bucket", "parent"), "parent", "left_anti").select("id", "samples", "bucket")
            big = big.join(dense, "bucket")
        blocks = F.ceil(F.col("n") * 2 / task).cast("int")  # each pair of blocks is a bucket, so any two rows meet once
        big = big.withColumn("nb", blocks).withColumn("o", F.pmod(F.xxhash64("id"), "nb").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        lo, hi = F.least("o", "other"), F.greatest("o", "other")
        ready.append(big.select("id", "samples", F.xxhash64("bucket", lo, hi).alias("bucket"), F.lit(DEPTH).alias("level"), F.when(lo == hi, 0).when(F.col("o") == lo, 1).otherwise(2).alias("side")))

    def find(frames):
        held: list[pd.DataFrame] = []

        def pairs(group: pd.DataFrame):
            ids, side = group["id"].to_numpy(), group["side"].to_numpy()
            samples = np.frombuffer(b"".join(group["samples"]), np.uint8).reshape(len(group), SAMPLES)
            for i, j in compare(samples, leaves(samples, group["bucket"].to_numpy().view(np.uint64), group["level"].to_numpy(), most), least):
                ok = (side[i] == 0) | (side[i] != side[j])
                x, y = ids[i[ok]], ids[j[ok]]
                swap = x > y
                out = pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y)})
                yield out[out["a"] != out["b"]].drop_duplicates()

        for pdf in frames:  # sorted by bucket: what may go on in the next batch is held
            if not len(pdf):
                continue
            if held and held[-1]["bucket"].iloc[-1] != pdf["bucket"].iloc[0]:
                yield from pairs(pd.concat(held, ignore_index=True))
                held = []
            open_ = (pdf["bucket"] == pdf["bucket"].iloc[-1]).to_numpy()
            if not open_.all():
                yield from pairs(pd.concat([*held, pdf[~open_]], ignore_index=True))
                held = []
            held.append(pdf[open_])
        if held:
            yield from pairs(pd.concat(held, ignore_index=True))

    all_ = reduce(DataFrame.unionByName, ready).repartition("bucket").sortWithinPartitions("bucket")
    return all_.mapInPandas(find, f"a {kind}, b {kind}").distinct()


def similar_classes(df: DataFrame, key: str = "cid", text: str = "abstract", extra: str | None = "title", n: int = 3, threshold: float = 0.6, min_words: int = 40, recall: float = 0.9999, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) of the classes of records with equal sets, ``rep`` the least id of each, and the links
    (a, b, jaccard) between representatives whose sets reach the threshold; a < b.

    Texts are cleaned of markup and look-alikes first. Records whose text is NULL or has too few words, and those with a
    NULL key, are in no class. Rows of a repeated key with different texts are different classes' members. Other columns
    aren't read. Jaccard similarities are exact; pairs at the threshold are missed with at most 1 - ``recall``, whatever
    the depth their buckets are split to.
    """
    roots, least = plan(threshold, recall)
    sets = Stored(df.sparkSession)(record_sets(df, key, text, extra, n, min_words, roots))
    members = sets.select("id", "class")
    reps = cut(members.groupBy("class").agg(F.min("id").alias("rep")))
    members = members.distinct().join(reps, "class").select("id", "rep")
    single = sets.select("id", "class", "samples", "roots").join(reps.select(F.col("rep").alias("id"), "class"), ["id", "class"]).dropDuplicates(["id", "class"])
    pairs = cut(candidate_pairs(single.select("id", "samples", "roots"), least, most))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = sets.select("id", "class", "s").join(needed, "id").join(reps.select(F.col("rep").alias("id"), "class"), ["id", "class"], "left_semi").dropDuplicates(["id", "class"])
    whole = cut(whole.select("id", "s"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(whole.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    links = links.where(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb"))).withColumn("c", both).withColumn("jaccard", F.col("c") / (F.size("sa") + F.size("sb") - F.col("c")))
    return members, cut(links.where(F.col("jaccard") >= threshold).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")))


def similar_pairs(df: DataFrame, key: str = "cid", **how) -> DataFrame:
    """(key_a, key_b), key_a < key_b: all pairs of records whose sets reach the threshold, those of equal sets included.
    Parameters as in ``similar_classes``; the result is as large as the groups make it."""
    members, links = similar_classes(df, key, **how)
    members = cut(members)
    x, y = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.where("x < y").union(within).distinct().select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))
