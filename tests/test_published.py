"""Published figures: agreement, allocation, draws and splits."""

import hashlib

import pytest

from litweave.operators import agreement, sampling

SEED = 20260928
#: Records by year, and the ids merged away, which aren't used again.
YEARS = {"2018": 18, "2019": 44, "2020": 36, "2021": 51, "2022": 66, "2023": 152, "2024": 372, "2025": 755, "2026": 769}
GONE = (42, 90, 170, 641, 1209, 1725, 2119)


def pools():
    ids = iter(c for c in range(1, sum(YEARS.values()) + len(GONE) + 1) if c not in GONE)
    return {y: [next(ids) for _ in range(n)] for y, n in YEARS.items()}


def mark(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()[:16]


@pytest.mark.parametrize(
    "cells, kappa, lo, hi, band",
    [
        ({("include", "include"): 13, ("include", "exclude"): 1, ("exclude", "exclude"): 12}, 0.923, 0.775, 1.0, "almost perfect"),
        ({("include", "include"): 26, ("include", "maybe"): 1, ("include", "exclude"): 4, ("exclude", "include"): 1, ("exclude", "exclude"): 51}, 0.844, 0.724, 0.964, "strong"),
        ({("include", "include"): 27, ("include", "exclude"): 4, ("exclude", "include"): 1, ("exclude", "exclude"): 51}, 0.869, 0.757, 0.980, "strong"),
        ({("include", "include"): 70, ("include", "exclude"): 4, ("exclude", "include"): 15, ("exclude", "exclude"): 137}, 0.816, 0.737, 0.895, "strong"),
    ],
)
def test_kappas(spark, cells, kappa, lo, hi, band):
    rows = [(f"{a}{b}{i}", a, b) for (a, b), n in cells.items() for i in range(n)]
    k = agreement.cohen(spark.createDataFrame(rows, "unit string, l1 string, l2 string")).first()
    assert (round(k["kappa"], 3), round(k["lo"], 3), round(k["hi"], 3), k["band"]) == (kappa, lo, hi, band)


def test_alphas(spark):
    rows = [(f"{a}{b}{i}", r, v) for (a, b), n in {("include", "include"): 13, ("include", "exclude"): 1, ("exclude", "exclude"): 12}.items() for i in range(n) for r, v in (("x", a), ("y", b))]
    assert round(agreement.krippendorff(spark.createDataFrame(rows, "unit string, rater string, label string")).first()["alpha"], 3) == 0.924


def test_sample_and_split():
    quotas = sampling.allocate([(y, len(p)) for y, p in pools().items()])
    assert quotas == {"2018": 2, "2019": 4, "2020": 4, "2021": 5, "2022": 7, "2023": 15, "2024": 37, "2025": 75, "2026": 77}
    order, _ = sampling.seeded_sample(pools(), quotas, SEED)
    assert order[:10] == [76, 1185, 1874, 2208, 371, 2230, 1189, 698, 906, 760]  # the order they were presented in
    assert len(order) == 226 and mark(sorted(order)) == "5d4ad37eceeb3e6b"
    rest = {y: [c for c in p if c not in set(order)] for y, p in pools().items()}
    split = sampling.seeded_split(rest, ["screener_1", "screener_2"], SEED)
    assert {k: (len(v), mark(sorted(v))) for k, v in split.items()} == {"screener_1": (1020, "6b33a4535590c19e"), "screener_2": (1017, "1c56667aa1c1bb1c")}


def test_a_split_that_runs_on_halves_the_whole():
    split = sampling.seeded_split({"a": [1, 2, 3], "b": [4, 5, 6], "c": [7]}, ["x", "y"], SEED, run_on=True)
    assert sorted(map(len, split.values())) == [3, 4] and sorted(x for v in split.values() for x in v) == list(range(1, 8))
