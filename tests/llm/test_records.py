import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.llm import components, linkage, names, neardup, publications, survive


def test_groups_against_union_find(spark):
    rng = random.Random(2)
    records = [(i,) for i in range(400)]
    edges = [(rng.randrange(420), rng.randrange(420)) for _ in range(250)] + [(3, 3), (None, 5), (7, None), (8, 9), (9, 8)] + [(300 + i, 301 + i) for i in range(60)]
    lists = [([rng.randrange(400) for _ in range(rng.randrange(4))],) for _ in range(60)] + [(None,), ([],), ([11, None, 12, 12],)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def tie(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    for a, b in edges:
        if a is not None and b is not None and a < 400 and b < 400:
            tie(a, b)
    for (m,) in lists:
        m = [x for x in m or [] if x is not None]
        for x in m[1:]:
            tie(m[0], x)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), []).append(x)
    want = {(x, min(g)) for g in groups.values() if len(g) > 1 for x in g}
    r = spark.createDataFrame(records * 2, "idx bigint")
    e = spark.createDataFrame([(a, b, "m") for a, b in edges], "src_idx bigint, dst_idx bigint, root string")
    ls = spark.createDataFrame(lists, "merged_idxs array<bigint>")
    assert {tuple(x) for x in components.record_groups(r, e, ls).collect()} == want
    assert components.record_groups(r, e.limit(0), ls.limit(0)).count() == 0


def test_hub_and_chain(spark):
    hub = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(200)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(hub, "u bigint, v bigint")).collect()}
    assert {got[i] for i in range(3000)} == {0} and {got[5000 + i] for i in range(201)} == {5000}


def test_survivors_against_brute_force(spark):
    import datetime as dt

    rng = random.Random(4)
    rows, members = [], []
    for i in range(300):
        rows.append(
            (i, rng.choice(["Scopus", "IEEE Xplore", None]), dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.choice([i, i, 5000 + i])), rng.choice([None, "", "n/a", "10.1234/x", "https://doi.org/10.1234%2Fy", "10.1234", "10./x"]),
             rng.choice([None, " ", "[No abstract available]", f"some text {i}", f"some longer text {i}"]), rng.choice([None, [], ["N/A"], ["a", "A ", "b"], ["a", None]]), rng.choice(["Not specified", "V", "Venue name", None]))
        )
        members.append((f"C{i // 3}" if i % 50 else None, i))
    r = spark.createDataFrame(rows + rows[:20], "idx bigint, source_db string, exported_at timestamp, doi string, abstract string, keywords array<string>, venue string")
    m = spark.createDataFrame(members + members[:9], "corpus_id string, idx bigint")
    bad = {"", "n/a", "no abstract available", "not specified"}
    ok = lambda s: s is not None and s.strip().strip("[]").lower() not in bad
    full = {
        "doi": lambda x: 1 if x[3] and "10.1234/" in x[3].replace("%2F", "/") else None,
        "abstract": lambda x: len(x[4]) if ok(x[4]) else None,
        "keywords": lambda x: len({k.strip().lower() for k in x[5] or [] if ok(k)}) or None,
        "venue": lambda x: len(x[6]) if ok(x[6]) else None,
    }
    groups = {}
    for c, i in members:
        if c:
            groups.setdefault(c, []).append(rows[i])
    want = set()
    for c, g in groups.items():
        for f, size in full.items():
            got = [x for x in g if size(x) is not None]
            if len(g) > 1 and got:
                want.add((c, f, max(got, key=lambda x: (size(x), x[2]))[0]))
    assert {tuple(x) for x in survive.survivors(r, m).collect()} == want
    one = {x["corpus_id"]: x for x in survive.surviving_records(r, m).collect()}
    c, f, i = sorted(want)[0]
    assert one[c][f"{f}_idx"] == i
    assert survive.survivors(r.limit(0), m).count() == 0


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(45, 120))] for _ in range(n)]
    out = []
    for k in range(4 * n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 25])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append((k, "Title " + w[0], " ".join(w)))
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(9)
    rows = texts(rng, 40) + [(1000 + i, "Same", "one same text " * 20) for i in range(60)] + [(2000, None, "few words"), (2001, "x", None), (None, "x", "y " * 60)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "cid bigint, title string, abstract string, id string")
    sets = {}
    for i, t, a in rows:
        if i is not None and a and len(neardup.words(a)) >= 40:
            sets[i] = set(neardup.shingles(neardup.words(t or "") + neardup.words(a), 3).tolist())
    want = {(x, y) for x in sets for y in sets if x < y and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.6}
    assert len(want) > 1700
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == want
    assert neardup.similar_pairs(df.limit(0)).count() == 0


def candidates(spark, sets, least, **how):
    """Candidates of sets given as arrays of hashes."""
    ends = np.cumsum([0, *map(len, sets)])
    roots, _ = neardup.plan(0.6, 0.9999)
    low = neardup.minima(np.concatenate(sets), ends[:-1], 0, neardup.SAMPLES + roots)
    samples = (neardup.mixed(low[:, : neardup.SAMPLES]) >> np.uint64(56)).astype(np.uint8)
    paths = neardup.mixed(low[:, neardup.SAMPLES :] + np.arange(roots, dtype=np.uint64)).view(np.int64)
    df = spark.createDataFrame([(i, bytearray(x.tobytes()), p.tolist()) for i, (x, p) in enumerate(zip(samples, paths))], "id bigint, samples binary, roots array<bigint>")
    return {tuple(r) for r in neardup.candidate_pairs(df, least, **how).collect()}


@pytest.mark.parametrize("how", [{}, {"most": 4}, {"most": 4, "task": 20}, {"most": 4, "task": 500}])
def test_large_buckets_lose_nothing(spark, how):
    """One bucket of near copies that can't be split, and many that share a third of their members: split by tasks, by the
    cluster, and compared in blocks, each gives the same pairs."""
    rng = np.random.default_rng(3)
    base, common = rng.integers(0, 2**63, 100, dtype=np.uint64), rng.integers(0, 2**63, 33, dtype=np.uint64)
    sets = []
    for k in range(120):
        s = base.copy()
        s[k % 100] = rng.integers(0, 2**63)
        sets.append(s)
    for k in range(120):
        s = np.concatenate([common, rng.integers(0, 2**63, 66, dtype=np.uint64)])
        sets += [s, np.append(s[1:], rng.integers(0, 2**63, dtype=np.uint64))]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120)} | {(120 + 2 * k, 121 + 2 * k) for k in range(120)}
    got = candidates(spark, sets, 35, **how)
    assert want <= got and len(got) < len(want) + 100


def test_recall_of_the_worst_pairs_at_any_depth(spark):
    """Pairs at 0.6, one set inside the other, among sets that keep their buckets large: 6,000 of them, all levels used."""
    rng = np.random.default_rng(8)
    missed, n, roots_least = 0, 3000, neardup.plan(0.6, 0.9999)
    roots, least = roots_least
    for seed in range(2):
        sets = []
        for _ in range(n):
            s = rng.integers(0, 2**64, 100, dtype=np.uint64)
            sets += [s, s[:60]]
        ends = np.cumsum([0, *map(len, sets)])
        low = neardup.minima(np.concatenate(sets), ends[:-1], 0, neardup.SAMPLES + roots)
        samples = (neardup.mixed(low[:, : neardup.SAMPLES]) >> np.uint64(56)).astype(np.uint8)
        found = np.zeros(n, bool)
        for r in range(roots):
            same = low[::2, neardup.SAMPLES + r] == low[1::2, neardup.SAMPLES + r]
            seeds = neardup.mixed(low[::2, neardup.SAMPLES + r])
            alive = [(np.flatnonzero(same), seeds[same])]  # down all levels, as in buckets that stay large
            for level in range(neardup.DEPTH):
                at, key = (np.concatenate(x) for x in zip(*alive))
                alive = []
                for w in range(neardup.WAYS):
                    k = neardup.way(key, level, w)
                    ok = samples[2 * at, k] == samples[2 * at + 1, k]
                    alive.append((at[ok], neardup.mixed(key[ok] + np.uint64(w + 1))))
            for at, _ in alive:
                found[at] = True
        missed += int((~(found & ((samples[::2] == samples[1::2]).sum(axis=1) >= least))).sum())
    assert missed <= 4  # one in 10,000 is what the plan allows


def test_shingles_and_samples():
    a = neardup.shingles("a b c d e".split(), 3)
    assert len(a) == 3 and len(neardup.shingles(["a"], 3)) == 1 and len(neardup.shingles([], 3)) == 0
    b = neardup.shingles("x a b c".split(), 3)
    assert np.array_equal(b[np.isin(b, a)], a[np.isin(a, b)]) and len(np.intersect1d(a, b)) == 1
    low = neardup.minima(np.concatenate([a, b, a]), np.array([0, len(a), len(a) + len(b)]), 0, 200)
    assert (low[0] == low[2]).all() and 0.1 < (low[0] == low[1]).mean() < 0.4  # one of four in common
    assert neardup.words("Ab-c d_e 5 é") == ["ab", "c", "d", "e", "5", "é"]


REGISTER = [(1, "Elizabeth Cédakkelstra"), (2, "Magdalena B. Berelréspoulos"), (3, "Michael Berelréspoulos"), (4, "Jean-Luc Münipětwright"), (5, "Miriam P. Münipětwright"), (6, "Søren de Dunanen"), (7, "Francisco Rilorharoğlu"), (8, "Oliver al-Tålesford"), (9, "Márton O'Draelrov")]


@pytest.mark.parametrize(
    "name, who",
    [
        ("Elizabeth Cédakkelstra", 1), ("Cedakkelstra, Elizabeth", 1), ("E. Cédakkelstra", 1), ("CÉDAKKELSTRA, Liz", 1), ("Elizabth Cédakkelstra", 1), ("Elizabeth Cedakelstra", 1), ("Prof. E. Cédakkelstra", 1), ("Cédakkelstra Elizabeth, PhD", 1), ("H. Cédakkelstra", None),
        ("Berelréspoulos MB", 2), ("M. B. Berelréspoulos", 2), ("Michael Berelrespoulos", 3), ("Magdalena Berelréspoulos", 2), ("Hans Berelréspoulos", None), ("Magdalena K. Berelréspoulos", None),
        ("J.-L. Münipětwright", 4), ("Münipětwright, J.", 4), ("JeanLuc Muenipetwright", 4), ("M. Münipětwright", 5), ("Soeren de Dunanen", 6), ("S. deDunanen", 6), ("Paco Rilorharoglu", 7), ("Ｏ． al-Tålesford", 8), ("M. O'Draelrov", 9), ("Márton O’Draelrov", 9), ("et al.", None), ("", None), ("Ri1orharoğlu, F.", 7),
    ],
)
def test_name_variants(name, who):
    scores = {}
    for i, full in REGISTER:
        person = names.person(full)
        for p in names.readings(name):
            for at, t in enumerate(p["tokens"]):
                if s := names.alike(t, person["surname"]):
                    scores[i] = max(scores.get(i, 0), names.score(p["tokens"], set(p["particles"]), at, s, person, 7.0, 5.0, False, names.SHORT))
    best = sorted(scores.items(), key=lambda x: -x[1])[:2]
    got = best[0][0] if best and best[0][1] >= 0.72 and (len(best) < 2 or best[0][1] - best[1][1] > 0.01) else None
    assert got == who


def test_token_join_misses_nothing_alike(spark):
    """Against all pairs: words one or two errors apart, swaps and letters written in two ways included."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abceour") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    for w in list(words):
        for _ in range(5):
            x = list(w)
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(len(x))
                edit = rng.randrange(4)
                x[k : k + 1] = [] if edit == 0 and len(x) > 1 else [rng.choice("aeou"), *x[k : k + 1]] if edit == 1 else [rng.choice("aeou")]
                if edit == 3 and k:
                    x[k - 1 : k + 1] = x[k - 1 : k + 1][::-1]
            words.append("".join(x))
    words = sorted(set(words))
    left, right = spark.createDataFrame([(w,) for w in words], "t string"), spark.createDataFrame([(w,) for w in words[::2]], "u string")
    want = {(a, b) for a in words for b in words[::2] if names.alike(a, b)}
    got = {tuple(r) for r in names.token_join(left, right).collect()}
    assert len(want) > 400 and not want - got


def people(spark, rows):
    return spark.createDataFrame(rows, "author_id bigint, full_name string")


def spellings(spark, rows):
    return spark.createDataFrame([(n,) for n in rows], "name string")


def test_a_misspelling_may_be_more_frequent_than_the_right_spelling(spark):
    """What counts is whether the word's spellings fit the person, at every size."""
    wrong = ["Anna Holasörkvoá", "Holasörkvoá, A.", "Holasörkvoá, Anna", "Anna Holasorkvoa", "A. HOLASÖRKVOÁ"]
    own = [f"{g} Thuranrić" for g in ("Björn", "Astrid", "Karl", "Wei", "P.", "Nadia")]
    reg = people(spark, [(1, "Anna Holasörková"), (2, "Philippa Thurakrić"), (None, "No Id"), (3, None)])
    got = {r["name"]: r["author_id"] for r in names.link(spellings(spark, [*wrong, "Anna Holasörková", *own, None, "", "  "]), reg).collect()}
    assert got == dict.fromkeys([*wrong, "Anna Holasörková"], 1)


def test_short_surnames(spark):
    reg = people(spark, [(1, "Wei Li"), (2, "Xiaoming Ng"), (3, "Mei-Lin Wu"), (4, "Jun O"), (5, "Hannah von Bjoraberg")])
    want = {"Wei Li": 1, "Li, Wei": 1, "W. Li": 1, "Wei LI": 1, "Xiaoming NG": 2, "Ng, X.": 2, "Wu, M.-L.": 3, "Jun O": 4, "vonn Bjoraberg, H.": 5, "Xiaoming Li": None, "N. G. Smith": None}
    got = {r["name"]: r["author_id"] for r in names.link(spellings(spark, want), reg).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_ties_nicknames_and_sizes(spark):
    reg = people(spark, [(1, "Karl Berelund"), (2, "Katja Berelund"), (3, "Quentin Haresford")])
    names_ = ["K. Berelund", "Karl Berelund", "Q. Haresford", "Tino Haresford", "x" * 5000, "Karl " + "Berelund " * 300]
    got = {r["name"][:20]: r["author_id"] for r in names.link(spellings(spark, names_), reg, nicknames={"quentin": ["tino"]}).collect()}
    assert got == {"Karl Berelund": 1, "Q. Haresford": 3, "Tino Haresford": 3}
    assert names.link(spellings(spark, names_), reg.limit(0)).count() == 0


def test_mentions_table(spark):
    df = spark.createDataFrame([(1, ["Cedakkelstra, E.", None, "", "Nobody Else"]), (2, None), (3, ["Cedakkelstra, E."])], "cid bigint, authors array<string>")
    reg = spark.createDataFrame(REGISTER, "author_id bigint, full_name string")
    assert {(r["cid"], r["pos"], r["author_id"]) for r in names.mentions(df, reg).collect()} == {(1, 0, 1), (3, 0, 1)}
    assert names.mentions(df.limit(0), reg).count() == 0


DESC = "id {}, title string, people array<string>, year string, doi string, venue string, pages string"


def test_matching(spark):
    corpus = [
        (1, "Virtual Reality Training for Surgeons: A Study", ["Doe, Jane", "Roe, Max"], "2024", "10.1234/a.1", "Journal of X", "1"),
        (2, "Augmented Maps for Railway Dispatchers in the Field", ["Karl Smith"], "2023", None, None, None),
        (3, "Front Matter", None, None, None, None, None),
        (4, "Augmented Maps for Railway Dispatchers in the Field", ["Ann Other"], "2018", None, None, None),
        (None, "x", None, None, None, None, None),
    ]
    bib = [
        ("a", "VIRTUAL REALITY TRAINING FOR SURGEONS [Demo]", ["J. Doe", "others"], "2025", "", None, "1--9"),
        ("b", "{Virtual} Reality Trainign for Surgeons: A Study", None, None, "https://doi.org/10.1234/A.1", None, None),
        ("c", "Augmented maps for railway dispatchers in the field", ["Smith, K."], "2023", None, None, None),
        ("d", "Augmented maps for railway dispatchers in the field", ["Nobody, N.", "Else, S."], "2011", None, None, None),
        ("e", None, None, None, None, None, None),
        ("f", "Front Matter", ["Jane Doe"], "2024", None, None, None),
    ]
    c, b = spark.createDataFrame(corpus, DESC.format("bigint")), spark.createDataFrame(bib, DESC.format("string"))
    m = linkage.match(c, b)
    assert {(r["c"], r["b"]) for r in linkage.best(m).collect()} == {(1, "a"), (1, "b"), (2, "c")}
    assert all(-1e-9 <= r["confidence"] <= 1 + 1e-9 for r in m.collect())
    assert linkage.match(c.limit(0), b).count() == 0


def test_solver_against_projected_subgradient(spark):
    """Two records of one entry, and a second entry tied to it: the minimum is known."""
    rule = "array(struct(3.0D AS w, {}D AS b, true AS up), struct(0.4D AS w, 0.0D AS b, false AS up))"
    v = spark.sql(f"SELECT 'b1' AS b, 1L AS c, {rule.format(0.9)} AS rules, 0.9D AS support UNION ALL SELECT 'b1', 2L, {rule.format(0.8)}, 0.8D UNION ALL SELECT 'b2', 1L, array(struct(0.1D AS w, 0.0D AS b, false AS up), struct(0.1D AS w, 0.1D AS b, true AS up)), 0.1D")
    ties = spark.sql("SELECT 1L AS c, 'b1' AS b1, 'b2' AS b2, 1.0D AS same, 0.6D AS w")
    x = {(r["b"], r["c"]): r["confidence"] for r in linkage.solve(v, ties, tolerance=1e-4).collect()}
    assert x["b1", 1] + x["b1", 2] <= 1.001

    def cost(a, b, c):
        return 3 * max(0, 0.9 - a) + 0.4 * a + 3 * max(0, 0.8 - b) + 0.4 * b + 0.1 * c + 0.1 * max(0, 0.1 - c) + 0.6 * max(0, a - c)

    grid = [i / 20 for i in range(21)]
    least = min(cost(a, b, c) for a in grid for b in grid for c in grid if a + b <= 1)
    assert cost(x["b1", 1], x["b1", 2], x["b2", 1]) == pytest.approx(least, abs=0.01)
    with pytest.warns(UserWarning, match="residual"):
        y = {(r["b"], r["c"]): r["confidence"] for r in linkage.across(v, ties, turns=12, tolerance=1e-4).collect()}
    numbers = [np.array(k) for k in ([0, 0, 1], [[3, 0.4], [3, 0.4], [0.1, 0.1]], [[0.9, 0], [0.8, 0], [0, 0.1]], [[True, False], [True, False], [False, True]], [0.9, 0.8, 0.1], [0], [2], [1.0], [0.6])]
    z, left = linkage.minimise(*numbers, turns=12, tolerance=1e-4)
    assert left > 1e-4 and [y["b1", 1], y["b1", 2], y["b2", 1]] == pytest.approx(z.tolist(), abs=1e-9)  # the same steps either way


def test_titles():
    t = publications.title
    assert publications.title_likeness(t("Virtual Reality for X"), t("VR for {X}")) > 0.9
    assert publications.title_likeness(t("Alpha: Using a Model to Share"), t("Omega: Using a Model to Share")) < publications.title_likeness(t("Alpha: Using a Model to Share"), t("Alpha: Using a Modle to Share"))
    assert publications.title_likeness([], t("x")) == 0
