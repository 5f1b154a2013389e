"""Problem 5: linking the spellings of names that people typed to the persons of a register.

A name is a set of tokens, a token a set of letter pairs. All tokens of the mentions are joined with the register's
surnames on their letter pairs by prefix filtering: sorted from the rarest pair on, two sets that share enough share one
of their first few. So a mention meets the persons one of whose tokens it may hold. What is left is verified by soft
weighted token similarity: each token of the register's name is matched with the mention's token that is most like it
(equal, nickname, initial, typing error), and weighs more the fewer register names have it. A mention that contradicts a
token, or fits two persons equally well, is linked with none.

The register may be of any size: both sides are tables, joined by keys.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litweave.llm.lookalike import normalize
from litweave.llm.markup import clean
from litweave.session import cut

#: Letters without a decomposition, and what typists write for letters with marks.
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ħ": "h"})
DIGRAPHS = (("oe", "o"), ("ue", "u"), ("ae", "a"), ("aa", "a"), ("rn", "m"))
PARTICLES = set("von van der den de di da del della la le ter ten du dos das al el bin ibn zu zur af av".split())
TITLES = set("dr prof professor phd md jr sr ii iii iv mr mrs ms dipl ing msc bsc ba ma et eds ed hon rev sir dame".split())
#: Nicknames and the given names they stand for: the default of the parameter ``nicknames``.
NICKNAMES = {
    k: v.split()
    for k, v in {
        "alexander": "alex sasha sandy xander lex alec", "anthony": "tony ant", "benjamin": "ben benny benji", "charles": "charlie chuck chas", "christopher": "chris kit topher",
        "daniel": "dan danny", "deborah": "deb debbie debby", "dmitri": "dima mitya", "edward": "ed ned ted eddie teddy", "ekaterina": "katya kate katja", "elizabeth": "liz beth betty lizzie eliza lisa libby bess",
        "francisco": "paco pancho fran cisco curro", "giuseppe": "pino beppe peppe", "gregory": "greg", "guadalupe": "lupe lupita", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hans hannes jo jan",
        "joseph": "joe joey", "jose": "pepe", "katherine": "kate katie kathy kat kitty", "magdalena": "magda lena", "margaret": "peggy meg maggie marge greta daisy", "matthew": "matt matty", "matthias": "matt matti",
        "michael": "mike mick mickey micky", "nicholas": "nick nico nicky klaus", "oliver": "ollie olly", "patricia": "pat trish tricia patty patsy", "philippa": "pippa pip", "rafael": "rafa", "rebecca": "becky becca beck", "richard": "rick rich dick ricky richie",
        "robert": "rob bob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve steph stevie", "susan": "sue susie suzy", "theodore": "ted theo teddy", "thomas": "tom tommy", "victoria": "tori vicky vicki vic", "william": "bill will billy willy liam", "stavros": "stav",
        "lorenzo": "renzo enzo", "miriam": "mimi miri", "beatriz": "bea", "imogen": "immy", "ingrid": "inga", "hannah": "hanna", "zainab": "zee", "duncan": "dunc", "frederick": "fred freddy", "andrew": "andy drew", "jonathan": "jon jonny", "timothy": "tim", "kenneth": "ken kenny",
    }.items()
}


def shorts(nicknames: dict[str, list[str]]) -> dict[str, set[str]]:
    """The given names each nickname may stand for."""
    out = defaultdict(set)
    for full, nicks in nicknames.items():
        for n in nicks:
            out[n].add(full)
    return dict(out)


SHORT = shorts(NICKNAMES)
#: What a name may hold that markup cleaning would change.
MARKED = re.compile(r"[&<>{}\\\[\]*_~`$#|=\n\r\u2028\u2029]|''|^\s*[-+•>]")


@lru_cache(maxsize=200_000)
def fold(s: str) -> str:
    """Plain lower-case letters; a digit in a word is the letter it looks like."""
    s = "".join(c for c in unicodedata.normalize("NFKD", s.lower().translate(PLAIN)) if not unicodedata.combining(c))
    s = re.sub(r"[^a-z0-9]", "", s)
    if s[:1].isalpha():
        s = re.sub(r"\d+$", "", s) if re.search(r"\D\d{2,}$", s) else s
        s = s.replace("1", "l").replace("0", "o").replace("5", "s")
    return re.sub(r"\d", "", s)


@lru_cache(maxsize=200_000)
def canon(s: str) -> str:
    for a, b in DIGRAPHS:
        s = s.replace(a, b)
    return s


def parse(name: str, together: bool = False) -> dict | None:
    """given and middle tokens and initials, particles, and the words that may be the surname. Two or three capitals
    beside longer words are initials without stops, unless ``together``."""
    text = normalize(clean(name)[0] if MARKED.search(name) else name, True)[0]
    text = re.sub(r"[(\[{<].*?[)\]}>]|[*†‡§¶#]|\S+@\S+|https?://\S+|\d{4}-\d{4}-\S+|(?<=\w)\d{2,}\b|^\W*\d+\W*", " ", text).replace("’", "'").replace("`", "'").replace("´", "'")
    text = re.sub(r"\b(?:et\s+al\.?|and\s+others)\s*$", "", text, flags=re.I)
    head, comma, tail = text.partition(",")
    if comma and {fold(w) for w in re.split(r"[\s.,]+", tail)} - {""} <= TITLES:
        head, comma, tail = head, "", ""  # a degree, not a given name
    loud = not re.search(r"[a-zß-öø-ÿ]", text)

    def words(part: str) -> list[tuple[str, str]]:
        out = []
        for w in re.split(r"[\s.,;/]+", re.sub(r"(?<=\b\w)\.-(?=\w\.)", ". ", part)):
            m = re.match(r"(?i)(al|el|ibn|bin)[-'](?=\w{3})", w) or re.match(r"(von|van|der|den|de|di|da|del|al|el)(?=[A-ZÀ-ÞŁŞČŘĚ])", w)
            if m:
                out.append((m[1].lower(), m[1]))
                w = w[m.end() :]
            f = fold(w)
            if f:
                out.append((f, w))
        return out

    first, second = words(head), words(tail)
    tokens = [(f, w, 0) for f, w in first] + [(f, w, 1 if comma else 0) for f, w in second]
    particles = [f for f, w, _ in tokens if f in PARTICLES]
    tokens = [t for t in tokens if t[0] not in PARTICLES and (t[0] not in TITLES or t[1].isupper() and len(t[0]) == 2 and not loud)]
    parts: list[tuple[str, str, int]] = []
    long = any(len(f) > 3 for f, _, _ in tokens)
    for f, w, side in tokens:
        if not together and long and 1 < len(f) <= 3 and w.isupper() and not loud and f not in SHORT:
            parts += [(c, c, side) for c in f]  # initials without stops
        else:
            parts.append((f, w, side))
    if not parts:
        return None
    return {"tokens": [f for f, _, _ in parts], "sides": [s for _, _, s in parts], "particles": particles, "comma": bool(comma)}


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


@lru_cache(maxsize=500_000)
def alike(a: str, b: str) -> float:
    """Similarity of two words: 1 if they are one but for digraphs, less for each edit, 0 beyond what typing explains."""
    if a == b:
        return 1.0
    if canon(a) == canon(b):
        return 0.99
    short, long = sorted((len(a), len(b)))
    most = 1 if short < 10 else 2
    if short < 4 or min(abs(len(a) - len(b)), abs(len(canon(a)) - len(canon(b)))) > most:
        return 0.0
    d = min(distance(a, b, most), distance(canon(a), canon(b), most))
    return 1 - d / long if d <= most else 0.0


@lru_cache(maxsize=200_000)
def variants(token: str) -> frozenset[str]:
    """What two words that are ``alike`` have one of in common: of short words, the word less a letter; of long ones, in
    which there may be two errors, the same of either end, one of which has one error at most."""
    out = set()
    for f in {token, canon(token)}:
        parts = [("", f)] if len(token) < 9 else [("", f), ("<", f[:5]), (">", f[-5:])]
        out |= {m + x for m, p in parts for x in (p, *(p[:k] + p[k + 1 :] for k in range(len(p))))}
    return frozenset(out)


def readings(name: str) -> list[dict]:
    """The ways a name can be read: one, or two where capitals may be initials or a short surname (``Wei LI``)."""
    p = parse(name)
    if p is None:
        return []
    q = parse(name, True) if re.search(r"\b[A-Z]{2,3}\b", name) else p
    return [p] if q == p or q is None else [p, q]


def person(name: str) -> dict | None:
    """What a register's name consists of: given name, middle ones, surname, particles, parts of a double given name."""
    p = parse(name)
    if p is None:
        return None
    first, t = name.split()[0], p["tokens"]
    parts = [fold(x) for x in first.split("-")] if "-" in first else []
    return {"given": t[0] if len(t) > 1 else "", "middle": t[1:-1], "surname": t[-1], "particles": sorted(set(p["particles"])), "parts": parts}


def given_fits(tokens: list[str], who: dict, is_given: bool, short: dict[str, set[str]]) -> tuple[float, int]:
    """How well the leading tokens say the given name, and how many of them do. ``is_given``: the first of them is a
    given name of the register, so no misspelling of another."""
    t, full, parts = tokens[0], who["given"], who["parts"]
    if len(parts) and len(tokens) > 1 and all(alike(x, y) > 0.7 or x == y[:1] for x, y in zip(tokens, parts)) and len(tokens) >= len(parts):
        return (1.0 if tokens[0] != parts[0][:1] else 0.75), len(parts)
    if t == full:
        return 1.0, 1
    if len(t) == 1:
        return (0.7, 1) if full.startswith(t) else (0.0, 1)
    if full in short.get(t, ()):
        return 0.95, 1
    if len(parts) and t == parts[0]:
        return 0.9, 1
    if is_given:
        return 0.0, 1
    s = alike(t, full)
    if s:
        return 0.93 * s, 1
    return (0.8, 1) if len(t) >= 3 and full.startswith(t) else (0.0, 1)


def score(tokens: list[str], said: set[str], at: int, sim: float, who: dict, ws: float, wg: float, is_given: bool, short: dict[str, set[str]]) -> float:
    """Soft weighted similarity of a mention, with the particles ``said``, whose token ``at`` is taken as the surname of
    ``who``; 0 if they contradict each other. ``ws`` and ``wg`` are the weights of the person's surname and given name."""
    particles = set(who["particles"])
    if particles and at and not particles & said and len(tokens) > 2 and len(tokens[at - 1]) > 1 and any(distance(tokens[at - 1], x, 1) <= 1 for x in particles):
        tokens, at, said = tokens[: at - 1] + tokens[at:], at - 1, said | particles  # a mistyped particle before the surname
    rest = [t for k, t in enumerate(tokens) if k != at]
    if not who["given"]:
        return sim if not rest else 0.0
    if not rest:
        return 0.0
    g, used = given_fits(rest, who, is_given, short)
    if not g:
        return 0.0
    middle, got = who["middle"], particles & said
    odd = [t for t in rest[used:] if not any(t == m or t[0] == m[0] and 1 in (len(t), len(m)) or alike(t, m) for m in middle)]
    if len(odd) == 1 and any(distance(odd[0], x, 1) <= 1 for x in particles):
        odd, got = [], particles  # a mistyped particle elsewhere
    if odd or said - particles and not got and not any(distance(x, y, 1) <= 1 for x in said for y in particles):
        return 0.0
    total, have = ws + wg, ws * sim + wg * g
    for k in range(len(middle)):  # a middle name left out says little, one that agrees a lot
        total += 0.25 * wg
        have += 0.25 * wg if len(rest) > used + k else 0.075 * wg
    return (have + 0.5 * len(got)) / (total + 0.5 * len(particles))


def edits(token: str) -> int:
    """Typing errors that a word may hold."""
    return 1 if len(token) < 10 else 2


def grams(token: str) -> list[str]:
    """Letter pairs with the borders marked, each once."""
    s = f"^{token}$"
    return sorted({s[k : k + 2] for k in range(len(s) - 1)})


def token_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(t, u): tokens of ``left`` (t) and of ``right`` (u) whose sets of letter pairs differ by no more than the typing
    errors in them can change; all that ``alike`` accepts are among them.

    An error changes at most three pairs of a set (a swap of neighbours does). So of its rarest 3 * errors + 1 pairs
    each set shares one with the other, and those are joined; then sizes and sketches, then the sets are compared. Words
    with letters written in two ways (oe, ue, ...) take part in both. The order of the pairs is by their counts over
    both sides; there are at most 28 x 28, the one thing that comes to the driver.
    """

    def cut_up(frames):
        for pdf in frames:
            yield pd.DataFrame({"g": [g for w in pdf["w"] for f in {w, canon(w)} for g in grams(f)]}, columns=["g"])

    def prefixes(frames):
        for pdf in frames:
            rows = []
            for w in pdf["w"]:
                for f in sorted({w, canon(w)}):
                    gs = sorted(grams(f), key=lambda g: (counts.get(g, 0), g))
                    bits = 0
                    for g in gs:
                        bits |= 1 << (place[g] & 63)
                    rows += [(w, g, k, edits(w), bits - (1 << 64) if bits >> 63 else bits, gs) for k, g in enumerate(gs[: 3 * edits(w) + 1])]
            yield pd.DataFrame(rows, columns=["w", "g", "at", "e", "bits", "gs"])

    l, r = left.select(F.col("t").alias("w")).distinct(), right.select(F.col("u").alias("w")).distinct()
    counts = {x["g"]: x["n"] for x in l.union(r).mapInPandas(cut_up, "g string").groupBy("g").agg(F.count("*").alias("n")).collect()}
    place = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    side = lambda df, name, p: df.mapInPandas(prefixes, "w string, g string, at int, e int, bits long, gs array<string>").select(F.col("w").alias(name), "g", *(F.col(c).alias(c + p) for c in ("at", "e", "bits", "gs")))
    x, y = cut(side(l, "t", "x")), cut(side(r, "u", "y"))
    # pairs of letters that many words begin their lists with are dealt to several tasks
    hot = x.groupBy("g").agg(F.count("*").alias("p")).join(y.groupBy("g").agg(F.count("*").alias("q")), "g")
    hot = hot.select("g", F.ceil(F.col("p") * F.col("q") / 50_000).cast("int").alias("parts"))
    x = x.join(hot, "g").withColumn("part", F.pmod(F.xxhash64("t"), "parts").cast("int")).drop("parts")
    y = y.join(hot, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    n = 4 * left.sparkSession.sparkContext.defaultParallelism
    j = x.repartition(n, "g", "part").join(y.repartition(n, "g", "part"), ["g", "part"])
    a, b, least = F.size("gsx"), F.size("gsy"), 3 * F.least("ex", "ey")
    j = j.where((F.abs(a - b) <= least) & (F.bit_count(F.col("bitsx").bitwiseXOR(F.col("bitsy"))) <= 2 * least))
    both = F.size(F.array_intersect("gsx", "gsy"))
    return j.where(both >= F.greatest(a, b) - least).select("t", "u").distinct()


def link(mentions: DataFrame, register: DataFrame, name: str = "name", least: float = 0.72, margin: float = 0.01, nicknames: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, author_id, full_name, score): the register's person each distinct spelling denotes, if there is exactly one.

    ``register`` has author_id and full_name; rows with a NULL are no persons. ``nicknames`` maps given names to their
    nicknames, a parameter table sent to every task. NULL and blank names, names without a known surname and those two
    persons fit equally well give no row. Spellings are linked once, however often they occur.

    A word that is like a surname is its misspelling only if at least half of the spellings that have the word fit a
    person of that surname: otherwise it is a surname of its own. How often anything occurs doesn't matter.
    """
    short = SHORT if nicknames is None else shorts(nicknames)
    kind = register.schema["author_id"].dataType.simpleString()

    def read(frames):
        for pdf in frames:
            rows = [(n, p["tokens"], p["sides"], p["particles"], p["comma"]) for n in pdf["name"] for p in readings(n)]
            yield pd.DataFrame(rows, columns=["name", "tokens", "sides", "said", "comma"])

    def enroll(frames):
        for pdf in frames:
            rows = [(i, n, *p.values()) for i, n in zip(pdf["author_id"], pdf["full_name"]) if (p := person(n))]
            yield pd.DataFrame(rows, columns=["author_id", "full_name", "given", "middle", "surname", "particles", "parts"])

    known = cut(register.select("author_id", "full_name").where("author_id IS NOT NULL AND full_name IS NOT NULL").mapInPandas(enroll, f"author_id {kind}, full_name string, given string, middle array<string>, surname string, particles array<string>, parts array<string>"))
    df = known.select(F.explode(F.array_distinct(F.concat(F.array("given", "surname"), "middle"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    weight = df.select("w", F.log(1 + known.count() / F.col("n")).alias("x"))
    people = known.join(weight.select(F.col("w").alias("surname"), F.col("x").alias("ws")), "surname").join(weight.select(F.col("w").alias("given"), F.col("x").alias("wg")), "given")
    names = cut(mentions.select(F.col(name).alias("name")).where(F.col("name").isNotNull()).distinct().mapInPandas(read, "name string, tokens array<string>, sides array<int>, said array<string>, comma boolean"))
    words = names.select("name", F.explode("tokens").alias("t"))
    pairs = token_join(words.select("t"), known.select(F.col("surname").alias("u")))

    def verify(frames):
        for pdf in frames:
            out = [(t, u, alike(t, u)) for t, u in zip(pdf["t"], pdf["u"])]
            yield pd.DataFrame([x for x in out if x[2] > 0], columns=["t", "u", "sim"])

    near = cut(pairs.mapInPandas(verify, "t string, u string, sim double"))
    each = names.select("*", F.posexplode("tokens").alias("at", "t")).join(near, "t").where("NOT comma OR sides[at] = 0 OR sim = 1")
    lead = each.withColumn("lead", F.coalesce(F.get("tokens", F.when(F.col("at") == 0, 1).otherwise(0)), F.lit("")))
    given = known.select(F.col("given").alias("lead")).distinct().withColumn("is_given", F.lit(True))
    meet = lead.join(given, "lead", "left").join(people.withColumnRenamed("surname", "u"), "u")

    def rate(frames):
        cols = ["name", "t", "u", "author_id", "full_name", "sim", "tokens", "said", "at", "ws", "wg", "is_given", "given", "middle", "particles", "parts"]
        for pdf in frames:
            rows = []
            for n, t, u, i, f, sim, tokens, said, at, ws, wg, g, *who in pdf[cols].itertuples(index=False, name=None):
                x = score(list(tokens), set(said), at, sim, dict(zip(("given", "middle", "particles", "parts"), who)), ws, wg, g is True, short)
                if x >= least:
                    rows.append((n, t, u, i, f, sim, x))
            yield pd.DataFrame(rows, columns=["name", "t", "u", "author_id", "full_name", "sim", "score"])

    fits = cut(meet.mapInPandas(rate, f"name string, t string, u string, author_id {kind}, full_name string, sim double, score double"))
    # a word of its own, or a misspelling?
    mine = near.where("sim < 0.985")
    have = words.join(mine.select("t").distinct(), "t", "left_semi").distinct().groupBy("t").agg(F.count("*").alias("n"))
    fit = fits.where("sim < 0.985").select("t", "u", "name").distinct().groupBy("t", "u").agg(F.count("*").alias("k"))
    wrong = mine.join(have, "t").join(fit, ["t", "u"]).where("2 * k < n").select("t", "u")
    fits = fits.join(wrong, ["t", "u"], "left_anti").groupBy("name", "author_id", "full_name").agg(F.max("score").alias("score"))
    w = W.partitionBy("name").orderBy(F.desc("score"), "author_id")
    two = fits.withColumn("place", F.row_number().over(w)).where("place <= 2")
    best = two.groupBy("name").agg(F.max_by(F.struct("author_id", "full_name", "score"), -F.col("place")).alias("s"), F.min("score").alias("next"), F.count("*").alias("n"))
    return best.where((F.col("n") == 1) | (F.col("s.score") - F.col("next") > margin)).select("name", "s.*")


def mentions(df: DataFrame, register: DataFrame, key: str = "cid", names: str = "authors", **how) -> DataFrame:
    """(key, pos, name, author_id, full_name, score): each element of the list that denotes a person of the register,
    spelled as in the register or not. NULL lists and elements give no row; ``pos`` counts from 0. Other parameters as
    in ``link``."""
    each = df.select(F.col(key), F.posexplode(names).alias("pos", "name")).where("name IS NOT NULL")
    return each.join(link(each, register, **how), "name").select(key, "pos", "name", "author_id", "full_name", "score")
