"""Problem 7: one consistent form for text that looks ordinary but is made of other characters.

Blanks, invisible characters, width, style and composition are settled character by character. Look-alike letters are
settled by token: the scripts a letter may belong to (its own, and those in which it has a look-alike) are intersected
over the token. A token of one script is left, unless every letter of it has a look-alike in the script of the text
around it (a whole-script confusable). A mixed token whose intersection isn't empty is spelled in the script it names.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜЗаеорсухѕіјһԁԛԝѵүгӏ", "ABESIJKMHOPCTYXYGQW3aeopcyxsijhdqwvyrl"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳανογικρυχϲ", "ABEZHIKMNOPTYXCjavoyikpuxc"))
ARMENIAN = dict(zip("ՍՕՏԼօսոհցզՁ", "UOSLounhgqQ"))
CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZbWVSLCPKB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
COPTIC = dict(zip("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲥⲣ", "HIKMNOPCTYXocp"))
#: Latin letters of phonetics that look like plain ones; they are sounds beside others of their kind.
PHONETIC = {"ɑ": "a", "ɡ": "g"}
OTHERS = {"CYRILLIC": CYRILLIC, "GREEK": GREEK, "ARMENIAN": ARMENIAN, "CHEROKEE": CHEROKEE, "LISU": LISU, "COPTIC": COPTIC}
TO_LATIN = {k: v for letters in OTHERS.values() for k, v in letters.items() if v.isalpha()}
BACK = {script: {v: k for k, v in reversed(letters.items()) if v.isalpha()} for script, letters in OTHERS.items()}
SCRIPTS = ("LATIN", *OTHERS)
#: Scripts and signs in which joiners are spelling, not dirt.
JOINING = regex.compile(r"[\p{Arabic}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Mongolian}\p{Extended_Pictographic}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}]")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0x2800}
PLAIN = frozenset(map(chr, (9, 10, 13)))


@lru_cache(maxsize=100_000)
def _kind(c: str) -> tuple[str, str]:
    """What is wrong with a character by itself, and what it becomes."""
    if c.isascii() and (c.isprintable() or c in PLAIN):
        return "", c
    cat, o = unicodedata.category(c), ord(c)
    if cat == "Zs" or o in (0x2028, 0x2029, 0x85):
        return "blank", " "
    if cat in ("Cf", "Cc") or o in FILLERS or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return "invisible", ""
    tag = unicodedata.decomposition(c).partition(">")[0].lstrip("<") if "<" in unicodedata.decomposition(c) else ""
    if tag in ("wide", "narrow"):
        return "width", unicodedata.normalize("NFKC", c)
    if tag == "font" or tag == "compat" and cat[0] == "L" and o != 0xB5:  # the micro sign is a symbol
        return "style", unicodedata.normalize("NFKC", c)
    return "", c


@lru_cache(maxsize=100_000)
def _script(c: str) -> str:
    name = unicodedata.name(c, "").split(" ")[0]
    return name if unicodedata.category(c)[0] == "L" else ""


@lru_cache(maxsize=100_000)
def _scripts(c: str) -> frozenset[str]:
    """Scripts in which a letter can be written so that it looks the same; a letter without a base is taken apart."""
    own = _script(c)
    base, *marks = unicodedata.normalize("NFD", c)
    if own == "LATIN":
        return frozenset([own, *(s for s, m in BACK.items() if base in m and not marks)])
    return frozenset([own, *(["LATIN"] if base in TO_LATIN else [])])


def _spell(c: str, script: str) -> str:
    if _script(c) in ("", script):
        return c
    base, *marks = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", "".join([TO_LATIN.get(base, base) if script == "LATIN" else BACK[script].get(base, base), *marks]))


def _letters(text: str, names: bool) -> tuple[str, bool]:
    changed = False
    if any(c in text for c in PHONETIC):
        plain = WORD.sub(lambda w: w[0].translate(str.maketrans(PHONETIC)) if len(w[0]) > 1 and all(c.isascii() or c in PHONETIC for c in w[0]) and any(c.isascii() for c in w[0]) else w[0], text)
        text, changed = plain, plain != text
    words = list(WORD.finditer(text))
    scripts = [{_script(c) for c in w[0]} - {""} for w in words]
    if all(s == {"LATIN"} for s in scripts):
        return text, changed
    latin = any(s == {"LATIN"} or "LATIN" in s for s in scripts)
    out, at = [], 0
    fits = [frozenset.intersection(*map(_scripts, (c for c in w[0] if _script(c)))) if s else frozenset() for w, s in zip(words, scripts)]
    for i, (w, s, fit) in enumerate(zip(words, scripts, fits)):
        to = None
        if len(s) > 1:
            to = next((x for x in SCRIPTS if x in fit), None)
        elif s and s != {"LATIN"} and latin and "LATIN" in fit and (len(w[0]) > 1 or names):
            near = [scripts[j] == s and "LATIN" not in fits[j] for j in (i - 1, i + 1) if 0 <= j < len(words)]
            to = None if any(near) else "LATIN"
        if to:
            new = "".join(_spell(c, to) for c in w[0])
            changed |= new != w[0]
            out += [text[at : w.start()], new]
            at = w.end()
    return "".join([*out, text[at:]]), changed


def normalize(text: str, names: bool = False) -> tuple[str, frozenset[str]]:
    """The consistent form of a text, and what had to be settled: any of blank, invisible, width, style, composition,
    lookalike. ``names``: single letters of another script are initials, not symbols."""
    if text.isascii() and (text.isprintable() or not any(_kind(c)[0] for c in text)):
        return text, frozenset()
    chars = set(text)
    if not any(_kind(c)[0] for c in chars) and all(c.isascii() or _script(c) in ("", "LATIN") and c not in PHONETIC for c in chars) and unicodedata.is_normalized("NFC", text):
        return text, frozenset()
    kinds, out = set(), []
    for i, c in enumerate(text):
        kind, new = _kind(c)
        if kind == "invisible" and (ord(c) in (0x200C, 0x200D) or 0xFE00 <= ord(c) <= 0xFE0F) and i and JOINING.match(text[i - 1]):
            kind, new = "", c
        elif kind == "width" and (CJK.search(text[max(0, i - 1) : i + 2]) or new == "") and not new.isalnum():
            kind, new = "", c
        if kind:
            kinds.add(kind)
        out.append(new)
    s = "".join(out)
    composed = unicodedata.normalize("NFC", s)
    if composed != s:
        kinds.add("composition")
    composed, changed = _letters(composed, names)
    if changed:
        kinds.add("lookalike")
    return composed, frozenset(kinds)


def normalized(df: DataFrame, key: str = "cid", texts: tuple[str, ...] = ("title",), lists: tuple[str, ...] = ("authors",)) -> DataFrame:
    """(key, field, pos, text, kinds): each non-NULL text in its consistent form, and what was settled in it.

    Lists give a row for each non-NULL element, ``pos`` counting from 0; for a text ``pos`` is 0. ``kinds`` is empty where
    the text was consistent already; an empty text is. Nothing is trimmed: the text is changed only where it must be.
    Repeated rows are repeated, other columns aren't read. Narrow: no shuffle.
    """
    kind = df.schema[key].dataType

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False, name=None):
                for f, v in zip((*texts, *lists), r[1:]):
                    many = f in lists
                    for i, x in enumerate([] if v is None else v if many else [v]):
                        if isinstance(x, str):
                            new, kinds = normalize(x, many)
                            rows.append((r[0], f, i, new, sorted(kinds)))
            yield pd.DataFrame(rows, columns=["key", "field", "pos", "text", "kinds"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("field", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    renamed = T.StructType([T.StructField("key", kind), *schema.fields[1:]])
    return df.select(F.col(key), *texts, *lists).mapInPandas(run, renamed).withColumnRenamed("key", key)


def found(df: DataFrame, key: str = "cid", texts: tuple[str, ...] = ("title",), lists: tuple[str, ...] = ("authors",)) -> DataFrame:
    """(key, field): the fields in which something had to be settled, once each."""
    return normalized(df, key, texts, lists).where(F.size("kinds") > 0).select(key, "field").distinct()
