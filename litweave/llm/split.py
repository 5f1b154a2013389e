"""Problem 10: cutting long texts into pieces at natural boundaries.

A text is a row of atoms (words with the blank before them, runs of blanks; very long ones are cut further), each with
its number of tokens. Every border between atoms has a strength. For each piece a sparse table of range maxima gives the
strongest border in the permissible window, the rightmost among equals; the next piece begins an overlap earlier.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litweave.llm import bpe

#: Border strengths, weakest first.
IN_WORD, IN_RUN, BEFORE_BREAK, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH, HEADING = range(-1, 8)
ATOM = 24
LINE_SEP, PAR_SEP = chr(0x2028), chr(0x2029)
SENTENCE_END = re.compile("[.!?…。！？][\"')\\]”’»]*$")
CLAUSE_END = re.compile("[,;:–—、，；：][\"')\\]”’»]*$")
HEADS = re.compile(r"#{1,6}$|==+|\\(?:sub)*section|\\chapter|<h[1-6]", re.I)


def atoms(text: str, tokenizer: bpe.Bpe) -> tuple[list[str], list[int], list[int]]:
    """Atoms, their tokens, and for each whether it continues a word (2) or a run (1) of the atom before."""
    parts: list[str] = []
    sizes: list[int] = []
    inner: list[int] = []
    known = tokenizer.bounded()
    for chunk in bpe.COARSE.findall(text):
        n = len(known[chunk])
        if n <= ATOM:
            parts.append(chunk)
            sizes.append(n)
            inner.append(0)
            continue
        kind = 0
        for word in bpe.FINE.findall(chunk):
            ids = tokenizer.words[word]
            if len(ids) <= ATOM:
                parts.append(word)
                sizes.append(len(ids))
                inner.append(kind)
            else:  # cut where a token ends with a character
                raw, at, since, begin = word.encode("utf-8", "replace"), 0, 0, 0
                for k, i in enumerate(ids):
                    at += tokenizer.lengths[i]
                    whole = at == len(raw) or raw[at] & 0xC0 != 0x80
                    if whole and (k + 1 - since >= ATOM or at == len(raw)):
                        parts.append(raw[begin:at].decode("utf-8"))
                        sizes.append(k + 1 - since)
                        inner.append(2 if since else kind)
                        since, begin = k + 1, at
            kind = 1
    return parts, sizes, inner


def strengths(parts: list[str], inner: list[int]) -> np.ndarray:
    """Strength of the border before each atom, and of the end."""
    out = np.zeros(len(parts) + 1, np.int64)
    out[-1] = HEADING
    breaks = 0  # line ends in the run of blanks that ends here
    for k, part in enumerate(parts):
        blank = part.isspace()
        if k:
            before = parts[k - 1]
            if breaks and not blank:
                out[k] = HEADING if HEADS.match(part) else PARAGRAPH if breaks > 1 else LINE
            elif blank or breaks:
                out[k] = BEFORE_BREAK
            elif inner[k] == 2:
                out[k] = IN_WORD
            elif SENTENCE_END.search(before[-4:]):
                out[k] = SENTENCE if inner[k] == 0 or before[-1] > "⿿" else IN_RUN
            elif CLAUSE_END.search(before[-4:]):
                out[k] = CLAUSE if inner[k] == 0 or before[-1] > "⿿" else IN_RUN
            else:
                out[k] = IN_RUN if inner[k] else BLANK
        if blank:
            breaks += part.count("\n") + part.count("\r") - part.count("\r\n") + part.count(LINE_SEP) + 2 * part.count(PAR_SEP)
        else:
            breaks = 0
    return out


class RangeMax:
    """Sparse table: the strongest border of any range in two look-ups, the rightmost among equals."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.n = n
        self.levels = [(values + 1) * n + np.arange(n)]
        while 2 << (len(self.levels) - 1) <= n:
            w, a = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.maximum(a[:-w], a[w:]))

    def best(self, lo: int, hi: int) -> int:
        """Index of the strongest value in lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a = self.levels[k]
        return int(max(a[lo], a[hi - (1 << k) + 1])) % self.n


def cut(text: str | None, tokenizer: bpe.Bpe, limit: int = 1024, overlap: int = 64) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, in characters. Each piece has at most ``limit`` tokens by itself."""
    if not text:
        return [(0, 0, 0)]
    parts, sizes, inner = atoms(text, tokenizer)
    upto = [0, *np.cumsum(sizes).tolist()]
    if upto[-1] <= limit:
        return [(0, len(text), upto[-1])]
    place = [0, *np.cumsum([len(p) for p in parts]).tolist()]
    index, n = RangeMax(strengths(parts, inner)), len(parts)
    pieces, start, last = [], 0, 0  # last: the border where the piece before ended
    while True:
        hi = min(n, bisect_right(upto, upto[start] + limit) - 1)
        while True:
            if hi == n:
                end = n
            else:
                lo = min(max(bisect_left(upto, upto[start] + limit // 2), last + 1, start + 1), hi)
                end = index.best(lo, hi)
            tokens = tokenizer.count(text[place[start] : place[end]])
            if tokens <= limit or end == start + 1:
                break
            hi = end - 1  # blanks at a cut are split otherwise than in the whole text
        pieces.append((place[start], place[end], tokens))
        if end == n:
            return pieces
        back = bisect_left(upto, upto[end] - overlap)
        if back and upto[end] - overlap - upto[back - 1] < upto[back] - (upto[end] - overlap):
            back -= 1
        start, last = max(back, start + 1), end


def split(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, overlap: int = 64, path: str | None = None, with_text: bool = True) -> DataFrame:
    """(key, piece, start, end, n_tokens[, text]): the pieces of each row, numbered from 0, in order.

    ``start`` and ``end`` count characters, so the text is the pieces without what each repeats of the one before.
    A text of at most ``limit`` tokens is one piece; NULL and empty texts give one empty piece (its text is ''). A text
    without blanks is cut between words, a single word of more tokens than fit between characters. Repeated rows give
    repeated pieces, other columns are not read. Narrow: no shuffle, each whole text is cut by one task.
    """
    if not 0 <= overlap < limit // 2 or limit < 4 * ATOM:
        raise ValueError("the overlap must be under half the limit, the limit at least four atoms")
    path = path or bpe.vocabulary_path()

    def run(frames):
        tokenizer = bpe.load(path)
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key].tolist(), pdf["__text"].tolist()):
                for i, (a, b, n) in enumerate(cut(t, tokenizer, limit, overlap)):
                    rows.append((k, i, a, b, n, (t or "")[a:b]) if with_text else (k, i, a, b, n))
            yield pd.DataFrame(rows, columns=names)

    fields = [T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("piece", "start", "end", "n_tokens"))]
    if with_text:
        fields.append(T.StructField("text", T.StringType()))
    names = [f.name for f in fields]
    return df.select(F.col(key), F.col(text).alias("__text")).mapInPandas(run, T.StructType(fields))
