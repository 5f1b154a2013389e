"""Byte-pair encoding in linear time: longest matches, backtracked until all neighbours are compatible.

A byte-level BPE vocabulary lists its tokens by rank. A sequence of tokens is the one the merges produce exactly when
every two neighbours are *compatible*: encoding their joined bytes gives back those two tokens. So a word is encoded
left to right by its longest match; a choice that isn't compatible with the token before is shortened, and if nothing
shorter fits, the token before is undone. A bit for each position that was given up keeps this linear.

Matches come from the trie of an Aho-Corasick automaton, asked only where a token may begin; bytes are mapped to Latin-1 characters, one for one, as the automaton
works on strings. Compatibility of two tokens is memoised.
"""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import ahocorasick
import numpy as np
import regex

#: Fixed value: the splitting pattern published with the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's White_Space, which the pattern's \s means (Python's own \s also has U+001C to U+001F).
WS = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A coarser split whose borders are always borders of PATTERN as well: a run without blanks, with the space before it.
COARSE = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
FINE = regex.compile(PATTERN.replace(r"\s", f"[{WS}]").replace(r"\S", f"[^{WS}]").replace(f"[^[{WS}]", f"[^{WS}"))
MEMO, LONG = 400_000, 48


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The installed vocabulary; LITWEAVE_TOKENIZERS names another folder."""
    if folder := os.environ.get("LITWEAVE_TOKENIZERS"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class Chunks(dict):
    """Ids of pieces of text, encoded when first seen; long pieces are not kept."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(self.encode(chunk))
        if len(chunk) <= LONG:
            self[chunk] = ids
        return ids


class Bpe:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.lengths = {i: len(t) for t, i in self.ranks.items()}
        self.widest = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.ranks.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for t, i in self.ranks.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := self.ranks.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.tokens):
            self._halve(i)
        self.fits.clear()  # answers given while halves were still missing
        self.chunks = Chunks(self._chunk)
        self.words = Chunks(lambda w: self.word(w.encode("utf-8", "replace").decode("latin-1")))

    def _halve(self, i: int) -> None:
        """The two tokens whose merge makes token i: the only compatible pair of lower tokens."""
        t, left = self.tokens[i], self.shorter.get(i)
        while left is not None:
            right = self.ranks.get(t[self.lengths[left] :])
            if right is not None and left < i and right < i and self._fit(left, right):
                self.halves[i] = (left, right)
                self.joined[left, right] = i
                return
            left = self.shorter.get(left)

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between a and b: undo both from the latest merge on, and look whether
        a pair across the border would have been merged before."""
        limit, halves, joined = 1 << 60, self.halves, self.joined
        while True:
            if joined.get((a, b), limit) < limit:
                return False
            if a > b:
                if a in halves:
                    limit, a = a, halves[a][1]
                elif b in halves:
                    limit, b = b + 1, halves[b][0]
                else:
                    return True
            elif b in halves:
                limit, b = b + 1, halves[b][0]
            elif a in halves:
                limit, a = a, halves[a][1]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self._fit(a, b)
        return known

    def _longest(self, s: str, at: int) -> int:
        part = s[at : at + self.widest]
        n = self.automaton.longest_prefix(part)
        while (token := self.ranks.get(part[:n])) is None:
            n -= 1
        return token

    def word(self, s: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 text of its bytes."""
        whole = self.ranks.get(s)
        if whole is not None:
            return [whole]
        n, lengths = len(s), self.lengths
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, self._longest(s, 0)
        while at < n:
            end = at + lengths[token]
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = self._longest(s, at)
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                # the token just undone is tried shorter in the next turn, as its end is given up now
        return out

    def _chunk(self, chunk: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, FINE.findall(chunk))))

    def bounded(self) -> Chunks:
        for memo in (self.chunks, self.words):
            if len(memo) > MEMO:
                memo.clear()
        return self.chunks

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.bounded().__getitem__, COARSE.findall(text))), np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.bounded().__getitem__, COARSE.findall(text)))) if text else 0


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of this Python worker; built once."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
