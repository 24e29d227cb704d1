"""Lines of pages as hashed token streams, shared by the operators that look at page structure."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash

#: Words, line ends, and the signs that part the links of a menu or a trail.
TOKEN = re.compile(r"\w+|[\n›»>/|·•→]")
SEPARATORS = "›»>/|·•→"
_DIGITS = re.compile(r"\d+")
_U = np.uint64
#: Base of the rolling hash, an odd constant, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
NEWLINE, CUT = 1, 2
SITE = xxhash.xxh64_intdigest("\x00site")
_CACHE_WORDS = 500_000
def word_hash(word: str) -> int:
    """64-bit hash of a lower-case word whose numbers count as one another."""
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", word))


_SIGNS = {"\n": NEWLINE, **dict.fromkeys(SEPARATORS, CUT)}


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
            self.update(_SIGNS)
        value = self[word] = word_hash(word)
        return value


_hashes = _Hashes(_SIGNS)


def site_label(host: str | None) -> str:
    """The word of a host that names the site: the label before the last one."""
    parts = (host or "").split(".")
    return parts[-2] if len(parts) > 1 else parts[0]


@dataclass
class Lines:
    """Token streams of a batch of pages, cut at line ends.

    ``tokens`` holds word hashes with the site's own name masked; line ``i`` has the
    tokens ``start[i]:end[i]`` and belongs to page ``page[i]`` as its line ``number[i]``.
    Separators are no tokens; ``cuts`` has the place in ``tokens`` that each one stands before.
    """

    tokens: np.ndarray
    start: np.ndarray
    end: np.ndarray
    page: np.ndarray
    number: np.ndarray
    prefix: np.ndarray
    back: np.ndarray
    cuts: np.ndarray

    def span_key(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words in ``start:end``; equal word sequences have equal keys wherever they stand."""
        return (self.prefix[end] - self.prefix[start]) * self.back[start]

    def keys(self) -> np.ndarray:
        return self.span_key(self.start, self.end)


def lines_of(texts: list[str], labels: list[str]) -> Lines:
    """All lines of all texts; empty lines keep their number."""
    find = TOKEN.findall
    split = [find((t + "\n").lower()) for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    tokens = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(split)), _U, count=int(sizes.sum()))
    page_of = np.repeat(np.arange(len(texts)), sizes)
    signs = tokens == _U(CUT)
    cuts = np.flatnonzero(signs)
    cuts -= np.arange(len(cuts))
    tokens, page_of = tokens[~signs], page_of[~signs]
    own = np.array([word_hash(x) if x else 0 for x in labels], _U)
    tokens[(tokens == own[page_of]) if len(tokens) else slice(0)] = _U(SITE)
    end = np.flatnonzero(tokens == _U(NEWLINE))
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    page = page_of[end]
    first = np.searchsorted(page, np.arange(len(texts)))
    number = np.arange(len(end)) - first[page] if len(end) else end
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[_U(1), np.full(len(tokens), _U(BASE))], dtype=_U)
        back = np.cumprod(np.r_[_U(1), np.full(len(tokens), _U(BASE_INVERSE))], dtype=_U)
        prefix = np.r_[_U(0), np.cumsum(tokens * powers[:-1], dtype=_U)]
    return Lines(tokens, start, end, page, number, prefix, back, cuts)
