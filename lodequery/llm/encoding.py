"""Problem 8: token ids of every text by a byte-level BPE vocabulary.

The distinct pieces of a batch are encoded together. Pieces of similar length form a
padded matrix of token ids; each round every row merges its leftmost pair of least
rank, found through a hash table of pairs, and the matrix is compacted: each live row
loses one cell, finished rows leave. Pieces that were encoded before come from a cache.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Where the vocabulary files lie, the one used, and its split pattern.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.tiktoken"
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
_PAD = -1
#: Bytes from which a piece is merged on its own, all pairs of the least rank at once.
LONG_PIECE = 512
#: Pieces a worker remembers; a bound on memory only.
CACHE_PIECES = 400_000
#: Cells of a matrix; longer lists of pieces are cut into several.
MATRIX_CELLS = 2_000_000


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of their union (its rank)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, union: np.ndarray):
        bits = max(4, int(len(union) * 3).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots = self._slot(keys)
        self.probes = 0
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = union[placed]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & int(self.mask)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return (mixed & self.mask).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slots] != -1) & (left != _PAD) & (right != _PAD))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & int(self.mask)
            at = slots[open_]
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return out.reshape(shape)


class ByteBpe:
    """A vocabulary of byte strings with ranks, read from a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.single = np.array([self.ranks.get(bytes([b]), _PAD) for b in range(256)], np.int32)
        triples = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*triples, strict=True)))
        self.split = regex.compile(SPLIT_PATTERN)
        self.cache: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _merge_rows(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields row numbers and their finished matrices (padded on the right)."""
        rows = np.arange(len(tokens))
        ranks = self.pairs.look_up(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            if not tokens.shape[1] - 1:
                yield rows, tokens
                return
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            live = least != _NONE
            if not live.all():
                yield rows[~live], tokens[~live]
                rows, tokens, ranks, at, least = rows[live], tokens[live], ranks[live], at[live], least[live]
                if not len(rows):
                    return
            n, width = tokens.shape
            line = np.arange(n)
            tokens[line, at] = least
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            tokens = tokens[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            for near, ok in ((at - 1, at > 0), (at, at < width - 2)):
                ranks[line[ok], near[ok]] = self.pairs.look_up(tokens[line[ok], near[ok]], tokens[line[ok], near[ok] + 1])

    def _merge_long(self, tokens: np.ndarray) -> np.ndarray:
        """As above for one long piece; equal pairs of least rank are merged in one round, left to right."""
        while len(tokens) > 1:
            ranks = self.pairs.look_up(tokens[:-1], tokens[1:])
            least = ranks.min()
            if least == _NONE:
                break
            at = np.flatnonzero(ranks == least)
            runs = np.flatnonzero(np.r_[True, np.diff(at) != 1])  # overlapping pairs: every second of a run
            place = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
            at = at[place % 2 == 0]
            tokens[at] = least
            tokens = np.delete(tokens, at + 1)
        return tokens

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that aren't in the cache."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        done: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            known = self.ranks.get(b)
            if known is not None:
                done[k] = np.array([known], np.int32)
            elif len(b) > LONG_PIECE:
                done[k] = self._merge_long(self.single[np.frombuffer(b, np.uint8)].copy())
            else:
                width = len(b) if len(b) < 16 else -(-len(b) // 16) * 16
                buckets.setdefault(width, []).append(k)
        for width, members in buckets.items():
            step = max(1, MATRIX_CELLS // width)
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                sizes = np.array([len(raw[k]) for k in part])
                joined = self.single[np.frombuffer(b"".join(raw[k] for k in part), np.uint8)]
                tokens = np.full((len(part), width), _PAD, np.int32)
                tokens[np.arange(width) < sizes[:, None]] = joined
                for rows, ended in self._merge_rows(tokens):
                    for r, line in zip(rows.tolist(), ended, strict=True):
                        done[part[r]] = line[line != _PAD]
        base = len(self.starts) - 1
        self.cache.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        sizes = np.array([len(x) for x in done], np.int64)
        self.ids = np.concatenate([self.ids, *done])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text starts (with the end)."""
        if len(self.cache) > CACHE_PIECES:
            self._reset()
        split = [self.split.findall(t) if t else () for t in texts]
        fresh = set().union(*split).difference(self.cache)
        if fresh:
            self.learn(list(fresh))
        where = self.cache
        piece = np.fromiter((where[p] for pieces in split for p in pieces), np.int64)
        lengths = self.starts[piece + 1] - self.starts[piece]
        per_text = np.r_[0, np.cumsum([len(x) for x in split])]
        ends = np.r_[0, np.cumsum(lengths)]
        source = np.repeat(self.starts[piece] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[source], ends[per_text]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def _runner(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids, starts = bpe.encode_batch(batch.column("text").to_pylist())
            if counts_only:
                value = pa.array(np.diff(starts))
            else:
                value = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), value], ["doc_id", "value"])

    return run


def encode_texts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``doc_id, ids`` of every row of ``docs`` (``doc_id``, ``text``), without special tokens.

    Null and empty texts give an empty list. Other columns are not read.
    """
    run = _runner(os.path.join(folder, vocabulary), counts_only=False)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, value array<int>").withColumnRenamed("value", "ids")


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """``doc_id, tokens``: the number of ids ``encode_texts`` would give."""
    run = _runner(os.path.join(folder, vocabulary), counts_only=True)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, value bigint").withColumnRenamed("value", "tokens")
