"""Problem 6: text that was decoded with the wrong character encoding.

The corpus gives every adjacent pair of characters its share of the mutual information
between neighbours; pairs that carry next to nothing are improbable. A field's runs of
improbable pairs are its maximum-scoring segments. Only the stretches of non-ASCII
characters that such a run touches are tested: each is written back with the encoding it
may have been read with and read with the one it may have been in; a mapping is accepted
if the pairs it gives are much more usual than those it replaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.session import cut_lineage

PAIR_SCHEMA = "pair bigint, n bigint"
FOUND_SCHEMA = "doc_id bigint, field string, original string, runs int, recovered boolean"

#: Information, in bits for each character of the corpus, below which a pair is improbable.
USUAL = 1e-4
#: Bounds of a pair's score, the cost of an ordinary pair in a segment, and least segment score.
SCORE_BOUND, PLAIN_COST, LEAST_SEGMENT = 6.0, 1.0, 2.0
#: Score that undoing a multi-byte reading must gain for each stretch; it seldom fits by chance.
LEAST_WIDE = 1.5
#: Score that another table must gain over all places of a stretch, and over the field.
LEAST_EACH, LEAST_GAIN = 5.0, 14.0
#: The same between two Cyrillic tables, which turn any word into letters.
LEAST_CYRILLIC = 30.0
#: Share of all pairs below which a pair is no better than an unknown one: even with 40 bits of mutual
#: information its score stays at the lower bound. Bounds the table to 1 / LEAST_SHARE pairs and one more a character.
LEAST_SHARE = USUAL * 2.0**-SCORE_BOUND / 40

# How text may have been read (left) although it was in (right).
MAPPINGS = [
    *[(read, "utf-8") for read in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp850", "cp437", "koi8_r", "cp866", "iso8859_15", "iso8859_2", "cp1254")],
    *[(read, "cp1252") for read in ("cp850", "mac_roman", "cp437", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_2", "cp1253", "cp1254")],
    *[(read, "cp1251") for read in ("cp1252", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "mac_roman", "cp1250")],
    *[(read, "koi8_r") for read in ("cp1251", "cp1252", "cp866")],
    *[(read, "cp866") for read in ("cp1251", "cp1252", "koi8_r")],
    *[(read, "mac_roman") for read in ("cp1252", "cp850")],
    *[(read, "cp850") for read in ("cp1252", "mac_roman")],
    *[(read, "iso8859_5") for read in ("cp1252", "cp1251")],
]

#: Two wrong readings one after the other: the outer and the inner encoding.
TWICE = [(outer, inner) for outer in ("cp1252", "latin-1", "cp1250") for inner in ("cp1252", "latin-1", "cp1250")]

#: Score at or below which a pair is as good as unknown, and how many such pairs make a field worth testing
#: for another table where nothing in it looks like a multi-byte reading.
DEEP, LEAST_DEEP = -3.5, 2

_WIDE = [k for k, (_, was) in enumerate(MAPPINGS) if was == "utf-8"]
_STRETCH = re.compile(r"[^\x00-\x7f]+")
_PAIRS = re.compile(r"[^\x00-\x7f]{2,}")
_OPEN, _CLOSE = "“„«\"'‘‚`»”", "”“»\"'’`«"
_SPACES = " \u00a0\u202f"
_LOST = "�"
_WINDOWS_KEPT = 50_000


@lru_cache(maxsize=64)
def _to_byte(codec: str) -> dict[str, int]:
    """Characters of a single-byte encoding; control codes stand for bytes it leaves open."""
    table = {chr(b): b for b in range(0x80, 0xA0)}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    return table


@lru_cache(maxsize=64)
def _from_byte(codec: str) -> list[str | None]:
    out: list[str | None] = [chr(b) for b in range(0x80)]
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(None)
    return out


def remap(stretch: str, read: str, was: str) -> str | None:
    """``stretch`` as it would have been, decoded rightly; None if it can't have come about this way."""
    table = _to_byte(read)
    if was != "utf-8":
        back = _from_byte(was)
        codes = [table.get(c) for c in stretch]
        if None in codes:
            return None
        chars = [back[b] for b in codes]
        return None if None in chars else "".join(chars)
    out, i, changed = [], 0, False
    codes = [table.get(c) for c in stretch]
    while i < len(codes):
        lead = codes[i]
        need = 0 if lead is None else 1 if 0xC2 <= lead < 0xE0 else 2 if 0xE0 <= lead < 0xF0 else 3 if 0xF0 <= lead < 0xF5 else 0
        tail = codes[i + 1 : i + 1 + need]
        if need and len(tail) == need and None not in tail:
            try:
                out.append(bytes([lead, *tail]).decode("utf-8"))
                i += 1 + need
                changed = True
                continue
            except UnicodeDecodeError:
                pass
        out.append(stretch[i])
        i += 1
    return "".join(out) if changed else None


def _even(text: str) -> str:
    """Lower case, no-break spaces as spaces: what pairs are counted over."""
    return text.lower().replace("\u00a0", " ")


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent pairs of characters (lower case) as ``first << 32 | second``, with their counts."""
    codes = np.frombuffer(_even("\n".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = codes[:-1], codes[1:]
    plain = (a < 128) & (b < 128)
    table = np.bincount(a[plain] * 128 + b[plain], minlength=128 * 128)
    ascii_ = np.flatnonzero(table)
    other, n = np.unique((a[~plain] << 32) | b[~plain], return_counts=True)
    return np.r_[((ascii_ // 128) << 32) | (ascii_ % 128), other], np.r_[table[ascii_], n]


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x for name in ("title", "content_text") for x in batch.column(name).to_pylist() if x]
        pairs, n = pair_counts(texts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])


@lru_cache(maxsize=10_000)
def _is_sign(code: int) -> bool:
    return unicodedata.category(chr(code)) in ("Sc", "Sk", "Sm", "So", "No", "Cc", "Cf")


class PairScores:
    """Scores of adjacent characters: positive where their share of the mutual information is usual."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        order = np.argsort(pairs)
        self.pairs, n = pairs[order], n[order].astype(float)
        total = max(n.sum(), 1.0)
        first, second = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        _, fi = np.unique(first, return_inverse=True)
        _, si = np.unique(second, return_inverse=True)
        expected = np.bincount(fi, n)[fi] * np.bincount(si, n)[si] / total
        information = n / total * np.maximum(np.log2(n / expected), 0.5)
        self.values = np.clip(np.log2(information / USUAL), -SCORE_BOUND, SCORE_BOUND)
        # Signs and control codes next to other characters outside ASCII are damage however often they occur.
        odd = np.flatnonzero((first > 127) & (second > 127))
        signs = [_is_sign(a) or _is_sign(b) for a, b in zip(first[odd].tolist(), second[odd].tolist(), strict=True)]
        self.values[odd[signs]] = np.minimum(self.values[odd[signs]], -2.0)
        self.seen: dict[tuple[str, ...], float] = {}  # gains and least scores of short windows, which recur

    @cached_property
    def by_pair(self) -> dict[str, float]:
        return {chr(p >> 32) + chr(p & 0xFFFFFFFF): v for p, v in zip(self.pairs.tolist(), self.values.tolist(), strict=True)}

    def each(self, text: str) -> list[float]:
        """Scores of the pairs of a few characters."""
        low, get = _even(text), self.by_pair.get
        return [get(low[i : i + 2], -SCORE_BOUND) for i in range(len(low) - 1)]

    def least(self, text: str) -> float:
        value = self.seen.get((text,))
        if value is None:
            if len(self.seen) > _WINDOWS_KEPT:
                self.seen.clear()
            value = self.seen[(text,)] = min(self.each(text), default=0.0)
        return value

    def of_codes(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) < 2 or not len(self.pairs):
            return np.zeros(max(len(codes) - 1, 0))
        asked = (codes[:-1] << 32) | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.values[at], -SCORE_BOUND)


def improbable_runs(text: str, scores: PairScores) -> list[tuple[int, int]]:
    """Maximum-scoring segments (as spans of characters) of the improbability of neighbours."""
    codes = np.frombuffer(_even(text)[: len(text)].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    value = -scores.of_codes(codes)
    plain = (codes[:-1] < 128) & (codes[1:] < 128)
    value[plain] = -PLAIN_COST
    mixed = np.flatnonzero(~plain)
    hot = value[mixed] > 0
    if not hot.any():
        return []
    # Plain pairs cost their sum; after more than 64 of them all candidates are settled.
    part = np.r_[0, np.cumsum(np.diff(mixed) > 64)][hot].tolist()
    sums = np.cumsum(value)
    at = mixed[hot]
    runs = []
    # Candidates sorted by start, each with the cumulative score before it and at its end.
    stack: list[tuple[float, float, int, int]] = []
    before = part[0]
    for i, k, above, v in zip(at.tolist(), part, sums[at].tolist(), value[at].tolist(), strict=True):
        if k != before:
            runs += [(s[2], s[3]) for s in stack if s[1] - s[0] >= LEAST_SEGMENT]
            stack, before = [], k
        fresh = (above - v, above, i, i + 2)
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= fresh[0]:
                j -= 1
            if j < 0 or stack[j][1] >= fresh[1]:
                stack.append(fresh)
                break
            fresh = (stack[j][0], fresh[1], stack[j][2], fresh[3])
            del stack[j:]
    return runs + [(s[2], s[3]) for s in stack if s[1] - s[0] >= LEAST_SEGMENT]


def _quoted(text: str, lo: int, hi: int) -> bool:
    """A sample: nothing but this stretch, and spaces, stands between quotation marks."""
    while lo < hi and text[lo] in _OPEN and hi - lo > 1 and text[hi - 1] in _CLOSE:
        lo, hi = lo + 1, hi - 1
    while lo > 0 and text[lo - 1] in _SPACES:
        lo -= 1
    while hi < len(text) and text[hi] in _SPACES:
        hi += 1
    return 0 < lo and hi < len(text) and text[lo - 1] in _OPEN and text[hi] in _CLOSE


def _trim_quotes(text: str, lo: int, hi: int) -> tuple[int, int]:
    if hi - lo > 2 and text[lo] in _OPEN and text[hi - 1] in _CLOSE:
        lo, hi = lo + 1, hi - 1
        while hi - lo > 1 and text[lo] in _SPACES:
            lo += 1
        while hi - lo > 1 and text[hi - 1] in _SPACES:
            hi -= 1
    return lo, hi


def _local(text: str, lo: int, hi: int, put: str, scores: PairScores) -> float:
    """Gain in score of the pairs in and around ``text[lo:hi]`` if it were ``put``."""
    before, after = text[max(lo - 1, 0) : lo], text[hi : hi + 1]
    key = (before, text[lo:hi], after, put)
    gain = scores.seen.get(key)
    if gain is not None:
        return gain
    gain = sum(scores.each(before + put + after)) - sum(scores.each(before + text[lo:hi] + after))
    if before.islower() and put[:1].isupper():
        gain -= SCORE_BOUND
    if len(scores.seen) > _WINDOWS_KEPT:
        scores.seen.clear()
    scores.seen[key] = gain
    return gain


@lru_cache(maxsize=20_000)
def _readings(stretch: str) -> tuple[tuple[int, str], ...]:
    """The mappings that can have given ``stretch``, with what they would have been given."""
    found = []
    for k, (read, was) in enumerate(MAPPINGS):
        if was == "utf-8" and len(stretch) < 2:
            continue
        put = remap(stretch, read, was)
        if put is not None and put != stretch and (was == "utf-8" or "\u00a0" not in put):
            found.append((k, put))
    for k, (outer, inner) in enumerate(TWICE, len(MAPPINGS)):
        once = remap(stretch, outer, "utf-8") if len(stretch) > 2 else None
        put = once and remap(once, inner, "utf-8")
        if put:
            found.append((k, put))
    return tuple(found)


@lru_cache(maxsize=50_000)
def _maybe_wide(stretch: str) -> bool:
    """True if some table turns the stretch into bytes that hold a multi-byte UTF-8 character."""
    return any(remap(stretch, MAPPINGS[k][0], "utf-8") is not None for k in _WIDE)


_CYRILLIC = {"cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5"}


def _least_gain(k: int) -> float:
    if _is_wide(k):
        return LEAST_WIDE
    return LEAST_CYRILLIC if set(MAPPINGS[k]) <= _CYRILLIC else LEAST_GAIN


def _is_wide(k: int) -> bool:
    return k >= len(MAPPINGS) or MAPPINGS[k][1] == "utf-8"


def _stretches(text: str, runs: list[tuple[int, int]]) -> tuple[dict[str, list[tuple[int, int]]], set[str]]:
    """Places of every non-ASCII stretch that isn't a quoted sample, and those that a run touches."""
    found: list[tuple[int, int, int, int, str]] = []
    touched: set[str] = set()
    k = 0
    for m in _STRETCH.finditer(text):
        start, end = m.span()
        while k < len(runs) and runs[k][1] <= start:
            k += 1
        lo, hi = _trim_quotes(text, start, end) if end - start > 2 else (start, end)
        found.append((start, end, lo, hi, text[lo:hi]))
        if k < len(runs) and runs[k][0] < end and not (_quoted(text, start, end) or _quoted(text, lo, hi)):
            touched.add(text[lo:hi])
    places: dict[str, list[tuple[int, int]]] = {}
    for start, end, lo, hi, piece in found:
        if piece in touched and not (_quoted(text, start, end) or _quoted(text, lo, hi)):
            places.setdefault(piece, []).append((lo, hi))
    return places, touched


def repair(text: str, scores: PairScores, deep: bool = True) -> tuple[str, int, bool]:
    """``(text, damaged stretches, all recovered)``: the text with every accepted mapping undone."""
    damaged, lost = 0, False
    if _LOST in text:
        marks = [m for m in re.finditer(f"{_LOST}+", text) if not _quoted(text, *m.span())]
        damaged += len(marks)
        lost = bool(marks)
    while True:  # every round gains score, which the text bounds
        runs = improbable_runs(text, scores)
        if not runs:
            break
        places, touched = _stretches(text, runs)
        total: dict[int, float] = {}
        changes: dict[int, list[tuple[int, int, str]]] = {}
        for piece in touched:
            at = places[piece]
            odd = deep and any(scores.least(text[max(lo - 1, 0) : hi + 1]) <= DEEP for lo, hi in at)
            for k, put in _readings(piece):
                if _is_wide(k):
                    gains = [_local(text, lo, hi, put, scores) for lo, hi in at]
                    good = [g > LEAST_WIDE for g in gains]
                    taken = [(lo, hi, put) for (lo, hi), ok in zip(at, good, strict=True) if ok]
                    gain = sum(g for g, ok in zip(gains, good, strict=True) if ok)
                elif odd:  # a character may be right in one place and wrong in another, but not in the same way
                    gain = sum(_local(text, lo, hi, put, scores) for lo, hi in at)
                    taken = [(lo, hi, put) for lo, hi in at] if gain > LEAST_EACH * len(at) else []
                else:
                    continue
                if taken:
                    total[k] = total.get(k, 0.0) + gain
                    changes.setdefault(k, []).extend(taken)
        for k in [k for k, taken in changes.items() if not _is_wide(k)]:
            pieces = {text[lo:hi] for lo, hi, _ in changes[k]}
            apart = not any(text[max(lo - 1, 0) : lo].isalpha() or text[hi : hi + 1].isalpha() for lo, hi, _ in changes[k])
            if apart and len(pieces) == 1 and unicodedata.category(next(iter(pieces))[0]) in ("No", "Sc", "So"):
                del total[k]  # a lone sign such as a fraction is no evidence of another table
        ranked = [(gain, k) for k, gain in total.items() if gain > _least_gain(k)]
        if not ranked:
            break
        _, k = max(ranked)
        damaged = max(damaged, len(changes[k]))
        for lo, hi, put in sorted(changes[k], reverse=True):
            text = text[:lo] + put + text[hi:]
    return text, damaged, not lost


def suspicious(texts: list[str | None], scores: PairScores) -> list[tuple[int, bool]]:
    """Numbers of the texts worth testing; True where several pairs are next to unknown."""
    some = [i for i, t in enumerate(texts) if t and not t.isascii()]
    if not some or not len(scores.pairs):
        return []
    joined = [_even(texts[i]) for i in some]
    ends = np.cumsum([len(t) for t in joined])
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    mixed = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
    asked = (codes[mixed] << 32) | codes[mixed + 1]
    at = np.minimum(np.searchsorted(scores.pairs, asked), len(scores.pairs) - 1)
    value = np.where(scores.pairs[at] == asked, scores.values[at], -SCORE_BOUND)
    unknown = np.searchsorted(ends, mixed[value <= DEEP], side="right")
    deep = np.bincount(unknown[unknown < len(some)], minlength=len(some)) >= LEAST_DEEP
    out = []
    for i, d in zip(some, deep.tolist(), strict=True):
        text = texts[i]
        if d or _LOST in text or any(_maybe_wide(s) for s in set(_PAIRS.findall(text))):
            out.append((i, d))
    return out


def corpus_pairs(docs: DataFrame) -> DataFrame:
    """``pair, n``: all adjacent pairs of characters of the corpus with their counts. Counts of several batches add up."""
    counted = docs.select("title", "content_text").mapInArrow(_count_pairs, PAIR_SCHEMA)
    return counted.groupBy("pair").agg(F.sum("n").alias("n"))


def merged_pairs(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can matter with their counts: at most ``1 / LEAST_SHARE`` of them, in order of the pair, whatever the corpus.

    A pair of a smaller share of all pairs scores as an unknown one; its count goes to a pair
    of its own first character with nothing, so that the characters' totals stay right.
    """
    counted = cut_lineage(counted)
    total = counted.agg(F.sum("n")).first()[0] or 0
    usual = F.col("n") >= total * LEAST_SHARE
    rest = counted.where(~usual).groupBy(F.shiftleft(F.shiftright("pair", 32), 32).alias("pair")).agg(F.sum("n").alias("n"))
    table = counted.where(usual).unionByName(rest).groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    return table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64)


class Repairer:
    """Repairs the texts of a batch; made once in each worker from shared pair counts."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        self.scores = PairScores(pairs, n)

    def __call__(self, texts: list[str | None]) -> list[str | None]:
        """The texts with wrongly decoded stretches restored; line ends stay where they are."""
        out = list(texts)
        for i, deep in suspicious(texts, self.scores):
            text, runs, _ = repair(texts[i], self.scores, deep)
            if runs and text.count("\n") == texts[i].count("\n"):
                out[i] = text
        return out


def _repair_batches(shared):
    made: list[PairScores] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(PairScores(*shared.value))
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            rows = []
            for field in ("title", "content_text"):
                texts = batch.column(field).to_pylist()
                for i, deep in suspicious(texts, made[0]):
                    text, runs, whole = repair(texts[i], made[0], deep)
                    if runs:
                        rows.append((docs[i], field, text, runs, whole))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "field", "original", "runs", "recovered"]
            )

    return run


def garbled_fields(docs: DataFrame) -> DataFrame:
    """``doc_id, field, original, runs, recovered`` of every ``title`` and ``content_text`` with wrongly decoded text.

    ``original`` has every recoverable stretch restored; ``recovered`` is false where
    replacement characters stand for lost ones. Stretches that stand alone between
    quotation marks are samples, not damage. Null and empty fields are never cases.
    """
    shared = docs.sparkSession.sparkContext.broadcast(merged_pairs(corpus_pairs(docs)))
    asked = docs.select("doc_id", "title", "content_text").where("doc_id IS NOT NULL")
    return asked.mapInArrow(_repair_batches(shared), FOUND_SCHEMA)
