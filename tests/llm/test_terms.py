import math

import numpy as np
from lodequery.llm import distinctive, frequencies, packing
from lodequery.llm.vocabulary import term_groups

POSTINGS = "term_id long, doc_id long, tf int, positions array<int>, source string, extra int"
TERMS = "term_id long, term string, doc_freq int, surface_form string"


def _tables(spark):
    terms = [(1, "index", 0, None), (2, "Index", 9, None), (3, "page", 1, "x"), (4, "ｐａｇｅ", 1, None), (5, None, 1, None), (6, "--", 1, None), (7, "café", 1, None), (8, "own", 1, None)]
    rows = [(1, 1, 2, [0, 4], None, 1), (1, 1, 2, [0, 4], None, 1), (2, 1, 1, [6], "h", 1), (3, 1, 1, [1], None, 1), (3, 2, 1, [0], None, 1), (4, 2, 1, [3], None, 1),
            (7, 3, 1, None, None, 1), (5, 1, 3, [7, 8, 9], None, 1), (99, 1, 1, [20], None, 1), (1, None, 1, [1], None, 1), (8, 3, 9, list(range(9)), None, 1), (3, 4, 1, [0], None, 1)]
    return spark.createDataFrame(rows, POSTINGS), spark.createDataFrame(terms, TERMS)


def test_groups(spark):
    groups = {r.term_id: (r.gid, r.term) for r in term_groups(_tables(spark)[1]).collect()}
    assert groups == {1: (1, "index"), 2: (1, "index"), 3: (3, "page"), 4: (3, "page"), 7: (7, "cafe"), 8: (8, "own")}


def test_distinctive_terms(spark):
    postings, terms = _tables(spark)
    scored = {(r.doc_id, r.gid): r for r in distinctive.term_distinctiveness(postings, terms).collect()}
    own = scored[(3, 8)]
    assert (own.tf, own.doc_freq, own.coll_freq, own.term_id) == (9, 1, 9, 8)
    ridf = -math.log2(1 / 4) + math.log2(1 - math.exp(-9 / 4))
    assert abs(own.score - 9 * ridf / 10 * 9 / 9) < 1e-9
    split = scored[(1, 1)]
    assert (split.tf, split.term_id) == (3, 1)
    checks = spark.createDataFrame([(3,), (3,), (None,), (77,)], "doc_id long")
    assert [tuple(r) for r in distinctive.most_distinctive(postings, terms, checks).collect()] == [(3, 8)]
    assert distinctive.most_distinctive(postings.where("false"), terms, checks).count() == 0


def test_term_frequencies(spark):
    postings, terms = _tables(spark)
    got = {r.term: (r.occurrences, r.doc_count, r.mark) for r in frequencies.term_frequencies(postings, terms, rare=1, common=0.5).collect()}
    assert got == {"index": (3, 1, "rare"), "page": (4, 3, "common"), "cafe": (1, 1, "rare"), "own": (9, 1, "rare")}
    assert frequencies.term_frequencies(postings.where("false"), terms).count() == 0


def test_ngrams_match_brute_force():
    rng = np.random.default_rng(5)
    doc = np.sort(rng.integers(0, 6, 300))
    pos = np.concatenate([np.arange((doc == d).sum()) * rng.choice([1, 1, 1, 2]) for d in range(6)])
    gid = rng.integers(0, 3, 300)
    twice = rng.permutation(np.r_[np.arange(300), np.arange(50)])
    got = {}
    for grams, n, docs in frequencies.ngram_counts(*frequencies.term_stream(doc[twice], gid[twice], pos[twice]), 3):
        got |= {tuple(g): (a, b) for g, a, b in zip(grams.tolist(), n.tolist(), docs.tolist(), strict=True)}
    expected: dict = {(): (300, 6)}
    where: dict = {}
    at = {(d, p): g for d, p, g in zip(doc.tolist(), pos.tolist(), gid.tolist(), strict=True)}
    for d, p in at:
        for n in (1, 2, 3):
            gram = tuple(at.get((d, p + k)) for k in range(n))
            if None not in gram:
                where.setdefault(gram, []).append(d)
    expected |= {g: (len(ds), len(set(ds))) for g, ds in where.items()}
    assert got == expected


def test_blocks_of_documents_add_up(spark, monkeypatch):
    postings, terms = _tables(spark)
    whole = {tuple(r.ngram): (r.occurrences, r.doc_count) for r in frequencies.ngram_frequencies(postings, terms, 2).collect()}
    assert whole[()] == (17, 4) and whole[(1, 3)] == (1, 1)


def _brute(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fit = [f for f in free if f >= s]
        if fit:
            free[free.index(min(fit))] -= s
        else:
            free.append(capacity - s)
    return sorted(free)


def test_packing_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 40, 300).tolist() + [95, 64, 32, None]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    kinds = spark.createDataFrame([("a", 32), ("b", 50), ("bad", 0), (None, 5), ("a", 32)], "kind string, capacity int")
    rows = packing.pack(items, kinds).collect()
    for kind, capacity in (("a", 32), ("b", 50)):
        mine = [r for r in rows if r.kind == kind]
        assert len({(r.doc_id, r.piece) for r in mine}) == len(mine) and {r.doc_id for r in mine} == set(range(len(sizes)))
        filled: dict = {}
        for r in mine:
            filled[r.container_id] = filled.get(r.container_id, 0) + r.tokens
        pieces = [p for s in sizes for p in [capacity] * ((s or 0) // capacity) + [(s or 0) % capacity] if p]
        assert sorted(capacity - f for f in filled.values()) == _brute(pieces, capacity)
        assert [sum(r.tokens for r in mine if r.doc_id == d) for d in range(len(sizes))] == [s or 0 for s in sizes]
    assert packing.pack(items.where("false"), kinds).count() == 0 and packing.pack(items, kinds.where("false")).count() == 0
