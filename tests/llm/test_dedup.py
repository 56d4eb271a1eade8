"""Substring dedup and Jaccard join against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import jaccard_join
from faultline.llm.jaccard_join import bands, allocation, near_classes, signatures
from faultline.llm.repeats import COVER, PERIOD, cut, repeated_windows


def words(text):
    return (text or "").encode().split()


def brute_repeats(rows):
    seen, result = {}, {}
    for i, text in sorted(rows):
        w = words(text)
        gone, mine = [False] * len(w), []
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            mine.append(key)
            if seen.get(key, i) < i:
                gone[j : j + 50] = [True] * 50
        for key in mine:
            seen.setdefault(key, i)
        kept = [x for x, g in zip(w, gone) if not g]
        result[i] = len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()
    return result


def brute_classes(rows):
    sets = {}
    for i, text in rows:
        w = [x.lower() for x in words(text)]
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got_repeats(docs):
    return {r[0]: tuple(r[1:]) for r in cut(docs, repeated_windows(docs)).select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()}


def edited(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**9)}"
    return " ".join(w)


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_repeats_on_documents(docs):
    assert got_repeats(docs) == brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_repeats_at_boundaries(spark):
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(90)]
    rows = []
    for i in range(60):
        own = [f"d{i}w{k}" for k in range(rng.randrange(0, 70))]
        low = rng.randrange(0, 60)
        part = shared[low : low + rng.choice([49, 50, 51, 80])]
        rows.append((i * 3, " ".join(own + part + [f"e{i}"] + part[:30])))
    rows += [(500 + i, rows[7][1]) for i in range(30)]
    assert got_repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_repeats_odd_and_empty(odd, empty):
    result = cut(odd, repeated_windows(odd))
    assert set(odd.columns) <= set(result.columns) and result.count() == odd.count()
    by_id = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in result.collect()}
    assert by_id[7] == (30_001, 30_000) and by_id[6] == (30_000, 0) and by_id[1] == (0, 0) and by_id[4] == (1, 0)
    assert cut(empty, repeated_windows(empty)).count() == 0


@pytest.mark.parametrize("small, few", [(2, 3), (2, 128), (12, 128)])
def test_classes_of_near_copies(spark, monkeypatch, small, few):
    """Copies at all distances around the threshold, so that stars leave links to be found in smaller buckets."""
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rng = random.Random(11)
    rows = []
    for group in range(4):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 150]))]
        for _ in range(60):
            source = rng.choice(rows)[1].split() if rows and rng.random() < 0.4 else base
            rows.append((len(rows), edited(rng, source, rng.randrange(0, 7))))
    want = brute_classes(rows)
    got = {r[0]: (r[1], r[2]) for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_classes_on_documents(docs):
    want = brute_classes([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {r[0]: (r[1], r[2]) for r in near_classes(docs).collect()} == want


def test_classes_odd_and_empty(odd, empty):
    got = sorted(map(tuple, near_classes(odd).collect()), key=str)
    assert (4, 1, 4) in got and got.count((4, 1, 4)) == 2 and (1, 0, 1) in got and (3, 0, 3) in got
    assert [r for r in got if r[0] is None] == [(None, 5, None)]
    assert {r[2] for r in got if r[0] in (6, 7)} == {6}
    assert near_classes(empty).count() == 0


def test_one_deletions_find_what_equal_segments_miss(monkeypatch):
    """With costly false candidates segments of threshold 1 are chosen, and linked sets still share a signature."""
    import numpy as np

    monkeypatch.setattr(jaccard_join, "COMMON", 0.6)
    allocation.cache_clear()
    try:
        band = int(np.searchsorted(bands(), 60, side="right") - 1)
        assert allocation(band)[1] > 0
        rng = np.random.default_rng(3)
        for _ in range(200):
            x = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
            y = np.unique(np.r_[x[3:], rng.integers(0, 2**63, 3).astype(np.uint64)])
            assert 19 * len(np.setxor1d(x, y)) <= len(x) + len(y)
            assert len(np.intersect1d(signatures(x), signatures(y)))
    finally:
        allocation.cache_clear()
