"""The near-duplicate stage and other limits of the Jaccard join against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from test_dedup import edited, words

import corpus_pipeline
from faultline.llm import jaccard_join
from faultline.llm.jaccard_join import limit_of, near_classes, signatures


def brute(rows, width, similarity):
    limit, sets, root = Fraction(str(similarity)), {}, {}
    for i, text in rows:
        w = [x.lower() for x in words(text)]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= limit * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def copies(rng, groups=4, size=60):
    """Copies of copies with words changed, appended or cut off, on both sides of the limits."""
    rows = []
    for group in range(groups):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 150]))]
        own = []
        for _ in range(size):
            source = rng.choice(own).split() if own and rng.random() < 0.4 else base
            text = edited(rng, source, rng.randrange(0, 5)).split()
            text = text[: len(text) - rng.choice([0, 0, len(text) // 7])] + [f"e{rng.randrange(10**9)}" for _ in range(rng.choice([0, 0, len(base) // 7]))]
            own.append(" ".join(text))
        rows += own
    return list(enumerate(rows))


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}


def test_stage_drops_copies_with_a_tail_and_with_one_changed_word(spark):
    plain = [f"w{i}" for i in range(100)]
    long = [f"v{i}" for i in range(50)]
    rows = [(1, " ".join(plain)), (2, " ".join(plain + [f"tail{i}" for i in range(15)])), (3, " ".join(plain[:85])), (4, " ".join(long)), (5, " ".join(long[:25] + ["other"] + long[26:])), (6, " ".join(f"u{i}" for i in range(60)))]
    assert stage(spark, rows) == {1, 4, 6}
    assert len({r[2] for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == 6


def test_stage_on_documents(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = {i for i, (_, c) in brute(rows, 5, 0.8).items() if c == i}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    assert want < {i for i, (_, c) in brute(rows, 3, 0.9).items() if c == i}


@pytest.mark.parametrize("width, similarity, small, few", [(5, 0.8, 2, 3), (5, 0.8, 12, 128), (3, 0.75, 2, 3), (2, 0.5, 2, 3), (4, 1.0, 2, 3)])
def test_classes_at_other_limits(spark, monkeypatch, width, similarity, small, few):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "FEW", few)
    rows = copies(random.Random(23))
    want = brute(rows, width, similarity)
    got = {r[0]: (r[1], r[2]) for r in near_classes(spark.createDataFrame(rows, "doc_id long, text string"), width=width, similarity=similarity).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(rows)


@pytest.mark.parametrize("similarity", [0.9, 0.8, 0.7, 0.5])
@pytest.mark.parametrize("common", [0.05, 0.6])
def test_linked_sets_share_a_signature(monkeypatch, similarity, common):
    """Also without the signatures of empty segments, which sets with nothing in common share."""
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    jaccard_join.allocation.cache_clear()
    try:
        limit, rng = limit_of(similarity), np.random.default_rng(7)
        for _ in range(1_500):
            n = int(rng.integers(2, 90))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut, more = int(rng.integers(0, n // 3 + 1)), int(rng.integers(0, n // 3 + 1))
            y = np.unique(np.r_[x[cut:], rng.integers(0, 2**63, more).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if both < n + more and limit.whole * both >= limit.part * (n + more):
                assert len(np.intersect1d(signatures(x, limit), signatures(y, limit)))
    finally:
        jaccard_join.allocation.cache_clear()


def test_sets_with_nothing_in_common_rarely_share_a_signature():
    limit, rng = limit_of(0.8), np.random.default_rng(9)
    signs = [signatures(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), limit, 5) for n in rng.integers(60, 80, 200)]
    shared = np.unique(np.concatenate(signs), return_counts=True)[1]
    assert shared.max() < 5


@pytest.mark.parametrize("low, high", [(372, 462), (700, 860)])
def test_sets_above_a_band_do_not_share_its_empty_segments(low, high):
    """They also use the scheme of the band below, in which a smaller partner may lie."""
    limit, rng = limit_of(0.8), np.random.default_rng(11)
    signs = [signatures(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)), limit, 5) for n in rng.integers(low, high, 400)]
    assert np.unique(np.concatenate(signs), return_counts=True)[1].max() < 5


def test_partners_in_neighbouring_bands_share_a_signature():
    limit, rng = limit_of(0.8), np.random.default_rng(13)
    for _ in range(400):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(250, 520))).astype(np.uint64))
        y = x[: -(-len(x) * 4 // 5)]  # as small as a linked set can be
        assert len(np.intersect1d(signatures(x, limit, 5), signatures(y, limit, 5)))


def test_similarity_is_checked(spark):
    for wrong in (0, 1.1):
        with pytest.raises(ValueError):
            near_classes(spark.createDataFrame([], "doc_id long, text string"), similarity=wrong)
