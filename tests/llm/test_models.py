"""Context-tree scores, syncmer fingerprints and source mixing against brute force."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import context_tree
from faultline.llm.common import held_out
from faultline.llm.context_tree import DEPTH, Lookup, ln_kt, score_texts
from faultline.llm.mixing import mix_sources, weights
from faultline.llm.syncmers import K, SKETCH, compare_with_next, successors

def out():
    return held_out(F.col("doc_id"), 10, 0)


def body(text):
    words = (text or "").encode().lower().split()
    return words, b"".join(w + b" " for w in words) + b"\n"


def brute_scores(rows):
    """rows (doc_id, text): the tree of all contexts, node by node."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None}
    counts = defaultdict(lambda: [0, 0])
    tokens = Counter()
    for i, text in rows:
        if held.get(i):
            continue
        words, data = body(text)
        tokens.update([*words, b"\n"])
        data = b"\n" * DEPTH + data
        for p in range(DEPTH, len(data)):
            for k in range(8):
                node, bit = (256 | data[p]) >> (8 - k), data[p] >> (7 - k) & 1
                for d in range(DEPTH + 1):
                    counts[data[p - d : p], node][bit] += 1
    children = defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append(context)
    lg = math.lgamma
    kt = {s: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) for s, (a, b) in counts.items()}
    whole, stop = {}, {}
    for s in sorted(counts, key=lambda s: -len(s[0])):
        if len(s[0]) == DEPTH:
            whole[s], stop[s] = kt[s], 1.0
        else:
            whole[s] = math.log(0.5) + np.logaddexp(kt[s], sum(whole[c, s[1]] for c in children[s]))
            stop[s] = math.exp(math.log(0.5) + kt[s] - whole[s])
    n, v = sum(tokens.values()), len(tokens)
    result = []
    for i, text in rows:
        words, data = body(text)
        data, score = b"\n" * DEPTH + data, 0.0
        for p in range(DEPTH, len(data)):
            for k in range(8):
                node, bit = (256 | data[p]) >> (8 - k), data[p] >> (7 - k) & 1
                prob, rest = 0.0, 1.0
                for d in range(DEPTH + 1):
                    s = data[p - d : p], node
                    if s not in counts:
                        prob += rest / 2
                        break
                    prob += rest * stop[s] * (counts[s][bit] + 0.5) / (sum(counts[s]) + 1)
                    rest *= 1 - stop[s]
                score += math.log10(prob)
        all_tokens = [*words, b"\n"]
        base = sum(math.log10((tokens[t] + 0.1) / (n + 0.1 * (v + 1))) for t in all_tokens)
        result.append((i, bool(held.get(i)), len(all_tokens), sum(tokens[t] > 0 for t in all_tokens), n, round(base, 4), round(score, 3)))
    return sorted(result, key=str)


def got_scores(docs, **more):
    rows = score_texts(docs, out(), **more).collect()
    return sorted(((*tuple(r)[:5], round(r["base_score"], 4), round(r["score"], 3)) for r in rows), key=str)


@pytest.mark.parametrize("sent", [context_tree.SENT, 0])
def test_scores(spark, sent):
    """Both ways from the run table to the texts, with copies, blanks, nulls, repeated ids and words only held-out texts have."""
    rows = [(i, f"The cat {i % 7} sat on the Mat{'!' * (i % 3)} and  ran\taway no{i}") for i in range(40)]
    rows += [(41, None), (42, ""), (43, " \n"), (43, " \n"), (3, "repeated id"), (None, "no id at all"), (50, "é ü 漢字 emoji 🎉"), (51, "x" * 3000)]
    rows = rows + [(i, f"only held {i} out zzz qqq") for i in range(60, 90) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    want = brute_scores(rows)
    assert sum(r[1] for r in want) > 3 and got_scores(docs, sent=sent) == want


def test_scores_empty(spark, empty):
    assert score_texts(empty, out()).count() == 0
    one = spark.createDataFrame([(i, "ab") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    row = score_texts(one, out()).first()  # nothing to learn from: 8 fair bits for each of 4 bytes
    assert row["train_tokens"] == row["n_known"] == 0 and row["score"] == pytest.approx(4 * 8 * math.log10(0.5)) and row["base_score"] == pytest.approx(2 * math.log10(0.1 / 0.1))


def test_scores_beat_words_on_held_out_documents(spark):
    rows = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), out()).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_kt_and_lookup():
    assert ln_kt(np.array([3.0]), np.array([2.0]))[0] == pytest.approx(math.log(0.5 * 1.5 * 2.5 * 0.5 * 1.5 / math.factorial(5)))
    keys = np.unique(np.random.default_rng(1).integers(0, 2**48, 5000).astype(np.uint64))
    values = np.arange(len(keys)) / 8
    assert np.array_equal(Lookup(keys, values)(keys[::-1]), values[::-1])


def test_fingerprints(spark, docs):
    rows = sorted(map(tuple, docs.select("doc_id", "text").collect()))
    got = {r["doc_id"]: r for r in compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        assert got[i]["n_chars"] == len(text) and got[i]["edited"] == text[: len(text) - half] + after[:half]
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    prints = defaultdict(set)
    for i, text in rows:
        prints[text].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert len({p for s in prints.values() for p in s}) == len(prints)
    longer = [i for i, t in rows if len(t.split()) > 60]
    assert np.mean([got[i]["near_edited"] for i in longer]) > 0.2 > 0.1 > np.mean([got[i]["near_next"] for i in longer])


def test_fingerprint_estimates_jaccard(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, share in enumerate([0.0, 0.25, 0.5, 0.75, 1.0]):
        a = [f"w{x}" for x in rng.integers(0, 10**6, 3000)]
        b = a[: int(3000 * share)] + [f"v{x}" for x in rng.integers(0, 10**6, 3000 - int(3000 * share))]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r["doc_id"]: r["near_next"] for r in compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, share in enumerate([0.0, 0.25, 0.5, 0.75, 1.0]):
        assert got[2 * i] == pytest.approx(share / (2 - share), abs=0.17)


def test_fingerprints_odd_and_empty(spark, odd, empty):
    rows = compare_with_next(odd).collect()
    assert len(rows) == odd.count() and compare_with_next(empty).count() == 0
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["fingerprint"] == "" and by_id[1]["near_edited"] == by_id[1]["near_next"] == 1.0 and by_id[None]["near_next"] == 0.0
    assert by_id[4]["edited"] == "wo12" and len(by_id[6]["fingerprint"]) == 8 * SKETCH and by_id[6]["near_next"] > 0.9
    assert K == 6 and [r[1] for r in sorted(successors(spark.range(1000).withColumnRenamed("id", "doc_id")).collect())] == [*range(1, 1000), 0]
    assert successors(spark.createDataFrame([(5,), (5,)], "doc_id long")).collect() == [(5, 5)]


def test_weights_meet_entropy_and_limit(spark):
    def solved(tokens, **more):
        return {r["source"]: r for r in weights(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), **more).collect()}

    tokens = {"a": 900_000, "b": 50_000, "c": 30_000, "d": 20_000, None: 1000, "none": 0}
    got = solved(tokens, entropy=0.9, epochs=1e9)
    w = np.array([r["weight"] for r in got.values()])
    assert "none" not in got and w.sum() == pytest.approx(1) and -(w * np.log(w)).sum() == pytest.approx(0.9 * math.log(5), rel=1e-6)
    assert got["a"]["need"] == pytest.approx(900_000)  # every document at least once
    got = solved(tokens, entropy=0.9, epochs=4.0)
    assert max(r["need"] / r["tokens"] for r in got.values()) == pytest.approx(4.0, rel=1e-6)
    assert all(r["exponent"] == 1 for r in solved({"a": 10, "b": 10}).values())
    assert sum(r["need"] for r in solved(tokens, epochs=1e9, budget=5000).values()) == pytest.approx(5000)


def brute_mix(rows, need, tokens):
    """The same permutations by a loop over documents."""
    md5 = lambda *x: hashlib.md5("|".join(map(str, x)).encode()).hexdigest()
    copies = Counter()
    for source in {r[1] for r in rows}:
        mine = [(i, n) for i, s, n in rows if s == source]
        full = math.floor(need[source] / tokens[source] + 1e-9)
        for i, _ in mine:
            copies[i] += full
        rest = need[source] - full * tokens[source]
        blocks = defaultdict(list)
        for i, n in mine:
            blocks[int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 1024].append((md5(i, full), i, n))
        start = 0
        for block in sorted(blocks, key=lambda b: (md5(source, full, b), b)):
            used = 0
            for _, i, n in sorted(blocks[block]):
                used += n
                if rest > start and used <= rest - start:
                    copies[i] += 1
            start += used
    return +copies


def test_mix(spark, docs):
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source"))).withColumn("epoch", F.lit("clash"))
    rows = [(r[0], r[1], len(r[2].encode().split())) for r in docs.select("doc_id", "source", "text").collect()]
    got = mix_sources(docs).collect()
    tokens = Counter()
    for _, s, n in rows:
        tokens[s] += n
    solved = weights(spark.createDataFrame(list(tokens.items()), "source string, tokens long")).collect()
    want = brute_mix(rows, {r["source"]: r["need"] for r in solved}, tokens)
    assert Counter(r["doc_id"] for r in got) == want and max(want.values()) > 1 and len(want) == len(rows)
    assert all(0 <= r["slot"] <= 1 for r in got)
    early = Counter()
    for r in got:
        if r["slot"] < 0.5:
            early[r["source"]] += r["n_tokens"]
    for r in solved:
        assert early[r["source"]] == pytest.approx(r["need"] / 2, abs=max(n for _, s, n in rows if s == r["source"]) * 2 + 0.1 * r["need"])


def test_mix_odd_and_empty(odd, empty):
    got = mix_sources(odd)
    assert {r["doc_id"] for r in got.collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8} and set(odd.columns) <= set(got.columns)
    assert mix_sources(empty).count() == 0
    blank = odd.where("doc_id IN (1, 2, 3)")
    assert [(r["epoch"], r["slot"]) for r in mix_sources(blank).collect()] == [(0, 0.0)] * 3


def test_runs_are_made_in_slices_of_bounded_bytes():
    texts = [b"one two " * 2500, None, b"", *[b"abc def ghi " * 1600] * 600]
    whole = context_tree.byte_runs(texts[:40])
    parts = list(context_tree.some_runs(texts[:40], 50_000))
    assert len(parts) > 10 and (np.concatenate([r for _, r, _ in parts]) == whole[0]).all() and (np.concatenate([o + at for at, _, o in parts]) == whole[1]).all()
    tracemalloc.start()
    total = sum(len(r) for _, r, _ in context_tree.some_runs(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 11_000_000 and peak < 200_000_000
