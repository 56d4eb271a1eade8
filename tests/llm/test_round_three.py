"""Packing, manifest and source audit against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faultline.llm import divergence, manifest, packing
from faultline.llm.catalog import ORACLES, QUERIES

ENCODER = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
HARD = [
    "a<|endoftext|>b c<|startoftext|> <|endoftext|>", "\x1cx !\x1c! \x85   q w ΑΣ ΑΣ. Σ İstanbul ﬁ é é ́x", "'S don't I'LL it's!' 'tis o''s", "日本語 テスト1234 5",
    "a" * 3000, "　x y z", "", "   ", "q\x85z ﷺ 👩‍👩‍👧 #tag@x ÀÉ×÷ß.", "Ünïcode naïve! (Œuvre) 50% a-b x_y",
]


def ids_of(text):
    return ENCODER.encode(text or "", add_special_tokens=False).ids + [packing.END]


def test_word_ids_are_the_tokenizers(docs):
    texts = HARD + [r["text"] for r in docs.collect()]
    reader = packing.WordIds(None)
    assert reader.wordwise
    for _ in range(2):  # the second time from kept words
        assert [i.tolist() for i in reader.of([t.encode() for t in texts])] == [ids_of(t) for t in texts]
    reader.wordwise = False
    assert [i.tolist() for i in reader.of([t.encode() for t in HARD])] == [ids_of(t) for t in HARD]


def plain_assign(lengths, capacity, weight):
    """The rule, looking at all sequences for each piece."""
    todo = sorted((-(n % capacity), i, n // capacity * capacity) for i, n in enumerate(lengths) if n % capacity)
    sizes = packing.room(-sum(t[0] for t in todo), capacity)
    left, cost, placed = list(sizes), [0.0] * len(sizes), []
    while todo:
        need, doc, start = todo.pop(0)
        length = -need
        fits = [s for s in range(len(sizes)) if left[s] >= length] or [s for s in range(len(sizes)) if left[s]]
        s = min(fits, key=lambda s: (cost[s], s))
        put = min(length, left[s])
        placed.append((doc, start, put, s, sizes[s] - left[s]))
        left[s] -= put
        cost[s] += put + weight * put * put
        if put < length:
            todo.append((put - length, doc, start + put))
            todo.sort()
    return placed


@pytest.mark.parametrize("seed", range(6))
def test_assignment_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in rng.choice([1, 2, 3, 7, 30, 64, 65, 200], 150)] + [1] * int(rng.integers(0, 40))
    placed, sizes = packing.assign(lengths, 64, 0.01)
    whole = sum(n // 64 for n in lengths)
    assert [(d, s, n, q - whole, o) for d, s, n, q, o in placed if q >= whole] == plain_assign(lengths, 64, 0.01)
    assert sum(sizes) == sum(lengths)


def check_pieces(rows, texts, capacity):
    """Every id once, sequences without gaps, full or as long as a power of two."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        got = b"".join(bytes(r["ids"]) for r in sorted(parts, key=lambda r: r["start"]))
        want = np.array([x for t in texts[i] for x in ids_of(t)], "<u4")
        assert len(texts[i]) > 1 or got == want.tobytes()
        assert len(got) == 4 * len(want) and all(4 * r["length"] == len(r["ids"]) > 0 for r in parts)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0 and {r["sequence_tokens"] for r in parts} == {at}


def texts_of(df):
    found = defaultdict(list)
    for r in df.collect():
        found[r["doc_id"]].append(r["text"])
    return found


def test_pack_round_trip(docs, odd, empty):
    check_pieces(packing.pack(docs).collect(), texts_of(docs), 4096)
    for table in (docs.unionByName(odd.select(docs.columns)).repartition(3), odd):
        check_pieces(packing.pack(table, capacity=256, shard=5_000).collect(), texts_of(table), 256)
    assert packing.pack(empty).collect() == []


def test_pack_query(spark, docs):
    got = QUERIES["op11_pack"](spark, "/root/testdata/sf0.001").collect()
    ids = {r["doc_id"]: ids_of(r["text"]) for r in docs.collect()}
    for r in got:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    sequences = {r["sequence_id"]: r["sequence_tokens"] for r in got}
    assert sum(sequences.values()) == sum(map(len, ids.values())) and sum(n == 4096 for n in sequences.values()) >= len(sequences) - 12 * 8


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][i : i + 3])) for i in range(0, len(rows[-1]), 3)])
    return rows


def siblings(rows, i):
    for level in rows[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        yield run[: i % 3], run[i % 3 + 1 :]
        i //= 3


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, sha(code(r)), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(v, key=lambda x: x[:3])]) for s, v in by_source.items()}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            now = sha(code((*r[:4], r[4].replace("\n", "")))) if tampered else leaf
            way = [*siblings(trees[s], i), *siblings(top, at)]
            for before, after in way:
                now = sha("".join(before) + now + "".join(after))
            proof = sha("".join(x for before, after in way for x in before + after))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return Counter(out)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_rows(docs, depth=manifest.DEPTH):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    found = manifest.manifest(docs, "doc_id", "source", COLUMNS, tampered, depth)
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")), "folded_root", "verified")


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest_against_plain_tree(spark, docs, odd, depth):
    hot = spark.range(1000, 1140).selectExpr("id AS doc_id", "concat('a\\n', id) AS text", "'en' AS lang", "'hot' AS source", "2L AS n_chars")
    table = docs.unionByName(hot).unionByName(odd.select(docs.columns)).select(*docs.columns)
    got = Counter(map(tuple, op12_rows(table, depth).collect()))
    assert got == plain_manifest([tuple(r[c] for c in COLUMNS) for r in table.collect()])


def test_manifest_of_one_row_and_of_none(docs, empty):
    one = docs.where("doc_id = 7")
    assert Counter(map(tuple, op12_rows(one).collect())) == plain_manifest([tuple(r[c] for c in COLUMNS) for r in one.collect()])
    assert op12_rows(empty).collect() == []


def test_proof_alone_gives_the_root(docs):
    for r in manifest.manifest(docs, "doc_id", "source", COLUMNS).collect():
        assert r["verified"] and manifest.fold(r["leaf"], r["proof"]) == r["root"] and manifest.fold("0" * 64, r["proof"]) != r["root"]


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def test_term_counts(spark, docs, odd, monkeypatch):
    lengths = [(i, " ".join(("xé" * n)[:n] + sep + "yz" * n for n in (1, 4, 7, 8, 9, 15, 16, 17, 24, 25, 127, 128, 129, 130, 900) for sep in (" ", ".", "1")), "en", "a", 1) for i in range(20, 23)]
    table = docs.unionByName(odd.select(docs.columns)).unionByName(spark.createDataFrame(lengths, docs.schema))
    want, having = Counter(), Counter()
    for r in table.collect():
        key = (r["lang"] or "", r["source"] or "")
        terms = plain_terms(r["text"])
        want.update((*key, t) for t in terms)
        having.update((*key, t) for t in set(terms))
    got = {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.term_counts(table).collect()}
    assert got == {k: (n, having[k]) for k, n in want.items()}


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "TEXT_BYTES", 1000)
    text = "".join(f"w{'x' * (i % 40)} Éa{i % 7}." for i in range(3000)) + "y" * 9000 + " end"
    terms, _, n, having = divergence._long_text(np.frombuffer(text.encode(), np.uint8))
    assert {t.decode(): k for t, k in zip(terms, n)} == Counter(plain_terms(text)) and set(having) == {1}


def test_long_texts_stand_alone(monkeypatch):
    monkeypatch.setattr(divergence, "TEXT_BYTES", 50)
    texts = ["a b", "c" * 80 + " d", None, "e f g", "h " * 60, "i", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (texts, ["en"] * 7, ["s", "s", "s", "t", "t", "s", "s"])], names=["text", "lang", "source"])
    parts = [b.column("text").to_pylist() for b in divergence._apart(iter([batch]))]
    assert parts == [["a b"], [texts[1]], [None, "e f g"], [texts[4]], ["i", ""]]
    got = Counter()
    for b in divergence._counted(iter([batch])):
        for r in b.to_pylist():
            got[r["source"], r["term"]] += r["n"]
    assert got == Counter((s, t) for text, s in zip(texts, ["s", "s", "s", "t", "t", "s", "s"]) for t in plain_terms(text))


def test_audit_on_odd_rows(spark, odd, empty, monkeypatch):
    rows = [(i, t, lang, s, 1) for i, (lang, s, t) in enumerate([("en", f"s{k % 5}", f"the cat{k % 3} sat Ärger {'long' * (k % 9)}") for k in range(90)] + [("xx", "a", "one"), ("xx", None, None), (None, "b", "the"), ("en", "none", None)])]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(odd, allowMissingColumns=True)
    con = duckdb.connect()
    con.register("documents", table.toPandas()[["doc_id", "text", "lang", "source", "n_chars"]])
    want = Counter(con.execute(ORACLES["op13_audit_sources"]).fetchall())
    assert Counter(map(tuple, divergence.audit_sources(table).collect())) == want
    assert divergence.audit_sources(empty).collect() == []


@pytest.mark.parametrize("name", ["op12_manifest", "op13_audit_sources"])
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES[name](spark, folder)
    assert Counter(map(tuple, got.collect())) == Counter(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())
