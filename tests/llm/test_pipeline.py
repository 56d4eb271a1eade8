"""The pipeline against a loop over documents, stage by stage, and its guard in the entry module."""

import regex
from test_dedup import brute_repeats
from test_models import brute_mix
from test_near_stage import brute

import __spark_entry__
import corpus_pipeline
from faultline.llm.mixing import weights
from faultline.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def loose(text):
    return " ".join(w.strip(".,!?;:%*#$&|\"'()") for w in text.lower().split())


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    more = spark.createDataFrame([(900, None, "en", "src0", 0), (901, "1234 5678", "en", "src1", 9), (902, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(more)
    bench = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    text = {i: r["text"] for i, r in rows.items()}
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder))
        out[name] = docs.collect()
        if name != "source_mix":
            assert docs.columns == COLUMNS
    want = {i for i, t in text.items() if t and regex.search(r"\p{L}", t)}
    assert {r["doc_id"] for r in out["language_id"]} == want and not want & {900, 901, 902}
    classes = brute([(i, text[i]) for i in want], 5, 0.8)
    want = {i for i, (_, c) in classes.items() if c == i}
    assert {r["doc_id"] for r in out["near_duplicates"]} == want and len(want) < len(classes)
    repeats = brute_repeats([(i, text[i]) for i in want])
    got = {r["doc_id"]: r for r in out["substring_dedup"]}
    assert got.keys() == want
    for i, (n, gone, _) in repeats.items():
        assert len(got[i]["text"].encode().split()) == n - gone and (gone or got[i]["text"] == text[i])
        assert got[i]["n_chars"] == (len(got[i]["text"]) if gone else rows[i]["n_chars"])
    text = {i: r["text"] for i, r in got.items()}
    leaks = {i for i, t in text.items() if any(loose(b) in loose(t) for b in bench)}
    want -= leaks
    assert leaks and {r["doc_id"] for r in out["decontamination"]} == want
    plain = [(i, rows[i]["source"], len(text[i].encode().split())) for i in want]
    tokens = {s: sum(n for _, t, n in plain if t == s) for s in {s for _, s, _ in plain}}
    solved = weights(spark.createDataFrame(list(tokens.items()), "source string, tokens long")).collect()
    copies = brute_mix(plain, {r["source"]: r["need"] for r in solved}, tokens)
    counted = {r["doc_id"]: 0 for r in out["source_mix"]}
    for r in out["source_mix"]:
        counted[r["doc_id"]] += 1
    assert counted == dict(copies) and counted.keys() == want


def test_empty_documents(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, "/root/testdata/sf0.001"))
    assert empty.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "source_mix"]
