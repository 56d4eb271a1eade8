"""Language, licenses, decontamination, rendering, URL rules."""

import pytest
from pyspark.sql import functions as F

from faultline.llm import decontaminate
from faultline.llm.common import held_out
from faultline.llm.decontaminate import contaminated
from faultline.llm.language import codewords, identify
from faultline.llm.licenses import scan_licenses
from faultline.llm.render import extract, rendered
from faultline.llm.url_filter import judge
from faultline.llm.catalog import QUERIES, URL_RULES, URL_SUFFIXES


def test_language_held_out_accuracy(spark):
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_and_empty(odd, empty):
    got = {r["doc_id"]: r for r in identify(odd, F.lit(True)).collect()}
    assert got[1]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == "und" and got[8]["lang_pred"] == "de"
    assert got[7]["lang_pred"] == "en"
    assert identify(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in identify(odd, F.lit(False)).collect()} == {"und"}


@pytest.mark.parametrize("k", [2, 4, 6, 9, 40])
def test_codewords_differ(k):
    code = codewords(k).astype(int)
    distance = (code.shape[1] - code @ code.T) // 2
    assert code.shape[0] == k and min(distance[i, j] for i in range(k) for j in range(i)) >= 1


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id"), 4, 2).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


QUESTION = "Anna bought 12 apples and paid 3 dollars for each of them. How much did Anna pay for all of the apples in the end?"


def test_decontamination_slots(spark, monkeypatch):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "short of it"), (4, "")], "item_id long, text string")
    rows = [
        (1, "Noise before. " + QUESTION + " Noise after."),
        (2, QUESTION.replace("Anna", "Maria").replace("12", "40").replace("dollars", "euros")),
        (3, QUESTION.replace("Anna bought", "Maria bought")),  # two people where the question has one
        (4, "Anna bought 12 apples and went home."), (5, None), (6, ""), (1, QUESTION), (None, "so, SHORT of it!"), (7, "nothing here " * 500),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    want = {(1, 1, True), (2, 1, False), (None, 3, True)}
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in contaminated(docs, bench).collect()} == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2)  # several blocks
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in contaminated(docs, bench).collect()} == want
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_finds_every_passage(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    inside = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, folder).collect()}
    assert inside and inside <= found
    loose = lambda t: " ".join(t.lower().replace("!!", "").split())
    text = {d["doc_id"]: loose(d["text"]) for d in docs}
    asked = {b["item_id"]: loose(b["text"]) for b in bench}
    assert all(asked[b] in text[d] for d, b in found)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [
        (1, "Some text here.\nReleased under the MIT License.\nMore text."), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0."), (4, "This work is licensed under the GNU General Public License, version 3."),
        (5, "This work is licensed under the GNU General Public License, version 2."), (6, "He has a driving licence from Rome and nothing else to declare."), (7, None), (8, ""), (9, "no cue at all"),
        (10, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3."), (11, "Licensed under CC BY-NC 3.0."), (1, "Released under the MIT License."), (None, "Licensed under the Apache License, Version 2.0."), (12, mit),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(1))
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    name = {k: {r["license"] for r in v} for k, v in got.items()}
    assert name[1] == {"MIT"} and len(got[1]) == 2 and name[2] == {"CC-BY-NC-4.0"} and name[3] == {"CC-BY-4.0"} and name[4] == name[10] == {"GPL-3.0"} and name[5] == {"GPL-2.0"}
    assert name[6] == name[11] == {None} and name[None] == {"Apache-2.0"} and not {7, 8, 9} & set(got)
    assert all(r["exact"] for k in (1, 2, 4, None) for r in got[k]) and next(r["start"] for r in got[1] if r["start"]) == 16
    assert scan_licenses(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"), ("a<script>b<p></script>c", "ac"), ("x &amp; y &lt;z&gt;", "x & y <z>"),
        ("<div hidden>no</div><div style='display: none'>no</div><span aria-hidden=true>no</span>yes", "yes"), ("a  b\n c<br>d", "a b c\nd"), ("<pre>  a\n   b</pre>", "  a\n   b"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k        | value\nlong key | 1"), ("1 < 2 and <b>bold</b> text", "1 < 2 and bold text"), ("</p></div>a</b>", "a"), ("<h1>T</h1>b<p>c</p>d", "T\n\nb\n\nc\n\nd"),
        ("<head><title>t</title></head><body>b", "b"), ("<!-- x -->a<!-- open", "a"), (None, ""), ("", ""), ("<p", ""), ("a<textarea>&lt;t</textarea>", "a<t"), ("<select><option>a<option>b</select>", "a\nb"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"), ("<td>x</td>", "x"), ("<p>a <b>b</b> c</p>", "a b c"), ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ],
)
def test_rendering(html, text):
    assert rendered(html)[0] == text


def test_rendering_deep_and_long():
    assert rendered("<div>" * 20_000 + "deep")[0] == "deep"
    assert rendered("<ul><li>" * 3000 + "x")[0].endswith("- x")
    assert len(rendered("<p>word" * 50_000)[0]) == 50_000 * 4 + 49_999 * 2


def test_extract_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    rows = sorted((tuple(r) for r in extract(pages).select("page_id", "text", "n_blocks").collect()), key=str)
    assert rows == [(1, "a", 1), (1, "a", 1), (None, "", 0)] and extract(pages.limit(0)).count() == 0


def test_url_rules(spark):
    cases = {
        "http://A.Example.ORG/en/2?x#y": ("a.example.org", "/en/2", "org/", "allow"), "http://example.org/es/": ("example.org", "/es/", "example.org/es/", "block"), "https://m.example.org/en/19": ("m.example.org", "/en/19", "example.org/en/1", "block"),
        "x://a.com/fr/9": ("a.com", "/fr/9", "com/fr/", "allow"), "x://a.com/de/9#z": ("a.com", "/de/9", "com/de/", "block"), "x://a.com/en": ("a.com", "/en", None, "allow"), "x://a.org": ("a.org", "", None, "allow"), "x://a.org?/": ("a.org", "", None, "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "x://xcom/fr/": ("xcom", "/fr/", None, "allow"), "x://b://c/d": ("b:", "//c/d", None, "allow"), "x://ÄB.net/p": ("Äb.net", "/p", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit(1))
    outcomes = spark.createDataFrame([], "doc_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(pages, outcomes, URL_RULES, URL_SUFFIXES, F.col("page_id")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_reputation_shrinks(spark):
    """A host with many bad outcomes is blocked, one with two is not, and good ones pull theirs down."""
    pages, outcomes, n = [], [], 0
    for host, good, bad in [("bad.example.net", 2, 60), ("few.example.net", 0, 2), ("good.example.net", 90, 2), *[(f"h{k}.example.net", 20, 1) for k in range(20)]]:
        for k in range(good + bad):
            pages.append((n, f"http://{host}/x"))
            outcomes.append((n, int(k < bad)))
            n += 1
    pages.append((n, "http://new.example.net/"))
    rows = judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "doc_id long, bad int"), [], URL_SUFFIXES, F.col("page_id")).collect()
    verdict = {r["host"]: r["verdict"] for r in rows}
    rate = {r["host"]: r["rate"] for r in rows}
    assert {h for h, v in verdict.items() if v == "block"} == {"bad.example.net"} and len(rows) == n + 1
    assert rate["good.example.net"] < rate["new.example.net"] < rate["few.example.net"] < rate["bad.example.net"] < 62 / 62
