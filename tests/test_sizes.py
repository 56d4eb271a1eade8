"""Steps whose share of one task once grew with the input, and the odd inputs of the queries that use them."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from faultline.functions.text import ENGLISH_STOP_WORDS, clean_text
from faultline.operators import skew
from faultline.operators import tickets as tk
from faultline.operators.similarity import centroids, tfidf, tokens, top_keywords
from faultline.operators.term_buckets import error_keywords
from faultline.session import materialize
from faultline.sources.tables import read_series


def raw_tickets(spark, rows):
    """Tickets of (subject, body, queue); the other columns are empty."""
    names = [*tk.COLUMNS, *tk.TAGS]
    df = spark.createDataFrame(rows, "subject string, body string, queue string")
    return df.select(*[c if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])


@pytest.mark.parametrize("size", [1, 64_000_000])
def test_dense_ids_put_missing_values_last(spark, monkeypatch, size):
    monkeypatch.setattr(tk, "RANGE_BYTES", size)
    rows = [(None, None, "q"), ("", "b", "q"), ("a", None, "q"), ("a", "z", "q"), ("a\x00", "a", "q"), ("é", "b", None), ("a", "z", "q"), ("same start 1", "x", "q"), ("same start 0", "y", "q")]
    want = sorted(rows, key=lambda r: [(v is None, (v or "").encode()) for v in r])
    found = tk.silver_tickets(raw_tickets(spark, rows), dense_ids=True).select("ticket_id", "subject", "body", "queue").collect()
    assert [tuple(r)[1:] for r in sorted(found)] == want and sorted(r[0] for r in found) == list(range(1, 10))


def test_dense_ids_cut_equal_rows_and_common_starts(spark, monkeypatch):
    monkeypatch.setattr(tk, "RANGE_BYTES", 2_000)
    written = []
    monkeypatch.setattr(skew, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    rng = random.Random(5)
    rows = [("same subject", "the same body", "q")] * 500 + [("same subject", f"the same start {rng.randrange(10**9)}", "q") for _ in range(500)]
    found = sorted(tuple(r) for r in tk.silver_tickets(raw_tickets(spark, rows), dense_ids=True).select("ticket_id", "body").collect())
    assert [r[0] for r in found] == list(range(1, 1001)) and [r[1] for r in found] == sorted(r[1] for r in rows)
    ranges = [r["count"] for r in written[0].groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(ranges) > 8 and max(ranges) < 300


WORDS = "red fox sea blue jump high low tide über wind".split()


@pytest.mark.parametrize("most", [3, 7, 10_000])
@pytest.mark.parametrize("repeated", [False, True])
def test_error_keywords_match_joins(spark, monkeypatch, most, repeated):
    """Also where the limit cuts terms that are used equally often; without repeated ids no row for each document and term is made."""
    rng = random.Random(most)
    rows = [(i % 30 if repeated else i, rng.choice("abc"), " ".join(rng.choices(WORDS, k=rng.randrange(9)))) for i in range(60)] + [(100, "a", None), (101, "d", "onlyhere")]
    wrong = spark.createDataFrame(rows, "id long, label string, t string")
    weights = tfidf(wrong, "id", tokens(F.col("t"), ENGLISH_STOP_WORDS), max_features=most)
    want = {(r["label"], r["rank"], r["term"]): round(r["weight"], 9) for r in top_keywords(centroids(weights, wrong, "id"), 5).collect()}
    right = spark.createDataFrame([(500, "a", "a", "red red red")], "id long, y string, p string, t string")
    if not repeated:
        monkeypatch.setattr("faultline.operators.similarity.term_counts", None)
    found = error_keywords(wrong.select("id", F.col("label").alias("y"), F.lit("z").alias("p"), "t").unionByName(right), "id", "t", "y", "p", 5, most)
    assert {(r["label"], r["rank"], r["term"]): round(r["weight"], 9) for r in found.collect()} == want and want


def cleaned(text):
    text = text.lower()
    for pattern in (r"http\S+|www\S+", r"\S+@\S+", r"[^a-zA-ZÀ-ÿ0-9\s]", r"\s+"):
        text = re.sub(pattern, " ", text, flags=re.ASCII)
    return text.strip(" ")


def test_cleaned_texts(spark):
    rng = random.Random(9)
    parts = ["@", "a", "B9", " ", "\n", "\t", "http", "www", "é", "ß", "€", "😀", ".", "a@b", "x.y@z "]
    rows = [("".join(rng.choices(parts, k=rng.randrange(12))),) for _ in range(3_000)]
    found = spark.createDataFrame(rows, "t string").select("t", clean_text(F.col("t")).alias("c")).collect()
    assert all(r["c"] == cleaned(r["t"]) for r in found)


def test_a_long_run_without_blanks_is_cleaned_in_time(spark):
    df = spark.range(4).select(F.repeat(F.lit("x"), 200_000).alias("t"))
    began = time.monotonic()
    assert df.select(F.sum(F.length(clean_text(F.col("t"))))).first()[0] == 800_000
    assert time.monotonic() - began < 20  # seeking an address from each character on took minutes


def test_tickets_are_cleaned_once(spark):
    df = tk.preprocess_tickets(raw_tickets(spark, [("a", "b", "q")]))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_series_are_named_by_their_files_without_patterns(spark, tmp_path):
    rows = "timestamp,value,label\n1,2.5,0\n2,3.5,1\n"
    for family, name in (("svc1", "cpu.total.csv"), ("a b", "load.csv"), ("svc1", "plain")):
        (tmp_path / family).mkdir(exist_ok=True)
        (tmp_path / family / name).write_text(rows)
    df = read_series(spark, f"{tmp_path}/*/*", 2)
    assert {(r["family"], r["series_id"]) for r in df.collect()} == {("svc1", "cpu.total"), ("a%20b", "load"), ("svc1", "")}
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
