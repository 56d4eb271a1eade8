"""Term runs and the sums of a linear fit, without a (non-zeros x classes) table."""

from __future__ import annotations

import tracemalloc

import numpy as np

from faultline.operators import linear as li


def test_runs_of_a_text():
    assert li.word_runs("Foo bar_1, é ÀB") == ["foo", "bar_1", "àb", "foo bar_1", "bar_1 àb"]
    assert li.character_runs("ab\n ") == [" ab", "ab ", " ab ", "   "]
    assert li.word_runs("") == li.character_runs("") == []


def test_margins_with_empty_rows_and_little_memory():
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 400, 500) * (rng.random(500) < 0.8)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index, value, weights = rng.integers(0, 50, offsets[-1]), rng.random(offsets[-1]), rng.normal(0, 1, (51, 10))
    dense = np.zeros((500, 50))
    np.add.at(dense, (np.repeat(np.arange(500), lengths), index), value)
    tracemalloc.start()
    found = li.margins(offsets, index, value, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(found, dense @ weights[:-1] + weights[-1])
    assert peak < offsets[-1] * 10 * 8  # before, one number for each non-zero and class


def test_terms_are_counted_before_they_move(spark):
    df = spark.createDataFrame([("ab ab",), ("ab",), (None,)], "t string")
    found = {r["term"]: (r["df"], r["tf"]) for r in li.counted_terms(df, "t", li.character_runs).collect()}
    assert found == {" ab": (2, 3), "ab ": (2, 3), " ab ": (2, 3)}
