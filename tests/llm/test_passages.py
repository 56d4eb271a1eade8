"""Benchmark passages with capitals, numbers and names in all places."""

import pytest

from faultline.llm import decontaminate
from faultline.llm.decontaminate import contaminated

ITEMS = [
    (1, "On Monday the guard asked Will about the red key in the old cellar"),
    (2, "People will often ask for a mark when the day is over and may wait"),
    (3, "The river bends near the mill.\nThe boats stop there in the early evening"),
    (4, "Which is right?\nA) the first B) a second C) the third D) none of them"),
    (5, "12 14 19 27 33 48 52 61 70 88"),
    (6, "Ann Bob Cid Dora Eve Finn Gus Hal"),
    (7, "In the spring Mark sold nine of the brown horses to the miller"),
]
FILL = "before it some words stand here "


@pytest.mark.parametrize("words", [1_000_000, 2])
def test_exact_passages_are_found(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(10 * i + k, FILL + form(text) + " and after it") for i, text in ITEMS for k, form in enumerate((str, str.lower, str.title, str.upper))]
    rows += [(901, "nothing of the kind"), (902, None), (903, "")]
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["exact"]) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(10 * i + k, i): (1.0, True) for i, _ in ITEMS for k in range(4)}


@pytest.mark.parametrize("words", [1_000_000, 2])
def test_other_names_are_found(spark, monkeypatch, words):
    """'will' and 'mark' are ordinary words of another item; a name may still be another one, a sentence's first word may not."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(1, FILL + ITEMS[0][1].replace("Will", "Peter")), (2, FILL + ITEMS[0][1].replace("Monday", "May")), (7, ITEMS[6][1].replace("Mark", "Will")), (8, "Small boats stop there in the early evening")]
    got = {(r["doc_id"], r["item_id"], r["exact"]) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got >= {(1, 1, False), (2, 1, False), (7, 7, False)} and 8 not in {g[0] for g in got}
