"""Removal of word passages that an earlier document holds, found through difference-cover anchors.

A perfect difference cover D of period v has, for any two positions i and j, a shift k < v with i + k and j + k both in D modulo
v. So two equal windows of WINDOW words hold an equal run of WINDOW - v + 1 words that starts at a cover position in both
documents. Only these runs (|D| / v of all positions) are hashed and grouped. Where an anchor occurs in two different texts, the
windows around it are candidates: their full hashes are grouped to the smallest doc_id in which each starts, and a window is
removed where that is another document. Exact copies are folded beforehand, so a group of copies costs one text.

Edge cases: a null or blank text has no words. Fewer than WINDOW words: nothing is removed. Windows are judged on the input, so
a passage may go although the earlier document loses its own copy to a still earlier one. Rows with the same doc_id are one
document: nothing is removed between them, and a window found in one is removed at the same place of all. Rows with a null
doc_id lose nothing. An empty table gives no windows. Other columns are carried; n_words and n_removed are replaced. Word
sequences are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import Words, bytes_of, pieces, runs, sequence_hash, signed, sized, starts_in
from faultline.session import discard, materialize, ship_package

WINDOW = 50
#: A perfect difference cover: every remainder modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def cover_positions(length: int) -> np.ndarray:
    base = np.arange(0, length, PERIOD)[:, None] + np.array(COVER)
    flat = base.ravel()
    return flat[flat < length]


def _sequences(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, n_words, hash of the whole word sequence."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            words = [t.split() if t else [] for t in bytes_of(batch.column(text))]
            seqs = signed(np.fromiter(map(sequence_hash, words), np.uint64, len(words)))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array([len(w) for w in words], pa.int64()), "seq": pa.array(seqs)})

    return docs.mapInArrow(read, "doc_id long, n_words long, seq long")


def _anchors(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(anchor, seq, pos) of every cover position."""
    width = window - PERIOD + 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            words = Words(bytes_of(batch.column(text)), sequences=True)
            anchor = runs(words.hashes(), width)
            keys, seqs, positions = [], [], []
            for a, b, seq in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), words.sequences):
                if b - a >= window:
                    p = cover_positions(b - a - width + 1)
                    keys.append(anchor[a + p])
                    positions.append(p)
                    seqs.append(np.repeat(seq, len(p)))
            if keys:
                yield pa.record_batch({"anchor": pa.array(signed(np.concatenate(keys))), "seq": pa.array(signed(np.concatenate(seqs))), "pos": pa.array(np.concatenate(positions).astype(np.int32))})

    return docs.select(text).mapInArrow(read, "anchor long, seq long, pos int")


def _windows(candidates: DataFrame, text: str, window: int) -> DataFrame:
    """(key, doc_id, start) of every window that holds a shared anchor."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            words = Words(bytes_of(batch.column(text)))
            full = runs(words.hashes(), window)
            near = np.zeros(len(words.codes) + 1, np.int64)
            for a, n, found in zip(words.bounds[:-1].tolist(), words.lengths.tolist(), batch.column("anchors").to_pylist()):
                p = np.array(found, np.int64)
                p = p[p < n]
                np.add.at(near, a + np.maximum(p - PERIOD + 1, 0), 1)
                np.add.at(near, a + p + 1, -1)
            at = np.flatnonzero((np.cumsum(near[:-1]) > 0) & starts_in(words, window))
            owner = words.owner[at]
            ids = batch.column("doc_id").to_numpy()
            yield pa.record_batch({"key": pa.array(signed(full[at])), "doc_id": pa.array(ids[owner]), "start": pa.array((at - words.bounds[owner]).astype(np.int32))})

    return candidates.select("doc_id", text, "anchors").mapInArrow(read, "key long, doc_id long, start int")


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, begins, ends): the runs of words of a document that are covered by windows which a smaller doc_id has too."""
    ship_package(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text)
    long = materialize(_sequences(docs, text).where(F.col("n_words") >= window))
    first = materialize(long.groupBy("seq").agg(F.min("doc_id").alias("first")))
    run = F.array(F.struct(F.lit(0).alias("b"), F.col("n_words").cast("int").alias("e")))
    copies = long.join(sized(first), "seq").where("doc_id > first").select("doc_id", run.alias("covered"))
    # An anchor counts when two different texts have it, so copies of one text never meet here.
    anchors = _anchors(docs, text, window)
    shared = anchors.groupBy("anchor").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).where("low < high").select("anchor")
    places = anchors.join(shared, "anchor").groupBy("seq").agg(F.collect_set("pos").alias("anchors"))
    wanted = materialize(places.join(first, "seq").select(F.col("first").alias("doc_id"), "anchors"))
    # Texts meet their anchors by a shuffle at every size; only texts with a shared anchor are kept.
    candidates = materialize(docs.join(wanted.hint("shuffle_merge"), "doc_id"))
    windows = _windows(candidates, text, window)
    least = windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key", "least")
    found = windows.join(least, "key").where("doc_id > least").groupBy("doc_id").agg(F.array_sort(F.collect_set("start")).alias("s"))
    s, last = F.col("s"), F.size("s") - 1
    begins = F.filter(s, lambda x, i: F.when(i == 0, True).otherwise(x - s[i - 1] > window))
    ends = F.transform(F.filter(s, lambda x, i: F.when(i == last, True).otherwise(s[i + 1] - x > window)), lambda x: x + window)
    found = found.select("doc_id", F.arrays_zip(begins.alias("b"), ends.alias("e")).alias("covered"))
    # An id may have several rows, of which one is a copy: the runs of an id are joined where they touch or overlap.
    each = found.unionByName(copies).groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("covered"))).alias("covered"), F.count(F.lit(1)).alias("lists"))
    none = F.array().cast("array<struct<b:int,e:int>>")

    def joined(done, x):
        ahead = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(ahead["b"].alias("b"), F.greatest(ahead["e"], x["e"]).alias("e"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["e"] >= x["b"]), grown).otherwise(F.concat(done, F.array(x)))

    one = F.when(F.col("lists") > 1, F.aggregate("covered", none, joined)).otherwise(F.col("covered"))
    result = materialize(each.select("doc_id", one.alias("covered")).select("doc_id", F.col("covered.b").alias("begins"), F.col("covered.e").alias("ends")))
    discard(wanted, candidates, long, first)
    return result


def cut(docs: DataFrame, repeated: DataFrame, text: str = "text", layout: bool = False) -> DataFrame:
    """Documents without the covered words: the kept words joined by one space. With ``layout``, rows that lose nothing keep
    their text as it is. Adds n_words and n_removed."""
    carried = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    plan = repeated.select(F.col("doc_id").alias("_id"), F.col("begins").alias("_begins"), F.col("ends").alias("_ends"))
    # Like the texts of the search: a shuffle at every size, as the runs grow with the input.
    joined = docs.select(*carried).join(plan.hint("shuffle_merge"), F.col("doc_id").cast("long") == F.col("_id"), "left").drop("_id")
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            kept, totals, removed = [], [], []
            for raw, begins, ends in zip(bytes_of(batch.column(text)), batch.column("_begins").to_pylist(), batch.column("_ends").to_pylist()):
                words = raw.split() if raw else []
                left = words
                if begins:
                    left = words[: begins[0]]
                    for end, begin in zip(ends, [*begins[1:], len(words)]):
                        left += words[end:begin]
                kept.append(raw if layout and len(left) == len(words) else b" ".join(left))
                totals.append(len(words))
                removed.append(len(words) - len(left))
            columns = [pa.array(kept, pa.binary()).cast(batch.column(c).type) if c == text else batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=[*carried, "n_words", "n_removed"])

    ship_package(docs.sparkSession)
    return joined.select(*carried, "_begins", "_ends").mapInArrow(apply, schema)
