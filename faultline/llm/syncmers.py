"""Document fingerprints from closed syncmers over words. DataFrame functions only.

A k-mer is a run of K words. It is chosen when the smallest hash of its inner runs of S words stands at its first or last place, which
depends on the k-mer alone, so the same passage gives the same k-mers wherever it stands. The fingerprint is the SKETCH smallest
hashes of a text's chosen k-mers; the likeness of two fingerprints is the share of common hashes among the SKETCH smallest
of both, an estimate of the Jaccard likeness of the k-mer sets.

Edge cases: a null or blank text has an empty fingerprint; two empty ones have likeness 1, an empty and another one 0. Texts
below K words, or without a chosen k-mer, are one k-mer as a whole. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import SPACES, sized
from faultline.session import materialize

#: Words of a k-mer and of its inner runs: five inner runs, of which two are edges, choose 2/5 of all k-mers.
K, S = 6, 2
SKETCH = 64


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, not once for each element of a lambda inside."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column) -> Column:
    """The fingerprint as a sorted array of 32-bit hashes."""
    words = F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def chosen(h: Column) -> Column:
        inner = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(h[i], h[i + 1]))

        def at(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.least(s[i], s[i + 4]) <= F.least(s[i + 1], s[i + 2], s[i + 3]))
            return F.transform(starts, lambda i: F.xxhash64(s[i], s[i + 2], s[i + 4]))

        return _let(inner, at)

    def least(h: Column) -> Column:
        kmers = F.when(F.size(h) >= K, chosen(h)).otherwise(F.array().cast("array<bigint>"))
        whole = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        some = _let(kmers, lambda k: F.when(F.size(k) > 0, k).otherwise(whole))
        return F.slice(F.array_sort(F.array_distinct(F.transform(some, lambda k: F.shiftright(k, 32).cast("int")))), 1, SKETCH)

    return _let(F.coalesce(hashes, F.array().cast("array<bigint>")), least)


def likeness(a: Column, b: Column) -> Column:
    def share(smallest: Column) -> Column:
        return F.when(F.size(smallest) == 0, 1.0).otherwise(F.size(F.array_intersect(smallest, F.array_intersect(a, b))) / F.size(smallest))

    return _let(F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH), share)


def printed(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) in ascending order, the first after the last, without ordering all ids in one task: ranges of ids, and
    the first id of each range."""
    ranged = materialize(ids.where("doc_id IS NOT NULL").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("doc_id").alias("head"))  # one row for each partition
    around = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy())).alias("after"))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(sized(materialize(around)), "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def compare_with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """Of every row: n_chars, its edited text (the last half, rounded down, replaced by as much of the next document's
    beginning), both fingerprints, and the likeness to the edited text and to the next document.

    The next document is the next larger doc_id; if that id has several rows, the one with the smallest beginning. Rows without an
    id have no next document: nothing comes in place of the half, near_next is 0. Other columns are dropped."""
    docs = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    lengths = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(half).alias("take"))
    asked = materialize(lengths.join(successors(docs.select("doc_id")), "doc_id").select(F.col("doc_id").alias("asker"), "next_id", "take"))
    given = docs.join(sized(asked), F.col("doc_id") == F.col("next_id")).select("asker", F.substring("text", F.lit(1), F.col("take")).alias("begin"), sketch(F.col("text")).alias("next_print"))
    given = given.groupBy("asker").agg(F.min(F.struct("begin", "next_print")).alias("next"))
    both = docs.join(given, F.col("doc_id") == F.col("asker"), "left")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.coalesce(F.substring("next.begin", F.lit(1), half), F.lit("")))
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("print"), F.col("next.next_print").alias("next_print"))
    both = both.withColumn("edited_print", sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        "edited",
        printed(F.col("print")).alias("fingerprint"),
        printed(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        F.coalesce(likeness(F.col("print"), F.col("next_print")), F.lit(0.0)).alias("near_next"),
    )
