"""How far the sources of a language differ in their words, and by which.

Terms are counted where the texts are read: a term of up to 8 bytes is one 64-bit word, of up to 16 bytes two, and those are radix-sorted by
16-bit digits; longer terms are sorted as bytes, in a bucket for each width. Runs of a sorted order are the counts. Only counts are shuffled,
summed once more before they move.

The distance of two sources is a sum over all terms of the language. Most terms of a large language are in few sources, so a
pair's sum is the distance of two absent terms, taken once for every term, plus what each term that occurs adds to it. Those parts are
summed for blocks of terms and of sources, of fixed size both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import pieces
from faultline.session import materialize, ship_package

TEXT_BYTES = 4_000_000
#: Terms of more bytes are sorted one by one, not as rows of one width.
WIDEST = 128
#: A task compares this many sources with as many, over about this many terms.
SOURCES, TERMS = 64, 4096

_BYTES = np.arange(256)
_IN_TERM = (_BYTES >= 0x80) | ((_BYTES | 0x20 >= ord("a")) & (_BYTES | 0x20 <= ord("z")) & (_BYTES >= 0x41))
_LOWER = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES | 0x20, _BYTES).astype(np.uint8)

Counted = tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]


def radix_order(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """``order`` sorted by unsigned keys, the last one first in weight: stable passes over 16-bit digits."""
    for key in keys:
        top = int(key.max()) if len(key) else 0
        for shift in range(0, top.bit_length(), 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(order: np.ndarray, keys: list[np.ndarray], group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the runs of equal key and group, their lengths, and the numbers of different documents in them."""
    fresh = np.ones(len(order), bool)
    fresh[1:] = False
    for key in [*keys, group]:
        sorted_key = key[order]
        fresh[1:] |= sorted_key[1:] != sorted_key[:-1]
    starts = np.flatnonzero(fresh)
    d = doc[order]
    fresh[1:] |= d[1:] != d[:-1]
    return starts, np.diff(starts, append=len(order)), np.add.reduceat(fresh.astype(np.int64), starts)


def count_terms(data: np.ndarray, bounds: np.ndarray, groups: np.ndarray) -> Iterator[Counted]:
    """Terms of texts (text i is data[bounds[i]:bounds[i + 1]]) with their group, occurrences and documents, a part for each length of term.

    A term is in the result once for each group."""
    inside = _IN_TERM[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[first] = False
    after[first[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(bounds, starts, side="right") - 1
    group, length = groups[doc].astype(np.uint64), ends - starts
    body = np.concatenate([_LOWER[data], np.zeros(WIDEST, np.uint8)])
    words = np.ndarray((len(body) - 7,), ">u8", body.tobytes(), strides=(1,))

    def word(rows: np.ndarray, at: int) -> np.ndarray:
        """Bytes ``at`` to ``at`` + 8 of the terms, high byte first, zeros behind the end."""
        behind = ((8 - np.minimum(length[rows] - at, 8)) * 8).astype(np.uint64)
        return (words[starts[rows] + at].astype(np.uint64) >> behind) << behind

    for low, high in ((1, 8), (9, 16)):
        rows = np.flatnonzero((length >= low) & (length <= high))
        if len(rows):
            keys = [word(rows, at) for at in range(0, high, 8)]
            order = radix_order([group[rows], *reversed(keys)], np.arange(len(rows)))
            run, n, docs = _runs(order, keys, group[rows], doc[rows])
            found = np.column_stack([k[order[run]] for k in keys]).astype(">u8").view(f"S{high}").ravel().tolist()
            yield found, group[rows][order[run]], n, docs
    for width in range(24, WIDEST + 8, 8):
        rows = np.flatnonzero((length > width - 8) & (length <= width))
        if len(rows):
            cells = body[starts[rows][:, None] + np.arange(width)]
            cells[np.arange(width) >= length[rows][:, None]] = 0
            key = np.ascontiguousarray(cells).view(f"S{width}").ravel()
            order = np.argsort(group[rows], kind="stable")
            order = order[np.argsort(key[order], kind="stable")]
            run, n, docs = _runs(order, [key], group[rows], doc[rows])
            yield key[order[run]].tolist(), group[rows][order[run]], n, docs
    rows = np.flatnonzero(length > WIDEST)
    if len(rows):
        terms = [body[a:b].tobytes() for a, b in zip(starts[rows], ends[rows])]
        order = np.array(sorted(range(len(rows)), key=lambda i: (terms[i], group[rows[i]])))
        key = np.empty(len(rows), object)
        key[:] = terms
        run, n, docs = _runs(order, [key], group[rows], doc[rows])
        yield key[order[run]].tolist(), group[rows][order[run]], n, docs


def _long_text(data: np.ndarray) -> Counted:
    """The terms of one text that is counted in parts; each part ends where no term is."""
    totals: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        end = min(at + TEXT_BYTES, len(data))
        while end < len(data):
            gaps = np.flatnonzero(~_IN_TERM[data[end : end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + 4096, len(data))
        for terms, _, n, _ in count_terms(data[at:end], np.array([0, end - at]), np.zeros(1, np.int64)):
            for term, k in zip(terms, n.tolist()):
                totals[term] = totals.get(term, 0) + k
        at = end
    one = np.zeros(len(totals), np.uint64)
    return list(totals), one, np.fromiter(totals.values(), np.int64, len(totals)), one.astype(np.int64) + 1


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with every text above TEXT_BYTES in one of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        at = 0
        for i in np.flatnonzero(sizes > TEXT_BYTES).tolist():
            if i > at:
                yield batch.slice(at, i - at)
            yield batch.slice(i, 1)
            at = i + 1
        if at < batch.num_rows:
            yield batch.slice(at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for batch in pieces(_apart(batches), "text", TEXT_BYTES):
        both = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        labels: dict[tuple, int] = {}
        groups = np.array([labels.setdefault((r["lang"], r["source"]), len(labels)) for r in both.to_pylist()], np.int64)
        lang, source = (pa.array([x[i] for x in labels], pa.string()) for i in (0, 1))
        text = batch.column("text").cast(pa.large_binary())
        bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        found = [_long_text(data)] if len(text) == 1 and len(data) > TEXT_BYTES else count_terms(data, bounds - bounds[0], groups)
        for terms, group, n, docs in found:
            at = pa.array(group.astype(np.int64))
            yield pa.RecordBatch.from_arrays([lang.take(at), source.take(at), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(docs)], names=names)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it); a null text, lang or source is empty. A row is a document."""
    ship_package(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = plain.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, terms: str) -> F.Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) in whole numbers; null without terms."""
    return F.expr(f"CAST(1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({count} + 5 AS DECIMAL(20, 0))) div nullif(CAST({total} + 5 * {terms} AS DECIMAL(20, 0)), 0) AS LONG)")


def _block_distances(block: pd.DataFrame) -> pd.DataFrame:
    """What the terms of a block add to the distances of its sources. Rows without a term name the sources."""
    members = block[block["term"].isna()].drop_duplicates("place").sort_values("place")
    sources, absent = members["source"].to_numpy(), members["p"].to_numpy(np.int64)
    left = members["side_a"].to_numpy(bool)
    right = members["side_b"].to_numpy(bool)
    cells = block[block["term"].notna()]
    row = pd.factorize(cells["term"])[0]
    shares = np.tile(absent, (row.max() + 1 if len(row) else 0, 1))
    shares[row, np.searchsorted(members["place"].to_numpy(), cells["place"].to_numpy())] = cells["p"].to_numpy(np.int64)
    all_terms = int(members["terms"].iat[0])
    same = block["a"].iat[0] == block["b"].iat[0]
    out = []
    for i in np.flatnonzero(left):
        apart = np.abs(absent - absent[i])
        value = np.abs(shares - shares[:, i : i + 1]).sum(axis=0) - len(shares) * apart + all_terms * apart
        other = np.flatnonzero(right & (np.arange(len(sources)) != i))
        out.append((np.repeat(i, len(other)), other, value[other]))
        if not same:
            out.append((other, np.repeat(i, len(other)), value[other]))
    i, j, value = (np.concatenate(x) for x in zip(*out))
    return pd.DataFrame({"lang": block["lang"].iat[0], "source": sources[i], "item": sources[j], "value": value})


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of all pairs of different sources of a language."""
    placed = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    placed = placed.withColumn("blocks", F.expr(f"int((count(*) OVER (PARTITION BY lang) - 1) div {SOURCES} + 1)"))
    parts = F.expr(f"int(greatest(1, (terms + {TERMS} - 1) div {TERMS}))")
    placed = materialize(placed.withColumns({"parts": parts, "block": F.expr(f"int(place div {SOURCES})")}))
    cells = kept.join(placed.select("lang", "source", "place", "block", "blocks", "parts"), ["lang", "source"])
    cells = cells.select("lang", "source", "place", "block", "blocks", "term", "p", F.pmod(F.xxhash64("term"), "parts").cast("int").alias("part"), F.lit(0).cast("long").alias("terms"))
    members = placed.select("lang", "source", "place", "block", "blocks", F.lit(None).cast("string").alias("term"), F.coalesce("absent", F.lit(0)).alias("p"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "terms")
    # All terms count once with the distance of absent ones: in part 0.
    members = members.withColumn("terms", F.when(F.col("part") == 0, F.col("terms")).otherwise(0))
    rows = cells.unionByName(members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    rows = rows.withColumns({"side_a": F.col("block") == F.col("a"), "side_b": F.col("block") == F.col("b")})
    found = rows.groupBy("lang", "part", "a", "b").applyInPandas(_block_distances, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    A language keeps the terms (runs of letters A-Z and characters beyond ASCII, A-Z in lower case) that at least ``least_docs`` of its documents have. A source's
    share of a term is 1 + floor(10^9 (count + 5) / (N + 5 V)), N its kept occurrences, V the kept terms. Part "pair": another source of the
    language, the sum of the differences over all kept terms; part "term": the ``top`` terms of which the source has more than
    the language. Ranks go by value, then bytes of the item.

    Null text, lang and source are empty texts; a source without terms takes part with counts of 0, and without kept terms all its
    distances are 0. Repeated rows are documents of their own. A very long text is counted in parts between terms. An empty table has
    no rows. Other columns are not read, so their names cannot clash."""
    counts = materialize(term_counts(docs))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("all_docs")).where(F.col("all_docs") >= least_docs)
    kept = materialize(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang", "term").agg(F.first("all_n").alias("all_n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = materialize(groups.withColumn("absent", _share("0L", "total", "terms")))
    shares = materialize(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "terms").alias("p"), _share("all_n", "lang_total", "terms").alias("q")))
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top_terms = over.withColumn("rank", ranked).where(F.col("rank") <= top)
    pairs = _pairs(shares, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", ranked)
    return pairs.unionByName(top_terms)
