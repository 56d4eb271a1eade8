"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle, as connected components.

Sets of word shingles fall into size bands. A link (a Jaccard likeness of at least ``similarity``) within a band allows at most H
differing shingles, so the shingle universe is hashed into segments with thresholds e (0: the segment must be equal, 1: equal up to
one shingle, found by indexing every one-deletion variant) whose sum of e + 1 is above H: some segment of every linked pair is within
its threshold. How many segments get e = 1 is chosen per band by expected cost. A set whose segments of more than e shingles alone
have a sum above what it may differ by is found by one of these, so it needs no signature of an empty segment, which it would share
with all sets that lack the same one; a few spare segments make that the rule. Records near a band's lower end also use the scheme
of the band below, in which a smaller partner may lie.

Sets that share a segment signature form a bucket. No bucket is expanded into all its pairs: small ones (SMALL sets) are
compared in full, larger ones only with one of them, r. What is left are pairs of which one is not linked to r. With
D(x) the difference of x and r, |x xor y| is |D(x)| + |D(y)| minus twice what D(x) and D(y) share, so such a pair shares at least
some elements of D, and one of the rarest few of both: these key new buckets, which lack r and go through the same step, or,
up to FEW members, through a test of each pair's sizes and positions. Every comparison is an exact set intersection.
Components come from large-star/small-star rounds on the verified links.

Edge cases: null or blank text has no shingles, is linked with nothing and is its own component. With fewer words than a
shingle has, the whole sequence is the one shingle. Equal sets are folded first (they are linked, J = 1). Rows with a null id
are linked with nothing and get a null component. Repeated rows are returned as often as they occur. An empty table gives no
rows. Other input columns are ignored. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import exp, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Words, bytes_of, mix, pieces, runs, signed, sized
from faultline.session import discard, materialize, ship_package

#: A bucket of at most SMALL sets that share a segment is compared in full, one of at most FEW that share a difference as far as its
#: members can link.
SMALL, FEW = 12, 128
#: Upper size of a band over its lower size: about 0.9 ** -3, so that most sets need one scheme.
BAND = 1.37
#: For the cost model: the chance that a shingle of COMMON_WIDTH words of one set is in another, and sets a segment is compared with.
COMMON, COMMON_WIDTH, OTHERS = 0.05, 3, 1e7

_U = np.uint64


class Limit(NamedTuple):
    """Sets x and y link when intersection / union >= part / whole, that is more * |x xor y| <= less * (|x| + |y|)."""

    part: int
    whole: int

    @property
    def more(self) -> int:
        return self.whole + self.part

    @property
    def less(self) -> int:
        return self.whole - self.part

    def errors(self, size: int) -> int:
        """The most shingles by which a set of this size, or a smaller one, differs from a linked one that is not smaller."""
        return size * self.less // self.part


NEAR = Limit(9, 10)


def limit_of(similarity: float) -> Limit:
    """Exactly the decimal that is written; binary 0.8 is a little more."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    return Limit(*Fraction(str(similarity)).as_integer_ratio())


@cache
def bands() -> np.ndarray:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(int(edges[-1] * BAND), edges[-1] + 1))
    return np.array(edges)


@cache
def allocation(band: int, limit: Limit = NEAR, width: int = COMMON_WIDTH) -> tuple[int, int]:
    """(segments, those of them with threshold 1) of least expected cost for the band."""
    most = int(bands()[band + 1]) - 1
    errors = limit.errors(most)
    chance = COMMON ** (width / COMMON_WIDTH)
    spare = 0
    for _ in range(8):  # as many as are empty in almost every set; the result holds with any number
        empty = (errors + 1 + spare) * exp(-most / (errors + 1 + spare))
        spare = min(int(empty + 3 * sqrt(empty)), errors)
    best = None
    for ones in range((errors + 1) // 2 + 1):
        segments = errors + 1 - ones + spare
        size = most / segments
        signatures = segments - ones + ones * (size + 1)
        false = (segments - ones) * chance**size + ones * (size + 1) * chance ** max(size - 1, 0)
        cost = signatures + OTHERS * false
        if best is None or cost < best[0]:
            best = cost, segments, ones
    return best[1], best[2]


def signatures(shingles: np.ndarray, limit: Limit = NEAR, width: int = COMMON_WIDTH) -> np.ndarray:
    """Of one sorted set. Sets that are too small to differ link only with equal sets and need none."""
    n = len(shingles)
    errors = limit.errors(n)
    if not errors:
        return np.empty(0, np.uint64)
    low, high = np.searchsorted(bands(), [-(-limit.part * n // limit.whole), n], side="right") - 1
    found = []
    for band in range(low, high + 1):
        segments, ones = allocation(band, limit, width)
        # The smaller set of a pair found by this scheme lies in its band: a larger one must not count the errors of its own size.
        most = min(errors, limit.errors(int(bands()[band + 1]) - 1))
        salt = _U(band * 2 + 1)
        value = mix(shingles, np.full(n, salt))
        segment = (value >> _U(20)) % _U(segments)
        order = np.argsort(segment, kind="stable")
        value, segment = value[order], segment[order]
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.zeros(segments, np.uint64)
        total = np.zeros(segments, np.uint64)
        at = segment[starts].astype(np.int64)
        size[at] = np.diff(np.r_[starts, n]).astype(np.uint64)
        total[at] = np.add.reduceat(value, starts)
        key = mix(np.arange(segments, dtype=np.uint64), np.full(segments, salt))
        enough = int((size[:ones] > 1).sum()) * 2 + int((size[ones:] > 0).sum()) > most
        found.append(mix(total + size, key)[size > 0] if enough else mix(total + size, key))
        if ones:
            mine = segment < ones
            s = segment[mine].astype(np.int64)
            if enough:
                mine[mine] = size[s] > 1
                s = s[size[s] > 1]
            found.append(mix(total[s] - value[mine] + size[s] - _U(1), key[s]))
    return np.unique(np.concatenate(found))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z in lower case."""
    words = Words(texts, lower=True)
    h = words.hashes()
    full = runs(h, width)
    sets = []
    for start, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if end - start >= width:
            sets.append(np.unique(full[start : end - width + 1]))
        else:
            sets.append(runs(h[start:end], end - start) + _U(end - start) if end > start else np.empty(0, np.uint64))
    return sets


def set_id(shingles: np.ndarray) -> int | None:
    if not len(shingles):
        return None
    total = np.add.reduce(mix(shingles, np.full(len(shingles), _U(97))))
    return int(signed(mix(np.array([total], np.uint64), np.array([len(shingles)], np.uint64)))[0])


def _described(docs: DataFrame, text: str, width: int, limit: Limit) -> DataFrame:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sets = shingle_sets(bytes_of(batch.column(text)), width)
            signs = [signed(signatures(s, limit, width)) for s in sets]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_id": pa.array([set_id(s) for s in sets], pa.int64()),
                    "signs": pa.array(signs, pa.list_(pa.int64())),
                }
            )

    return docs.mapInArrow(describe, "doc_id long, n_shingles long, set_id long, signs array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, text: str, width: int) -> DataFrame:
    """(id, shingles) of the wanted (doc_id, set_id)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sets = shingle_sets(bytes_of(batch.column(text)), width)
            right = [set_id(s) == want for s, want in zip(sets, batch.column("set_id").to_pylist())]  # an id may be repeated
            yield pa.record_batch({"id": batch.column("set_id").filter(pa.array(right)), "shingles": pa.array([s.tobytes() for s, ok in zip(sets, right) if ok], pa.binary())})

    rows = docs.join(wanted, "doc_id").select("doc_id", text, "set_id").mapInArrow(read, "id long, shingles binary")
    return rows.dropDuplicates(["id"])


def _compare(pairs: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """pairs (a, b, star) to verified links (a, b) and, of star pairs, the difference of id to its leader a: its elements, how many
    of them a partner may be found by (take), the size of the set, and whether id is not linked to a (open)."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    some = sets.join(sized(ids), "id", "left_semi")  # later rounds ask for few
    left = some.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = some.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.join(right, "b").join(left, "a")
    more, less = limit.more, limit.less

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links, stars = ([], []), ([], [], [], [], [], [])
            for a, b, star, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "star", "sa", "sb"))):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                differ = len(both) - 2 * common
                linked = more * differ <= less * len(both)
                if linked:
                    links[0].append(a)
                    links[1].append(b)
                if star:
                    shared = (less * len(x) + more * differ - less * len(y)) // (2 * more) + 1 if linked else differ - limit.errors(len(y))
                    take = differ - max(shared, 1) + 1
                    if take > 0:
                        for column, value in zip(stars, (a, b, len(y), take, not linked, signed(np.setxor1d(x, y, assume_unique=True)))):
                            column.append(value)
            n, m = len(links[0]), len(stars[0])
            yield pa.record_batch(
                {
                    "a": pa.array(links[0] + stars[0], pa.int64()),
                    "b": pa.array(links[1] + [None] * m, pa.int64()),
                    "id": pa.array([None] * n + stars[1], pa.int64()),
                    "size": pa.array([None] * n + stars[2], pa.int64()),
                    "take": pa.array([None] * n + stars[3], pa.int32()),
                    "open": pa.array([None] * n + stars[4], pa.bool_()),
                    "elements": pa.array([None] * n + stars[5], pa.list_(pa.int64())),
                }
            )

    return rows.select("a", "b", "star", "sa", "sb").mapInArrow(check, "a long, b long, id long, size long, take int, open boolean, elements array<long>")


def _phi(limit: Limit) -> Column:
    """At most less * |r| if a set is linked to the leader r of its star."""
    return limit.more * F.col("differ") - limit.less * F.col("size")


def _opened(checked: DataFrame, limit: Limit) -> DataFrame:
    """New buckets (key, id, size, differ, at, open): the ``take`` rarest elements of each difference, rarest within its star first.
    ``at`` is how many rarer ones an id has before."""
    star = checked.where("elements IS NOT NULL").select("a", "id", "size", "take", "open", F.size("elements").alias("differ"), "elements")
    each = star.select("a", "id", "open", F.explode("elements").alias("e"))
    often = each.groupBy("a", "e").agg(F.count("*").alias("f"), F.max("open").alias("any")).where("f > 1")
    common = each.join(often, ["a", "e"]).groupBy("a", "id").agg(F.array_sort(F.collect_list(F.struct("f", "e", "any"))).alias("common"))
    alone = F.col("differ") - F.size("common")  # elements no other id of the star has come first
    first = star.drop("elements").join(common, ["a", "id"]).select("a", "id", "size", "differ", "open", alone.alias("alone"), F.posexplode(F.slice("common", 1, F.greatest(F.col("take") - alone, F.lit(0)))).alias("k", "c"))
    member = first.where("c.any").select(F.xxhash64("a", "c.e").alias("key"), "id", "size", "differ", (F.col("alone") + F.col("k")).alias("at"), "open")
    # A linked pair shares at least (phi(x) + phi(y)) / (2 * more) elements, and at most what either has from the bucket's element on.
    phi, room = _phi(limit), 2 * limit.more * (F.col("differ") - F.col("at"))
    bounds = member.groupBy("key").agg(F.min(phi).alias("low"), F.max(room - phi).alias("high"))
    return member.join(bounds, "key").where((phi + F.col("low") <= room) & (phi <= F.col("high"))).select(*member.columns)


def _close(groups: DataFrame, limit: Limit) -> DataFrame:
    """Pairs of a bucket's members that can link: by their sizes, or as their differences can still share enough behind its element."""
    more, less = limit.more, limit.less

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for members in batch.column("members").to_pylist():
                ids = np.array([m["id"] for m in members])
                x, y = np.triu_indices(len(ids), 1)
                size = np.array([m["size"] for m in members])
                if members[0]["differ"] is None:
                    can = limit.whole * np.minimum(size[x], size[y]) >= limit.part * np.maximum(size[x], size[y])
                else:
                    differ, at, unlinked = (np.array([m[c] for m in members]) for c in ("differ", "at", "open"))
                    left = differ - at
                    need = np.maximum(-(-(more * (differ[x] + differ[y]) - less * (size[x] + size[y])) // (2 * more)), 1)
                    can = (np.minimum(left[x], left[y]) >= need) & (unlinked[x] | unlinked[y])
                x, y = x[can], y[can]
                found_a.append(np.minimum(ids[x], ids[y]))
                found_b.append(np.maximum(ids[x], ids[y]))
            if found_a:
                yield pa.record_batch({"a": pa.array(np.concatenate(found_a)), "b": pa.array(np.concatenate(found_b))})

    return groups.mapInArrow(close, "a long, b long")


def _pairs(buckets: DataFrame, few: int, limit: Limit) -> DataFrame:
    """Distinct pairs to compare: those of a bucket of up to ``few`` sets that can link; of a larger one those with its leader, the
    set that links by nearness to the last leader alone if any does."""
    nearest = F.struct(_phi(limit).alias("phi"), "id")
    groups = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(nearest)["id"].alias("leader"), F.max(F.coalesce("open", F.lit(True))).alias("any")).where("n > 1 AND any")
    member = buckets.join(groups.drop("any"), "key")
    star = member.where((F.col("n") > few) & (F.col("id") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("id").alias("b"), F.lit(True).alias("star"))
    small = member.where(F.col("n") <= few).groupBy("key").agg(F.collect_list(F.struct("id", "size", "differ", "at", "open")).alias("members"))
    close = _close(small.select("members"), limit).withColumn("star", F.lit(False))
    return star.unionByName(close).groupBy("a", "b").agg(F.max("star").alias("star"))


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every vertex of links (a, b): root is the least id of its component."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.least("m", "v").alias("u")).distinct()
        wide = materialize(large)
        small = wide.join(wide.groupBy("v").agg(F.min("u").alias("m")), "v")
        pair = F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        after = materialize(small.select(pair.alias("p")).select("p.v", "p.u").where("v <> u").distinct())
        discard(edges, wide)
        edges = after
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return edges.select(F.col("v").alias("id"), F.col("u").alias("root"))


def near_classes(docs: DataFrame, text: str = "text", width: int = 3, similarity: float = 0.9) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    limit = limit_of(similarity)
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    described = materialize(_described(docs, text, width, limit))
    signs = described.where("doc_id IS NOT NULL AND size(signs) > 0").select("set_id", F.col("n_shingles").alias("size"), F.explode("signs").alias("key"))
    shared = materialize(signs.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("key"))
    first = materialize(signs.join(sized(shared), "key").select("key", F.col("set_id").alias("id"), "size").distinct())
    ids = first.select(F.col("id").alias("set_id")).distinct()
    plain = materialize(described.select("doc_id", "n_shingles", "set_id"))
    wanted = materialize(plain.where("doc_id IS NOT NULL").join(ids, "set_id").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")))
    sets = materialize(_sets(docs, sized(wanted), text, width))
    none = {"differ": "int", "at": "int", "open": "boolean"}
    discard(described, shared)
    buckets = first.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    found, few = [], SMALL
    while True:
        pairs = materialize(_pairs(buckets, few, limit))
        checked = materialize(_compare(pairs, sets, limit))
        discard(pairs)
        found.append(checked.where("b IS NOT NULL").select("a", "b"))
        if not checked.where("elements IS NOT NULL").limit(1).count():
            break
        buckets, few = materialize(_opened(checked, limit)), FEW
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    discard(sets, first)
    root = components(links)
    rooted = plain.join(sized(root.withColumnRenamed("id", "set_id")), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = materialize(rooted.select("doc_id", "n_shingles", "root"))
    least = rooted.where("doc_id IS NOT NULL AND root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("first"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", component.alias("component_id"))
