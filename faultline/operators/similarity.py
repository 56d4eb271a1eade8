"""Text features in long form, exact nearest neighbours and near-duplicate pairs.

Vectors are rows (id, idx, val): sorted term numbers and unit-length weights. Term numbers
grow with document frequency, so a vector starts with its rarest terms.

Exact copies are folded before any comparison, so a text repeated over a third of the
table is compared once. The comparisons run in bounded blocks inside tasks that return
only their best rows; no pair list is ever emitted.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.skew import join_on, range_numbered
from faultline.session import materialize, ship_package, spread

WORD = r"[\p{L}\p{N}_]{2,}"
DIGITS = 9


def tokens(text: Column, stop_words: list[str] = ()) -> Column:
    """Words of two and more characters, in text order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def word_grams(words: Column, longest: int = 2) -> Column:
    """Words and runs of up to ``longest`` words. Built from shifted copies of the whole
    array, so the words are split once and not once per position."""
    grams, runs = [words], words
    for n in range(2, longest + 1):
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), count), F.slice(words, F.lit(n), count), lambda a, b: F.concat_ws(" ", a, b))
        grams.append(runs)
    return F.concat(*grams)


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside blank-padded words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        sizes = F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: n <= F.length(padded))
        return F.flatten(
            F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n)))
        )

    return F.flatten(F.transform(words, of_word))


def term_counts(df: DataFrame, id_col: str, base: Column, grams: Callable[[Column], Column]) -> DataFrame:
    """Terms of every document with their counts. ``base`` (such as the word list) is
    computed once per row, then ``grams`` turns it into terms."""
    based = spread(df).select(id_col, base.alias("_base"))
    terms = based.select(id_col, F.explode(grams(F.col("_base"))).alias("term"))
    return terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(
    df: DataFrame,
    id_col: str,
    base: Column,
    grams: Callable[[Column], Column] = word_grams,
    min_df: int = 2,
    max_features: int | None = None,
) -> DataFrame:
    """(id, term, idx, tf, weight): sublinear tf, smoothed idf, unit length per document. idx numbers the terms, rare ones first.

    Every term of at least ``min_df`` documents counts; ``max_features`` keeps only the terms used most often.
    """
    counts = materialize(term_counts(df, id_col, base, grams))
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("_uses")).filter(F.col("df") >= min_df)
    if max_features is not None:
        vocabulary = vocabulary.orderBy(F.col("_uses").desc(), "term").limit(max_features)
    vocabulary = range_numbered(vocabulary.select("term", "df"), ["df", "term"], "idx")
    n = df.agg(F.count(F.lit(1))).scalar()
    raw = (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    weighted = counts.join(vocabulary, "term").withColumn("_w", raw)
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return weighted.withColumn("weight", F.col("_w") / length).select(id_col, "term", "idx", "tf", "weight")


def vectors(weights: DataFrame, id_col: str) -> DataFrame:
    """One row per document: sorted terms, weights and a fingerprint of the raw counts."""
    cells = F.array_sort(F.collect_list(F.struct("idx", "weight", "tf")))
    packed = weights.groupBy(id_col).agg(cells.alias("_c"))
    raw = F.array_join(F.transform("_c", lambda c: F.concat_ws(":", c["idx"], c["tf"])), ",")
    return packed.select(
        F.col(id_col).alias("id"), F.col("_c.idx").alias("idx"), F.col("_c.weight").alias("val"), F.sha2(raw, 256).alias("copy_key")
    )


def dense_vectors(df: DataFrame, id_col: str, embedding: str) -> DataFrame:
    """Embeddings scaled to unit length, in the same form."""
    v = F.transform(embedding, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform(v, lambda x: F.try_divide(x, norm))
    return df.filter(F.size(embedding) > 0).select(
        F.col(id_col).alias("id"), F.sequence(F.lit(0), F.size(embedding) - 1).alias("idx"), unit.alias("val"),
        F.sha2(F.array_join(F.col(embedding).cast("array<string>"), ","), 256).alias("copy_key"),
    )


# --- dense blocks inside tasks -----------------------------------------------------------


def _matrix(idx: pd.Series, val: pd.Series, terms: np.ndarray) -> np.ndarray:
    """Rows as a dense matrix over the given sorted terms; other terms are left out."""
    out = np.zeros((len(idx), len(terms)))
    for row, (i, v) in enumerate(zip(idx, val)):
        i, v = np.asarray(i), np.asarray(v)
        at = np.searchsorted(terms, i)
        at[at == len(terms)] = 0
        known = terms[at] == i
        out[row, at[known]] = v[known]
    return out


def _terms(idx: pd.Series) -> np.ndarray:
    return np.unique(np.concatenate([np.asarray(i) for i in idx])) if len(idx) else np.array([], dtype=int)


VECTOR = "id long, idx array<int>, val array<double>"
FOUND = "id long, neighbour long, similarity double"


def _best_in_block(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> pd.DataFrame:
    rows: list[tuple[int, int, float]] = []
    if len(queries) and len(block):
        terms = _terms(block["idx"])
        index, ids = _matrix(block["idx"], block["val"], terms), block["id"].to_numpy()
        for start in range(0, len(queries), 256):
            part = queries.iloc[start : start + 256]
            scores = np.round(_matrix(part["idx"], part["val"], terms) @ index.T, DIGITS)
            for query, score in zip(part["id"].to_numpy(), scores):
                score = np.where(ids == query, -1.0, score)
                floor = np.partition(score, -k)[-k] if len(score) > k else -1.0
                near = np.flatnonzero((score >= floor) & (score > 0))
                order = near[np.lexsort((ids[near], -score[near]))][:k]
                rows += [(int(query), int(ids[i]), float(score[i])) for i in order]
    return pd.DataFrame(rows, columns=["id", "neighbour", "similarity"])


MAX_PIVOTS = 128
BLOCK_ROWS = 1024
QUERY_ROWS = 2048


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest corpus rows (cosine, itself left out) of every query.

    The corpus is cut into cells around at most 128 pivots and cells into blocks of about
    ``block_rows`` rows. A query first searches one block of its own cell; its k-th
    similarity then rules out every cell whose triangle-inequality bound is worse. Block
    and query groups are bounded, each returns k rows per query.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    size = corpus.count()
    if size == 0:
        return spark.createDataFrame([], FOUND)
    wanted = min(MAX_PIVOTS, max(1, math.ceil(size / block_rows)))
    pivots = corpus.orderBy(F.xxhash64("id"), "id").limit(wanted).select("idx", "val").toPandas()
    terms = _terms(pivots["idx"])
    shared = spark.sparkContext.broadcast((terms, _matrix(pivots["idx"], pivots["val"], terms)))

    def distances(batch: pd.DataFrame) -> np.ndarray:
        known, matrix = shared.value
        dots = _matrix(batch["idx"], batch["val"], known) @ matrix.T
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = distances(batch)
            yield batch.assign(cell=d.argmin(axis=1).astype("int32"), pivot_distance=d.min(axis=1))

    celled = VECTOR + ", cell int, pivot_distance double"
    placed = materialize(corpus.select("id", "idx", "val").mapInPandas(to_cells, celled))
    stats = {
        r["cell"]: (r["n"], r["radius"])
        for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("pivot_distance").alias("radius")).collect()
    }
    blocks = {cell: math.ceil(n / block_rows) for cell, (n, _) in stats.items()}
    per_cell = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    sub = F.pmod(F.xxhash64("id"), per_cell[F.col("cell")]).cast("int")
    index = placed.withColumn("sub", sub).drop("pivot_distance")
    asked = (placed.toDF(*placed.columns) if queries is corpus else materialize(queries.select("id", "idx", "val").mapInPandas(to_cells, celled))).filter(F.col("cell").isin(list(blocks)))
    first = asked.withColumn("sub", sub).drop("pivot_distance")
    near = materialize(_search(first, index, k))
    floor = near.groupBy("id").agg(F.min("similarity").alias("_min"), F.count(F.lit(1)).alias("_n"))
    floor = floor.select("id", F.when(F.col("_n") >= k, F.col("_min")).otherwise(F.lit(0.0)).alias("floor"))
    everyone = queries.select("id", "idx", "val").join(first.select("id", "cell", "sub"), "id", "left").join(floor, "id", "left")

    def to_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d = distances(batch)
            limit = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * batch["floor"].fillna(0.0).to_numpy())) + 1e-6
            nearest = d.min(axis=1)
            home, home_sub = batch["cell"].fillna(-1).to_numpy(), batch["sub"].fillna(-1).to_numpy()
            for cell, (_, radius) in stats.items():
                bound = np.maximum(d[:, cell] - radius, (d[:, cell] - nearest) / 2)
                for number in range(blocks[cell]):
                    keep = (bound <= limit) & ~((home == cell) & (home_sub == number))
                    if keep.any():
                        yield batch.loc[keep, ["id", "idx", "val"]].assign(cell=np.int32(cell), sub=np.int32(number))

    other = everyone.mapInPandas(to_blocks, VECTOR + ", cell int, sub int")
    return best_k(near.unionByName(_search(other, index, k)), k)


def best_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Queries against the block they name, at most QUERY_ROWS queries per group."""
    load = queries.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
    q = queries.join(load, ["cell", "sub"]).select("cell", "sub", part.alias("part"), "id", "idx", "val")
    i = index.join(load, ["cell", "sub"]).select(
        "cell", "sub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "idx", "val"
    )
    keys = ["cell", "sub", "part"]
    return q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(lambda a, b: _best_in_block(a, b, k), FOUND)


def knn_documents(vecs: DataFrame, k: int) -> DataFrame:
    """Exact k nearest other documents of every document, copies included.

    Only one document per copy group is searched. A group then offers its first k + 1
    members: a copy's nearest rows are its fellow copies, and of any other group no more
    than k rows can be needed.
    """
    groups = vecs.groupBy("copy_key").agg(F.min_by(F.struct("id", "idx", "val"), "id").alias("v"))
    reps = groups.select("copy_key", "v.*")
    reps = materialize(reps)
    found = materialize(knn_join(reps, reps, k))
    first = Window.partitionBy("copy_key").orderBy("id")
    members = vecs.select("copy_key", "id").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).drop("_n")
    own = members.select("copy_key", F.col("id").alias("neighbour"), F.lit(1.0).alias("similarity"))
    keyed = found.join(reps.select("id", "copy_key"), "id").join(
        reps.select(F.col("id").alias("neighbour"), F.col("copy_key").alias("_other")), "neighbour"
    )
    others = keyed.select("copy_key", "similarity", "_other").join(members.select(F.col("copy_key").alias("_other"), F.col("id").alias("neighbour")), "_other")
    offers = own.unionByName(others.select("copy_key", "neighbour", "similarity"))
    ranked = Window.partitionBy("copy_key").orderBy(F.col("similarity").desc(), "neighbour")
    offers = offers.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= k + 1).drop("_n")
    pairs = vecs.select("id", "copy_key").join(offers, "copy_key").filter(F.col("id") != F.col("neighbour"))
    return best_k(pairs.select("id", "neighbour", "similarity"), k)


def topk_similar(queries: DataFrame, corpus: DataFrame, k: int, small: int = 5_000) -> DataFrame:
    """k most similar corpus rows of every query. A counted small query set is sent to the
    tasks, which keep k rows per query while they read; a larger one is joined in blocks."""
    if queries.count() > small:
        return knn_join(queries, corpus, k)
    ship_package(queries.sparkSession)
    asked = queries.select("id", "idx", "val").toPandas()
    shared = queries.sparkSession.sparkContext.broadcast(asked)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            for start in range(0, len(batch), 4096):
                found = _best_in_block(shared.value, batch.iloc[start : start + 4096], k)
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["id", "similarity", "neighbour"], ascending=[True, False, True]).groupby("id").head(k)
        if best is not None:
            yield best

    return best_k(corpus.select("id", "idx", "val").mapInPandas(scan, FOUND), k)


# --- near duplicates ---------------------------------------------------------------------

PAIR = "a string, b string, similarity double, first long, second long"


def _first_mismatch(la, ia, lb, ib) -> tuple[int, int] | None:
    """Smallest (i, j) of members with different labels, from the least id of each label."""
    best = None
    for x, i in zip(la, ia):
        for y, j in zip(lb, ib):
            if x != y:
                pair = (min(i, j), max(i, j))
                best = pair if best is None or pair < best else best
    return best


def near_duplicates(vecs: DataFrame, labels: DataFrame, threshold: float, limit: int, posting_rows: int = 64) -> DataFrame:
    """The ``limit`` most similar pairs (cosine at or above the threshold) of documents
    with different labels, ordered by similarity and ids.

    The threshold falls in steps from 1 to the one asked for. A step finds every pair at or above its own threshold, so the first one with ``limit`` pairs
    has the result, and the leading terms that lower thresholds add, which many texts share, are not looked at.
    """
    ship_package(vecs.sparkSession)
    labelled = vecs.join(labels.select(F.col("id"), "label"), "id")
    units = labelled.groupBy("copy_key", "label").agg(F.min("id").alias("least"))
    named = units.groupBy("copy_key").agg(F.array_sort(F.collect_list(F.struct("label", "least"))).alias("_u"))
    reps = vecs.groupBy("copy_key").agg(F.min_by(F.struct("idx", "val"), "id").alias("v")).join(named, "copy_key")
    reps = materialize(
        reps.select(F.col("copy_key").alias("key"), "v.idx", "v.val", F.col("_u.label").alias("labels"), F.col("_u.least").alias("least"))
    )

    for step in dict.fromkeys([1.0, 1 - (1 - threshold) / 4, threshold]):
        pairs = materialize(_expanded(materialize(_similar_pairs(reps, step, limit, posting_rows)), reps, labelled, limit))
        if step <= threshold or pairs.count() >= limit:
            break
    return pairs.orderBy(F.col("similarity").desc(), "i", "j").limit(limit)


def _similar_pairs(reps: DataFrame, threshold: float, limit: int, posting_rows: int) -> DataFrame:
    """Pairs of different texts with different labels at or above the threshold.

    Prefix filter: with rare terms first, a pair above the threshold shares a term among
    the leading terms whose remainder is shorter than the threshold. Short posting lists
    give candidates whose bound (product over the shared leading terms plus the product of
    the remainders) is checked before any vector is moved. Lists longer than
    ``posting_rows`` are compared as block pairs inside tasks, each of which keeps its
    ``limit`` best rows in the final order, which loses nothing.
    """

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, idx, val in zip(batch["key"], batch["idx"], batch["val"]):
                v = np.asarray(val)
                rest = np.append(np.sqrt(np.maximum(0.0, np.cumsum((v * v)[::-1])[::-1])), 0.0)
                cut = int(np.count_nonzero(rest[:-1] >= threshold - 1e-9))
                if cut:
                    last = int(idx[cut - 1])
                    out += [(int(idx[p]), key, float(v[p]), float(rest[p + 1]), last, float(rest[cut])) for p in range(cut)]
            yield pd.DataFrame(out, columns=["term", "key", "w", "rest", "last", "rest_cut"])

    posted = reps.select("key", "idx", "val").mapInPandas(prefixes, "term int, key string, w double, rest double, last int, rest_cut double")
    sizes = posted.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    sized = materialize(posted.join(sizes, "term"))

    light = sized.filter(F.col("n") <= posting_rows).drop("n")
    other = light.select("term", *[F.col(c).alias("_" + c) for c in ("key", "w", "rest", "last", "rest_cut")])
    shared = light.join(other, "term").filter(F.col("key") < F.col("_key"))
    left_first = F.col("last") <= F.col("_last")
    tail = F.when(left_first, F.col("rest_cut") * F.col("_rest")).otherwise(F.col("rest") * F.col("_rest_cut"))
    bound = shared.groupBy(F.col("key").alias("a"), F.col("_key").alias("b")).agg(
        (F.sum(F.col("w") * F.col("_w")) + F.max_by(tail, "term")).alias("bound")
    )
    candidates = bound.filter(F.col("bound") >= threshold - 1e-6).select("a", "b")
    side = lambda name: reps.select(F.col("key").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("idx", "val", "labels", "least")])
    verify = candidates.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                _, x, y = np.intersect1d(r.idx_a, r.idx_b, assume_unique=True, return_indices=True)
                score = round(float(np.dot(np.asarray(r.val_a)[x], np.asarray(r.val_b)[y])), DIGITS)
                first = _first_mismatch(r.labels_a, r.least_a, r.labels_b, r.least_b) if score >= threshold else None
                if first is not None:
                    out.append((r.a, r.b, score, int(first[0]), int(first[1])))
            yield pd.DataFrame(out, columns=["a", "b", "similarity", "first", "second"])

    from_light = verify.mapInPandas(check, PAIR)

    heavy = sized.filter(F.col("n") > posting_rows).select("term", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")
    spread = heavy.join(reps, "key").withColumn("_own", own).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.select(
        F.col("term").alias("g"), F.least("_own", "_x").alias("ca"), F.greatest("_own", "_x").alias("cb"), F.col("_own").alias("own"), "key", "idx", "val", "labels", "least"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        best: list[tuple] = []
        dense = _matrix(group["idx"], group["val"], _terms(group["idx"]))
        crossing = group["ca"].iloc[0] != group["cb"].iloc[0]
        keys, owner = group["key"].to_numpy(), group["own"].to_numpy()
        labelled_as, least = group["labels"].to_list(), group["least"].to_list()
        for start in range(0, len(group), 256):
            scores = np.round(dense[start : start + 256] @ dense.T, DIGITS)
            for i, j in zip(*np.nonzero(scores >= threshold)):
                i, score = i + start, float(scores[i, j])
                if i >= j or (crossing and owner[i] == owner[j]):
                    continue
                first = _first_mismatch(labelled_as[i], least[i], labelled_as[j], least[j])
                if first is not None:
                    best.append((*sorted((keys[i], keys[j])), score, int(first[0]), int(first[1])))
            best = heapq.nsmallest(limit, best, key=lambda e: (-e[2], e[3], e[4]))
        return pd.DataFrame(best, columns=["a", "b", "similarity", "first", "second"])

    from_heavy = spread.groupBy("g", "ca", "cb").applyInPandas(compare, PAIR)
    return from_light.unionByName(from_heavy).distinct()


def _expanded(across: DataFrame, reps: DataFrame, labelled: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best pairs of documents from pairs of texts, and of the texts that have several labels themselves."""
    two = reps.filter(F.size("labels") > 1)
    ids = F.array_sort("least")
    inside = two.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity"), ids[0].alias("first"), ids[1].alias("second"))
    order = [F.col("similarity").desc(), F.col("first"), F.col("second")]
    chosen = across.unionByName(inside).orderBy(*order).limit(limit)
    per_unit = Window.partitionBy("copy_key", "label").orderBy("id")
    members = labelled.select("copy_key", "label", "id").withColumn("_n", F.row_number().over(per_unit)).filter(F.col("_n") <= limit).drop("_n")
    sides = chosen.select("a", "b", "similarity", F.explode(F.array_distinct(F.array("a", "b"))).alias("copy_key")).join(members, "copy_key")

    def expand(group: pd.DataFrame) -> pd.DataFrame:
        a, b, score = group["a"].iloc[0], group["b"].iloc[0], group["similarity"].iloc[0]
        left = group[group["copy_key"] == a].sort_values("id")
        right = group[group["copy_key"] == b].sort_values("id")
        members = [(i, "a", name) for i, name in zip(left["id"], left["label"])]
        if a != b:
            members += [(i, "b", name) for i, name in zip(right["id"], right["label"])]
        members.sort()
        rows: list[tuple] = []
        for at, (i, side, label) in enumerate(members):
            for j, other, name in members[at + 1 :]:
                if label != name and (a == b or side != other):
                    rows.append((i, j, label, name, score))
                    if len(rows) >= limit:
                        break
            if len(rows) >= limit:
                break
        return pd.DataFrame(rows, columns=["i", "j", "label_i", "label_j", "similarity"])

    pairs = sides.groupBy("a", "b").applyInPandas(expand, "i long, j long, label_i string, label_j string, similarity double")
    return pairs.orderBy(F.col("similarity").desc(), "i", "j").limit(limit)


# --- label studies -----------------------------------------------------------------------


def neighbour_labels(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Neighbours with the label of both sides; labels has (id, label)."""
    mine = found.join(labels.select("id", "label"), "id")
    return mine.join(labels.select(F.col("id").alias("neighbour"), F.col("label").alias("neighbour_label")), "neighbour")


def neighbor_entropy(pairs: DataFrame, ks: list[int]) -> DataFrame:
    """Nearest label, normalized label entropy of the neighbours and agreement@k."""
    base = pairs.groupBy("id", "label").agg(
        F.max_by("neighbour_label", -F.col("rank")).alias("nearest_label"),
        F.max("similarity").alias("nearest_similarity"),
        *[F.avg(F.when(F.col("rank") <= k, (F.col("label") == F.col("neighbour_label")).cast("int"))).alias(f"agreement_k{k}") for k in ks],
    )
    counts = pairs.groupBy("id", "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("id").agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_c"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
    entropy = F.when(F.col("_c") > 1, (F.log2("_t") - F.col("_s") / F.col("_t")) / F.log2("_c")).otherwise(F.lit(0.0))
    return base.join(sums.select("id", entropy.alias("local_entropy")), "id")


def queue_ambiguity(entropy: DataFrame, ks: list[int]) -> DataFrame:
    same = F.avg((F.col("nearest_label") == F.col("label")).cast("int"))
    out = entropy.groupBy("label").agg(
        F.count(F.lit(1)).alias("tickets"),
        same.alias("nearest_same_rate"),
        F.avg("nearest_similarity").alias("mean_nearest_similarity"),
        F.avg("local_entropy").alias("mean_local_entropy"),
        *[F.avg(f"agreement_k{k}").alias(f"mean_agreement_k{k}") for k in ks],
    )
    return out.withColumn("ambiguity_score", 0.4 * (1 - F.col("nearest_same_rate")) + 0.6 * F.col("mean_local_entropy"))


def centroids(weights: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """Mean weight per (label, term) over all documents of the label."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_docs"))
    sums = weights.join(labels.select(F.col("id").alias(id_col), "label"), id_col).groupBy("label", "term").agg(F.sum("weight").alias("_sum"))
    return sums.join(sizes, "label").select("label", "term", (F.col("_sum") / F.col("_docs")).alias("weight"))


def _lengths(c: DataFrame) -> DataFrame:
    return c.groupBy("label").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))


def centroid_similarity(c: DataFrame) -> DataFrame:
    """Cosine of every pair of label centroids; rows are (labels x terms), labels are few."""
    other = c.select(F.col("label").alias("label_b"), "term", F.col("weight").alias("_w"))
    dots = c.join(other, "term").groupBy("label", "label_b").agg(F.sum(F.col("weight") * F.col("_w")).alias("_dot"))
    size = _lengths(c)
    other_size = size.select(F.col("label").alias("label_b"), F.col("length").alias("_l"))
    joined = dots.join(size, "label").join(other_size, "label_b")
    return joined.select(F.col("label").alias("label_a"), "label_b", (F.col("_dot") / (F.col("length") * F.col("_l"))).alias("similarity"))


def label_similarity(weights: DataFrame, c: DataFrame, id_col: str) -> DataFrame:
    """Cosine of every document with every label centroid that shares a term with it."""
    by_label = c.join(_lengths(c), "label").select("label", "term", (F.col("weight") / F.col("length")).alias("_w"))
    return weights.join(by_label, "term").groupBy(id_col, "label").agg(F.sum(F.col("weight") * F.col("_w")).alias("similarity"))


def label_consistency(scores: DataFrame, labels: DataFrame, id_col: str, margin: float = 0.10) -> DataFrame:
    """Similarity to the own and to the best label; far better other labels are flagged. Every document of ``labels`` has a row: without
    a common term a similarity is 0, and a document without any term is nearest to the label that sorts first."""
    own = labels.select(F.col("id").alias(id_col), F.col("label").alias("assigned"))
    # At equal similarity the label that sorts first wins.
    found = own.join(scores, id_col, "left").groupBy(id_col, "assigned").agg(
        F.coalesce(F.max(F.when(F.col("label") == F.col("assigned"), F.col("similarity"))), F.lit(0.0)).alias("assigned_similarity"),
        F.min(F.when(F.col("label").isNotNull(), F.struct((-F.round("similarity", DIGITS)).alias("s"), "label"))).alias("_best"),
        F.coalesce(F.max("similarity"), F.lit(0.0)).alias("best_similarity"),
    )
    first = own.agg(F.min("assigned")).scalar()
    out = found.withColumns({"best_label": F.coalesce(F.col("_best.label"), first), "margin": F.col("best_similarity") - F.col("assigned_similarity")})
    return out.withColumn("potentially_inconsistent", (F.col("best_label") != F.col("assigned")) & (F.col("margin") >= margin)).drop("_best")


def suspicious_labels(consistency: DataFrame, id_col: str, k: int = 300) -> DataFrame:
    """The k flagged documents with the largest margins."""
    return consistency.filter("potentially_inconsistent").orderBy(F.round("margin", DIGITS).desc(), id_col).limit(k)


def representatives(scores: DataFrame, labels: DataFrame, id_col: str, k: int = 10) -> DataFrame:
    """The k documents of each label nearest to its centroid."""
    own = join_on(scores, labels.select(F.col("id").alias(id_col), "label"), [id_col, "label"])
    order = Window.partitionBy("label").orderBy(F.round("similarity", DIGITS).desc(), id_col)
    return own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_keywords(c: DataFrame, k: int = 15) -> DataFrame:
    order = Window.partitionBy("label").orderBy(F.round("weight", DIGITS).desc(), "term")
    return c.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def target_pairs(similarity: DataFrame, names: list[str]) -> DataFrame:
    """Pairs of the named labels, each once."""
    return similarity.filter(F.col("label_a").isin(names) & F.col("label_b").isin(names) & (F.col("label_a") < F.col("label_b")))
