"""Linear text classifiers: sparse term vectors made batch by batch, and all classes fitted together.

A vector is two arrays, ``_idx`` and ``_val``: TF-IDF of word runs (and character runs), then one-hot categories. The weights of all classes
are one matrix. A pass over the rows gives the loss and the gradient of every class at once, summed in each task before the sums meet by class; L-BFGS
takes its steps in the driver, which holds a few copies of the matrix and never a row. Rows that fit one part have no sums to meet: all steps are then
taken in the one task that holds them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import discard, materialize, ship_package

#: Rows that are worked on at once, and that a row of a packed table holds.
ROWS = 200
PART_BYTES = 64_000_000


_WORD, _BLANK = re.compile(r"\w{2,}"), re.compile(r"[ \t\n\x0b\f\r]+")
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 1_000_000


def word_runs(text: str) -> list[str]:
    """Words of two characters or more in lower case, and their pairs."""
    words = _WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@lru_cache(200_000)
def _grams_of_word(word: str) -> tuple[str, ...]:
    padded = f" {word} "
    return tuple(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1))


def character_runs(text: str) -> list[str]:
    """Three to five characters in a row inside blank-padded words."""
    return [g for w in _BLANK.split(text.lower()) if w for g in _grams_of_word(w)]


def counted_terms(df: DataFrame, text: str, runs: Callable[[str], list[str]]) -> DataFrame:
    """(term, df, tf): rows with a term and its uses. A task counts the terms of its rows before any are moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: Counter = Counter()
        rows: Counter = Counter()

        def handed_on() -> pa.RecordBatch:
            terms = list(used)
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([rows[t] for t in terms], pa.int64()), pa.array([used[t] for t in terms], pa.int64())], names=["term", "df", "tf"])
            used.clear()
            rows.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = runs(text or "")
                used.update(found)
                rows.update(set(found))
                if len(used) > HELD_TERMS:
                    yield handed_on()
        yield handed_on()

    ship_package(df.sparkSession)
    seen = df.select(text).mapInArrow(count, "term string, df long, tf long")
    return seen.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


@dataclass
class TermPart:
    """One TF-IDF block of the vector: sublinear tf, smoothed idf, unit length. The ``features`` most frequent terms in at least ``min_df`` rows are kept."""

    text: str
    features: int
    min_df: int = 2
    characters: bool = False
    terms: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None

    @property
    def runs(self) -> Callable[[str], list[str]]:
        return character_runs if self.characters else word_runs

    def fit(self, df: DataFrame, counts: DataFrame | None = None) -> TermPart:
        """``counts``: what ``counted_terms`` found, where several models of the same rows share it."""
        counts = (counted_terms(df, self.text, self.runs) if counts is None else counts).filter(F.col("df") >= self.min_df)
        kept = sorted(tuple(r) for r in counts.orderBy(F.desc("tf"), "term").limit(self.features).select("term", "df").collect())  # `features` rows at most
        n = df.count()
        self.terms = [t for t, _ in kept]
        self.idf = np.log((1 + n) / (1 + np.array([d for _, d in kept], float))) + 1.0
        return self


def _tfidf(texts: list[str | None], runs: Callable[[str], list[str]], place: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term number and value of each non-zero, by row and term."""
    found = [[place[t] for t in runs(text or "") if t in place] for text in texts]
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    width = max(1, len(place))
    cells, n = np.unique(row * width + np.fromiter(chain.from_iterable(found), np.int64, len(row)), return_counts=True)
    row, term = cells // width, cells % width
    value = (1.0 + np.log(n)) * idf[term]
    size = np.sqrt(np.bincount(row, value * value, len(found)))
    return row, term, value / size[row]


@dataclass
class SparseVectors:
    """Text parts and one-hot categories as one sparse vector; unknown terms and categories are left out."""

    parts: list[TermPart]
    categories: list[str] = field(default_factory=list)
    known: dict[str, list[str]] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return sum(len(p.terms) for p in self.parts) + sum(len(v) for v in self.known.values())

    def fit(self, df: DataFrame, counts: dict[tuple[str, bool], DataFrame] | None = None) -> SparseVectors:
        """``counts``: term counts of ``df`` by text column and whether they are of characters."""
        for part in self.parts:
            part.fit(df, (counts or {}).get((part.text, part.characters)))
        for c in self.categories:  # labels of tickets: a few tens
            self.known[c] = sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_idx`` and ``_val``."""
        ship_package(df.sparkSession)
        names = df.columns
        shared = df.sparkSession.sparkContext.broadcast(([(p.terms, p.idf) for p in self.parts], [self.known[c] for c in self.categories]))
        sources = [(p.text, p.runs) for p in self.parts]
        categories = self.categories

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, known = shared.value
            parts = [({t: i for i, t in enumerate(terms)}, idf) for terms, idf in parts]
            known = [pa.array(k, pa.string()) for k in known]
            for batch in batches:
                row, index, value, base = [], [], [], 0
                for (name, runs), (place, idf) in zip(sources, parts):
                    r, i, v = _tfidf(batch.column(name).to_pylist(), runs, place, idf)
                    row, index, value, base = [*row, r], [*index, i + base], [*value, v], base + len(place)
                for name, values in zip(categories, known):
                    at = pc.fill_null(pc.index_in(batch.column(name).cast(pa.string()), value_set=values), -1).to_numpy(zero_copy_only=False)
                    r = np.flatnonzero(at >= 0)
                    row, index, value, base = [*row, r], [*index, at[r] + base], [*value, np.ones(len(r))], base + len(values)
                row, index, value = (np.concatenate(x) for x in (row, index, value))
                order = np.argsort(row, kind="stable")
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *lists], names=[*names, "_idx", "_val"])

        shape = T.StructType([*df.schema.fields, T.StructField("_idx", T.ArrayType(T.IntegerType())), T.StructField("_val", T.ArrayType(T.DoubleType()))])
        return df.mapInArrow(vectors, shape)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, term numbers and values of the vectors of a batch."""
    index, value = batch.column("_idx"), batch.column("_val")
    lengths = pc.list_value_length(index).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), index.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)


def margins(offsets: np.ndarray, index: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """rows x classes. ``weights``: (terms + 1) x classes, the last row the intercepts."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.tile(weights[-1], (len(offsets) - 1, 1))
    for c in range(weights.shape[1] if len(some) else 0):  # a class at a time, whose weights stay in the cache
        out[some, c] += np.add.reduceat(value * np.ascontiguousarray(weights[:, c])[index], offsets[some])
    return out


def squared_hinge(m: np.ndarray, label: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each class and its derivative by the margin, every class against the rest; one margin is that of class 1."""
    sign = np.where(label[:, None] == (np.arange(m.shape[1]) if m.shape[1] > 1 else 1), 1.0, -1.0)
    short = np.maximum(0, 1 - sign * m)
    return (w[:, None] * short**2).sum(0), -2 * w[:, None] * sign * short


def log_loss(m: np.ndarray, label: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial; the loss is shared out to the classes by their part in it."""
    top = m - m.max(1, keepdims=True)
    p = np.exp(top)
    total = p.sum(1, keepdims=True)
    p /= total
    hit = label[:, None] == np.arange(m.shape[1])
    return (w[:, None] * hit * (np.log(total) - top)).sum(0), w[:, None] * (p - hit)


LOSSES: dict[str, Callable] = {"svc": squared_hinge, "logistic": log_loss}


BLOCK = "offsets binary, terms binary, vals binary, labels binary, weights binary"
#: Offsets, term numbers, values, label numbers and weights of some rows.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_idx, _val, _label, weight) as few rows of bytes, which are read again at each pass without a look at their elements."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            columns = (*_rows(part), part.column("_label").to_numpy().astype(np.int64), part.column("weight").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=[c.split()[0] for c in BLOCK.split(", ")])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    kinds = (np.int64, np.int32, np.float64, np.int64, np.float64)
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns, kinds))


def _gradient(blocks: Iterable[Block], weights: np.ndarray, loss: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each class and (classes x terms) gradient over the rows of some blocks."""
    terms, classes = weights.shape
    lost, gradient = np.zeros(classes), np.zeros((classes, terms))
    for offsets, index, value, label, weight in blocks:
        own, slope = loss(margins(offsets, index, value, weights), label, weight)
        lost += own
        lengths = np.diff(offsets)
        for c in range(classes):
            gradient[c, :-1] += np.bincount(index, value * np.repeat(slope[:, c], lengths), terms - 1)
        gradient[:, -1] += slope.sum(0)
    return lost, gradient


def _curvature(blocks: Iterable[Block], terms: int) -> np.ndarray:
    """Weighted sum of squares of every term, and of the intercept."""
    out = np.zeros(terms)
    for offsets, index, value, _, weight in blocks:
        out[:-1] += np.bincount(index, value * value * np.repeat(weight, np.diff(offsets)), terms - 1)
        out[-1] += weight.sum()
    return out


def _pass(batches: Iterator[pa.RecordBatch], weights: np.ndarray, loss: Callable) -> Iterator[pa.RecordBatch]:
    lost, gradient = _gradient(_blocks(batches), weights, loss)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lost), dtype=np.int32)), pa.array(lost), pa.array([g.tobytes() for g in gradient], pa.binary())], names=["c", "loss", "gradient"])


def _added(part: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(g) for g in part["gradient"])
    return pd.DataFrame({"c": [part["c"].iat[0]], "loss": [part["loss"].sum()], "gradient": [total.tobytes()]})


def minimize(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, int]:
    """L-BFGS with a backtracking line search; every trial is one evaluation. Returns the point and the evaluations made."""
    value, slope = evaluate(x)
    made, first = 1, np.linalg.norm(slope)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    while made < steps and np.linalg.norm(slope) > tolerance * max(1.0, first):
        way, held = slope.copy(), []
        for s, y, r in reversed(pairs):
            a = r * (s @ way)
            held.append(a)
            way -= a * y
        if pairs:
            s, y, _ = pairs[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.linalg.norm(slope))
        for (s, y, r), a in zip(pairs, reversed(held)):
            way += s * (a - r * (y @ way))
        fall, size = slope @ way, 1.0
        while True:
            there = x - size * way
            new_value, new_slope = evaluate(there)
            made += 1
            if new_value <= value - 1e-4 * size * fall or made >= steps:
                break
            size /= 2
        if new_value > value:
            break
        s, y = there - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs[-(memory - 1) :], (s, y, 1 / (s @ y))]
        gained, x, value, slope = value - new_value, there, new_value, new_slope
        if gained < 1e-9 * max(1.0, abs(value)):
            break
    return x, made


@dataclass
class LinearModel:
    weights: np.ndarray
    labels: list[str]
    passes: int

    def transform(self, df: DataFrame, output: str, margin: str | None = None) -> DataFrame:
        """``df`` without its vector and with the predicted label; with ``margin`` the last class's margin too."""
        shared = df.sparkSession.sparkContext.broadcast(self.weights)
        labels = pa.array(self.labels, pa.string())
        names = [c for c in df.columns if c not in ("_idx", "_val")]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    m = margins(*_rows(part), shared.value)
                    best = (m[:, 0] > 0).astype(np.int64) if m.shape[1] == 1 else m.argmax(1)
                    more = [labels.take(pa.array(best))] + ([pa.array(m[:, -1])] if margin else [])
                    yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *more], names=[*names, output] + ([margin] if margin else []))

        fields = [df.schema[n] for n in names] + [T.StructField(output, T.StringType())] + ([T.StructField(margin, T.DoubleType())] if margin else [])
        return df.mapInArrow(scored, T.StructType(fields))


def fit_linear(df: DataFrame, label: str, weight: Column, width: int, kind: str, c: float, steps: int = 200, tolerance: float = 1e-4, part_bytes: int = PART_BYTES) -> LinearModel:
    """Minimize |w|^2 / 2 + c * sum of weighted losses over vectors of ``width``, for all labels at once. ``kind``: "svc" (squared hinge, intercepts are
    shrunk like weights) or "logistic" (multinomial, intercepts free). ``steps`` bounds the passes over the rows."""
    ship_package(df.sparkSession)
    labels = sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)  # classes: a few tens
    number = F.create_map(*[x for i, n in enumerate(labels) for x in (F.lit(n), F.lit(i))])
    rows = df.filter(F.col(label).isNotNull()).select("_idx", "_val", number[F.col(label)].alias("_label"), weight.cast("double").alias("weight"))
    cells = rows.agg(F.sum(F.size("_idx")).alias("n")).first()["n"] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = int(cells * 12 // part_bytes) + 1
    packed = materialize((rows.coalesce(1) if parts == 1 else rows.repartition(max(parts, cores))).mapInArrow(_packed, BLOCK))
    classes = 1 if kind == "svc" and len(labels) == 2 else len(labels)
    shape, loss, size = "c int, loss double, gradient binary", LOSSES[kind], (width + 1, classes)
    free = np.ones(size)
    if kind == "logistic":
        free[-1] = 0.0

    def objective(weights: np.ndarray, lost: float, gradient: np.ndarray) -> tuple[float, np.ndarray]:
        return float((free * weights**2).sum() / 2 + c * lost), (free * weights + c * gradient).ravel()

    def solve(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], curvature: np.ndarray) -> tuple[np.ndarray, int]:
        """Weights are scaled by their curvature, a bound of it: frequent terms and rare ones then take steps of one size."""
        bend = 2.0 if kind == "svc" else (1 - 1 / classes) / classes
        scale = np.broadcast_to(1 / np.sqrt(np.maximum(free[:, :1] + c * bend * curvature[:, None], 1e-12)), size).ravel()

        def scaled(z: np.ndarray) -> tuple[float, np.ndarray]:
            value, slope = evaluate(z * scale)
            return value, slope * scale

        z, made = minimize(scaled, np.zeros(len(scale)), steps, tolerance)
        return z * scale, made

    tasks = packed.coalesce(cores) if parts > 1 else packed  # a gradient from each

    def over_parts(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights = x.reshape(size)
        shared = df.sparkSession.sparkContext.broadcast(weights)
        sums = tasks.mapInArrow(lambda batches: _pass(batches, shared.value, loss), shape).groupBy("c").applyInPandas(_added, shape).collect()
        shared.destroy()
        gradient = np.zeros(size)
        for r in sums:
            gradient[:, r["c"]] = np.frombuffer(r["gradient"])
        return objective(weights, sum(r["loss"] for r in sums), gradient)

    def bends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0.0]), pa.array([_curvature(_blocks(batches), width + 1).tobytes()], pa.binary())], names=["c", "loss", "gradient"])

    def in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(_blocks(batches))

        def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
            weights = x.reshape(size)
            lost, gradient = _gradient(held, weights, loss)
            return objective(weights, lost.sum(), gradient.T)

        x, made = solve(evaluate, _curvature(held, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([made])], names=["x", "made"])

    if parts == 1:
        row = packed.coalesce(1).mapInArrow(in_one_task, "x binary, made long").first()  # one file may be read in several splits
        x, made = np.frombuffer(row["x"]), row["made"]
    else:
        curvature = tasks.mapInArrow(bends, shape).groupBy("c").applyInPandas(_added, shape).first()["gradient"]
        x, made = solve(over_parts, np.frombuffer(curvature))
    discard(packed)
    return LinearModel(x.reshape(size), labels, made)
