"""Second-order boosted trees for a binary label, grown level by level over packed rows.

Features are cut into at most 255 quantile bins and packed into one byte each; a value that is null, NaN or infinite has a bin of its own,
and every split learns the side it goes to. One pass over the rows grows one level: each task adds gradients and hessians up by (node,
feature, bin) for its rows, the sums of the tasks meet by block of features, and a block returns its best split of each node. The driver sees
one row per node and block. Rows keep their margin; it is brought up to date every ``REFRESH`` trees, and until then a pass adds the newer trees itself.
Rows that fit one part have nobody to meet: the same steps then run one after the other in the one task that holds them.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import discard, materialize, ship_package

MISSING = 255
REFRESH = 25
BLOCK = 32
#: Bytes of packed rows that one task holds.
PART_BYTES = 64_000_000


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2 i + 1 and 2 i + 2. A feature of -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def leaf_of(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row is in after ``levels`` splits at most."""
        at = np.zeros(len(bins), np.int64)
        every = np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[at]
            inner = feature >= 0
            seen = bins[every, np.maximum(feature, 0)]
            left = np.where(seen == MISSING, self.missing_left[at], seen <= self.cut[at])
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return at


@dataclass(frozen=True)
class Settings:
    trees: int = 300
    depth: int = 5
    rate: float = 0.05
    subsample: float = 1.0
    columns: float = 1.0
    child_weight: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    l2: float = 1.0
    seed: int = 42


def sampled_rows(rows: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Whether a row takes part in a tree: by its number and the tree's alone, so every pass and every retry sees the same rows."""
    with np.errstate(over="ignore"):
        x = rows.view(np.uint64) + np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def binned(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.full(features.shape, MISSING, np.uint8)
    for j, c in enumerate(cuts):
        good = np.isfinite(features[:, j])
        out[good, j] = np.searchsorted(c, features[good, j], side="left")
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _packed_rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "y", "w", "margin"))


def _margin(bins: np.ndarray, margin: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.leaf_of(bins, depth)]
    return margin


def _sums(sums: np.ndarray, bins: np.ndarray, row: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray, tree: Tree, number: int, level: int, chosen: np.ndarray, s: Settings) -> None:
    """Adds gradients and hessians of rows to ``sums``: (2, features, nodes * 256)."""
    p = 1 / (1 + np.exp(-margin))
    size = sums.shape[2]
    node = tree.leaf_of(bins, level) - (2**level - 1)
    use = (node >= 0) & sampled_rows(row, number, s.subsample)
    node, cells = node[use] * 256, bins[use]
    g, h = (w * (p - y))[use], (w * p * (1 - p))[use]
    for i, j in enumerate(chosen):
        at = node + cells[:, j]
        sums[0, i] += np.bincount(at, g, size)
        sums[1, i] += np.bincount(at, h, size)


def _histograms(width: int, newer: list[Tree], tree: Tree, number: int, level: int, chosen: np.ndarray, s: Settings):
    """Sums of gradient and hessian by (feature, node, bin), a row for each block of the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(chosen), 2**level * 256))
        for batch in batches:
            bins, row, y, w, margin = _packed_rows(batch, width)
            _sums(sums, bins, row, y, w, _margin(bins, margin, newer, s.depth), tree, number, level, chosen, s)
        blocks = range(0, len(chosen), BLOCK)
        bodies = [np.ascontiguousarray(sums[:, b : b + BLOCK]).tobytes() for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK for b in blocks], pa.int32()), pa.array(bodies, pa.binary())], names=["block", "sums"])

    return run


def _score(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    shrunk = np.sign(g) * np.maximum(np.abs(g) - s.alpha, 0)
    return shrunk**2 / (h + s.l2)


def leaf_value(g: np.ndarray, h: np.ndarray, s: Settings) -> np.ndarray:
    return -s.rate * np.sign(g) * np.maximum(np.abs(g) - s.alpha, 0) / (h + s.l2)


def best_splits(sums: np.ndarray, s: Settings) -> pd.DataFrame:
    """sums: (2, features, nodes, 256). The best split of each node, with the sums of its left side and of the node."""
    g, h = sums[0], sums[1]
    total_g, total_h = g.sum(-1), h.sum(-1)
    below_g, below_h = g[..., :MISSING].cumsum(-1), h[..., :MISSING].cumsum(-1)
    sides = []
    for missing_left in (False, True):
        left_g = below_g + (g[..., MISSING:] if missing_left else 0)
        left_h = below_h + (h[..., MISSING:] if missing_left else 0)
        right_g, right_h = total_g[..., None] - left_g, total_h[..., None] - left_h
        gain = _score(left_g, left_h, s) + _score(right_g, right_h, s) - _score(total_g, total_h, s)[..., None]
        sides.append(np.where((left_h >= s.child_weight) & (right_h >= s.child_weight), gain, -np.inf))
    gains = np.stack(sides, -1)  # features, nodes, cuts, side
    features, nodes = gains.shape[:2]
    flat = gains.transpose(1, 0, 2, 3).reshape(nodes, -1)
    best = flat.argmax(1)
    feature, cut, side = np.unravel_index(best, (features, MISSING, 2))
    node = np.arange(nodes)
    left = side == 1
    return pd.DataFrame({
        "node": node, "gain": flat[node, best], "feature": feature, "cut": cut, "missing_left": left,
        "left_g": below_g[feature, node, cut] + left * g[feature, node, MISSING], "left_h": below_h[feature, node, cut] + left * h[feature, node, MISSING],
        "g": total_g[feature, node], "h": total_h[feature, node],
    })


_SPLIT = "node long, gain double, feature long, cut long, missing_left boolean, left_g double, left_h double, g double, h double"


@dataclass
class BoostedModel:
    cuts: list[np.ndarray]
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def probability(self, features: Column) -> Column:
        """P(label = 1) from an array of numbers in the order of the fit."""
        trees, cuts, depth = self.trees, self.cuts, self.settings.depth

        @F.pandas_udf("double")
        def scored(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype="float64")
            raw = np.array([[np.nan if x is None else x for x in v] for v in values], np.float64)
            return pd.Series(1 / (1 + np.exp(-_margin(binned(raw, cuts), np.zeros(len(raw)), trees, depth))))

        return scored(features)

    def importance(self, names: list[str]) -> dict[str, float]:
        """Mean gain of a feature's splits, as a share of all."""
        gain, splits = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(gain, tree.feature[inner], tree.gain[inner])
            np.add.at(splits, tree.feature[inner], 1)
        mean = gain / np.maximum(splits, 1)
        return dict(zip(names, (mean / (mean.sum() or 1.0)).tolist()))


def quantile_cuts(rows: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """At most 254 rising cuts per feature; one short row for each feature comes to the driver."""
    cells = rows.select(F.posexplode(features).alias("j", "x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    steps = F.array(*[F.lit(i / 255) for i in range(1, 255)])
    found = cells.groupBy("j").agg(F.percentile_approx("x", steps, 10_000).alias("cuts"))
    cuts = [np.zeros(0)] * width
    for r in found.collect():
        cuts[r["j"]] = np.unique(r["cuts"])
    return cuts


def fit_boosted(df: DataFrame, features: str, label: str, weight: Column, ids: list[str], width: int, settings: Settings, part_bytes: int = PART_BYTES) -> BoostedModel:
    """Trees over the array column ``features`` of ``width`` numbers. ``ids`` name a row: they decide in which trees it takes part."""
    ship_package(df.sparkSession)
    s = settings
    rows = materialize(df.select(F.xxhash64(F.lit(s.seed), *ids).alias("row"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w"), F.transform(features, lambda x: x.cast("double")).alias("x")))
    cuts = quantile_cuts(rows, "x", width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = binned(_matrix(b.column("x"), width), cuts)
            body = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("y"), b.column("w"), pa.array(np.zeros(len(bins))), body], names=["row", "y", "w", "margin", "bins"])

    shape = "row long, y double, w double, margin double, bins binary"
    parts = int(rows.count() * width // part_bytes) + 1
    packed = rows.mapInArrow(pack, shape)
    packed = materialize(packed.coalesce(1) if parts == 1 else packed.repartition(parts, "row"))
    discard(rows)
    features = columns_of_trees(width, s)
    if parts == 1:
        trees = pickle.loads(packed.coalesce(1).mapInArrow(_in_one_task(width, features, s), "trees binary").first()["trees"])  # one file may be read in several splits
    else:
        trees = _over_parts(packed, shape, width, features, s)
    discard(packed)
    return BoostedModel(cuts, s, trees)


def columns_of_trees(width: int, s: Settings) -> list[np.ndarray]:
    rng = np.random.default_rng(s.seed)
    return [np.sort(rng.choice(width, max(1, round(width * s.columns)), replace=False)) for _ in range(s.trees)]


def _in_one_task(width: int, features: list[np.ndarray], s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.concatenate(c) for c in zip(*(_packed_rows(b, width) for b in batches))]
        trees: list[Tree] = []
        if rows:
            bins, row, y, w, margin = rows

            def best(tree: Tree, level: int) -> pd.DataFrame:
                sums = np.zeros((2, len(chosen), 2**level * 256))
                _sums(sums, bins, row, y, w, margin, tree, number, level, chosen, s)
                return best_splits(sums.reshape(2, len(chosen), 2**level, 256), s)

            for number, chosen in enumerate(features):
                trees.append(_grown(best, chosen, s))
                margin = _margin(bins, margin, trees[-1:], s.depth)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], names=["trees"])

    return run


def _over_parts(packed: DataFrame, shape: str, width: int, features: list[np.ndarray], s: Settings) -> list[Tree]:
    trees: list[Tree] = []
    newer: list[Tree] = []
    for number, chosen in enumerate(features):

        def best(tree: Tree, level: int) -> pd.DataFrame:
            sums = packed.mapInArrow(_histograms(width, newer, tree, number, level, chosen, s), "block int, sums binary")
            return sums.groupBy("block").applyInPandas(_best_of_block(2**level, s), _SPLIT).toPandas()

        tree = _grown(best, chosen, s)
        newer = [*newer, tree]
        trees.append(tree)
        if len(newer) == REFRESH and number + 1 < s.trees:
            old, packed = packed, materialize(packed.mapInArrow(_refreshed(width, newer, s.depth), shape))
            if number >= REFRESH:
                discard(old)
            newer = []
    return trees


def _refreshed(width: int, newer: list[Tree], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, *_, margin = _packed_rows(b, width)
            yield b.set_column(b.schema.get_field_index("margin"), "margin", pa.array(_margin(bins, margin, newer, depth)))

    return run


def _best_of_block(nodes: int, s: Settings):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        found = best_splits(sum(np.frombuffer(x).reshape(2, -1, nodes, 256) for x in block["sums"]), s)
        found["feature"] += int(block["block"].iat[0]) * BLOCK
        return found

    return run


def _grown(best: Callable[[Tree, int], pd.DataFrame], chosen: np.ndarray, s: Settings) -> Tree:
    """A tree; ``best`` gives the best splits of a level's nodes, possibly several for a node, of which the greatest gain counts."""
    tree = Tree.empty(s.depth)
    for level in range(s.depth):
        found = best(tree, level).sort_values(["gain", "feature"], ascending=[False, True]).drop_duplicates("node")
        first, split = 2**level - 1, False
        for r in found.itertuples():
            at = first + r.node
            if level and tree.feature[(at - 1) // 2] < 0:
                continue  # below a leaf
            if level == 0:
                tree.value[at] = leaf_value(r.g, r.h, s)
            if r.gain > s.gamma:
                split = True
                tree.feature[at], tree.cut[at], tree.missing_left[at], tree.gain[at] = chosen[r.feature], r.cut, r.missing_left, r.gain
                tree.value[2 * at + 1] = leaf_value(r.left_g, r.left_h, s)
                tree.value[2 * at + 2] = leaf_value(r.g - r.left_g, r.h - r.left_h, s)
        if not split:
            break
    return tree
