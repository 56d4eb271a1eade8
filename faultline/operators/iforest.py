"""Isolation forest: trees on small samples built in parallel, scoring in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.quantiles import quantiles_by
from faultline.session import ship_package

SAMPLE = 256
NODES = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, depth array<double>"


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(points: np.ndarray, rng: np.random.Generator) -> tuple[list, list, list, list, list]:
    """Random axis-parallel splits down to single points or the height limit. Leaves carry
    the path length of a point that ends there."""
    feature, cut, left, right, depth = [], [], [], [], []
    limit = math.ceil(math.log2(max(2, len(points))))
    stack = [(points, 0, -1, False)]
    while stack:
        rows, level, parent, is_right = stack.pop()
        me = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = me
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        leaf = level >= limit or len(spread) == 0
        f = -1 if leaf else int(rng.choice(spread))
        at = 0.0 if leaf else float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        feature.append(f)
        cut.append(at)
        left.append(-1)
        right.append(-1)
        depth.append(level + expected_path(len(rows)) if leaf else 0.0)
        if not leaf:
            below = rows[:, f] < at
            stack += [(rows[below], level + 1, me, False), (rows[~below], level + 1, me, True)]
    return feature, cut, left, right, depth


class IsolationForest:
    """``fit`` draws up to 256 rows for each tree on its own, by a hash of the tree and the id, and
    keeps the threshold that flags the ``contamination`` share of the training rows."""

    def __init__(self, features: list[str], id_col: str, trees: int = 200, contamination: float = 0.15, seed: int = 42):
        self.features, self.id_col = features, id_col
        self.trees, self.contamination, self.seed = trees, contamination, seed

    def _standard(self, df: DataFrame) -> DataFrame:
        values = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in self.features}
        return df.withColumn("_x", F.array(*[(values[c] - F.lit(self.mean[c])) / F.lit(self.std[c]) for c in self.features]))

    def fit(self, df: DataFrame) -> IsolationForest:
        ship_package(df.sparkSession)
        stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in self.features for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        self.mean = {c: float(stats["m_" + c] or 0.0) for c in self.features}
        self.std = {c: float(stats["s_" + c] or 0.0) or 1.0 for c in self.features}
        # Every tree draws its own min(SAMPLE, n) rows: those with the smallest hash of (tree, id), bounded by the row count.
        n = df.count()
        share = min(1.0, (SAMPLE + 8 * math.sqrt(SAMPLE)) / max(n, 1))
        bound = F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))
        hashes = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(self.seed), t, self.id_col).alias("h")))
        dealt = self._standard(df).select(F.col(self.id_col).alias("_id"), "_x", F.explode(F.filter(hashes, lambda s: s["h"] <= bound)).alias("_s"))
        seed = self.seed

        def build(group: pd.DataFrame) -> pd.DataFrame:
            tree = int(group["tree"].iloc[0])
            ordered = group.sort_values(["h", "_id"]).head(SAMPLE)
            points = np.stack(ordered["_x"].to_list())
            grown = grow(points, np.random.default_rng(seed * 100_003 + tree))
            return pd.DataFrame([(tree, *grown)], columns=["tree", "feature", "cut", "left", "right", "depth"])

        grown = dealt.select("_s.*", "_id", "_x").groupBy("tree").applyInPandas(build, NODES)
        # At most `trees` rows with at most 511 nodes each.
        self.forest = [
            tuple(np.asarray(r[c]) for c in ("feature", "cut", "left", "right", "depth")) for r in grown.orderBy("tree").collect()
        ]
        self.norm = expected_path(max(2, min(SAMPLE, n)))
        scored = self.score(df)
        self.threshold = quantiles_by(scored, [], {"t": ("isolation_score", 1 - self.contamination)}).first()["t"]
        return self

    def score(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.forest, self.norm))
        narrow = self._standard(df).select(*df.columns, "_x")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", isolation_score double"

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            forest, norm = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                x, total = np.stack(batch["_x"].to_list()), np.zeros(len(batch))
                rows = np.arange(len(x))
                for feature, cut, left, right, depth in forest:
                    at = np.zeros(len(x), dtype=int)
                    while True:
                        f = feature[at]
                        inner = f >= 0
                        if not inner.any():
                            break
                        below = x[rows, np.maximum(f, 0)] < cut[at]
                        at = np.where(inner, np.where(below, left[at], right[at]), at)
                    total += depth[at]
                yield batch.drop(columns="_x").assign(isolation_score=2.0 ** (-(total / len(forest)) / norm))

        return narrow.mapInPandas(scan, schema)

    def transform(self, df: DataFrame) -> DataFrame:
        """anomaly_score above 0 marks an anomaly."""
        score = F.col("isolation_score") - F.lit(self.threshold)
        return self.score(df).withColumns({"anomaly_score": score, "is_anomaly": score > 0}).drop("isolation_score")
