"""Spark ML models over tickets, logs and metric features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from faultline.functions.rules import ALERT_CUTS, prob_level
from faultline.operators.boosting import BoostedModel, Settings, fit_boosted
from faultline.operators.evaluation import classification_report, threshold_sweep
from faultline.operators.linear import LinearModel, SparseVectors, TermPart, character_runs, counted_terms, fit_linear, word_runs
from faultline.operators.quality import impute_median, text_overlap
from faultline.operators.skew import Timeline, join_on
from faultline.operators.timeseries import time_split
from faultline.session import discard, materialize


def stratified_split(df: DataFrame, columns: list[str], id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Repeatable split with the same test share in every class combination. When some
    combination has a single row the split falls back to the first column alone."""
    smallest = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    by = columns if smallest and smallest >= 2 else columns[:1]
    hashed = df.withColumn("_h", F.xxhash64(F.lit(seed), id_col))
    numbered = Timeline(hashed, by, ["_h", id_col]).running({"_at": ("sum", F.lit(1))}).result("_h")
    sized = join_on(numbered, df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")), by, "left")
    test = F.col("_at") <= F.round(F.col("_all") * test_share)
    return sized.withColumn("split", F.when(test, "test").otherwise("train")).drop("_at", "_all")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("weight", totals["n"] / (totals["k"] * F.col("n")))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    return join_on(df, F.broadcast(class_weights(df, label).select(label, "weight")), [label], "left")  # classes: a few tens


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive."""
    row = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not row["p"]:
        raise ValueError("no positive rows to train on")
    return (row["n"] - row["p"]) / row["p"]


class TicketModel:
    """Text TF-IDF, one-hot categories (unknown ones ignored) and a classifier: "svc" and "logistic" are fitted for all classes together over the sparse
    rows (see linear.py), "forest" and "boosted" are Spark ML's trees."""

    def __init__(self, label: str, categories: list[str] = (), kind: str = "svc", balanced: bool = False, c: float = 1.0, features: int = 30_000, characters: bool = False, trees: int = 30):
        self.label, self.kind, self.balanced, self.c = label, kind, balanced, c
        parts = [TermPart("ticket_text", features)]
        if characters:
            parts.append(TermPart("ticket_text", features, characters=True))
        self.vectors = SparseVectors(parts, list(categories))
        forest = RandomForestClassifier(numTrees=trees, featuresCol="_features", labelCol="_label", predictionCol="_prediction", seed=42)
        boosted = OneVsRest(classifier=GBTClassifier(maxIter=5, maxDepth=3, seed=42), featuresCol="_features", labelCol="_label", predictionCol="_prediction")
        self.classifier = {"forest": forest, "boosted": boosted}.get(kind)
        if balanced and self.classifier is not None:
            self.classifier.setWeightCol("weight")

    def fit(self, df: DataFrame, counts: dict | None = None) -> TicketModel:
        """``counts``: of ``shared_counts``, where several models are fitted to ``df``."""
        weighted = with_weights(df, self.label) if self.balanced else df.withColumn("weight", F.lit(1.0))
        # The optimizers read their input many times: vectors are computed once.
        train = materialize(self.vectors.fit(df, counts).transform(weighted.select("weight", self.label, *[c for c in self._inputs() if c != self.label])))
        if self.classifier is None:
            self.model = fit_linear(train, self.label, F.col("weight"), self.vectors.width, self.kind, self.c)
            discard(train)
            return self
        indexer = StringIndexer(inputCol=self.label, outputCol="_label", handleInvalid="error").fit(train)
        self.model = self.classifier.fit(materialize(ml_vectors(indexer.transform(train), self.vectors.width).select("_label", "_features", "weight")))
        self.names = IndexToString(inputCol="_prediction", outputCol="_name", labels=indexer.labels)
        return self

    def _inputs(self) -> list[str]:
        return list(dict.fromkeys(["ticket_text", *self.vectors.categories]))

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        vectors = self.vectors.transform(df)
        if self.classifier is None:
            return self.model.transform(vectors, output)
        scored = self.names.transform(self.model.transform(ml_vectors(vectors, self.vectors.width)))
        return scored.select(*df.columns, F.col("_name").alias(output))


def shared_counts(train: DataFrame, characters: bool = False) -> dict[tuple[str, bool], DataFrame]:
    """Counts of the words of the tickets that a model may use, and of their characters: all models of ``train`` choose their terms from them."""
    kinds = {False: word_runs, True: character_runs} if characters else {False: word_runs}
    return {("ticket_text", c): materialize(counted_terms(train, "ticket_text", runs).filter("df >= 2")) for c, runs in kinds.items()}


def ml_vectors(df: DataFrame, width: int) -> DataFrame:
    """``_idx`` and ``_val`` as ``_features``, a Spark ML vector; whole batches at a time."""
    names = [c for c in df.columns if c not in ("_idx", "_val")]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            fields = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), b.column("_idx"), b.column("_val")]
            vector = pa.StructArray.from_arrays(fields, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], vector], names=[*names, "_features"])

    return df.mapInArrow(packed, StructType([*[df.schema[c] for c in names], StructField("_features", VectorUDT())]))


def train_type(train: DataFrame, features: int = 30_000, counts: dict | None = None) -> TicketModel:
    return TicketModel("type", c=1.0, features=features).fit(train, counts)


# The five queue model variants.
QUEUE_VARIANTS = {
    "v4": dict(categories=["type"], kind="svc", balanced=True, c=1.5),
    "A": dict(kind="logistic", c=2.0),
    "B": dict(kind="logistic", balanced=True, c=2.0),
    "C": dict(kind="logistic", balanced=True, c=2.0, characters=True),
    "D": dict(categories=["type"], kind="logistic", balanced=True, c=2.0),
}


# Terms that the variants keep, of words and of characters alike.
QUEUE_FEATURES = {"v4": 40_000, "A": 100_000, "B": 100_000, "C": 80_000, "D": 100_000}


def train_queue(train: DataFrame, variant: str = "v4", features: int | None = None, counts: dict | None = None) -> TicketModel:
    return TicketModel("queue", features=features or QUEUE_FEATURES[variant], **QUEUE_VARIANTS[variant]).fit(train, counts)


def train_priority(train: DataFrame, features: int = 30_000, counts: dict | None = None) -> TicketModel:
    return TicketModel("priority", ["type", "queue"], balanced=True, features=features).fit(train, counts)


def predict_tickets(df: DataFrame, models: dict[str, TicketModel]) -> DataFrame:
    """Cascade over a table: type, then queue from text and type, then priority from all
    three; priorities come out in upper case."""
    kept = df.drop("type", "queue", "priority")
    typed = models["type"].transform(kept, "type")
    queued = models["queue"].transform(typed, "queue")
    return models["priority"].transform(queued, "priority").withColumn("priority", F.upper("priority"))


def evaluate(df: DataFrame, label: str, prediction: str, name: str) -> DataFrame:
    return classification_report(df, label, prediction).withColumn("model", F.lit(name))


def compare_models(train: DataFrame, test: DataFrame, label: str, kinds: list[str], features: int | dict[str, int] = 20_000) -> DataFrame:
    """One report row per kind of model, with its error count. ``features``: terms of all kinds, or of each."""
    counts, out = shared_counts(train), None
    for kind in kinds:
        terms = features[kind] if isinstance(features, dict) else features
        model = TicketModel(label, ["type"] if label != "type" else [], kind, balanced=kind != "forest", features=terms).fit(train, counts)
        row = evaluate(model.transform(test, "_p"), label, "_p", kind)
        out = row if out is None else out.unionByName(row)
    return out.withColumn("errors", F.round((1 - F.col("accuracy")) * F.col("rows")).cast("long"))


def benchmark(sets: dict[str, DataFrame], label: str, id_col: str, features: int = 20_000) -> DataFrame:
    """Train on each set, test on each: report rows with the text overlap of the pair."""
    # Written once, in a part for every core at least: a fit reads its rows several times.
    parts = lambda df: max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    split = {n: materialize(stratified_split(df, [label], id_col).repartition(parts(df))) for n, df in sets.items()}
    shared: dict[frozenset, float] = {}
    out = None
    for trained, rows in split.items():
        model = TicketModel(label, kind="logistic", features=features).fit(rows.filter("split = 'train'"))
        for tested, others in split.items():
            row = evaluate(model.transform(others.filter("split = 'test'"), "_p"), label, "_p", "logistic")
            pair = frozenset((trained, tested))
            if pair not in shared:
                shared[pair] = float(text_overlap(sets[trained], sets[tested], "ticket_text").select(F.col("overlap_percent")).first()[0])
            row = row.withColumns({"trained_on": F.lit(trained), "tested_on": F.lit(tested), "overlap_percent": F.lit(shared[pair])})
            out = row if out is None else out.unionByName(row)
    return out


def numeric_model(features: list[str], label: str, weight: str = "weight") -> Pipeline:
    """Scaled numbers and a logistic regression."""
    assemble = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="keep")
    scale = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True)
    return Pipeline(stages=[assemble, scale, LogisticRegression(featuresCol="_features", labelCol=label, weightCol=weight, maxIter=50)])


def positive_probability(df: DataFrame, column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def log_semantic(df: DataFrame, text: str, label: str, features: int = 100_000) -> tuple[SparseVectors, LinearModel]:
    """Linear SVC over log text; the raw margin is the semantic score of a line."""
    vectors = SparseVectors([TermPart(text, features)]).fit(df)
    labelled = vectors.transform(df.select(text, F.col(label).cast("string").alias(label)))
    return vectors, fit_linear(materialize(labelled), label, F.lit(1.0), vectors.width, "svc", 1.0)


def score_logs(df: DataFrame, vectors: SparseVectors, model: LinearModel) -> DataFrame:
    return model.transform(vectors.transform(df), "_label", "margin").drop("_label")


def train_next_anomaly(df: DataFrame, keys: list[str], features: list[str], order: list[str]) -> tuple[PipelineModel, DataFrame]:
    """Logistic model of the next window's anomaly from the lags of the features, balanced,
    first 70 % of the time for training; returns the model and the scored test rows."""
    names = [*features, "is_anomaly"]

    def stage(w):
        out = {f"{c}_lag_{n}": F.lag(F.col(c).cast("double"), n).over(w) for c in names for n in (1, 2, 3)}
        return {**out, "target": F.lead(F.col("is_anomaly").cast("int")).over(w)}

    lagged = Timeline(df, keys, order).frames(stage, before=3, after=1).result()
    columns = [f"{c}_lag_{n}" for c in names for n in (1, 2, 3)]
    rows = lagged.na.drop("any", subset=[*columns, "target"])
    split = time_split(rows, [], [*order, *keys], {"train": 0.7, "test": 1.0})
    split = materialize(split)
    train = with_weights(split.filter("split = 'train'"), "target")
    model = numeric_model(columns, "target").fit(train)
    test = model.transform(split.filter("split = 'test'").withColumn("weight", F.lit(1.0)))
    return model, test.withColumn("incident_risk", positive_probability(test))


# Settings of the two boosted models.
INCIDENT_TREES = Settings(trees=300, depth=5, rate=0.05, subsample=0.85, columns=0.85, child_weight=3, gamma=0.1, alpha=0.1, l2=1.0)
RISK_TREES = Settings(trees=350, depth=5, rate=0.04, subsample=0.80, columns=0.70, child_weight=5, gamma=0.10, alpha=0.10, l2=1.50)


def train_incident(df: DataFrame, numeric: list[str], category: str, label: str, order: list[str], settings: Settings = INCIDENT_TREES) -> tuple[DataFrame, DataFrame]:
    """Boosted trees with imputed medians and a one-hot service: 70/15/15 by time, the
    threshold chosen on the validation rows. ``order`` names the rows. Returns (threshold sweep of the validation rows, scored rows of all three parts)."""
    split = time_split(df, [], order, {"train": 0.7, "validation": 0.85, "test": 1.0})
    filled = materialize(impute_median(materialize(split), [], numeric, F.col("split") == "train"))
    train = filled.filter("split = 'train'")
    known = sorted(r[0] for r in train.select(category).distinct().collect() if r[0] is not None)  # services
    hot = [F.coalesce((F.col(category) == k).cast("double"), F.lit(0.0)) for k in known]
    row = F.array(*[F.col(c).cast("double") for c in numeric], *hot)
    weight = F.when(F.col(label) == 1, positive_weight(train, label)).otherwise(1.0)
    model = fit_boosted(train.withColumn("_row", row), "_row", label, weight, order, len(numeric) + len(known), settings)
    scored = materialize(filled.withColumn("risk", model.probability(row)))
    sweep = threshold_sweep(scored.filter("split = 'validation'"), label, "risk", [round(0.05 * i, 2) for i in range(1, 20)])
    return sweep, scored


# Name endings of the twelve features, in the order of the vector.
FEATURE_ENDINGS = {
    "value": "", "value_lag_1": "__lag_5m", "value_lag_2": "__lag_10m", "value_lag_3": "__lag_15m", "delta_1": "__delta_5m", "delta_2": "__delta_10m", "delta_3": "__delta_15m",
    "pct_change_1": "__pct_change_5m", "pct_change_2": "__pct_change_10m", "pct_change_3": "__pct_change_15m", "rolling_mean": "__rolling_mean_15m", "rolling_std": "__rolling_std_15m",
}


def feature_names(metrics: list[str]) -> list[str]:
    return [m + ending for ending in FEATURE_ENDINGS.values() for m in metrics]


def packed_rows(long: DataFrame, at: list[str], metric: str, metrics: list[str], extra: list[Column] = ()) -> DataFrame:
    """One fixed-layout row per time from the long matrix: all values, then all first lags, and so on (``feature_names``). A metric that a time lacks is null.
    One grouping by time, in which a row has at most ``metrics`` entries; no join and no column per feature."""
    place = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i))])
    cell = F.struct(place[F.col(metric)].alias("i"), F.array(*[F.col(c).cast("double") for c in FEATURE_ENDINGS]).alias("x"))
    rows = long.filter(F.col(metric).isin(metrics)).groupBy(*at).agg(F.map_from_entries(F.collect_set(cell)).alias("_cells"), *extra)
    index = F.array(*[F.lit(i) for i in range(len(metrics))])
    blocks = F.transform(F.sequence(F.lit(0), F.lit(len(FEATURE_ENDINGS) - 1)), lambda k: F.transform(index, lambda i: F.get(F.try_element_at(F.col("_cells"), i), k)))
    return rows.withColumn("features", F.flatten(blocks)).drop("_cells")


def train_risk(rows: DataFrame, label: str, order: list[str], metrics: list[str], settings: Settings = RISK_TREES) -> tuple[BoostedModel, DataFrame]:
    """Boosted trees over packed rows, fitted on the first 70 % of the times (``order``, which names the rows). Returns the model and all rows with ``split`` and ``risk``."""
    split = materialize(time_split(rows, [], order, {"train": 0.7, "validation": 0.85, "test": 1.0}))
    train = split.filter("split = 'train'")
    weight = F.when(F.col(label) == 1, positive_weight(train, label)).otherwise(1.0)
    model = fit_boosted(train, "features", label, weight, order, len(FEATURE_ENDINGS) * len(metrics), settings)
    return model, materialize(split.withColumn("risk", model.probability(F.col("features"))))


def feature_importance(model: BoostedModel, names: list[str], spark) -> DataFrame:
    return spark.createDataFrame(list(model.importance(names).items()), "feature string, importance double")


def score_risk(df: DataFrame, model: BoostedModel, ts: str, threshold: float = 0.25, last: int | None = None) -> DataFrame:
    """Risk, level and alert flag for every packed row, or for the last timestamps only."""
    if last:
        recent = df.select(ts).distinct().orderBy(F.col(ts).desc()).limit(last)
        df = df.join(recent, ts, "left_semi")
    scored = df.drop("risk").withColumn("risk", model.probability(F.col("features")))
    return scored.withColumns({"risk_level": prob_level(F.col("risk"), ALERT_CUTS), "alert": F.col("risk") >= threshold})


def risk_kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("alert").alias("alerts"), F.avg("risk").alias("mean_risk"), F.max("risk").alias("max_risk"),
        *[F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in ("HIGH", "MEDIUM", "LOW")],
    )
