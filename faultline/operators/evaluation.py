"""Classification and ranking metrics as aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.incidents import top_k_by
from faultline.operators.quantiles import quantiles_by
from faultline.operators.skew import Timeline, join_on


def confusion_matrix(df: DataFrame, y: str, p: str, labels: list[str] | None = None) -> DataFrame:
    """Counts by (true, predicted); pivoted to one column per label when labels are given."""
    if labels is None:
        return df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return df.groupBy(F.col(y).alias("actual")).pivot(p, labels).count().na.fill(0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_scores(df: DataFrame, y: str, p: str, keys: Iterable[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every label seen in y or p. The table shrinks
    to one row per (true, predicted) pair before anything else happens."""
    keys = list(keys)
    pairs = df.groupBy(*keys, F.col(y).alias("_y"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col("_y").alias("label"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0).alias("hits")),
        F.struct(F.col("_p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
    )
    long = pairs.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
    sums = long.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return sums.withColumns(
        {"precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall)}
    )


def classification_report(df: DataFrame, y: str, p: str, keys: Iterable[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1 per group."""
    keys = list(keys)
    scores = class_scores(df, y, p, keys)
    weight = F.col("support")
    aggregates = [F.sum("support").alias("rows"), (F.sum("hits") / F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggregates.append(F.avg(m).alias("macro_" + m))
        aggregates.append((F.sum(F.col(m) * weight) / F.sum(weight)).alias("weighted_" + m))
    return scores.groupBy(*keys).agg(*aggregates)


def confusion_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    """Wrong pairs with their share of all errors and of the class, ranked; the most
    common wrong label of each class is marked."""
    pairs = confusion_matrix(df, y, p)
    totals = pairs.groupBy("actual").agg(F.sum("n").alias("class_rows"))
    wrong = join_on(pairs.filter(F.col("actual") != F.col("predicted")), totals, ["actual"], "left")
    errors = wrong.agg(F.sum("n")).scalar()
    by_class = Window.partitionBy("actual").orderBy(F.col("n").desc(), "predicted")
    overall = Window.orderBy(F.col("n").desc(), "actual", "predicted")  # at most labels**2 rows
    return wrong.withColumns(
        {
            "share_of_errors": F.col("n") / errors,
            "share_of_class": F.col("n") / F.col("class_rows"),
            "most_common_for_class": F.row_number().over(by_class) == 1,
            "pair_rank": F.row_number().over(overall),
        }
    )


def error_examples(df: DataFrame, y: str, p: str, id_col: str, pairs: int = 30, rows: int = 10) -> DataFrame:
    """``rows`` example rows of each of the ``pairs`` most frequent confusions."""
    ranked = confusion_pairs(df, y, p).filter(F.col("pair_rank") <= pairs).select(F.col("actual").alias(y), F.col("predicted").alias(p), "pair_rank", F.col("n").alias("pair_count"))
    wrong = df.filter(F.col(y) != F.col(p)).join(ranked, [y, p])
    return top_k_by(wrong, [y, p], [F.col(id_col)], rows, "example")


def auc(df: DataFrame, keys: list[str], y: str, score: str, minimum: int = 1, weight: str | None = None) -> DataFrame:
    """ROC-AUC with ties at half weight, and its direction-free form. Rows collapse to
    distinct scores first; the running count over them is a sliced timeline. ``weight``: a whole number of times that a row counts."""
    times = F.lit(1) if weight is None else F.col(weight)
    counts = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(times * F.col(y).cast("long")).alias("_pos"), F.sum(times * (1 - F.col(y).cast("long"))).alias("_neg")
    )
    below = Timeline(counts, keys, [score]).running({"_below": ("sum", F.col("_neg"))}, exclusive=True).result()
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    sums = below.groupBy(*keys).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), wins.alias("_wins"), F.count(F.lit(1)).alias("_values"))
    usable = (F.col("n_pos") >= minimum) & (F.col("n_neg") >= minimum) & (F.col("_values") >= 2)
    area = F.when(usable, F.col("_wins") / (F.col("n_pos") * F.col("n_neg")))
    return sums.withColumn("auc", area).withColumns(
        {"discriminative_auc": F.greatest(F.col("auc"), 1 - F.col("auc")), "cliffs_delta": 2 * F.col("auc") - 1}
    ).drop("_wins", "_values")


def average_precision(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    """Area under the precision-recall curve (step form)."""
    counts = df.groupBy(*keys, score).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    run = Timeline(counts, keys, [score]).running({"_tp": ("sum", F.col("_pos")), "_all": ("sum", F.col("_n"))}, reverse=True).result()
    return run.groupBy(*keys).agg(
        F.sum("_pos").alias("n_pos"),
        F.try_divide(F.sum(F.col("_pos") * F.col("_tp") / F.col("_all")), F.sum("_pos")).alias("average_precision"),
    )


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: list[float], max_positive_rate: float | None = None) -> DataFrame:
    """Confusion counts and metrics at every threshold, the best F1 marked.

    Scores are counted between neighbouring thresholds, then accumulated over the few
    thresholds, so no row is repeated per threshold.
    """
    cuts = sorted(thresholds)
    reached = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in cuts), F.lit(0))
    bins = df.groupBy(reached.alias("_bin")).agg(
        F.sum(F.col(y).cast("long")).alias("_p"), F.sum(1 - F.col(y).cast("long")).alias("_n")
    )
    named = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])
    long = bins.withColumn("_t", F.explode(named)).select("_bin", "_p", "_n", "_t.*")
    above = F.col("_bin") >= F.col("i")
    pick = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    sweep = long.groupBy("threshold").agg(
        pick("_p", above).alias("tp"), pick("_n", above).alias("fp"), pick("_p", ~above).alias("fn"), pick("_n", ~above).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sweep = sweep.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "specificity": _ratio(tn, tn + fp), "positive_rate": (tp + fp) / (tp + fp + fn + tn)})
    sweep = sweep.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    allowed = F.lit(True) if max_positive_rate is None else F.col("positive_rate") <= max_positive_rate
    best = sweep.agg(F.max_by("threshold", F.when(allowed, F.struct("f1", (-F.col("threshold")).alias("t"))))).scalar()
    return sweep.withColumn("is_best", F.coalesce(F.col("threshold") == best, F.lit(False)))


def evaluate_by(df: DataFrame, y: str, predictions: list[str], key: str) -> DataFrame:
    """Precision, recall and F1 of several detectors per key, ranked by F1 within it."""
    entry = lambda c: F.struct(F.lit(c).alias("detector"), F.col(c).alias("p"))
    long = df.select(key, F.col(y).alias("_y"), F.explode(F.array(*[entry(c) for c in predictions])).alias("e")).select(key, "_y", "e.*")
    both = long.groupBy(key, "detector").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if((F.col("p") == 1) & (F.col("_y") == 1)).alias("tp"),
        F.count_if((F.col("p") == 1) & (F.col("_y") == 0)).alias("fp"),
        F.count_if((F.col("p") == 0) & (F.col("_y") == 1)).alias("fn"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = both.withColumns({"precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall)})
    order = Window.partitionBy(key).orderBy(F.col("f1").desc(), "detector")  # one row per detector
    return scored.withColumn("detector_rank", F.row_number().over(order))


def robust_effect(df: DataFrame, keys: list[str], y: str, value: str, minimum: int = 10) -> DataFrame:
    """(median of cases - median of controls) / IQR of controls; null if not defined. Values that are not finite count as missing."""
    finite = df.withColumn(value, F.when(F.abs(F.col(value)) < float("inf"), F.col(value)))
    cased = finite.withColumns({"_case": F.when(F.col(y) == 1, F.col(value)), "_control": F.when(F.col(y) == 0, F.col(value))})
    q = quantiles_by(
        cased,
        keys,
        {"_m1": ("_case", 0.5), "_m0": ("_control", 0.5), "_q1": ("_control", 0.25), "_q3": ("_control", 0.75)},
        [F.count("_case").alias("n_cases"), F.count("_control").alias("n_controls")],
    )
    enough = (F.col("n_cases") >= minimum) & (F.col("n_controls") >= minimum)
    effect = F.when(enough, F.try_divide(F.col("_m1") - F.col("_m0"), F.col("_q3") - F.col("_q1")))
    return q.withColumn("effect", effect).drop("_m1", "_m0", "_q1", "_q3")


HORIZON_WEIGHTS = {15: 0.20, 10: 0.30, 5: 0.50}


def rank_signals(results: DataFrame, renormalize: bool = False) -> DataFrame:
    """Ranking of features from (feature, horizon_minutes, auc, effect): weighted AUC,
    persistence, strong horizons, consistency of the effect sign and a combined score."""
    a = {h: F.col(f"auc_{h}") for h in HORIZON_WEIGHTS}
    e = {h: F.col(f"effect_{h}") for h in HORIZON_WEIGHTS}
    at = lambda c, h: F.max(F.when(F.col("horizon_minutes") == h, F.col(c)))
    wide = results.groupBy("feature").agg(
        *[at("auc", h).alias(f"auc_{h}") for h in HORIZON_WEIGHTS], *[at("effect", h).alias(f"effect_{h}") for h in HORIZON_WEIGHTS]
    )
    total = sum((F.coalesce(a[h] * w, F.lit(0.0)) for h, w in HORIZON_WEIGHTS.items()), F.lit(0.0))
    used = sum((F.when(a[h].isNotNull(), w).otherwise(0.0) for h, w in HORIZON_WEIGHTS.items()), F.lit(0.0))
    weighted = F.when(used > 0, total / used if renormalize else total)
    count = lambda tests: sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0))
    up, down = count([e[h] > 0 for h in e]), count([e[h] < 0 for h in e])
    wide = wide.withColumns(
        {
            "weighted_auc": weighted,
            "persistence": count([a[h] >= 0.60 for h in a]),
            "strong_horizons": count([a[h] >= 0.70 for h in a]),
            "effect_consistency": F.when(up + down >= 2, F.greatest(up, down) / (up + down)).otherwise(0.0),
        }
    )
    gain = F.coalesce(F.greatest(F.lit(0.0), (F.col("weighted_auc") - 0.50) * 2.0), F.lit(0.0))
    wide = wide.withColumn(
        "signal_score", F.round(0.60 * gain + 0.25 * F.col("persistence") / 3.0 + 0.15 * F.col("effect_consistency"), 9)
    )
    line = Timeline(wide.withColumns({"_s": -F.col("signal_score"), "_w": -F.coalesce("weighted_auc", F.lit(-1.0)), "_p": -F.col("persistence")}), [], ["_s", "_w", "_p", "feature"])
    return line.running({"rank": ("sum", F.lit(1))}).result("_s", "_w", "_p")


def prefault_summary(df: DataFrame, group: list[str], y: str, value: str, anomaly: str, weight: str | None = None) -> DataFrame:
    """Cases against controls per (band, feature): n, mean, median, MAD, anomaly rates,
    median difference and Cliff's delta (exact, from the AUC). ``weight``: a whole number of times that a row counts, so
    that a point in many bands is one row."""
    sides = df.withColumns({"side": F.when(F.col(y) == 1, "case").otherwise("control"), "_times": F.lit(1) if weight is None else F.col(weight)})
    keyed = [*group, "side"]
    there = F.when(F.col(value).isNotNull(), F.col("_times"))
    n = F.coalesce(F.sum(there), F.lit(0))
    counted = [n.alias("n"), F.try_divide(F.sum(F.col(value) * F.col("_times")), n).alias("mean")]
    flagged = F.when(F.col(anomaly).isNotNull(), F.col("_times"))
    rate = F.try_divide(F.sum(F.col(anomaly).cast("int") * F.col("_times")), F.sum(flagged)).alias("anomaly_rate")
    med = quantiles_by(sides, keyed, {"median": (value, 0.5)}, [*counted, rate], "_times")
    spread = join_on(sides, med.select(*keyed, "median"), keyed).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    full = join_on(med, quantiles_by(spread, keyed, {"mad": ("_d", 0.5)}, (), "_times"), keyed, "left")
    pick = lambda c, side: F.max(F.when(F.col("side") == side, F.col(c)))
    wide = full.groupBy(*group).agg(*[pick(c, s).alias(f"{s}_{c}") for s in ("case", "control") for c in ("n", "mean", "median", "mad", "anomaly_rate")])
    wide = wide.withColumns({f"{s}_n": F.coalesce(f"{s}_n", F.lit(0)) for s in ("case", "control")})
    wide = wide.withColumn("median_difference", F.col("case_median") - F.col("control_median"))
    return join_on(wide, auc(df, group, y, value, weight=weight).select(*group, "cliffs_delta"), group, "left")


def diff_predictions(a: DataFrame, b: DataFrame, id_col: str, label: str) -> DataFrame:
    """Rows whose two predictions differ."""
    left, right = a.select(id_col, F.col(label).alias("first")), b.select(id_col, F.col(label).alias("second"))
    return left.join(right, id_col).filter(~F.col("first").eqNullSafe(F.col("second")))


def cascade_impact(df: DataFrame, truth: str, upstream_true: str, upstream_pred: str, with_true: str, with_pred: str) -> DataFrame:
    """How much a wrong upstream label costs the downstream accuracy."""
    right_true, right_pred = F.col(with_true) == F.col(truth), F.col(with_pred) == F.col(truth)
    upstream_ok = F.col(upstream_true) == F.col(upstream_pred)
    out = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(upstream_ok.cast("int")).alias("upstream_accuracy"),
        F.avg(right_true.cast("int")).alias("accuracy_true_upstream"),
        F.avg(right_pred.cast("int")).alias("accuracy_predicted_upstream"),
        F.count_if(right_true & ~right_pred).alias("caused_errors"),
        F.count_if(~right_true & right_pred).alias("lucky_fixes"),
        F.count_if(right_true & ~right_pred & ~upstream_ok).alias("caused_by_wrong_upstream"),
        F.avg(F.when(~upstream_ok, right_pred.cast("int"))).alias("accuracy_when_upstream_wrong"),
    )
    return out.withColumn("accuracy_drop", F.col("accuracy_true_upstream") - F.col("accuracy_predicted_upstream"))
