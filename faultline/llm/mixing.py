"""Mixing sources to target weights by temperature, as budgeted block permutations. DataFrame functions only.

A source with token share p gets a weight in proportion to p ** a. The exponent is the largest one up to 1 whose weights reach
the target entropy, but never below the smallest one at which no source is repeated more often than the limit allows; both are
found by bisection, inside one row that holds the token counts of the sources.

Each source is dealt into BLOCKS blocks by a hash of the doc_id. An epoch of a source is a permutation of its blocks, and its
budget is whole epochs plus the first blocks of one more. Only the one block in which a budget ends is resolved by document, so
the ordered groups hold BLOCKS rows, or 1 / BLOCKS of a source. ``slot`` places every copy between 0 and 1 along the budget of its
source: rows sorted by slot have the target weights in every stretch.

Edge cases: a null source is a source of its own. Texts without words (or null) cost nothing and go with their block. A null
doc_id falls in one block with the others. Repeated rows stay together. Without any token every row is returned once, slot 0. An
empty table gives no rows. Other columns are carried; n_tokens, epoch and slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import sized, word_count
from faultline.session import materialize

BLOCKS = 1024
#: Share of the largest possible entropy, log(number of sources), that the weights reach.
ENTROPY = 0.95
#: No document is used more often than this.
EPOCHS = 4.0
_STEPS = 50


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _entropy(logs: Column, exponent: Column) -> Column:
    """Of weights exp(exponent * log share), normalised."""
    sums = F.aggregate(
        logs,
        F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("e")),
        lambda a, x: F.struct((a["z"] + F.exp(exponent * x)).alias("z"), (a["e"] + exponent * x * F.exp(exponent * x)).alias("e")),
        lambda a: F.log(a["z"]) - a["e"] / a["z"],
    )
    return sums


def _repeats(logs: Column, exponent: Column, factor: Column) -> Column:
    """Times the most repeated source is used: factor * weight / share at its largest, the rarest source."""
    return factor * F.exp((exponent - 1) * F.array_min(logs)) / _total(F.transform(logs, lambda x: F.exp(exponent * x)))


def _bisect(fits_low: object) -> Column:
    """The exponent in [0, 1] where ``fits_low`` stops to hold."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_STEPS)),
        F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")),
        lambda a, _: F.when(fits_low((a["low"] + a["high"]) / 2), F.struct(((a["low"] + a["high"]) / 2).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), ((a["low"] + a["high"]) / 2).alias("high"))),
    )


def weights(tokens: DataFrame, entropy: float = ENTROPY, epochs: float = EPOCHS, budget: float | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, need) from (source, tokens). budget: total tokens of the mix; None is the least one
    that uses every document."""
    one = tokens.where("tokens > 0").agg(F.array_sort(F.collect_list(F.struct("tokens", "source"))).alias("s"))
    total = _total(F.transform("s", lambda x: x["tokens"].cast("double")))
    one = one.select("s", total.alias("total"))
    one = one.select("s", "total", F.transform("s", lambda x: F.log(x["tokens"] / F.col("total"))).alias("logs"))
    logs = F.col("logs")
    if budget is None:
        # share / weight is largest for the largest source; that many totals use all of it
        factor = lambda a: F.exp((1 - a) * F.array_max(logs)) * _total(F.transform(logs, lambda x: F.exp(a * x)))
    else:
        factor = lambda a: F.lit(float(budget)) / F.col("total")
    target = F.lit(entropy) * F.log(F.size("s"))
    flat = _bisect(lambda a: _entropy(logs, a) >= target)
    kept = _bisect(lambda a: _repeats(logs, a, factor(a)) > epochs)
    one = one.select("s", "total", "logs", F.when(_entropy(logs, F.lit(1.0)) >= target, F.lit(1.0)).otherwise(flat["low"]).alias("flat"), F.when(_repeats(logs, F.lit(0.0), factor(F.lit(0.0))) <= epochs, F.lit(0.0)).otherwise(kept["high"]).alias("kept"))
    one = one.select("s", "total", "logs", F.greatest("flat", "kept").alias("exponent"))
    one = one.select("s", "exponent", "logs", _total(F.transform(logs, lambda x: F.exp(F.col("exponent") * x))).alias("z"), (F.col("total") * F.least(factor(F.col("exponent")), F.lit(epochs))).alias("budget"))
    rows = one.select("exponent", "budget", "z", F.posexplode("s").alias("at", "s"), "logs")
    weight = F.exp(F.col("exponent") * F.col("logs")[F.col("at")]) / F.col("z")
    return rows.select(F.col("s.source").alias("source"), F.col("s.tokens").alias("tokens"), "exponent", weight.alias("weight"), (weight * F.col("budget")).alias("need"))


def _hex(value: Column) -> Column:
    """The first eight hex digits of a hash as a number."""
    return F.conv(F.substring(value, 1, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, entropy: float = ENTROPY, epochs: float = EPOCHS, budget: float | None = None, text: str = "text") -> DataFrame:
    """Every chosen copy of every document: the columns of docs with n_tokens, epoch and slot."""
    carried = [c for c in docs.columns if c not in ("n_tokens", "epoch", "slot")]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = docs.select(*carried, word_count(F.col(text)).alias("n_tokens"), (_hex(F.md5(key)) % BLOCKS).alias("_block"))
    light = dealt.select("doc_id", "source", "_block", "n_tokens")
    blocks = materialize(light.groupBy("source", "_block").agg(F.sum("n_tokens").alias("size")))
    wanted = weights(blocks.groupBy("source").agg(F.sum("size").alias("tokens")), entropy, epochs, budget).withColumnRenamed("source", "_source")
    full = F.floor(F.col("need") / F.col("tokens") + 1e-9)
    wanted = materialize(wanted.withColumn("full", full).withColumn("rest", F.greatest(F.col("need") - full * F.col("tokens"), F.lit(0.0))))
    # A source without tokens has no weight; its documents cost nothing and are used once.
    planned = blocks.join(wanted, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    planned = planned.fillna({"full": 1, "rest": 0.0}).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full").cast("int"))))
    permuted = Window.partitionBy("source", "epoch").orderBy(F.md5(F.concat_ws("|", F.coalesce("source", F.lit("")), "epoch", "_block")), "_block")
    planned = planned.withColumn("start", F.coalesce(F.sum("size").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    room = F.when(F.col("epoch") < F.col("full"), F.col("size").cast("double")).otherwise(F.least(F.col("rest") - F.col("start"), F.col("size").cast("double")))
    planned = materialize(planned.withColumn("room", room).where("epoch < full OR room > 0").withColumnRenamed("source", "_source").withColumnRenamed("_block", "_at"))
    order = lambda epoch: F.md5(F.concat_ws("|", key, epoch))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_at"))
    ends = light.join(sized(planned.where("room < size")), same)
    inside = Window.partitionBy("_source", "_at", "epoch").orderBy("_order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = ends.withColumn("_order", order(F.col("epoch"))).withColumn("used", F.sum("n_tokens").over(inside)).where("used <= room").groupBy("_source", "_at", "epoch").agg(F.max("_order").alias("last"))
    last = last.select(F.col("_source").alias("s2"), F.col("_at").alias("b2"), F.col("epoch").alias("e2"), "last")
    cut = F.col("_source").eqNullSafe(F.col("s2")) & (F.col("_at") == F.col("b2")) & (F.col("epoch") == F.col("e2"))
    plan = materialize(planned.join(last, cut, "left").select("_source", "_at", "epoch", "start", "size", "room", "need", "tokens", "last"))
    chosen = dealt.join(sized(plan), same).withColumn("_order", order(F.col("epoch"))).where("room >= size OR _order <= last")
    place = (F.col("epoch") * F.col("tokens") + F.col("start") + F.col("size") * _hex(F.col("_order")) / F.lit(float(1 << 32))) / F.col("need")
    return chosen.select(*carried, "n_tokens", "epoch", F.coalesce(place, F.lit(0.0)).alias("slot"))
