"""Language identification with error-correcting output codes.

Each language has a codeword. One linear classifier over byte n-grams predicts each bit of the word; its weights are the
log ratios of smoothed n-gram shares between the languages whose bit is 1 and those whose bit is 0. The text gets the
language whose codeword costs least under an exponential loss, every bit weighted by how well its classifier separates the
training profiles. A small gap to the second language is flagged as ambiguous.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null label are not learned from. An
empty training table gives ``und`` everywhere. Repeated rows count as often as they occur; ties go to the language that
sorts first. Other input columns are passed through unless they bear the name of an output column, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import Words, bytes_of, pieces
from faultline.session import ship_package

#: n-grams are hashed into this many features: the model has a fixed size.
FEATURES = 1 << 16
SIZES = (1, 2, 3, 4)
#: Bytes of text looked at together: the features of their vocabulary take about a hundred times that.
PIECE = 2_000_000
#: A difference of losses below this share of the best one is ambiguous.
GAP = 0.1
NONE = "und"
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    scale: np.ndarray  # bits: typical size of a margin
    trust: np.ndarray  # bits: weight in the decoding


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """All distinct splits of up to six languages; beyond that random words with the widest least distance."""
    if k <= 6:
        columns = [(1, *rest) for rest in product((1, -1), repeat=k - 1) if -1 in rest]
        return np.array(columns, np.int8).T.reshape(k, -1)
    bits, random = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(50):
        words = random.choice(np.array([-1, 1], np.int8), (k, bits))
        words = words[:, np.abs(words.sum(0)) < k]
        distance = (words.shape[1] - words.astype(int) @ words.T.astype(int)) // 2
        nearest = distance[~np.eye(k, dtype=bool)].min()
        if nearest > least:
            best, least = words, nearest
    return best


def _grams(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all n-grams of all words, a space on either side, and the word of each."""
    buffer = np.frombuffer(b" " + b" ".join(vocabulary) + b" ", np.uint8)
    space = buffer == 32
    owner = np.cumsum(space) - 1 - space  # the space before a word belongs to the word before it ...
    features, words = [], []
    h = np.zeros(len(buffer), np.uint64)
    for n in range(1, max(SIZES) + 1):
        length = len(buffer) - n + 1
        h = h[:length] * np.uint64(257) + buffer[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n not in SIZES:
            continue
        inside = np.ones(length, bool)
        for k in range(1, n - 1):
            inside &= ~space[k : k + length]
        if n == 1:
            inside &= ~space
        features.append((((h + np.uint64(n)) * _ODD) >> np.uint64(48)).astype(np.int64)[inside] & (FEATURES - 1))
        words.append((owner[:length] + space[:length])[inside])  # ... so move it to the word it opens
    features, words = np.concatenate(features), np.concatenate(words)
    kept = words < len(vocabulary)
    order = np.argsort(words[kept], kind="stable")
    return features[kept][order], words[kept][order]


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """Learn from all rows with a label. Every text weighs the same; a task sends at most languages x FEATURES sums."""
    ship_package(labelled.sparkSession)

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, text, PIECE):
            words = Words(bytes_of(batch.column(text)), lower=True)
            if not words.vocabulary:
                continue
            labels = np.array(batch.column(label).to_pylist(), object)[words.owner]
            weight = 1.0 / words.lengths[words.owner]
            features, owner = _grams(words.vocabulary)
            for name in set(labels):
                mine = labels == name
                per_word = np.bincount(words.codes[mine], weight[mine], len(words.vocabulary))
                sums[name] = sums.get(name, 0) + np.bincount(features, per_word[owner], FEATURES)
        for name, values in sums.items():
            at = np.flatnonzero(values)
            yield pa.record_batch({"label": pa.array([name] * len(at), pa.string()), "feature": pa.array(at, pa.int32()), "weight": pa.array(values[at])})

    known = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias(label), text)
    rows = known.mapInArrow(profiles, "label string, feature int, weight double").groupBy("feature", "label").agg(F.sum("weight").alias("weight"))
    table = rows.toPandas()  # at most languages x FEATURES rows, whatever the input
    languages = sorted(table["label"].unique())
    share = np.zeros((len(languages), FEATURES))
    if len(table):
        share[table["label"].map(languages.index).to_numpy(), table["feature"].to_numpy()] = table["weight"].to_numpy()
    share = share + 1e-4 * np.maximum(share.sum(1, keepdims=True), 1e-9) / FEATURES
    share = share / share.sum(1, keepdims=True)
    code = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 1), np.int8)
    weights = np.zeros((FEATURES, code.shape[1]))
    for bit in range(code.shape[1]):
        one, other = code[:, bit] > 0, code[:, bit] < 0
        if other.any():
            weights[:, bit] = np.log(share[one].mean(0)) - np.log(share[other].mean(0))
    margins = share @ weights  # of each language's own profile
    right = margins * code
    scale = np.maximum(np.abs(margins).mean(0), 1e-9) if len(languages) else np.ones(1)
    trust = np.maximum(right.min(0) / scale, 0.05) if len(languages) else np.ones(1)
    return Model(languages, code.astype(float), weights.astype(np.float32), scale, trust / trust.sum())


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1: share of the exponential weights that the winner has) and ambiguous."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # FEATURES x bits numbers
    names = ["lang_pred", "score", "ambiguous"]
    carried = [c for c in docs.columns if c not in names]
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in pieces(batches, text, PIECE):
            texts = batch.column(text).to_pylist()
            words = Words(bytes_of(batch.column(text)), lower=True)
            n = len(texts)
            sums, grams = np.zeros((n, m.code.shape[1] if m.languages else 1)), np.ones(n)
            if words.vocabulary and m.languages:
                features, owner = _grams(words.vocabulary)
                first = np.searchsorted(owner, np.arange(len(words.vocabulary)))
                per_word = np.add.reduceat(m.weights[features], first, axis=0)
                size = np.bincount(owner, minlength=len(words.vocabulary))
                full = np.flatnonzero(words.lengths)
                sums[full] = np.add.reduceat(per_word[words.codes], words.bounds[:-1][full], axis=0)
                grams[full] = np.add.reduceat(size[words.codes], words.bounds[:-1][full])
            margin = sums / grams[:, None] / m.scale
            named, score, unsure = [NONE] * n, np.zeros(n), np.zeros(n, bool)
            if m.languages:
                loss = np.stack([(np.exp(-np.clip(margin * c, -6, 6)) * m.trust).sum(1) for c in m.code], 1)
                weight = np.exp(4 * (loss.min(1, keepdims=True) - loss))
                best, ranked = loss.argmin(1), np.sort(loss, 1)
                top = weight.max(1) / weight.sum(1)
                for i, t in enumerate(texts):
                    if t and _LETTER.search(t):
                        named[i], score[i] = m.languages[best[i]], top[i]
                        unsure[i] = len(m.languages) > 1 and ranked[i, 1] - ranked[i, 0] < GAP * ranked[i, 0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(named, pa.string()), pa.array(score), pa.array(unsure)], names=carried + names)

    return docs.select(*carried).mapInArrow(label, schema)


def identify(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang") -> DataFrame:
    """Fit on the rows where ``learn`` holds, then label every row."""
    return predict(docs, fit(docs.where(learn), text, label), text)
