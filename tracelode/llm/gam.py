"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into quantile bins. Shallow trees are boosted in cycles over the features,
each tree on one feature's bins (or one pair's grid of bins), and their sum is kept as a
lookup table for each feature and pair. A score is the sum of the tables' entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelode.llm.texthash import SPACE, raw, words

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "non_ascii", "spaced_marks", "ends_marked",
    "shouted", "repeated_next", "distinct_words", "repeated_lines", "line_words", "stop_marks",
)
BINS = 32
PAIR_BINS = 8
PAIRS = 6
CYCLES = 60
RATE = 0.15
#: At most so many labelled rows are fitted, those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
HELD_OUT = 5
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_SYMBOL = _MARK & ~_STOP
_SYMBOL[[34, 39, 40, 41, 45]] = False
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


def features(data: np.ndarray) -> np.ndarray:
    """The FEATURES of one text's bytes; zeros for a text without words."""
    hashes, starts = words(data)
    n = len(hashes)
    if not n:
        return np.zeros(len(FEATURES))
    space = SPACE[data]
    after = np.flatnonzero(np.diff(np.concatenate((space, [True])).astype(np.int8)) == 1)
    ends = after + 0
    length = ends - starts + 1
    first, last = data[starts], data[ends]
    letters = max(1, np.count_nonzero(_LETTER[data]))
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    word_upper = upper[ends + 1] - upper[starts]
    lines = np.concatenate(([0], np.flatnonzero(data == 10) + 1))
    at = np.searchsorted(starts, lines)
    at = np.unique(at[at < n])
    sums = np.add.reduceat(hashes * (np.arange(n, dtype=np.uint64) - np.repeat(at, np.diff(np.append(at, n))).astype(np.uint64) + np.uint64(1)), at)
    return np.array([
        np.log1p(n), length.mean(), np.count_nonzero(_UPPER[data]) / letters, np.count_nonzero(_DIGIT[data]) / len(data),
        np.count_nonzero(_SYMBOL[data]) / len(data), np.count_nonzero(data >= 128) / len(data),
        np.count_nonzero((length == 1) & _MARK[first]) / n, np.count_nonzero(_SYMBOL[last] | (last == 33)) / n,
        np.count_nonzero((word_upper == np.maximum(1, np.minimum(length, 2))) | (word_upper > 1)) / n,
        np.count_nonzero(hashes[1:] == hashes[:-1]) / n, len(np.unique(hashes)) / n,
        1 - len(np.unique(sums)) / len(at), n / len(at), np.count_nonzero(_STOP[data]) / n,
    ])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: pd.Series) -> pd.Series:
    data, at = raw(pa.array(texts, pa.large_string(), from_pandas=True))
    return pd.Series([features(data[at[i] : at[i + 1]]) for i in range(len(texts))], dtype=object)


@dataclass
class Model:
    """cuts: each feature's bin borders; tables: a value for each bin; pairs: (i, j, table); bias: the rest."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        total = np.full(len(x), self.bias)
        for i, table in enumerate(self.tables):
            total += table[bins[:, i]]
        for i, j, table in self.pairs:
            total += table[coarse(bins[:, i], self.cuts[i]), coarse(bins[:, j], self.cuts[j])]
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(cuts)], axis=1) if len(x) else np.zeros((0, len(cuts)), int)


def coarse(bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(cuts) + 1)


def _tree(gradient: np.ndarray, hessian: np.ndarray, depth: int = 2, ridge: float = 1.0) -> np.ndarray:
    """A tree over ordered bins: at each level the split that gains most; leaves by Newton's step."""
    g, h = gradient.sum(), hessian.sum()
    if depth and len(gradient) > 1:
        left_g, left_h = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1]
        gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > 1e-9:
            return np.concatenate((_tree(gradient[:cut], hessian[:cut], depth - 1, ridge), _tree(gradient[cut:], hessian[cut:], depth - 1, ridge)))
    return np.full(len(gradient), g / (h + ridge))


def _grid_tree(gradient: np.ndarray, hessian: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A tree over a grid: one cut of each axis, four leaves; the cuts that gain most."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(gradient)
    for i in range(gradient.shape[0] - 1):
        for j in range(gradient.shape[1] - 1):
            gs = (g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j])
            hs = (h[i, j], h[i, -1] - h[i, j], h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j])
            values = [a / (b + ridge) for a, b in zip(gs, hs, strict=True)]
            gain = sum(a * v for a, v in zip(gs, values, strict=True))
            if gain > best:
                best = gain
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cycles over features, then over the pairs that gain most on what is left. Without both labels: their share alone."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(len(FEATURES))]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], [], float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    bins = binned(x, cuts)
    total = np.full(len(x), model.bias)

    def push() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(CYCLES):
        for i, table in enumerate(model.tables):
            g, h = push()
            step = RATE * _tree(np.bincount(bins[:, i], g, len(table)), np.bincount(bins[:, i], h, len(table)))
            table += step
            total += step[bins[:, i]]
    small = [coarse(bins[:, i], c) for i, c in enumerate(cuts)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(small[i] * PAIR_BINS + small[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = push()
    gains = sorted(((float((_grid_tree(grid(i, j, g), grid(i, j, h)) * grid(i, j, g)).sum()), -i, -j) for i in range(len(cuts)) for j in range(i)), reverse=True)
    model.pairs = [(-i, -j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains[:PAIRS]]
    for _ in range(CYCLES // 3):
        for i, j, table in model.pairs:
            g, h = push()
            step = RATE * _grid_tree(grid(i, j, g), grid(i, j, h))
            table += step
            total += step[small[i], small[j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 on division by 5; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % HELD_OUT == 0


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most sample_rows labelled rows that aren't held out, those of the smallest id hashes.

    Ids whose labels differ take their smallest, ids with several texts the text of the
    smallest hash; null labels and null ids take no part.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marked = marked.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample_rows).drop("h")
    # The sample has sample_rows rows of 16 bytes at most, which bounds what is broadcast and brought here.
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    rows = rows.select("doc_id", feature_column("text").alias("x"), F.xxhash64("text").alias("t"), "quality")
    rows = rows.groupBy("doc_id").agg(F.min_by("x", "t").alias("x"), F.first("quality").alias("quality")).toPandas().sort_values("doc_id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x.astype(float), rows["quality"].to_numpy(float))


def score_column(model: Model):
    """A function of a text column: the model's scores."""
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        data, at = raw(pa.array(texts, pa.large_string(), from_pandas=True))
        x = np.array([features(data[at[i] : at[i + 1]]) for i in range(len(texts))]).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(x))

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each document: doc_id, held_out, score, predicted.

    Takes columns doc_id and text of docs and doc_id and quality of labels; others are
    ignored, whatever their names. Null, empty and blank texts have all features 0 and get the
    score of that point. Repeated rows and null ids each give a row. Without labels, or with one
    label only, every score is the share of label 1, smoothed. An empty table gives no rows.
    """
    model = learn(docs, labels, sample_rows)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model)(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
