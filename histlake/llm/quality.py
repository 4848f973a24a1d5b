"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of its n-grams, hashed: byte 1- to 3-grams, and 1- to
3-grams of word shapes (length class, letter case, symbols, digits, and whether the word
repeats the one before), so that shouting, symbol salad and stuttering are seen whatever the
words are. Each indicator is scaled by its log-count ratio between the classes, the vector is
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
Margins become scores by a sigmoid fitted on margins of examples left out of the fit.

Scale: the fit sees at most ``per_class`` labelled documents of each class, each class with
half the weight; the sigmoid's fit weighs them by the classes' counts over all labels, so
scores are shares of label 1 as they occur. Scoring is one pass over whole texts without an exchange,
and the model that goes to the executors has a fixed size (about 2 MB).

Defined cases: null and empty texts have no features and get the bias's score; texts of any
length are taken whole; repeated rows score alike; an empty table gives no rows; without
labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histlake.llm.common import OWN, fold, without
from histlake.llm.labels import Sample, sample_labelled
from histlake.llm.linear import Sigmoid, dual_coordinate_descent, fit_sigmoid
from histlake.sources import read_table

BYTE_BITS, SHAPE_BITS = 18, 16
N_FEATURES = (1 << BYTE_BITS) + (1 << SHAPE_BITS)
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)

_BYTES = np.arange(256, dtype=np.uint8)
_BLANK = np.isin(_BYTES, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_LENGTHS = np.array([2, 4, 7, 11, 17], dtype=np.int64)


def _grams(codes: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of small codes."""
    h = np.full(len(codes) - n + 1, n * 0x01000193, dtype=np.uint32)
    for k in range(n):
        h = (h ^ codes[k : len(codes) - n + 1 + k]) * _ODD[k]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


def _shapes(data: np.ndarray) -> np.ndarray:
    """One code for each word."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint32)
    inside = lambda flags: np.add.reduceat(np.append(flags[data], 0).astype(np.int64), np.stack([starts, ends], 1).ravel())[::2]
    length = ends - starts
    upper, lower, digit, symbol = inside(_UPPER), inside(_LOWER), inside(_DIGIT), inside(_SYMBOL)
    at = np.zeros(len(data), np.uint64)  # place within the word
    at[~blank] = np.flatnonzero(~blank) - np.repeat(starts, length)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * (at * np.uint64(2) + np.uint64(0xBF58476D1CE4E5B9))
    mixed[blank] = 0
    whole = np.add.reduceat(np.append(mixed, np.uint64(0)), np.stack([starts, ends], 1).ravel())[::2]
    same = np.concatenate([[False], whole[1:] == whole[:-1]])
    case = np.where((upper > 1) & (lower == 0), 2, upper > 0)
    many = np.minimum(symbol, 3)
    return ((((np.searchsorted(_LENGTHS, length) * 3 + case) * 4 + many) * 2 + (digit > 0)) * 2 + same).astype(np.uint32)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    codes, shapes = data.astype(np.uint32), _shapes(data)
    parts = [_grams(codes, n, BYTE_BITS) for n in (1, 2, 3) if len(codes) >= n]
    parts += [_grams(shapes, n, SHAPE_BITS) + np.uint32(1 << BYTE_BITS) for n in (1, 2, 3) if len(shapes) >= n]
    if not parts:
        return np.zeros(0, np.int64)
    every = np.concatenate(parts).astype(np.int64)
    place = np.arange(len(every), dtype=np.int32)
    _LAST[every] = place  # of each feature's occurrences, the one written last stays
    return every[_LAST[every] == place]


#: Scratch, per process; never read before it is written.
_LAST = np.empty(N_FEATURES, np.int32)


@dataclass(frozen=True)
class NbSvm:
    """Log-count ratios and weights of the features, the bias, and the scores' sigmoid."""

    ratio: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: float
    sigmoid: Sigmoid

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        norm = float(np.sqrt(r @ r))
        return float(r @ self.weights[found]) / norm + self.bias if norm else self.bias

    def score(self, text: str | None) -> float:
        return float(self.sigmoid(np.array([self.margin(features(text))]))[0])


class _Scaled(Sequence):
    """Each row's features with their values, derived when asked for: values of all rows at once would fill the driver."""

    def __init__(self, rows: list[np.ndarray], ratio: np.ndarray):
        self.rows, self.ratio = rows, ratio
        self.norms = [float(np.sqrt(r @ r)) or 1.0 for r in (ratio[found] for found in rows)]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rows[i], self.ratio[self.rows[i]] / self.norms[i]


def _fit_plain(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, alpha: float, cost: float) -> NbSvm:
    counts = {}
    for sign in (-1, 1):
        total = np.full(N_FEATURES, alpha)
        for found, w in ((rows[i], weight[i]) for i in np.flatnonzero(y == sign)):
            total[found] += w
        counts[sign] = np.log(total / (weight[y == sign].sum() + 2 * alpha))
    ratio = counts[1] - counts[-1]
    scaled = _Scaled(rows, ratio)
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == -1).sum()) * len(y)
    w = dual_coordinate_descent(scaled, y, cost * balance, N_FEATURES)
    return NbSvm(ratio, w[:-1], float(w[-1]), Sigmoid(1.0, 0.0))


def fit(sample: Sample, *, alpha: float = 1.0, cost: float = 1.0, parts: int = 3) -> NbSvm:
    """The model of a sample; the sigmoid comes from margins of ``parts`` models that each leave a part out."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "f": [features(t).astype("<i4").tobytes() for t in pdf["text"]]})

    got = sample.docs.mapInPandas(extract, "doc_id long, label int, f binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["f"])))
    rows = [np.frombuffer(r["f"], "<i4") for r in got]  # as they came, not copied
    y = np.array([1 if r["label"] == 1 else -1 for r in got])
    weight = np.array([sample.weight(int(r["label"])) for r in got])
    if len(set(y.tolist())) < 2:
        total = sum(sample.counts.values())
        share = sample.counts.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(N_FEATURES)
        return NbSvm(zero, zero, 0.0, Sigmoid(0.0, float(np.log(share / (1 - share)))))
    one = np.ones(len(y))
    margin = np.zeros(len(y))
    for part in range(parts):
        left_out = np.arange(len(y)) % parts == part
        inside = np.flatnonzero(~left_out)
        if len(set(y[inside].tolist())) < 2:
            continue
        model = _fit_plain([rows[i] for i in inside], y[inside], one[inside], alpha, cost)
        for i in np.flatnonzero(left_out):
            margin[i] = model.margin(rows[i])
    final = _fit_plain(rows, y, one, alpha, cost)
    return NbSvm(final.ratio, final.weights, final.bias, fit_sigmoid(margin, y == 1, weight))


def score_quality(docs: DataFrame, model: NbSvm, *, threshold: float = 0.3, text_col: str = "text", outputs: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and whether it reaches the threshold (1 or 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(
        NbSvm(model.ratio.astype(np.float32), model.weights.astype(np.float32), model.bias, model.sigmoid)
    )

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        for texts in batches:
            margins = np.array([fitted.margin(features(t if isinstance(t, str) else "")) for t in texts], dtype=float)
            yield pd.Series(fitted.sigmoid(margins))

    name, verdict = outputs
    scored = without(docs, *outputs).withColumn(name, score(F.col(text_col)))
    return scored.withColumn(verdict, (F.col(name) >= threshold).cast("int"))


#: The contract's folds: rows whose crc32(doc_id) mod 5 is 0 are never learned from.
FOLDS, HELD_OUT = 5, 0


def fit_on_tables(docs: DataFrame, labels: DataFrame) -> NbSvm:
    return fit(sample_labelled(docs, labels, "quality", folds=FOLDS, held_out=HELD_OUT))


def op1_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_tables(docs, read_table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, model: NbSvm, *, text_col: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    names = (f"{OWN}score", f"{OWN}predicted")
    return score_quality(docs, model, text_col=text_col, outputs=names).where(F.col(names[1]) == 1).drop(*names)
