"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel counts common subsequences of three characters, gaps allowed: an occurrence that
spans k characters weighs decay**k, up to a span of seven, so an insult with characters put
in ("id.io-t"), stretched or inflected still shares most of its subsequences with the plain
one. The kernel is normalised by the lengths of its two strings.

A sentence is made of spans: its words (long ones in overlapping windows), and runs of
single characters joined ("i d i o t"). A sentence is as toxic as its most toxic span, and a
text as its most toxic sentence. Labels mark texts, so the fit alternates: take each toxic
text's most suspicious span (at first the one most typical of toxic texts, if it recurs) and each clean
text's, fit, and choose again.

The machine is linear in the Nystroem features K(s, Z) K(Z, Z)^(-1/2) of at most
``n_landmarks`` landmark spans Z, and is fitted by dual coordinate descent. Since the kernel
is an inner product over hashed subsequences, weights and landmarks fold into one table of
subsequence weights: scoring a span reads a few dozen table entries and no landmark.

Scale: the fit sees at most ``per_class`` labelled texts of each class; scoring is one pass
over whole texts without an exchange, with a table of fixed size (1 MB) and a bounded cache
of spans per worker.

Defined cases: null and empty texts have no spans and get the lowest score; texts of any
length are taken whole; repeated rows score alike; an empty table gives no rows; without
labels of both classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histlake.llm.common import fold, without
from histlake.llm.labels import Sample, sample_labelled
from histlake.llm.linear import Sigmoid, dual_coordinate_descent, fit_sigmoid
from histlake.sources import read_table

BITS, SPAN, DECAY = 18, 7, 0.7
#: Longer words are read in windows of this length, every half of it.
WINDOW = 24
CACHE_SPANS = 400_000
NO_SPANS = -2.0
#: A span starts the fit if so many toxic texts have it, and so many times the share of clean texts.
MIN_TEXTS, MIN_LIFT = 3, 8

_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_EDGES = ".,;:!?\"'()[]{}<>«»¿¡-_*#|/\\"


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s.strip()]


def spans(text: str | None) -> set[str]:
    """The distinct spans of a text (or sentence), lower-cased, without outer punctuation."""
    low = (text or "").lower()
    found = {w.strip(_EDGES) for w in set(low.split())}
    found.update("".join(m.split()) for m in _SPACED.findall(low))
    for w in [w for w in found if len(w) > WINDOW]:
        found.discard(w)
        found.update(w[k : k + WINDOW] for k in range(0, len(w) - WINDOW // 2, WINDOW // 2))
    found.discard("")
    return found


def _triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word number, hash, weight) of all subsequences, by gap pattern; words get edge marks."""
    gap = "\0" * (SPAN - 1)
    joined = gap.join(f"\2{w}\3" for w in words) + gap
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(w) + 2 + SPAN - 1 for w in words])
    owner = np.repeat(np.arange(len(words)), lengths)
    n = len(codes)
    for b in range(2, SPAN):
        for a in range(1, b):
            x, y, z = codes[: n - b], codes[a : n - b + a], codes[b:]
            at = np.flatnonzero((x != 0) & (y != 0) & (z != 0))
            h = (x[at] * np.uint32(0x9E3779B1)) ^ (y[at] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + z[at] * np.uint32(0x165667B1)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)
            yield owner[at], h >> np.uint32(32 - BITS), DECAY ** (b + 1)


def _norms(words: list[str]) -> np.ndarray:
    total = np.zeros(len(words))
    for owner, _, w in _triples(words):
        total += np.bincount(owner, minlength=len(words)) * w * w
    return np.sqrt(np.maximum(total, 1e-12))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of every word with every landmark."""
    table = np.zeros((1 << BITS, len(landmarks)), np.float32)
    for owner, h, w in _triples(landmarks):
        np.add.at(table, (h, owner), np.float32(w))
    table /= _norms(landmarks).astype(np.float32)
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 256):
        part = words[at : at + 256]
        for owner, h, w in _triples(part):
            if len(h):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                out[at + owner[starts]] += w * np.add.reduceat(table[h], starts, axis=0)
        out[at : at + len(part)] /= _norms(part)[:, None]
    return out


@dataclass(frozen=True)
class SubsequenceSvm:
    """Weights of hashed subsequences, the bias, the scores' sigmoid, and the landmarks they came from."""

    table: np.ndarray = field(repr=False)
    bias: float
    sigmoid: Sigmoid
    landmarks: tuple[str, ...] = ()

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        total, norm = np.zeros(len(words)), np.zeros(len(words))
        for owner, h, w in _triples(words):
            total += np.bincount(owner, self.table[h], minlength=len(words)) * w
            norm += np.bincount(owner, minlength=len(words)) * (w * w)
        return total / np.sqrt(np.maximum(norm, 1e-12)) + self.bias

    def text_margin(self, text: str | None) -> float:
        found = sorted(spans(text))
        return float(self.margins(found).max()) if found else NO_SPANS

    def sentence_scores(self, text: str | None) -> list[tuple[str, float]]:
        """Every sentence with its own score."""
        return [(s, float(self.sigmoid(np.array([self.text_margin(s)]))[0])) for s in sentences(text)]


def _fit_plain(bags: list[list[str]], y: np.ndarray, n_landmarks: int, cost: float, rounds: int, rng) -> SubsequenceSvm:
    seen = {1: Counter(), -1: Counter()}
    for bag, label in zip(bags, y, strict=True):
        seen[int(label)].update(bag)
    n1, n0 = int((y == 1).sum()), int((y == -1).sum())

    def typical(w: str) -> float:
        p = seen[1][w]
        return np.sqrt(p) * (np.log((p + 0.5) / (n1 + 1)) - np.log((seen[-1][w] + 0.5) / (n0 + 1)))

    toxic = [i for i in np.flatnonzero(y == 1) if bags[i]]
    clean = [i for i in np.flatnonzero(y == -1) if bags[i]]
    vocabulary = sorted(set().union(*bags))
    number = {w: k for k, w in enumerate(vocabulary)}
    numbers = {i: np.array([number[w] for w in bags[i]]) for i in [*toxic, *clean]}
    chosen = {i: max(bags[i], key=lambda w: (typical(w), w)) for i in toxic}
    # Labels are noisy: a text explains nothing unless its span recurs in toxic texts, and rarely elsewhere.
    known = {i: w for i, w in chosen.items() if seen[1][w] >= MIN_TEXTS and seen[1][w] * (n0 + 1) >= MIN_LIFT * (seen[-1][w] + 0.5) * (n1 + 1)}
    chosen = known or chosen
    top = Counter(chosen.values())
    landmarks = [w for w, _ in sorted(top.items(), key=lambda x: (-x[1], x[0]))[: n_landmarks * 3 // 4]]
    common = sorted(seen[-1].items(), key=lambda x: (-x[1], x[0]))
    step = max(1, len(common) // max(1, n_landmarks - len(landmarks)))
    landmarks += [w for w, _ in common[::step] if w not in set(landmarks)][: n_landmarks - len(landmarks)]
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-4 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])

    table = np.zeros((1 << BITS, len(landmarks)), np.float32)
    for owner, h, w in _triples(landmarks):
        np.add.at(table, (h, owner), np.float32(w))
    table /= _norms(landmarks).astype(np.float32)

    negative = {bags[i][int(k)] for i in clean for k in rng.integers(0, len(bags[i]), 3)}
    model = SubsequenceSvm(np.zeros(1 << BITS), -1.0, Sigmoid(1.0, 0.0))
    for turn in range(rounds):
        if turn:
            margin = np.concatenate([model.margins(vocabulary[k : k + 8192]) for k in range(0, len(vocabulary), 8192)])
            worst = {i: k[int(np.argmax(margin[k]))] for i, k in numbers.items()}
            chosen = {i: vocabulary[worst[i]] for i in toxic if margin[worst[i]] > 0} or chosen
            negative |= {vocabulary[worst[i]] for i in clean}
        positive = [w for w in chosen.values() if w not in negative]
        words = positive + sorted(negative)
        if not positive or not negative:
            break
        label = np.array([1] * len(positive) + [-1] * len(negative))
        x = kernel(words, landmarks) @ whiten
        balance = np.where(label == 1, 0.5 / len(positive), 0.5 / len(negative)) * len(label)
        every = np.arange(x.shape[1])
        w = dual_coordinate_descent([(every, row) for row in x], label, cost * balance, x.shape[1])
        model = SubsequenceSvm((table @ (whiten @ w[:-1]).astype(np.float32)), float(w[-1]), Sigmoid(1.0, 0.0), tuple(landmarks))
    return model


def fit(sample: Sample, *, n_landmarks: int = 128, cost: float = 1.0, rounds: int = 4, parts: int = 2, seed: int = 7) -> SubsequenceSvm:
    """The model of a sample; the sigmoid comes from margins of models that each leave a part out."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "spans": [sorted(spans(t)) for t in pdf["text"]]})

    got = sample.docs.mapInPandas(extract, "doc_id long, label int, spans array<string>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["spans"]))
    bags = [r["spans"] for r in got]
    y = np.array([1 if r["label"] == 1 else -1 for r in got])
    weight = np.array([sample.weight(int(r["label"])) for r in got])
    if len(set(y.tolist())) < 2:
        total = sum(sample.counts.values())
        share = sample.counts.get(1, 0) / total if total else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return SubsequenceSvm(np.zeros(1 << BITS, np.float32), 0.0, Sigmoid(0.0, float(np.log(share / (1 - share)))))
    rng = np.random.default_rng(seed)
    margin = np.full(len(y), NO_SPANS)
    for part in range(parts):
        left_out = np.arange(len(y)) % parts == part
        inside = np.flatnonzero(~left_out)
        if len(set(y[inside].tolist())) < 2:
            continue
        model = _fit_plain([bags[i] for i in inside], y[inside], n_landmarks, cost, rounds, rng)
        for i in np.flatnonzero(left_out):
            if bags[i]:
                margin[i] = model.margins(bags[i]).max()
    final = _fit_plain(bags, y, n_landmarks, cost, rounds, rng)
    return SubsequenceSvm(final.table, final.bias, fit_sigmoid(margin, y == 1, weight), final.landmarks)


def score_toxicity(docs: DataFrame, model: SubsequenceSvm, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with a score (0 to 1) and whether it reaches the threshold (1 or 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        cache: dict[str, float] = {}
        for texts in batches:
            out: list[float] = []
            for at in range(0, len(texts), 256):
                found = [spans(t if isinstance(t, str) else "") for t in texts.iloc[at : at + 256]]
                if len(cache) > CACHE_SPANS:
                    cache.clear()
                missing = list(set().union(*found).difference(cache))
                for k in range(0, len(missing), 8192):
                    part = missing[k : k + 8192]
                    cache.update(zip(part, fitted.margins(part).tolist(), strict=True))
                out += [max(map(cache.__getitem__, s), default=NO_SPANS) for s in found]
            yield pd.Series(fitted.sigmoid(np.array(out, dtype=float)))

    scored = without(docs, "score", "predicted").withColumn("score", score(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: The contract's folds: rows whose crc32(doc_id) mod 4 is 2 are never learned from.
FOLDS, HELD_OUT = 4, 2


def op4_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    sample = sample_labelled(docs, read_table(spark, sf_dir, "labels"), "toxic", folds=FOLDS, held_out=HELD_OUT, per_class=1500)
    scored = score_toxicity(docs, fit(sample))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
