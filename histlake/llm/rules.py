"""Quality rules: a learned decision list over text statistics.

Sequential covering: a rule for bad texts grows by the threshold condition of greatest
information gain until it covers no good text, is pruned from its end on examples kept
aside, and is taken if it is precise there; what it covers is removed and the next one is
learned. The rules become one ordered Spark conditional expression over the statistics, so
the verdict of every text can be read, and traced to one rule.

Scale: the statistics are one pass over whole texts without an exchange; at most
``per_class`` labelled rows of numbers of each class are learned from.

Defined cases: null and empty texts have no words: all statistics are 0 and the base rule
fails them; texts of any length are counted whole; repeated rows are judged alike; an empty
table gives no rows; without labels of both classes the list is empty and only the base rule
speaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histlake.llm.common import without
from histlake.llm.labels import sample_labelled
from histlake.sources import read_table

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaim", "n_pipes", "n_same_as_last")
WINDOW = 8

#: What rules speak of: name and SQL over the counts. Shares are of words or characters.
MEASURES = {
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaim / greatest(n_words, 1)",
    "pipe_share": "n_pipes / greatest(n_words, 1)",
    "stutter_share": "n_same_as_last / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}

_SYMBOLS = b"#*$%&|<>"


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * (len(COUNTS) + len(MORE))
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in data.split(b"\n") if x.strip()]
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    n_upper = int(((raw >= 65) & (raw <= 90)).sum())
    n_digits = int(((raw >= 48) & (raw <= 57)).sum())
    return (
        n, len(text) - blanks, sum(map(data.count, (bytes([c]) for c in _SYMBOLS))), len(lines) - len(set(lines)), _repeated(ids),
        len(lines), len(numbers), n_upper, n_digits, data.count(b"!"), data.count(b"|"), int((ids[1:] == ids[:-1]).sum()),
    )


def _repeated(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words within windows of so many words that occur at least twice.

    Windows get exact numbers by doubling: pairs, pairs of pairs, and so on (a power of two).
    """
    n = len(ids)
    if n < window + 1:
        return 0
    size = 1
    while size < window:
        pairs = ids[:-size] * np.int64(n + 1) + ids[size:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size *= 2
    twice = np.bincount(ids)[ids] > 1
    change = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    return int((np.cumsum(change)[:n] > 0).sum())


def text_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, the counts and the measures of whole texts."""

    @F.pandas_udf(", ".join(f"{c} long" for c in (*COUNTS, *MORE)))
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([count_text(t if isinstance(t, str) else "") for t in texts], columns=[*COUNTS, *MORE])

    counted = docs.select(F.col(id_col).alias("doc_id"), *keep, count(F.col(text_col)).alias("c")).select("doc_id", *keep, "c.*")
    return counted.withColumns({name: F.expr(f"cast({sql} as double)") for name, sql in MEASURES.items()})


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.threshold if self.above else x[self.measure] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.measure)
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, max_conditions: int, cuts: int) -> Rule:
    """Add the condition of greatest information gain until no good example is covered."""
    rule: list[Condition] = []
    alive = np.ones(len(bad), bool)
    while len(rule) < max_conditions and (alive & ~bad).any():
        p0, n0 = weight[alive & bad].sum(), weight[alive & ~bad].sum()
        best: tuple[float, Condition] | None = None
        for name, values in x.items():
            v = values[alive]
            order = np.argsort(v, kind="stable")
            v, b, w = v[order], bad[alive][order], weight[alive][order]
            p_below, n_below = np.cumsum(w * b), np.cumsum(w * ~b)
            edges = np.flatnonzero(v[1:] > v[:-1])
            # thresholds: all class changes, thinned to at most ``cuts``
            edges = edges[b[edges] != b[edges + 1]] if len(edges) > cuts else edges
            edges = edges[:: max(1, len(edges) // cuts)]
            for above in (True, False):
                p = p_below[-1] - p_below[edges] if above else p_below[edges]
                n = n_below[-1] - n_below[edges] if above else n_below[edges]
                gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
                if len(gain) and (best is None or gain.max() > best[0] + 1e-12):
                    e = edges[int(np.argmax(gain))]
                    best = (float(gain.max()), Condition(name, above, float((v[e] + v[e + 1]) / 2)))
        if best is None or best[0] <= 0:
            break
        rule.append(best[1])
        alive &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule that does best on examples kept aside, and its precision there."""

    def worth(r: Rule) -> tuple[float, float]:
        c = _covers(r, x, len(bad))
        p, n = weight[c & bad].sum(), weight[c & ~bad].sum()
        return (p - 2 * n) / max(p + n, 1e-9) if p + n else -2.0, p / max(p + n, 1e-9)

    options = [(worth(rule[:k]), rule[:k]) for k in range(len(rule), 0, -1)]
    (_, precision), chosen = max(options, key=lambda o: o[0][0])
    return chosen, precision


def learn(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, *, min_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4, cuts: int = 256) -> list[Rule]:
    """Ordered rules for bad examples. Every third example is kept aside for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    aside = np.arange(len(bad)) % 3 == 2
    failures = 0
    while len(rules) < max_rules and (left & bad & ~aside).any() and failures < 2:
        part = lambda mask: {k: v[mask] for k, v in x.items()}
        grow, prune = left & ~aside, left & aside
        rule = _grow(part(grow), bad[grow], weight[grow], max_conditions, cuts)
        if not rule:
            break
        rule, precision = _prune(rule, part(prune), bad[prune], weight[prune])
        covered = _covers(rule, x, len(bad)) & left
        share = weight[covered & bad].sum() / max(weight[covered].sum(), 1e-9)
        if not (covered & bad).any():
            break
        if min(precision, share) >= min_precision:
            rules.append(rule)
        else:
            failures += 1
        left &= ~covered
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), 0 for none: one ordered conditional expression."""
    out = F.lit(0)
    for k in range(len(rules), 0, -1):
        held = rules[k - 1][0].column()
        for c in rules[k - 1][1:]:
            held = held & c.column()
        out = F.when(held, F.lit(k)).otherwise(out)
    return out


def base_failed() -> Column:
    """Too short, or too much of it repeated."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def learn_rules(docs: DataFrame, labels: DataFrame, *, per_class: int = 4000, label: str = "quality") -> list[Rule]:
    """Rules from labelled documents (label 0: bad)."""
    sample = sample_labelled(docs, labels, label, per_class=per_class)
    rows = text_statistics(sample.docs, keep=("label",)).select("doc_id", "label", *MEASURES).toPandas()
    if rows["label"].nunique() < 2:
        return []
    rows = rows.sort_values(["doc_id", *MEASURES], kind="stable", ignore_index=True)
    rows = rows.iloc[np.random.default_rng(3).permutation(len(rows))]
    weight = rows["label"].map(lambda v: sample.weight(int(v))).to_numpy(dtype=float)
    return learn({m: rows[m].to_numpy(dtype=float) for m in MEASURES}, (rows["label"] == 0).to_numpy(), weight)


def judge(docs: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, measures, base_failed, rule (the first that holds, 0: none) and kept."""
    stats = text_statistics(docs, id_col=id_col, text_col=text_col)
    judged = without(stats, "base_failed", "rule", "kept").withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def op5_quality_rules(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
