"""The divergence audit against dictionaries and whole numbers of any size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from histlake.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, min_docs, top):
    """rows: (text, lang, source)."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        words = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        v = len(kept)

        def smooth(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        p, q = {s: smooth(counts[lang, s]) for s in sources}, smooth(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "tHe's", "é", "É", "ß", "ﬀ", "\U0001f600x", "a1b", "l'été", "_", "x_y", "ſ", "İ"] + ["".join(rng.choice("abcABC") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["s1", "s2", "S", "é", "", None, "s10"])
        rows.append((rng.choice([" ", "\n", "-"]).join(rng.choices(words, k=rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "none"), ("", "fr", "a"), ("1 2 3", "fr", "b"), ("rare", "xx", "one")]
    return rows + [("same text here", "en", "s1")] * 40


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("entries, min_docs", [(1 << 14, 10), (7, 3), (1, 25)])
def test_every_row_as_by_hand(spark, entries, min_docs):
    rows = corpus(300)
    docs = spark.createDataFrame([(t, la, s, "x", 1.0) for t, la, s in rows], "text string, lang string, source string, term string, VALUE double").repartition(5)
    assert result(D.audit_sources(docs, min_docs=min_docs, slice_entries=entries, top_terms=4)) == by_hand(rows, min_docs, 4)


def test_rare_terms_and_nothing(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("", "de", "z")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(D.audit_sources(docs)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)] == by_hand(rows, 10, 10)
    assert result(D.audit_sources(docs.limit(0))) == []


def test_odd_tables(spark, odd, odd_rows, empty):
    docs = odd.selectExpr("*", "n_chars as lang")
    assert result(D.audit_sources(docs, min_docs=1)) == by_hand([(r[1], None if r[3] is None else str(r[3]), r[2]) for r in odd_rows], 1, 10)
    assert result(D.audit_sources(empty.selectExpr("*", "kept as lang"))) == []


def test_counts_beyond_a_long_times_the_scale(spark):
    """10^9 times a count of 10^12 does not fit a long; the quotient is exact all the same."""
    rows = spark.createDataFrame([(10**12, 3 * 10**12, 5), (0, 10**18, 10**6)], "c long, n long, v long")
    got = [r[0] for r in rows.select(D._smoothed(rows.c, rows.n, rows.v)).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in [(10**12, 3 * 10**12, 5), (0, 10**18, 10**6)]]


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["lang", "source", "text"])


def counted(batches):
    found = Counter()
    for b in D.count_terms(iter(batches)):
        for r in b.to_pylist():
            found[r["lang"], r["source"], r["term"], "n"] += r["n"]
            found[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    return found


def plainly(rows):
    found = Counter()
    for lang, source, text in rows:
        words = Counter(TERM.findall(text.translate(LOWER)))
        for w, n in words.items():
            found[lang, source, w, "n"] += n
            found[lang, source, w, "docs"] += 1
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.text(alphabet="aAbz@[`{ \n\x7f\x80é\U0001f600", max_size=60)), max_size=12), st.integers(1, 40))
def test_blocks_and_cuts_lose_nothing(rows, block):
    D.BLOCK_BYTES, before = block, D.BLOCK_BYTES
    try:
        assert counted([batch(rows), batch(rows).slice(len(rows) // 2)]) == plainly(rows + rows[len(rows) // 2 :])
    finally:
        D.BLOCK_BYTES = before


def test_hash_collisions_are_told_apart(monkeypatch):
    rows = [("a", "x", t) for t, *_ in corpus(40, 2) if t]
    want = plainly(rows)
    for weak in (len, lambda word: 0, lambda word: word[0]):
        monkeypatch.setattr(D, "digest", weak)
        assert counted([batch(rows)]) == want


def test_sparse_sums_are_the_dense_ones():
    rng = np.random.default_rng(4)
    for _ in range(20):
        s, v = rng.integers(1, 9), rng.integers(0, 30)
        base = rng.integers(1, 10**9, s)
        dense = np.repeat(base[:, None], v, 1)
        there = rng.random((s, v)) < 0.3
        dense[there] = rng.integers(1, 10**9, there.sum())
        indptr = np.concatenate([[0], np.cumsum(there.sum(1))])
        got = D.pair_sums(indptr, np.nonzero(there)[1], dense[there], base, v, most=5)
        for i in range(s):
            for j in range(i + 1, s):
                assert got[i, j] == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(dense[i], dense[j], strict=True))
