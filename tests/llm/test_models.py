"""Quality, toxicity and rules: held-out accuracy, counts against brute force, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from histlake.llm import quality, rules, toxicity
from histlake.llm.labels import sample_labelled
from histlake.llm.linear import dual_coordinate_descent, fit_sigmoid

SYLLABLES = ["ta", "ri", "mo", "len", "sho", "ka", "vu", "des", "pir", "on", "al", "ge"]
BAD = ["grumbag", "snotfel", "durkwit"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def text(rng, n):
    return ". ".join(" ".join(word(rng) for _ in range(8)).capitalize() for _ in range(n // 8)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for doc in range(600):
        t = text(rng, rng.choice([24, 80, 200]))
        good, toxic = 1, 0
        if doc % 5 == 0:
            good = 0
            w = t.split()
            t = {0: " ".join(x + rng.choice(["***", "$$$", "%%%"]) for x in w), 1: " ".join(x.upper() + "!!" for x in w), 2: " ".join(" ".join([x] * 9) for x in w[:20])}[doc % 3]
        elif doc % 7 == 0:
            toxic = 1
            w = t.split()
            insult = rng.choice(BAD)
            if doc % 2:
                k = rng.randrange(1, len(insult) - 1)
                insult = insult[:k] + rng.choice([".", "-", "x"]) + insult[k:]
            w.insert(rng.randrange(len(w)), insult)
            t = " ".join(w)
        docs.append((doc, t))
        labels.append((doc, good, toxic))
    labels += [(None, 1, 0), (5000, 1, 0), (0, None, None), (3, 7, 7)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {d: (g, x) for d, g, x in labels},
    )


def accuracy(rows, truth, col, folds, out):
    import zlib

    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % folds == out]
    assert len(held) > 50
    return np.mean([r["predicted"] == truth[r["doc_id"]][col] for r in held])


def test_quality_on_held_out_documents(corpus):
    docs, labels, truth = corpus
    rows = quality.score_quality(docs, quality.fit_on_tables(docs, labels)).collect()
    assert accuracy(rows, truth, 0, 5, 0) > 0.95
    assert all(0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_toxicity_on_held_out_documents(corpus):
    docs, labels, truth = corpus
    sample = sample_labelled(docs, labels, "toxic", folds=4, held_out=2)
    model = toxicity.fit(sample)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert accuracy(rows, truth, 1, 4, 2) > 0.95
    spaced = " ".join(BAD[0])
    tried = {t: model.text_margin(f"Ta ri molen. {t} shoka vu.") for t in (BAD[0], BAD[0][:3] + "." + BAD[0][3:], spaced, "desonal")}
    assert min(list(tried.values())[:3]) > tried["desonal"]
    worst = max(model.sentence_scores(f"Molen ta ri. Sho {BAD[1]} ka. Al ge on."), key=lambda s: s[1])
    assert BAD[1] in worst[0]


def test_samples_keep_to_their_folds_and_bound(corpus):
    import zlib

    docs, labels, _ = corpus
    sample = sample_labelled(docs, labels, "quality", folds=5, held_out=0, per_class=30)
    rows = sample.docs.collect()
    assert Counter(r["label"] for r in rows) == {0: 30, 1: 30}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert sample.weight(1) > sample.weight(0) > 1


def test_scores_of_odd_rows(spark, corpus, odd, odd_rows, empty):
    docs, labels, _ = corpus
    q = quality.fit_on_tables(docs, labels)
    t = toxicity.fit(sample_labelled(docs, labels, "toxic"))
    for scored, none in ((quality.score_quality(odd, q), q.score("")), (toxicity.score_toxicity(odd, t), None)):
        rows = scored.collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
        nothing = {r["score"] for r in rows if not (r["text"] or "").strip() and (r["text"] or "") == ""}
        assert len(nothing) == 1 and (none is None or abs(nothing.pop() - none) < 1e-6)
    assert quality.score_quality(empty, q).count() == 0 and toxicity.score_toxicity(empty, t).count() == 0
    kept = quality.keep_quality(odd, q)
    assert kept.columns == odd.columns


def test_without_labels_scores_are_the_prior(spark, corpus, odd):
    docs, labels, _ = corpus
    for part, want in ((labels.where("false"), 0.5), (labels.where("quality = 1"), 1.0)):
        model = quality.fit_on_tables(docs, part)
        assert abs(model.score("some text") - want) < 1e-3
        other = toxicity.fit(sample_labelled(docs, part.selectExpr("doc_id", "quality as toxic"), "toxic"))
        assert all(abs(r["score"] - want) < 1e-3 for r in toxicity.score_toxicity(odd, other).collect())
        assert rules.learn_rules(docs, part) == []


def test_kernel_is_the_sum_over_gapped_subsequences():
    def brute(s, z):
        def phi(w):
            w = f"\2{w}\3"
            out = Counter()
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        out[w[i], w[j], w[k]] += toxicity.DECAY ** (k - i + 1)
            return out

        def norm(w):
            w = f"\2{w}\3"
            return np.sqrt(sum(toxicity.DECAY ** (2 * (k - i + 1)) for i in range(len(w)) for k in range(i + 2, min(len(w), i + toxicity.SPAN)) for _ in range(i + 1, k)))

        a, b = phi(s), phi(z)
        return sum(a[u] * b[u] for u in a) / norm(s) / norm(z)

    words = ["idiot", "id.io.t", "ab", "clown", "c"]
    got = toxicity.kernel(words, words)
    for i, s in enumerate(words):
        for j, z in enumerate(words):
            assert got[i, j] == pytest.approx(brute(s, z), abs=1e-5)


def test_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = np.where(x @ [2, -1, 0.5] + 0.3 > 0, 1, -1)
    w = dual_coordinate_descent([(np.arange(3), r) for r in x], y, np.full(200, 10.0), 3, epochs=100)
    margin = x @ w[:3] + w[3]
    assert (np.sign(margin) == y).mean() > 0.97
    assert fit_sigmoid(margin, y == 1, np.ones(200))(np.array([5.0]))[0] > 0.9


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeat))


def test_counts_match_brute_force(odd_rows):
    rng = random.Random(1)
    texts = [r[1] for r in odd_rows] + ["\n".join(" ".join(rng.choice(["a", "b|", "é", " "]) for _ in range(rng.randint(0, 30))) for _ in range(4)) for _ in range(300)]
    for t in texts:
        if t and not re.search(r"\S", t):
            assert rules.count_text(t)[:5] == (0, 0, 0, 0, 0)
        else:
            assert rules.count_text(t)[:5] == brute_counts(t)


def test_rules_judge_as_they_read(corpus, odd, odd_rows, empty):
    docs, labels, truth = corpus
    learned = rules.learn_rules(docs, labels)
    assert learned and all(str(c) for r in learned for c in r)
    rows = rules.judge(docs, learned).collect()
    right = np.mean([r["kept"] == bool(truth[r["doc_id"]][0]) for r in rows if not r["base_failed"]])
    assert right > 0.95
    for r in rows[:200]:
        x = {m: np.array([r[m]]) for m in rules.MEASURES}
        held = [k for k, rule in enumerate(learned, 1) if all(c.holds(x)[0] for c in rule)]
        assert r["rule"] == (held[0] if held else 0)
        assert r["kept"] == (not r["base_failed"] and not held)
    odd_out = rules.judge(odd, learned).collect()
    assert len(odd_out) == len(odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in odd_out if r["doc_id"] in (22, 23, 24))
    assert rules.judge(empty, learned).count() == 0


def test_a_fit_does_not_hold_the_values_of_all_rows():
    import tracemalloc

    from histlake.llm.quality import N_FEATURES, _fit_plain, _Scaled

    rng = np.random.default_rng(3)
    rows = [rng.choice(N_FEATURES, 10_000, replace=False).astype("<i4") for _ in range(800)]
    y = np.where(np.arange(800) % 2, 1, -1)
    tracemalloc.start()
    _fit_plain(rows, y, np.ones(800), 1.0, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # all values are 64 MB
    ratio = rng.normal(size=N_FEATURES)
    found, values = _Scaled(rows, ratio)[5]
    r = ratio[rows[5]]
    assert (found == rows[5]).all() and (values == r / float(np.sqrt(r @ r))).all()
