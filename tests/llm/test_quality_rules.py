import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sifter.llm import quality_rules as q

RULES = q.QualityRules()


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n\x0b ", "a", "one two\n\none two\n", " x y " * 30, "#*$ & " * 12, "a b c d e f g h " * 5]
    for _ in range(60):
        v = [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        out.append(rng.choice([" ", "  ", "\n", "\t"]).join(v))
    return out + [" ".join(f"w{rng.randint(0, 900)}" for _ in range(5000)), "x" * 100_000]


def test_counts_equal_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8, 40)], "doc_id long, quality int, toxic int")
    weights = q.fit(docs, labels, RULES)
    got = {r.doc_id: r for r in q.score(docs, weights, RULES).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), i
        assert r.kept == (not r.base_failed and r.score >= RULES.threshold)


def test_ratio_prefers_the_target_and_odd_inputs_pass(spark):
    # With so few words the default prior (a count a bucket) would leave every ratio near 1.
    rules = q.QualityRules(smoothing=0.01)
    good = " ".join(f"word{i}" for i in range(40))
    junk = " ".join(f"zz{i}##" for i in range(40))
    docs = spark.createDataFrame([(1, good), (1, good), (2, junk), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    weights = q.fit(docs, labels, rules)
    rows = q.score(docs, weights, rules, carry=("text",)).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in rows) == [(0, False), (1, True), (1, True), (2, False)]
    assert q.score(docs.limit(0), weights, rules).count() == 0
    assert set(q.fit(docs, labels.limit(0), rules)) == {0.0}


def test_weights_and_scores_equal_brute_force(spark):
    """Counts by bucket, the smoothed ratio, and every document's mean over its words and pairs."""
    rules = q.QualityRules(buckets=64, smoothing=0.5, threshold=0.01)
    rows = list(enumerate(texts()[:40]))
    trusted = {i for i in range(5, 30) if i % 2}
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(5, 35)] + [(7, 1, 0)], "doc_id long, quality int, toxic int")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    every = sorted({w for v in words.values() for w in v})
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(h[a], h[b]) for v in words.values() for a, b in zip(v, v[1:], strict=False)})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    grams = {i: [x % 64 for x in [*(h[w] for w in v), *(two[h[a], h[b]] for a, b in zip(v, v[1:], strict=False))]] for i, v in words.items()}
    raw, target = [0] * 64, [0] * 64
    for i, v in grams.items():
        for b in v:
            raw[b] += 1
            target[b] += i in trusted
    prior = 0.5 * 64
    p = [(r + 0.5) / (sum(raw) + prior) for r in raw]
    want = [math.log((t + prior * x) / (sum(target) + prior)) - math.log(x) for t, x in zip(target, p, strict=True)]
    weights = q.fit(docs, labels, rules)
    assert weights == pytest.approx(want, rel=1e-12)
    for r in q.score(docs, weights, rules).collect():
        mean = sum(want[b] for b in grams[r.doc_id]) / max(1, len(grams[r.doc_id]))
        assert r.score == pytest.approx(mean, rel=1e-9, abs=1e-12) and r.kept == (not r.base_failed and r.score >= 0.01)
