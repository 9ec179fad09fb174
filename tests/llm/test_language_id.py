import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sifter.llm import language_id as l

VOCAB = {"en": "the and house tree walking thing".split(), "de": "der und haus baum laufen ding".split(), "fr": "le et maison arbre marcher chose".split()}


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lang = rng.choice(list(VOCAB))
        words = [rng.choice(VOCAB[lang]) for _ in range(rng.randint(3, 40))]
        rows.append((i, " ".join(words).title() + ", 12!", lang))
    rows += [(900, None, "en"), (901, "12 34 !!", "en"), (902, "the house", None), (903, "", "fr"), (None, "der baum", "de"), (5, rows[5][1], rows[5][2])]
    rows += [(904, "unhaus bäumlein", "de"), (905, "漢字", "en"), (906, "the " * 60_000, "en")]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(*r, 0.5) for r in corpus()], "doc_id long, text string, lang string, score double")
    return df, l.identify(df).collect()


def test_every_row_is_labelled_and_held_out_rows_are_right(rows):
    df, got = rows
    assert len(got) == len(corpus())
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == by[903].lang_pred == "und" and by[902].lang_pred == "en" and by[906].lang_pred == "en"
    assert by[904].lang_pred == "de" and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = dict((i, g) for i, _, g in corpus())
    assert sum(r.lang_pred == right[r.doc_id] for r in held) / len(held) > 0.98


def test_model_equals_brute_force(spark, rows):
    df, got = rows
    spec = l.LanguageId()
    train = [(t, g) for i, t, g in corpus() if t is not None and g is not None and (i is None or zlib.crc32(str(i).encode()) % 5)]
    counts = {g: Counter() for g in VOCAB}
    for t, g in train:
        counts[g].update(l.words_in(t))
    total = {g: sum(c.values()) for g, c in counts.items()}
    known = [w for w in set().union(*counts.values()) if sum(c[w] for c in counts.values()) >= 1e-5 * sum(total.values())]
    model = l.fit(df.filter("doc_id is null or crc32(cast(doc_id as string)) % 5 <> 0"), spec)
    assert set(model.tables[0]) == set(known) and set(model.langs) == set(VOCAB)
    for w in known:
        want = [math.log(counts[g][w] + 0.5) - math.log(total[g] + 0.5 * (len(known) + 1)) for g in model.langs]
        assert np.allclose(model.tables[0][w], want)
    grams = {g: Counter() for g in VOCAB}
    for g, c in counts.items():
        for w, n in c.items():
            for x in l.grams_of(w, 4):
                grams[g][x] += n
    assert np.allclose(
        model.tables[4]["<the"],
        [math.log(grams[g]["<the"] + 0.5) - math.log(sum(grams[g].values()) + 0.5 * (len(model.tables[4]) + 1)) for g in model.langs],
    )


def brute_labels(model, rows):
    """Every text by Model.word, a word at a time."""
    plain, out = l.Model(model.langs, model.tables, model.spec), []
    for _, text, _ in rows:
        words = Counter(l.words_in(text or ""))
        if not words:
            out.append(("und", 0.0))
            continue
        n = sum(words.values())
        mean = np.round(sum(k * plain.word(w) for w, k in words.items()) / n, 9)
        out.append((model.langs[int(np.argmax(mean))], float(1 / np.exp((mean - mean.max()) * min(n, 20)).sum())))
    return out


@pytest.mark.parametrize("frequent_bytes", [0, 500, 32 << 20])
def test_labels_equal_brute_force(spark, frequent_bytes):
    """Whatever part of the model is broadcast: words known, unseen, of parts, and repeated."""
    spec = l.LanguageId(frequent_bytes=frequent_bytes)
    odd = [(1000 + i, t, None) for i, t in enumerate(["haus’s “baum” baumhaus", "½ ² ①", "über-the-haus the", "zzz qqq 漢字", "unhaus " * 30 + "marcherait"])]
    rows = [r for r in corpus() if r[0] != 906] + odd
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, place int")
    model = l.fit(df.filter("doc_id is null or crc32(cast(doc_id as string)) % 5 <> 0"), spec)
    got = {r.carried_place: (r.lang_pred, r.score) for r in l.predict(df, model, carry=("place",)).collect()}
    assert len(got) == len(rows)
    for k, (lang, score) in enumerate(brute_labels(model, rows)):
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, rel=1e-6), rows[k]


def test_words_are_letters_and_marks():
    assert l.words_in("½ ² ① 12") == [] and l.words_in("नमस्ते, Cafe\u0301") == ["नमस्ते", "cafe\u0301"]


def test_backoff_takes_the_longest_known_order():
    spec = l.LanguageId()
    v = lambda x: np.array([x, 0.0])
    model = l.Model(["a", "b"], {0: {"word": v(9)}, 4: {"abcd": v(4)}, 3: {"xyz": v(3), "yzq": v(5)}, 2: {"mn": v(2)}, 1: {"k": v(1)}}, spec)
    assert [model.word(w)[0] for w in ("word", "abcdxyz", "xyzq", "mnx", "kk", "ü")] == [9, 4, 4, 2, 1, 0]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in l.identify(empty).collect()] == ["und"] and l.identify(empty.limit(0)).count() == 0


def test_rare_words_of_a_small_language_are_known(spark):
    """Each word of `sm` is far below 1e-5 of all tokens; its n-grams are those of `big`."""
    big = [(i, " ".join(["abab baba aabb bbaa"] * 5000), "big") for i in range(1, 11)]
    small = [(50, "abba baab", "sm")]
    df = spark.createDataFrame([*big, *small], "doc_id long, text string, lang string")
    model = l.fit(df)
    assert {"abba", "baab"} <= set(model.tables[0])
    (r,) = l.predict(spark.createDataFrame([(1, "abba baab abba")], "doc_id long, text string"), model).collect()
    assert r.lang_pred == "sm" and r.score > 0.9
