import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sifter.llm import near_dedup as n

SPEC = n.NearDedup()


def multiset(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def alike(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def signed(sets, spec):
    return n.signatures(np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(x) for x in sets], np.int64), spec)


def brute(rows):
    sets = [(i, multiset(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for p, (i, a) in enumerate(sets):
        for j, b in sets[:p]:
            if alike(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def corpus():
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopq") + str(rng.randint(0, 30))
    texts = [None, "", "  \n", "one two", "one  TWO", "a b c d e", "a b c d e"]
    passage = " ".join(word() for _ in range(60))
    for _ in range(40):
        w = [word() for _ in range(rng.randint(30, 150))]
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    texts += [" ".join(word() for _ in range(rng.randint(20, 60))) + " " + passage for _ in range(30)]
    hub = [word() for _ in range(300)]  # spokes that are like the hub, but less like each other
    texts.append(" ".join(hub))
    for k in range(12):
        v = list(hub)
        v[k * 20] = word()
        v[k * 20 + 9] = word()
        v[k * 20 + 15] = word()
        v[k * 20 + 19] = word()
        texts.append(" ".join(v))
    texts += ["x y " * 3000, "x y " * 3000 + "z", "x y " * 900, "long " * 50_000]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_registers_estimate_the_weighted_similarity():
    spec = n.NearDedup(bands=100, rows=20)
    rng = np.random.default_rng(1)
    for _ in range(6):
        u = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = (np.sort(np.repeat(u, rng.integers(0, rng.choice([2, 9, 70]), 60))) for _ in range(2))
        if len(a) and len(b):
            m = signed([a, b, a], spec)
            assert abs((m[0] == m[1]).mean() - n.similarity(a, b)) < 0.06 and (m[0] == m[2]).all() and (m != 0).all()


def test_signatures_do_not_depend_on_the_batch():
    sets = [n.shingles(t, 5) for _, t in corpus()[:40]]
    together = signed(sets, SPEC)
    assert all((signed([s], SPEC)[0] == together[i]).all() for i, s in enumerate(sets))
    hashes, counts = n.shingle_batch([t for _, t in corpus()[:40]], 5)
    assert (np.concatenate(sets) == hashes).all() and [len(s) for s in sets] == counts.tolist()


def test_similarity_is_of_multisets():
    for a, b in (("x y " * 30, "x y " * 20), ("a b c d e f", "a b c d e g"), ("one two", "ONE two"), ("", "a"), ("q", "q r s t u v")):
        assert n.similarity(n.shingles(a, 5), n.shingles(b, 5)) == pytest.approx(alike(multiset(a), multiset(b)))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, class_id string")
    want = brute(rows)
    for spec in (SPEC, n.NearDedup(block_bytes=2000, star=3)):
        got = {r.doc_id: r for r in n.classes(df, spec).collect()}
        assert {i: r.class_id for i, r in got.items()} == want
        sizes = Counter(want.values())
        assert all(r.class_size == sizes[r.class_id] for r in got.values())
    kept = sorted(r.doc_id for r in n.keep_one(df).collect())
    assert kept == sorted(set(want.values()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, None), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in n.classes(df).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert sorted((r.doc_id or 0, r.text or "") for r in n.keep_one(df).collect()) == [(0, ""), (1, "a b c")]
    assert n.classes(df.limit(0)).count() == 0 and n.keep_one(df.limit(0)).count() == 0


def test_rows_that_share_an_id_get_the_class_of_their_own_text(spark):
    base = [f"w{i}" for i in range(60)]
    near = base[:30] + ["other"] + base[31:]
    rows = [(7, " ".join(base)), (7, "quite another text of its own"), (3, " ".join(near)), (None, " ".join(base)), (9, "quite another text of its own")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    assert sorted((r.doc_id or 0, r.class_id) for r in n.classes(df).collect()) == [(0, 3), (3, 3), (7, 3), (7, 7), (9, 7)]
    kept = n.keep_one(df)
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, " ".join(near)), (7, "quite another text of its own")]


def test_links_within_a_group_join_each_component_once():
    import pyarrow as pa

    words = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(30):  # all alike, and each a component of its own
        v = list(words)
        v[k * 5] = "changed"
        texts.append(" ".join(v))
    ids = list(range(10, 40))
    t = pa.table({"bucket": [1] * 30, "i": [0] * 30, "j": [0] * 30, "side": [0] * 30, "id": ids, "root": ids, "text": texts})
    assert len(n._joining(t, SPEC)) == 29


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in n.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
