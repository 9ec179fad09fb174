import random
import time

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sifter.llm import merge_dropout as m

PATH = m.vocabulary_path()
PLAIN = m.Encoder(PATH, m.MergeDropout(dropout=0.0))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
KEYS = np.arange(1000, dtype=np.uint64)


def slow(encoder, text, key):
    """One text, one chunk at a time, each agenda searched whole."""
    p, out = encoder.pieces, []
    chars = [m.MARK] + [m.MARK if c == " " else c for c in text]
    literal = [False] + [c == m.MARK for c in text]
    ids = [-1 if lit else int(p.symbol[ord(c)]) for c, lit in zip(chars, literal)]
    marks = [c == m.MARK and not lit for c, lit in zip(chars, literal)]
    heads = [i for i in range(len(ids)) if i == 0 or marks[i] and not marks[i - 1]] + [len(ids)]
    for n, (a, b) in enumerate(zip(heads, heads[1:])):
        one = np.array([key], np.uint64)
        chunk = m._mixed(m._mixed(one ^ np.uint64(encoder.spec.seed)) + np.uint64(n))
        parts = [(i - a, ids[i], chars[i]) for i in range(a, b)]
        while True:
            best = None
            for k in range(len(parts) - 1):
                j = p.join(np.array([parts[k][1]]), np.array([parts[k + 1][1]]))
                r = encoder._kept(j, chunk, np.array([parts[k][0]]))[0]
                if r != m.NONE and (best is None or r < best[0]):
                    best = (r, k, int(j[0]))
            if best is None:
                break
            _, k, j = best
            parts[k : k + 2] = [(parts[k][0], j, parts[k][2] + parts[k + 1][2])]
        for _, i, c in parts:
            out += [i] if i >= 0 else [int(p.byte[x]) for x in c.encode()]
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aeinrst \n1é😀ß.", max_size=90), min_size=1, max_size=5))
def test_without_dropout_ids_are_the_librarys(texts):
    got = PLAIN.encode(texts, KEYS[: len(texts)])
    assert [list(g) for g in got] == [LIBRARY.encode(t) if t else [] for t in texts]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="aeinrst \nxé😀▁", max_size=60), min_size=1, max_size=4), st.sampled_from([0.1, 0.5, 1.0]))
def test_dropout_equals_the_slow_agenda_and_decodes(texts, dropout):
    e = m.Encoder(PATH, m.MergeDropout(dropout=dropout))
    for spec in (e.spec, m.MergeDropout(dropout=dropout, array_symbols=1, batch_symbols=9)):
        e.spec = spec
        got = e.encode(texts, KEYS[: len(texts)])
        assert [list(g) for g in got] == [slow(e, t, k) if t else [] for k, t in enumerate(texts)]
        assert [e.decode(g) for g in got] == texts


def test_segmentations_vary_by_key_and_long_chunks_pass():
    e = m.Encoder(PATH, m.MergeDropout())
    text = "there is the station of the nations " * 3 + "therestation" * 3000
    ids = e.encode([text, text, text], KEYS[[1, 2, 1]])
    assert list(ids[0]) == list(ids[2]) != list(ids[1]) and all(e.decode(i) == text for i in ids)


def test_documents(spark):
    texts = [None, "", " ", "plain words", "▁ literal ▁", "x" * 200_000, "tab\t\x00 end ", "plain words"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "plain words", 1), (None, "z", 1)], "doc_id long, text string, ids int")
    got = m.encode_documents(docs)
    rows = got.collect()
    assert len(rows) == len(texts) + 2 and all(r.lossless for r in rows)
    assert [list(r.ids) for r in rows if r.doc_id == 3][0] == [list(r.ids) for r in rows if r.doc_id == 3][1]
    assert {r.doc_id: r.text for r in m.decode_documents(got).collect() if r.doc_id is not None} == dict(enumerate(texts))
    assert m.encode_documents(docs.limit(0)).count() == 0
