import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from sifter.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents whose fate is known, in a folder of tables."""
    rng = random.Random(1)
    vocab = [a + b for a in ("tha", "sol", "mer", "kin", "rou", "bel") for b in ("an", "et", "or", "is", "um", "ay", "ith", "ode")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, prose(rng.randint(80, 200)), "en") for i in range(100)]
    near = rows[10][1].split()
    near[3] = "changed"
    rows += [(200, rows[10][1], "en"), (201, " ".join(near), "en"), (202, "12 34 " * 60, "en"), (203, None, "en"), (204, prose(5), "en")]
    rows += [(205, "same words here again and more of it now " * 20, "en"), (206, prose(90) + ' token = "0123456789abcdef0123456789abcdef01234567" ' + prose(30), "en")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return rows, str(path)


def test_each_stage_decides_and_run_equals_a_plain_version(spark, corpus, monkeypatch):
    rows, path = corpus
    seen = {}

    def watched(name, stage):
        def call(session, docs, sf_dir):
            seen[name] = docs  # the rows that the stage before has kept, read back
            return stage(session, docs, sf_dir)

        return call

    monkeypatch.setattr(c, "STAGES", [(n, watched(n, f)) for n, f in c.STAGES])
    got = c.run(spark, path).collect()
    assert list(seen) == ["language_id", "quality_rules", "near_dedup", "secret_scan", "best_fit_packing"]
    assert all(df.columns == list(c.COLUMNS) for df in seen.values())
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    everything = {i for i, _, _ in rows}
    assert ids["quality_rules"] == everything - {202, 203}
    assert ids["near_dedup"] == ids["quality_rules"] - {204, 205}
    assert ids["secret_scan"] == ids["best_fit_packing"] == ids["near_dedup"] - {200, 201}

    before = {i: t for i, t, _ in rows}
    texts = {r.doc_id: r for r in seen["best_fit_packing"].collect()}
    secret = 'token = "0123456789abcdef0123456789abcdef01234567'
    assert texts[206].text == before[206].replace(secret, "[secret]") and texts[206].n_chars == len(texts[206].text)
    assert all(texts[i].text == before[i] for i in texts if i != 206)

    tokenizer = packing.ByteTokenizer(packing.vocabulary_path(), 1000)
    want = {(i, k, a, b - a) for i, r in texts.items() for k, (a, b) in enumerate(packing._cut(len(tokenizer.ids(r.text)) + 1, 1024))}
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got} == want and len(got) == len(want)


def test_odd_tables(spark, corpus, tmp_path):
    """No rows; and nulls everywhere, repeated ids and rows, a very long text, and columns of its own."""
    _, path = corpus
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, rows in (("none", docs.limit(0)), ("odd", None)):
        at = str(tmp_path / name)
        if rows is None:
            first, second = (r.text for r in docs.filter("doc_id in (1, 2)").orderBy("doc_id").collect())
            extra = [(None, None, None, None, None), (None, first, None, None, None), (7, first, "en", "s", 1), (1, second, "en", "s", 1), (1, second, "en", "s", 1), (8, f"{first} {second} " * 300 + " other", "en", None, None)]
            rows = docs.unionByName(spark.createDataFrame(extra, SCHEMA)).withColumns({"row__": F.lit(1), "score": F.lit("x"), "kept": F.lit(False), "id": F.lit(0)})
        rows.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        got = c.run(spark, at)
        assert "sequence_id" in got.columns
        if name == "none":
            assert got.count() == 0
            continue
        first_pieces = [r.doc_id for r in got.filter("piece = 0").collect()]
        # 1 stands for its own text and, as a row of its own, for the repeated text, which 2 has, too.
        assert first_pieces.count(1) == 2 and None not in first_pieces and 2 not in first_pieces and 7 not in first_pieces
