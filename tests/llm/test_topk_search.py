import math
import random

import duckdb
from pyspark.sql import functions as F

from sifter.llm import topk_search as t

SCHEMA = "vec_id long, embedding array<double>, rank int"


def brute(rows, every, k):
    fit = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in {i for i, _ in fit if i % every == 0}:
        a = min(v for i, v in fit if i == q)
        hits = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in fit if i != q and len(v) == len(a))[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(hits)}
    return out


def run(df, spec, every=20):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in t.search(df, F.col("vec_id") % every == 0, spec).collect()}


def test_equals_brute_force_over_many_tiles(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(6)], i) for i in range(400)]
    rows += [(40, rows[40][1], 0), (7, rows[40][1], 0), (401, None, 1), (402, [None] * 6, 1), (403, [float("nan")] * 6, 1), (404, [math.inf] * 6, 1)]
    rows += [(None, [0.1] * 6, 1), (420, [1.0, 2.0], 1), (421, [0.5, 0.5], 1), (440, [1e12] * 6, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 20, 20)
    assert run(df, t.TopK(shard_rows=30, tile_rows=7, fan_in=3)) == want


def test_ties_few_rows_and_sql(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df, t.TopK()) == brute(rows, 20, 20)
    con = duckdb.connect()
    con.execute("create table embeddings(vec_id bigint, embedding float[])")
    con.executemany("insert into embeddings values (?, ?)", [(i, v) for i, v, _ in rows])
    assert {(a, b): (c, d) for a, b, c, d in con.execute(t.sql()).fetchall()} == brute(rows, 20, 20)
    assert run(df.limit(3), t.TopK()) == brute(rows[:3], 20, 20)
    assert run(df.limit(0), t.TopK()) == {}
