"""Exact top-k inner-product search: tiled matrix products and tree-merged top lists.

Vectors become whole numbers (floor of 64 times each component). Candidates are dealt to shards
and queries to tiles by hash, each packed into one matrix row. Every (tile, shard) pair is one
matrix product, of which each query keeps its k best; the lists are then merged shard group by
shard group until one list a query is left. No list is ever longer than k times the fan-in.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; nor
do null ids. Vectors of another length than the query's score 0 against it over no components,
so only equal lengths are compared. Rows of one id are one vector each as candidates; a query id
is asked once, with its smallest vector, and rows of its own id are never its results. With
fewer candidates than k all are returned. Equal scores rank by the smaller id. Other columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKED = "part int, dim int, ids binary, vectors binary"
LISTED = "query_id long, shard int, top array<struct<score:bigint,vec_id:bigint>>"


@dataclass(frozen=True)
class TopK:
    """Parameters; the defaults are those of the registered query."""

    k: int = 20
    scale: int = 64
    #: Rows of a shard and of a tile, on average; a product holds tile x shard scores in blocks.
    shard_rows: int = 16_384
    tile_rows: int = 2_048
    fan_in: int = 8


def quantized(rows: DataFrame, spec: TopK, id_col: str, vector_col: str) -> DataFrame:
    """id and v: floor(scale * x) of each component as long, of vectors fit to take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    )
    return rows.filter(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * spec.scale)).alias("v"))


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """Matrix rows by part and vector length."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        matrix = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), -1)
        return pd.DataFrame(
            {"part": [int(pdf["part"].iloc[0])], "dim": [matrix.shape[1]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "vectors": [matrix.tobytes()]}
        )

    keyed = rows.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int")).withColumn("dim", F.size("v"))
    return keyed.groupBy("part", "dim").applyInPandas(pack, PACKED)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in doubles as long as no sum can pass 2**53."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row: score descending, then id; ties at the edge are kept apart."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _tile_lists(k: int):
    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                asked, queries = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_vectors, np.int64).reshape(-1, r.dim)
                ids, shard = np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, np.int64).reshape(-1, r.dim)
                for at in range(0, len(asked), 256):
                    scores = _product(queries[at : at + 256], shard)
                    tops = []
                    for q, row in zip(asked[at : at + 256], scores, strict=True):
                        near = _best(row, ids, k + int((ids == q).sum()))
                        near = near[ids[near] != q][:k]
                        tops.append([{"score": int(row[i]), "vec_id": int(ids[i])} for i in near])
                    yield pd.DataFrame({"query_id": asked[at : at + 256], "shard": r.part, "top": tops})

    return lists


def search(
    rows: DataFrame,
    queries: Column,
    spec: TopK = TopK(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows that `queries` (a Column) selects."""
    candidates = quantized(rows, spec, id_col, vector_col)
    asked = quantized(rows.filter(queries), spec, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    n = rows.count()
    shards, tiles = max(1, math.ceil(n / spec.shard_rows)), max(1, math.ceil(asked.count() / spec.tile_rows))
    packed = _packed(asked, tiles)
    pairs = packed.select(
        "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part")
    ).join(_packed(candidates, shards), ["part", "dim"])
    lists = pairs.select("part", "dim", "q_ids", "q_vectors", "ids", "vectors").mapInPandas(_tile_lists(spec.k), LISTED)
    order = lambda a, b: (
        F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0)
    )
    while shards > 1:  # a level of the merge tree
        shards = math.ceil(shards / spec.fan_in)
        lists = (
            lists.groupBy("query_id", (F.col("shard") / spec.fan_in).cast("int").alias("shard"))
            .agg(F.flatten(F.collect_list("top")).alias("top"))
            .withColumn("top", F.slice(F.array_sort("top", order), 1, spec.k))
        )
    return lists.select("query_id", F.posexplode("top").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def sql(k: int = 20, scale: int = 64, every: int = 20, table: str = "embeddings") -> str:
    """The same in DuckDB SQL, over all pairs."""
    return f"""
WITH v AS (SELECT vec_id, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM {table}
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {k}"""
