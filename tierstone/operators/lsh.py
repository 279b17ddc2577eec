"""Nearest vectors of a query set by random hyperplanes, for corpora and query sets of any size.

Every table cuts space by `bits` random planes; a vector's side of each is its bucket. A query looks into several buckets of each table,
in the order of how little it would have to move to lie there. How many is fitted: the exact neighbours of a bounded sample of queries say which
share of all neighbours a number of probes reaches. Vectors and queries meet by bucket, in blocks of bounded size, where they are
scored exactly; k rows for each query leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.operators.ranking import top_n
from tierstone.operators.vectors import top_k_of_each
from tierstone.session import settle

TABLES = 6
BUCKET_ROWS = 512  # vectors a bucket is planned for
MOST_BITS = 16
SAMPLE = 200  # queries whose exact neighbours are looked up to fit the number of probes
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024  # of one bucket that a task scores at once


@dataclass(frozen=True)
class Planes:
    """Unit normals, tables x bits x numbers."""

    normals: np.ndarray

    @classmethod
    def draw(cls, dim: int, tables: int, bits: int, seed: int = 7) -> Planes:
        drawn = np.random.default_rng(seed).normal(size=(tables, bits, dim))
        return cls(drawn / np.linalg.norm(drawn, axis=2, keepdims=True))

    @property
    def tables(self) -> int:
        return self.normals.shape[0]

    @property
    def bits(self) -> int:
        return self.normals.shape[1]

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """rows x tables x bits: how far on which side."""
        return np.einsum("nd,tbd->ntb", rows, self.normals)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """rows x tables: the bucket, numbered through all tables."""
        sides = (self.margins(rows) >= 0) @ (1 << np.arange(self.bits))
        return sides + (np.arange(self.tables) << self.bits)

    def moves(self, rows: np.ndarray) -> np.ndarray:
        """rows x tables x buckets: the square of the way to each bucket of each table."""
        margins = self.margins(rows)
        own = (margins >= 0) @ (1 << np.arange(self.bits))
        flips = (np.arange(1 << self.bits)[:, None] >> np.arange(self.bits)) & 1  # buckets x bits
        by_flip = np.einsum("ntb,fb->ntf", margins**2, flips)
        places = own[:, :, None] ^ np.arange(1 << self.bits)
        return np.take_along_axis(by_flip, places, axis=2)

    def probes(self, rows: np.ndarray, n: int) -> np.ndarray:
        """rows x (tables * n): the n nearest buckets of each table."""
        order = np.argsort(self.moves(rows), axis=2, kind="stable")[:, :, :n]
        return (order + (np.arange(self.tables) << self.bits)[None, :, None]).reshape(len(rows), -1)

    def places(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each row, after how many probes of the query its bucket comes, in the table where it comes first."""
        order = np.argsort(np.argsort(self.moves(query[None, :])[0], axis=1, kind="stable"), axis=1)
        sides = self.keys(rows) - (np.arange(self.tables) << self.bits)
        return order[np.arange(self.tables)[None, :], sides].min(axis=1)


def _array(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _usable(rows: DataFrame, vector_col: str) -> DataFrame:
    return rows.filter(F.col(vector_col).isNotNull() & F.exists(vector_col, lambda x: x != 0))


def planned_bits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return min(MOST_BITS, max(1, math.ceil(math.log2(max(2, rows / bucket_rows)))))


def fit_probes(
    corpus: DataFrame, queries: DataFrame, planes: Planes, k: int, id_col: str, vector_col: str, query_col: str, recall: float, sample: int = SAMPLE
) -> tuple[int, float]:
    """(probes of each table, recall they reach) on at most `sample` queries, picked by the hash of their names."""
    some = settle(queries.select(query_col, vector_col).orderBy(F.xxhash64(query_col), query_col).limit(sample), "probe-sample")
    exact = top_k_of_each(corpus, some, k, id_col, vector_col, query_col).select(query_col, id_col)
    # at most sample * k vectors
    pairs = exact.join(corpus.select(id_col, F.col(vector_col).alias("_vector")), id_col).join(some, query_col).select(query_col, vector_col, "_vector").toPandas()
    if not len(pairs):
        return 1, 1.0
    found = np.concatenate([planes.places(_array(g[vector_col])[0], _array(g["_vector"])) for _, g in pairs.groupby(query_col)])
    places = np.sort(found)
    need = int(places[max(0, math.ceil(recall * len(places)) - 1)]) + 1
    return need, float((places < need).mean())


def nearest_by_planes(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str,
    vector_col: str,
    query_col: str = "query_id",
    recall: float = 0.95,
    tables: int = TABLES,
    bucket_rows: int = BUCKET_ROWS,
    probes: int | None = None,
) -> DataFrame:
    """The k rows closest to each query among those its probes reach: query, id, similarity, rank (from 1).

    `recall` is the share of true neighbours to aim for; it sets the probes unless they are given. 2^bits probes reach every row, and
    the result is then exact. Null and zero vectors have no angle and take no part. Similarities within 1e-12 are ties and go by id.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_col), (corpus, id_col))}
    out = f"{query_col} {kinds[query_col]}, {id_col} {kinds[id_col]}, similarity double"
    corpus = _usable(corpus.select(id_col, vector_col), vector_col)
    asked = _usable(queries.select(query_col, vector_col), vector_col)
    first = corpus.select(F.size(vector_col)).first()
    if first is None or asked.isEmpty():
        return corpus.sparkSession.createDataFrame([], f"{out}, rank int")
    rows = corpus.count()
    planes = Planes.draw(first[0], tables, planned_bits(rows, bucket_rows))
    if probes is None:
        probes, _ = fit_probes(corpus, asked, planes, k, id_col, vector_col, query_col, recall)
    probes = min(probes, 1 << planes.bits)

    def keyed(name: str, keys_of):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    yield frame.assign(keys=list(keys_of(_array(frame[vector_col]))))

        return run

    schema = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}, {vector_col} {df.schema[vector_col].dataType.simpleString()}, keys array<long>"
    # every vector once with its buckets; a block gets its numbers from here
    held = settle(corpus.mapInPandas(keyed(id_col, planes.keys), schema(corpus, id_col)), "hashed-vectors")
    searching = settle(asked.mapInPandas(keyed(query_col, lambda rows: planes.probes(rows, probes)), schema(asked, query_col)), "hashed-queries")
    in_bucket = held.select(id_col, vector_col, F.explode("keys").alias("key"))
    probing = searching.select(F.col(query_col).alias("_query"), F.col(vector_col).alias("_wanted"), F.explode("keys").alias("key"))
    blocks = lambda df, n, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = settle(blocks(held.select(F.explode("keys").alias("key")), BLOCK_ROWS, "row_blocks").join(blocks(probing, BLOCK_QUERIES, "query_blocks"), "key"), "buckets")
    dealt = in_bucket.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64(id_col), F.col("row_blocks")).cast("int")).select(
        "key", "i", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("j"), id_col, vector_col
    )
    sent = probing.join(sizes, "key").withColumn("j", F.pmod(F.xxhash64("_query"), F.col("query_blocks")).cast("int")).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("i"), "j", "_query", "_wanted"
    )

    def score(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(here) or not len(there):
            return pd.DataFrame({query_col: [], id_col: [], "similarity": []})
        here = here.sort_values(id_col, kind="stable")
        x, q = _array(here[vector_col]), _array(there["_wanted"])
        near = np.round(q @ x.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)), 12)
        best = np.argsort(-near, axis=1, kind="stable")[:, :k]  # rows come by id, so ties stay in that order
        return pd.DataFrame({
            query_col: np.repeat(there["_query"].to_numpy(), best.shape[1]), id_col: here[id_col].to_numpy()[best.ravel()],
            "similarity": np.take_along_axis(near, best, axis=1).ravel(),
        })

    scored = dealt.groupBy("key", "i", "j").cogroup(sent.groupBy("key", "i", "j")).applyInPandas(score, out).distinct()
    return top_n(scored, [query_col], [F.col("similarity").desc_nulls_last(), F.col(id_col).asc()], k, "rank")
