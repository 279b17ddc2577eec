"""Cosine search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.operators.ranking import top_n
from tierstone.session import fresh_path, settle


def top_k_similar(corpus: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k rows closest to one query vector: id, similarity (1 - cosine distance).

    Every Arrow batch is scored by one matrix product and passes on its own k best
    (ties by id), so k rows per batch and not the corpus reach the final sort. Rows
    without a vector are skipped; a zero vector has no angle and comes last as null.
    """
    wanted = np.asarray(query, dtype=np.float64)
    length = float(np.linalg.norm(wanted))
    dim = len(wanted)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(1)
            sizes = np.diff(np.asarray(listed.offsets))
            if (sizes != dim).any():
                raise ValueError(f"expected vectors of {dim} numbers")
            flat = np.asarray(listed.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            rows = flat.reshape(-1, dim)
            scale = np.linalg.norm(rows, axis=1) * length
            score = np.divide(rows @ wanted, scale, out=np.full(len(rows), np.nan), where=scale != 0)
            ids = batch.column(0)
            rank = pa.table({"i": ids, "s": pa.array(score, from_pandas=True)})
            order = pa.compute.sort_indices(
                rank, sort_keys=[("s", "descending"), ("i", "ascending")], null_placement="at_end"
            )[:k]
            yield pa.RecordBatch.from_arrays([ids.take(order), rank["s"].combine_chunks().take(order)], names=[id_col, "similarity"])

    import pyarrow.compute  # noqa: F401  (pa.compute for the closure above)

    id_type = corpus.schema[id_col].dataType.simpleString()
    scored = (
        corpus.select(id_col, vector_col)
        .filter(F.col(vector_col).isNotNull())
        .mapInArrow(best, f"{id_col} {id_type}, similarity double")
    )
    return scored.orderBy(F.col("similarity").desc_nulls_last(), F.col(id_col).asc()).limit(k)


# query vectors every task holds at once: 16,384 of 1,024 numbers are 128 MB
MAX_QUERIES = 16_384
# similarities a task holds at once, for rows x queries: some copies of 8 MB
CELLS = 1 << 20


def top_k_of_each(
    corpus: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, query_col: str = "query_id"
) -> DataFrame:
    """The k rows closest to each vector of a query set: query, id, similarity, rank (from 1).

    Every task scores up to MAX_QUERIES query vectors against its Arrow batches, in matrix products of CELLS numbers; k rows
    per query and batch leave the task, never a pair more. A larger set is dealt to parts, which
    are searched one after the other; `lsh.nearest_by_planes` does without a scan for each.
    Rows without a vector are skipped; a zero vector has no angle and comes last as
    null. Similarities within 1e-12 are ties and go by id.
    """
    asked = queries.select(query_col, vector_col).filter(F.col(vector_col).isNotNull())
    first = asked.limit(MAX_QUERIES + 1).toArrow()
    if first.num_rows <= MAX_QUERIES:
        return _top_k_of_some(corpus, first, queries.schema[query_col].dataType.simpleString(), k, id_col, vector_col, query_col)
    asked = settle(asked, "queries")
    parts = -(-asked.count() * 2 // MAX_QUERIES)  # half full, as a hash does not deal evenly
    path = fresh_path(corpus.sparkSession, "nearest")
    for part in range(parts):
        some = asked.filter(F.pmod(F.xxhash64(query_col, vector_col), F.lit(parts)) == part).toArrow()
        found = _top_k_of_some(corpus, some, queries.schema[query_col].dataType.simpleString(), k, id_col, vector_col, query_col)
        found.write.mode("append").parquet(path)
    return corpus.sparkSession.read.schema(found.schema).parquet(path)


def nearest_in_batch(rows: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, query, similarity) of the k rows closest to each query, some queries at a time; rows of equal similarity in their order."""
    sizes, step = np.linalg.norm(rows, axis=1), max(1, CELLS // max(1, len(rows)))
    for start in range(0, len(wanted), step):
        some = wanted[start : start + step]
        scale = np.outer(sizes, np.linalg.norm(some, axis=1))
        score = np.round(np.divide(rows @ some.T, scale, out=np.full(scale.shape, np.nan), where=scale != 0), 12)
        order = np.argsort(-score, axis=0, kind="stable")[:k]
        picked, number = order.T.ravel(), np.repeat(np.arange(len(some)), len(order))
        yield picked, start + number, score[picked, number]


def _top_k_of_some(corpus: DataFrame, asked: pa.Table, query_kind: str, k: int, id_col: str, vector_col: str, query_col: str) -> DataFrame:
    names = asked.column(0).combine_chunks()
    wanted = np.asarray(asked.column(1).to_pylist(), dtype=np.float64).reshape(asked.num_rows, len(asked) and -1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(wanted):
                continue
            batch = batch.sort_by(batch.schema.names[0])
            listed = batch.column(1)
            if (np.diff(np.asarray(listed.offsets)) != wanted.shape[1]).any():
                raise ValueError(f"expected vectors of {wanted.shape[1]} numbers")
            rows = np.asarray(listed.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
            # rows come by id, so ties stay in that order
            for picked, number, score in nearest_in_batch(rows, wanted, k):
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(number)), batch.column(0).take(pa.array(picked)), pa.array(score, from_pandas=True)],
                    names=[query_col, id_col, "similarity"],
                )

    scored = (
        corpus.select(id_col, vector_col)
        .filter(F.col(vector_col).isNotNull())
        .mapInArrow(best, f"{query_col} {query_kind}, {id_col} {corpus.schema[id_col].dataType.simpleString()}, similarity double")
    )
    return top_n(scored, [query_col], [F.col("similarity").desc_nulls_last(), F.col(id_col).asc()], k, "rank")


def search(store: DataFrame, query: Sequence[float], k: int = 5) -> DataFrame:
    """The k closest stored chunks with their text."""
    hits = top_k_similar(store, query, k, "chunk_id", "embedding")
    # k rows: the store is scanned for k known ids, never shuffled
    return store.join(F.broadcast(hits), "chunk_id").orderBy(F.col("similarity").desc(), "chunk_id")
