"""Ticket exports as a stream into a store of chunks that embeds only what changed.

The store is a keyed table by (ticket_id, chunk_id), in buckets by ticket, so a batch reads the buckets of its tickets and no others. Of a
ticket that comes again, chunks with the same checksum are left alone, chunks with another one are embedded, and chunks
it no longer has are marked as removed. A ticket in an older version than the stored one is ignored; so an export that is
taken again, in whole or in part, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tierstone.operators.chunks import MIN_COMMENT_CHARS, chunk, embed, embed_text
from tierstone.operators.ranking import first_per_key
from tierstone.plans.keyed import BUCKETS, KeyedStore
from tierstone.plans.stores import Store
from tierstone.session import list_dirs, scratch, settle

TICKET = """ticket_id string, customer_id string, product_sku string, subject string, body string, updated_at timestamp,
  comments array<struct<comment_id string, author_role string, body string, created_at timestamp>>"""
CHUNK = """ticket_id string, chunk_id string, source_kind string, comment_id string, customer_id string, product_sku string, chunk_ordinal int,
  heading string, body string, checksum string, embedding array<float>, embedding_model string, removed boolean, updated_at timestamp, embedded_at timestamp"""
#: What a chunk that comes again may change, besides its vector: whether it is there, and the version of its ticket.
RULE = Store(("ticket_id", "chunk_id"), ("heading", "body", "checksum", "embedding", "embedding_model", "removed", "updated_at"), "embedded_at")


def chunk_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedStore:
    """The store in a folder, made where there is none."""
    if list_dirs(spark, f"{path}/layout"):
        return KeyedStore(spark, path)
    return KeyedStore.create(spark, path, RULE, CHUNK, buckets, ["ticket_id"])


def current_chunks(store: KeyedStore) -> DataFrame:
    return store.read().filter("NOT removed").drop("removed")


def chunk_changes(tickets: DataFrame, stored: DataFrame, model: str, embedder=None, min_chars: int = MIN_COMMENT_CHARS) -> DataFrame:
    """The rows to apply to a store whose rows for these tickets are `stored`: moved and new chunks with vectors, and removed ones."""
    newest = first_per_key(tickets, ["ticket_id"], [F.col("updated_at").desc_nulls_last()])
    version = stored.groupBy("ticket_id").agg(F.max("updated_at").alias("_stored"))
    due = newest.join(version, "ticket_id", "left").filter(F.col("_stored").isNull() | (F.col("updated_at") >= F.col("_stored"))).drop("_stored")
    due = settle(due, "due-tickets")
    comments = due.select("ticket_id", F.inline("comments"))
    versions = due.select("ticket_id", "updated_at")
    chunks = chunk(due.drop("comments", "updated_at"), comments, min_chars).join(versions, "ticket_id")
    held = stored.join(versions.select("ticket_id"), "ticket_id", "left_semi")
    same = held.filter("NOT removed AND embedding IS NOT NULL").select("ticket_id", "chunk_id", "checksum")
    chunks = settle(chunks, "due-chunks")
    moved = chunks.join(same, ["ticket_id", "chunk_id", "checksum"], "left_anti").withColumn("_text", embed_text())
    vectors = embed(moved, "_text", embedder).drop("_text").withColumns({"embedding_model": F.lit(model), "removed": F.lit(False)})
    gone = held.filter("NOT removed").join(chunks.select("ticket_id", "chunk_id"), ["ticket_id", "chunk_id"], "left_anti")
    gone = gone.drop("updated_at", "embedded_at").join(versions, "ticket_id").withColumn("removed", F.lit(True))
    return vectors.unionByName(gone)


def _absorb(batch: DataFrame, path: str, model: str, embedder, buckets: int) -> None:
    spark = batch.sparkSession
    with scratch(spark):
        tickets = settle(batch.filter("ticket_id IS NOT NULL"), "ticket-batch")
        if tickets.isEmpty():
            return
        store = chunk_store(spark, path, buckets)
        changes = settle(chunk_changes(tickets, store.near(tickets), model, embedder), "chunk-changes")
        if not changes.isEmpty():
            store.apply(changes)


def stream_chunks(
    spark: SparkSession, in_dir: str, store: str, checkpoint: str, model: str, embedder: Callable[[list[str]], np.ndarray] | None = None,
    buckets: int = BUCKETS, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Take up new files of tickets (JSON lines), then stop."""
    reader = spark.readStream.schema(TICKET)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def absorb(batch: DataFrame, _: int) -> None:
        _absorb(batch, store, model, embedder, buckets)

    return reader.json(in_dir).writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
