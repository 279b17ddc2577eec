"""Retrieval chunks of ticket threads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import checksum16, uuid5_url
from tierstone.operators.membership import changed
from tierstone.operators.ranking import ordinal

# Shortest comment that is embedded; texts per embedding call.
MIN_COMMENT_CHARS = 200
EMBED_BATCH = 256


def _identified(rows: DataFrame, kind: str, mark: str) -> DataFrame:
    name = F.concat_ws(":", "ticket_id", F.lit(kind), mark)
    return rows.select(
        uuid5_url(name).alias("chunk_id"),
        F.lit(kind).alias("source_kind"),
        "ticket_id",
        "comment_id",
        "customer_id",
        "product_sku",
        "chunk_ordinal",
        "heading",
        "body",
        checksum16("body").alias("checksum"),
    )


def chunk(tickets: DataFrame, comments: DataFrame, min_chars: int = MIN_COMMENT_CHARS, hot_rows: int | None = None) -> DataFrame:
    """One chunk per ticket and one per long comment that is not the ticket text itself.

    hot_rows: comments of one ticket and day of which a task numbers more than that only by ranges (see ordinal).

    A comment's ordinal counts all comments of the ticket, so gaps are real. Short
    bodies are dropped before anything is shuffled; the ordinal needs only their place.
    """
    whole = tickets.select(
        "ticket_id",
        F.lit(None).cast("string").alias("comment_id"),
        "customer_id",
        "product_sku",
        F.lit(0).alias("chunk_ordinal"),
        F.col("subject").alias("heading"),
        "body",
        F.lit("0").alias("_mark"),
    )
    long_enough = F.length("body") >= min_chars
    placed = ordinal(
        comments.select(
            "ticket_id", "comment_id", "author_role", "created_at", F.when(long_enough, F.col("body")).alias("_said")
        ),
        ["ticket_id"],
        [F.col("created_at").asc_nulls_first(), F.col("comment_id").asc()],
        F.coalesce(F.unix_date(F.to_date("created_at")), F.lit(-(2**31))),
        "_n",
        hot_rows,
    ).filter(F.col("_said").isNotNull())
    said = placed.join(
        tickets.select("ticket_id", "customer_id", "product_sku", F.col("subject").alias("heading"), "body"),
        "ticket_id",
    ).filter(F.col("body").isNull() | (F.col("_said") != F.col("body")))
    replies = said.select(
        "ticket_id",
        "comment_id",
        "customer_id",
        "product_sku",
        F.col("_n").cast("int").alias("chunk_ordinal"),
        "heading",
        F.concat(F.coalesce("author_role", F.lit("None")), F.lit(": "), "_said").alias("body"),
    )
    return _identified(whole, "ticket", "_mark").unionByName(_identified(replies, "comment", "comment_id"))


def embed_text(heading: str = "heading", body: str = "body"):
    return F.concat(F.coalesce(F.col(heading), F.lit("None")), F.lit("\n\n"), F.col(body))


def hash_embedder(dim: int = 1536) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding service: signed hashed word counts,
    scaled to unit length."""

    def embed_batch(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            words = text.lower().split()
            if words:
                hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
                sign = np.where((hashed >> np.uint64(63)).astype(bool), -1.0, 1.0)
                np.add.at(out[i], (hashed % np.uint64(dim)).astype(np.int64), sign)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed_batch


def embed(
    df: DataFrame, text_col: str, embedder: Callable[[list[str]], np.ndarray] | None = None, out: str = "embedding"
) -> DataFrame:
    """The vector of a text column. The embedder sees at most EMBED_BATCH texts per call
    and its answers stay in row order, so no positional matching is needed."""
    call = embedder or hash_embedder()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows: list = []
            for at in range(0, len(texts), EMBED_BATCH):
                rows.extend(call(texts.iloc[at : at + EMBED_BATCH].tolist()))
            yield pd.Series(rows, dtype=object)

    return df.withColumn(out, vectors(F.col(text_col)))


def embed_changed(chunks: DataFrame, store: DataFrame, model: str, embedder=None, whole_text: bool = False) -> DataFrame:
    """Embed only chunks that are new or whose checksum moved. By default the checksum
    covers the body; with whole_text a changed heading counts too."""
    if whole_text:
        chunks = chunks.withColumn("checksum", checksum16(embed_text()))
    fresh = changed(chunks, store.filter("embedding is not null"), "chunk_id", "checksum")
    texted = fresh.withColumn("_text", embed_text())
    return embed(texted, "_text", embedder).drop("_text").withColumn("embedding_model", F.lit(model))
