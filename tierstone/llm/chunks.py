"""Repeated passages by content-defined chunks.

A gear rolling hash runs over the bytes of a text. A word end is a cut where its hash is the smallest among the word ends
around it, so cuts depend on the content near them alone: an insertion moves only the cuts beside it. Chunks
are matched by digest over all documents, and neighbouring repeated chunks join into passages.

Where words repeat with a short period, hashes do too and none is the smallest. There the stretch itself is cut: where the repeats begin, every
LONGEST words from there, and where they end, which depends on its content alone again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierstone.llm.bagminhash import mix
from tierstone.session import settle

REACH = 3  # a cut is the smallest of its own and so many word ends to each side: chunks of 7 words on average, 4 at least
PERIOD = 8  # words after which a repeating stretch repeats, at most
LONGEST = 16  # words of a chunk inside such a stretch
GEAR_BYTES = 16  # bytes the rolling hash remembers
PASSAGE_WORDS = 20  # repeated words in a row that make a passage; one of 50 words keeps at least so many between its cuts

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last GEAR_BYTES bytes, by doubling."""
    h, reach = _GEAR[data], 1
    while reach < GEAR_BYTES:
        earlier = np.zeros_like(h)
        earlier[reach:] = h[:-reach]
        h = h + (earlier << np.uint64(reach))
        reach *= 2
    return h


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words start, where they end, exclusive). Blanks part words; a character of U+3000 to U+9FFF, whose scripts have no blanks, is one."""
    inside = np.concatenate([[False], ~_BLANK[data], [False]])
    alone = np.concatenate([[False], (data >= 0xE3) & (data <= 0xE9), [False]])  # first byte of three
    begins = inside & ~np.concatenate([[False], inside[:-1]]) | alone
    begins[3:] |= inside[3:] & alone[:-3]
    return np.flatnonzero(begins) - 1, np.flatnonzero(inside[:-1] & (~inside[1:] | begins[1:]))


def _in_repeats(value: np.ndarray) -> np.ndarray:
    """The word ends that end a chunk in stretches that repeat after up to PERIOD words."""
    out = np.zeros(len(value), bool)
    again = np.zeros(len(value), bool)
    for k in range(1, min(PERIOD, len(value) - 1) + 1):
        again[k:] |= value[k:] == value[:-k]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if stop - start >= LONGEST:
            out[start:stop:LONGEST] = True
            out[stop - 1] = True
    return out


def cuts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets where chunks end, word ends); a chunk ends with its last word, blanks before a word belong to it."""
    _, ends = words_of(data)
    if not len(ends):
        return ends, ends
    value = mix(gear(data)[ends - 1])
    least = np.ones(len(ends), bool)
    for k in range(1, min(REACH, len(ends) - 1) + 1):
        least[k:] &= value[k:] < value[:-k]
        least[:-k] &= value[:-k] <= value[k:]
    # near the text's ends there is no whole neighbourhood to compare with
    least[: min(REACH, len(ends))] = False
    least[-min(REACH, len(ends)) :] = False
    at = ends[least | _in_repeats(value)]
    return (at if len(at) and at[-1] == ends[-1] else np.append(at, ends[-1])), ends


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, no, start, stop, words, digest binary): the chunks of every text, offsets in code points, stop exclusive.

    row numbers the rows of docs; store the result before it is used twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for frame in frames:
            parts, held = [], 0
            for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                row += 1
                if not text:
                    continue
                raw = text.encode("utf-8", "replace")
                data = np.frombuffer(raw, np.uint8)
                stops, ends = cuts(data)
                if not len(stops):
                    continue
                # a chunk starts at its first word, so blanks between chunks don't matter
                last = np.searchsorted(ends, stops, side="right")
                starts_of_words, _ = words_of(data)
                first = np.concatenate([[0], last[:-1]])
                starts = starts_of_words[first]
                points = np.cumsum((data & 0xC0) != 0x80) if len(raw) != len(text) else None
                place = (lambda x: x) if points is None else (lambda x: points[x - 1] * (x > 0))  # noqa: B023
                digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                parts.append(pd.DataFrame({
                    "row": row, "doc_id": pd.array([None if doc_id is None else int(doc_id)] * len(stops), "Int64"), "no": np.arange(len(stops)),
                    "start": place(starts), "stop": place(stops), "words": last - first, "digest": digests,
                }))
                held += len(stops)
                if held >= 200_000:
                    yield pd.concat(parts)
                    parts, held = [], 0
            if parts:
                yield pd.concat(parts)

    # ids go to pandas as text, since whole numbers beside a null would lose digits
    kept = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInPandas(run, "row long, doc_id long, no int, start long, stop long, words int, digest binary")


def repeated_passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """(doc_id, start, stop, words, first_doc_id, kept): passages of `words` or more that another document repeats.

    Offsets count code points, stop exclusive; inner blanks included. first_doc_id is the smallest doc_id that
    holds the passage's first chunk; kept tells that this document is the first holder of every chunk, so the passage stays here.
    A passage is a run of neighbouring chunks that other documents hold too. Every row has passages of its own, but rows of one doc_id are one
    document: what they share with each other alone is not repeated. Each row without a doc_id is a document of its own, and these come first.
    Null, empty and blank texts hold no passage; texts of any length are taken whole. Further columns are not read.
    """
    rows = settle(chunk_rows(docs), "chunks")
    # null before all numbers, and then by row
    holder = F.struct(F.col("doc_id").alias("id"), F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
    shared = settle(
        rows.groupBy("digest").agg(F.min(holder).alias("low"), F.max(holder).alias("high")).filter(~F.col("low").eqNullSafe(F.col("high"))).select("digest", "low"),
        "shared-chunks",
    )
    found = rows.withColumn("holder", holder).join(shared, "digest").drop("digest")
    in_order = Window.partitionBy("row").orderBy("no")
    jumps = F.coalesce((F.lag("no").over(in_order) + 1 != F.col("no")).cast("int"), F.lit(1))
    runs = found.withColumn("own", F.col("holder").eqNullSafe(F.col("low"))).withColumn("jump", jumps).withColumn("run", F.sum("jump").over(in_order))
    return runs.groupBy("row", "run").agg(
        F.min_by(F.struct("doc_id", F.col("low.id").alias("first_doc_id")), "no").alias("ids"), F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.sum("words").alias("words"), F.min("own").alias("kept"),
    ).filter(F.col("words") >= words).select("ids.doc_id", "start", "stop", "words", "ids.first_doc_id", "kept")
