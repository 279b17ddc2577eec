"""Documents ranked for query items by one automaton over all item terms; no index of the documents is built.

The terms of all items, each between boundary marks, make an Aho-Corasick automaton that every task gets. A text is folded to bytes in which
every separator is the boundary mark, so a term is found exactly where it stands as a whole. The first scan counts what the weights need:
documents, terms and the documents that hold each item term. The second scan scores every document in the task that reads it: the automaton's outputs
map to the items that hold the term. A task hands on only its best documents of each item.

An automaton holds up to AUTOMATON_BYTES of item text; more items are dealt to groups, which are scanned one after the other.

Equal rows of items count once. Rows with one item_id and different texts are ranked each for itself. Items without a term have no
rows, as have null and empty texts. Documents are rows: repeated ones are ranked each for itself, and null ids follow all others in a tie.
Texts are scanned whole, at any length; other columns are not read. No documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierstone.session import fresh_path, settle

BEST = 20
AUTOMATON_BYTES = 2_000_000  # item text of one automaton, which takes some fifty bytes for each of them at most
SCORES = 1_000_000  # scores (documents x items) that a task holds at once
SCALE, ONE, HALF, PART = 1_000_000_000, 1000, 12, 25  # fixed values of the score

MARK = b" "
#: The mark for every byte that belongs to no term, small letters for A-Z; bytes of other letters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else MARK[0] for c in range(256))
FOUND = "item int, absent int, id long, score long"
COUNTED = "term int, n long"
DOCUMENTS, TERMS = -1, -2  # in place of a term: the documents with a term, all terms


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(FOLD)


def terms(text: str | None) -> list[bytes]:
    return folded(text).split()


def _as_text(marked: bytes) -> str:
    """A character for each byte, which the automaton reads."""
    return (MARK + marked + MARK).decode("latin-1")


class ItemTerms:
    """The terms of some items: term -> items that hold it and how often."""

    def __init__(self, texts: list[str | None]):
        self.words: list[bytes] = []
        places: dict[bytes, int] = {}
        held: list[tuple[int, int, int]] = []
        for item, text in enumerate(texts):
            for word, times in Counter(terms(text)).items():
                if word not in places:
                    places[word] = len(self.words)
                    self.words.append(word)
                held.append((places[word], item, times))
        held.sort()
        self.items = len(texts)
        self.starts = np.searchsorted([h[0] for h in held], np.arange(len(self.words) + 1))
        self.holders = np.array([h[1] for h in held], np.int64)
        self.times = np.array([h[2] for h in held], np.int64)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for place, word in enumerate(self.words):
            made.add_word(_as_text(word), place)
        made.make_automaton()
        return made


_second = itemgetter(1)


def term_counts(automaton: ahocorasick.Automaton, marked: bytes) -> Counter:
    """Term -> occurrences; neighbouring terms share the mark between them."""
    return Counter(map(_second, automaton.iter(_as_text(marked))))


def counted(docs: DataFrame, held: ItemTerms) -> DataFrame:
    """(term, n): the documents that hold each term, and at DOCUMENTS and TERMS the totals over all documents."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = held.automaton()
        holders, documents, total = np.zeros(len(held.words), np.int64), 0, 0
        for batch in batches:
            for text in batch["text"]:
                marked = folded(text)
                words = len(marked.split())
                documents += words > 0
                total += words
                holders[list(term_counts(automaton, marked))] += 1
        some = np.flatnonzero(holders)
        yield pd.DataFrame({"term": [*some, DOCUMENTS, TERMS], "n": [*holders[some], documents, total]})

    return docs.select("text").mapInPandas(scan, COUNTED).groupBy("term").agg(F.sum("n").alias("n"))


def weights(held: ItemTerms, counts: dict[int, int]) -> np.ndarray:
    documents = counts.get(DOCUMENTS, 0)
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(held.words))], np.int64)


class Best:
    """The best documents of each item so far, by falling score and rising id, null last."""

    def __init__(self, items: int, most: int):
        self.most, self.kept = most, pd.DataFrame({"item": [], "score": [], "absent": [], "id": []}, dtype=np.int64)
        self.least = np.zeros(items, np.int64)  # what a document needs to be among them

    def add(self, items: np.ndarray, scores: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> None:
        both = pd.concat([self.kept, pd.DataFrame({"item": items, "score": scores, "absent": absent, "id": ids})], ignore_index=True)
        both = both.sort_values(["item", "score", "absent", "id"], ascending=[True, False, True, True], kind="stable")
        self.kept = both[both.groupby("item").cumcount() < self.most]
        full = self.kept.groupby("item")["score"].agg(["size", "min"])
        full = full[full["size"] == self.most]
        self.least[full.index] = full["min"]


def scored(docs: DataFrame, held: ItemTerms, counts: dict[int, int], most: int) -> DataFrame:
    """(item, doc_id, score): the best documents of every task."""
    weight, documents, total = weights(held, counts), counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
    at_once = max(1, SCORES // max(held.items, 1))

    def scores_of(found: list[tuple[int, Counter]]) -> np.ndarray:
        """documents x items."""
        row = np.repeat(np.arange(len(found)), [len(c) for _, c in found])
        term = np.fromiter((t for _, c in found for t in c), np.int64, len(row))
        times = np.fromiter((n for _, c in found for n in c.values()), np.int64, len(row))
        length = np.array([100 - PART + PART * n * documents // total for n, _ in found], np.int64)
        worth = weight[term] * (SCALE * times // (ONE * times + HALF * length[row]))
        sums = np.zeros((len(found), held.items), np.int64)
        order = np.argsort(term, kind="stable")
        here, first = np.unique(term[order], return_index=True)
        for t, rows in zip(here, np.split(order, first[1:])):  # a term once for all documents of the batch: its items take the worth times their repeats
            span = slice(held.starts[t], held.starts[t + 1])
            sums[np.ix_(row[rows], held.holders[span])] += worth[rows, None] * held.times[span]
        return sums

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, best = held.automaton(), Best(held.items, most)
        for batch in batches:
            for start in range(0, len(batch), at_once):
                part = batch.iloc[start:start + at_once]
                found = []
                for text in part["text"]:
                    marked = folded(text)
                    found.append((len(marked.split()), term_counts(automaton, marked)))
                sums = scores_of(found)
                rows, items = np.nonzero((sums > 0) & (sums >= best.least))
                best.add(items, sums[rows, items], part["absent"].to_numpy()[rows], part["id"].to_numpy()[rows])
        yield best.kept.astype({"item": "int32", "absent": "int32"})

    numbered = docs.select(F.col("doc_id").isNull().cast("int").alias("absent"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "text")
    found = numbered.mapInPandas(scan, FOUND)
    return found.select("item", F.when(F.col("absent") == 0, F.col("id")).alias("doc_id"), "score")


def _groups(items: DataFrame, bytes_each: int) -> tuple[DataFrame, int]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = settle(rows.filter(F.length("text") > 0), "query-items")
    size = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n = -(-size // bytes_each)
    return rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))), n


def ranked(docs: DataFrame, items: DataFrame, most: int = BEST, bytes_each: int = AUTOMATON_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, with a score above 0, equal scores by ascending doc_id."""
    spark = docs.sparkSession
    found, path = "item_id long, rank int, doc_id long, score long", fresh_path(spark, "ranked")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows, n = _groups(items, bytes_each)
    spark.createDataFrame([], found).write.parquet(path)
    for part in range(n):
        group = rows.filter(F.col("part") == part).collect()  # about bytes_each of text
        held = ItemTerms([r["text"] for r in group])
        if not held.words:
            continue
        counts = {r["term"]: r["n"] for r in counted(texts, held).collect()}  # a row for each term of the automaton
        if not counts.get(DOCUMENTS):
            continue
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())).cast("int").alias("rank")
        best = scored(texts, held, counts, most).select("item", place, "doc_id", "score").filter(F.col("rank") <= most)
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(group)], "item int, item_id long")
        best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(found).parquet(path)
