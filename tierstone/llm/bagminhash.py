"""Near duplicates by weighted Jaccard similarity of word shingles, through BagMinHash signatures.

A text is the multiset of its shingles of five words (fewer words: one shingle of them all). Every unit of a
shingle's weight carries a Poisson process of points in time; each point belongs to one signature component at random, and
a component's value is the time of its first point. Two texts agree in a component with probability
sum(min weight) / sum(max weight), exactly. The weight axis is cut into cells (0,1], (1,2], (2,4], (4,8], ...: one process per
shingle and cell, whose points are spread over the cell by their own hash, so texts that hold a shingle in
different weights share the points below the smaller weight. Points come in order of time and stop at the time by
which all components are settled, so a text costs one point per shingle plus about m log m.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierstone.llm.components import connected
from tierstone.session import settle

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6  # a pair at 0.8 meets in some band with probability 1 - (1 - 0.8**6)**32 = 0.99994
SMALL = 6  # buckets of up to so many texts compare all their pairs, larger ones by leaders
FEW = 32  # texts that share a rare shingle compare all their pairs at once up to so many; of more, leaders go first
BLOCK = 256  # texts of one rare shingle that a task pairs with as many others
CHARS = 500_000  # characters hashed at once; a longer text goes alone
ROWS_OUT = 250_000  # rows a task hands on at once

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_ODD) % (1 << 64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_STEP, _BACK = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text.

    A word is a run of ASCII letters and digits and of characters beyond ASCII, in small letters; a character of U+3000 to U+9FFF, whose
    scripts have no blanks, is a word by itself.
    """
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    inside = np.concatenate([[False], _WORD_BYTE[data], [False]])
    alone = np.concatenate([[False], (data >= 0xE3) & (data <= 0xE9), [False]])  # first byte of three
    begins = inside & ~np.concatenate([[False], inside[:-1]]) | alone
    begins[3:] |= inside[3:] & alone[:-3]
    starts = np.flatnonzero(begins) - 1
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | begins[1:]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # a polynomial of the word's bytes, shifted back to the word's start
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_BACK, len(data))[starts])
    limits = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(starts, limits), prepend=0)


def bags(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(text number, shingle, weight) of every distinct shingle, by text; a digest of each text's words; words of each."""
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    digests = [hashlib.blake2b(words[a : a + n].tobytes(), digest_size=16).digest() for a, n in zip(first, counts, strict=True)]
    total = np.zeros(len(words), np.uint64)
    place = np.arange(len(words)) - first[owner]
    for k in range(size):
        there = place + k < counts[owner]
        total[there] += mix(words[np.flatnonzero(there) + k] + _times(k + 1))
    starts = place < np.maximum(1, counts - size + 1)[owner]
    shingles, owner = mix(total[starts]), owner[starts]
    order = np.argsort(mix(shingles + owner.astype(np.uint64) * _ODD), kind="stable")
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    weights = np.diff(np.append(at, len(order)))
    return owner[at], shingles[at], weights, digests, counts


def signatures(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m first times; infinity for texts without shingles."""
    total = np.bincount(owner, weights=weights, minlength=texts)
    out = np.full(texts * m, np.inf)
    cells = 1 + np.ceil(np.log2(weights)).astype(np.int64)
    item = np.repeat(np.arange(len(owner)), cells)
    cell = np.arange(len(item)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell == 0, 0, 2.0 ** (cell - 1))
    width = np.where(cell == 0, 1, low)
    seed = mix(shingles[item] + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
    doc, weight = owner[item], weights[item]
    # all m components of a text have a point by `until`, except with probability exp(-4)
    until = m * (np.log(m) + 4) / np.maximum(total, 1)
    open_texts = total > 0
    while open_texts.any():
        live = np.flatnonzero(open_texts[doc])
        time = np.zeros(len(live))
        step = 0
        while len(live):
            step += 1
            draw = mix(seed[live] + _times(step))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53) / width[live]
            stay = time <= until[doc[live]]
            live, time, draw = live[stay], time[stay], mix(draw[stay] + _ODD)
            height = low[live] + width[live] * (((draw >> np.uint64(32)).astype(np.float64) + 1) / 2.0**32)
            real = height <= weight[live]
            component = ((draw[real] & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(out, doc[live[real]] * m + component.astype(np.int64), time[real])
        open_texts &= np.isinf(out.reshape(texts, m)).any(axis=1)
        until[open_texts] *= 2
    return out.reshape(texts, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    total = np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    total = np.broadcast_to(total, bits.shape[:2]).copy()
    for k in range(rows):
        total = mix(total + mix(bits[:, :, k]) * _ODD)
    return total.view(np.int64)


def _batches(frames: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sizes = frame[column].str.len().fillna(0).cumsum()
        for _, part in frame.groupby((sizes // CHARS).astype(int).to_numpy()):
            yield part


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, words, digest, bands array<long>) of every row; digest and bands describe the words alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(frames, "text"):
            texts = part["text"].fillna("").tolist()
            owner, shingles, weights, digests, counts = bags(texts)
            keys = band_keys(signatures(owner, shingles, weights, len(texts), bands * rows), bands, rows)
            yield pd.DataFrame({
                "doc_id": pd.array([None if x is None else int(x) for x in part["doc_id"]], "Int64"), "text_key": part["text_key"], "words": counts, "digest": digests,
                "bands": [k if n else [] for k, n in zip(keys, counts, strict=True)],
            })

    # ids go to pandas as text, since whole numbers beside a null would lose digits
    rows_in = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.withColumn("text_key", F.xxhash64("text")).mapInPandas(
        run, "doc_id long, text_key long, words long, digest binary, bands array<long>"
    )


def _leader_pairs(rows: DataFrame) -> DataFrame:
    """Of every bucket (key) of rows (key, digest, central): each member with the most central one."""
    top = rows.groupBy("key").agg(F.max(F.struct("central", "digest")).alias("top"))
    paired = rows.join(top, "key").select("digest", F.col("top.digest").alias("leader")).filter("digest <> leader")
    return paired.select(F.least("digest", "leader").alias("a"), F.greatest("digest", "leader").alias("b")).distinct()


def _small_pairs(rows: DataFrame) -> DataFrame:
    small = rows.filter(F.col("n") <= SMALL)
    other = small.select("key", F.col("digest").alias("b"))
    return small.join(other, "key").filter("digest < b").select(F.col("digest").alias("a"), "b").distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose multisets of shingles overlap by `similarity` or more.

    texts: (digest, text), one row per digest.
    """

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def bag(digest: bytes, text: str):
            if digest not in held:
                if len(held) > 64:
                    held.clear()
                _, shingles, weights, _, _ = bags([text])
                order = np.argsort(shingles)
                held[digest] = shingles[order], weights[order]
            return held[digest]

        for frame in frames:
            keep = []
            for row in frame.itertuples(index=False):
                (x, v), (y, w) = bag(row.a, row.text_a), bag(row.b, row.text_b)
                _, i, k = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = int(np.minimum(v[i], w[k]).sum())
                # integers, so that exactly `similarity` counts: both / (all - both) >= similarity
                keep.append(both * (1 + similarity) >= similarity * int(v.sum() + w.sum()) - 1e-9)
            yield frame.loc[keep, ["a", "b"]]

    one, two = texts.select(F.col("digest").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("digest").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").sortWithinPartitions("b")
    return joined.mapInPandas(check, "a binary, b binary")


def _rare_keys(texts: DataFrame, similarity: float) -> DataFrame:
    """(key, digest, before, total) of the shingles of each text that a text with `similarity` can't all do without.

    texts: (digest, number, text). With the shingles of every text in one order, rarest first, the first shingle two such texts have in
    common has at most a part of 1 - similarity of either text before it. So the shingles up to there, and no others, are keys.
    before: the weight of the text's shingles ahead of the key; total: of all its shingles.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _batches(frames, "text"):
            owner, shingles, weights, _, _ = bags(part["text"].tolist())
            numbers = part["number"].to_numpy()[owner]
            for at in range(0, len(owner), ROWS_OUT):
                here = slice(at, at + ROWS_OUT)
                yield pd.DataFrame({"number": numbers[here], "key": shingles[here].view(np.int64), "weight": weights[here].astype(np.int32)})

    # numbers in place of digests: a text has as many rows as shingles
    rows = settle(texts.select("number", "text").mapInPandas(run, "number long, key long, weight int"), "shingles")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("number").orderBy("n", "key")
    before = F.sum("weight").over(in_order) - F.col("weight")
    total = F.sum("weight").over(Window.partitionBy("number"))
    placed = rows.join(counts, "key").withColumn("before", before).withColumn("total", total)
    keys = placed.filter((F.col("n") > 1) & (F.col("before") <= F.col("total") * (1 - similarity) + 1e-9)).select("key", "number", "before", "total")
    return keys.join(texts.select("number", "digest"), "number").drop("number")


def _pairs_across(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of rows (key, digest, part, before, total, bands) of one key and two parts that can have `similarity`.

    At the first shingle two texts have in common, what each has from there on bounds their overlap; a pair with `similarity` passes
    that bound there, and its texts meet in a band. The members of a key are dealt into blocks, and a task takes two blocks.
    """
    kinds = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.join(kinds.select("key", blocks.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    one = dealt.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), "digest", "part", "before", "total", "bands")
    other = dealt.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("digest").alias("b"),
        F.col("part").alias("part_b"), F.col("before").alias("before_b"), F.col("total").alias("total_b"), F.col("bands").alias("bands_b"),
    )
    most = F.least(F.col("total") - F.col("before"), F.col("total_b") - F.col("before_b"))
    near = (most * (1 + similarity) >= similarity * (F.col("total") + F.col("total_b")) - 1e-9) & F.arrays_overlap("bands", "bands_b")
    paired = one.join(other, ["key", "i", "j"]).filter("part <> part_b AND (i < j OR digest < b)").filter(near)
    return paired.select(F.least("digest", "b").alias("a"), F.greatest("digest", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, class_id, class_rows.

    class_id is the smallest doc_id of the class, a connected component of texts that overlap by `similarity`; class_rows its
    rows. Texts of equal words are one text. Null, empty
    and wordless texts are classes of their own with their doc_id as class_id; so is a null doc_id's lone text. Rows that
    repeat a doc_id stay rows. Other columns are not read.

    Candidates come from the bands. A small bucket compares all its pairs. A large one links its members
    to its most central text (the one that meets most texts over all bands); then, while that finds links,
    the parts of each bucket that are still apart are compared through their most central members. The texts of
    buckets that end in several parts meet once more over their rare shingles, of which two such
    texts share at least one: all pairs of a rare shingle across parts. Where more than FEW texts hold it, leaders join
    what they can first, and all pairs across the parts that are left follow.
    """
    sketched = settle(sketch(docs, bands, rows), "sketches")
    # one grouping of the rows, combined before its exchange, gives all that is asked of equal texts; from here on a text is one row
    classes = sketched.filter("words > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_key")).alias("row")
    )
    classes = settle(classes, "text-classes")
    keyed = classes.select("digest", F.explode("bands").alias("key"))
    sizes = settle(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    members = settle(keyed.join(sizes, "key"), "bucket-members")
    central = members.groupBy("digest").agg(F.sum("n").alias("central"))
    members = settle(members.join(central, "digest"), "bucket-members")

    # texts of the candidates; a row is right if its words have the digest that is asked for
    holders = classes.select("digest", "row.*").join(members.select("digest").distinct(), "digest")
    source = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).withColumn("_key", F.xxhash64("text"))
    texts = source.join(holders, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
    # rows that repeat both id and text would repeat the digest
    texts = settle(texts.groupBy("digest").agg(F.first("text").alias("text")).withColumn("number", F.monotonically_increasing_id()), "candidate-texts")

    tried = settle(_small_pairs(members).union(_leader_pairs(members.filter(F.col("n") > SMALL))).distinct(), "pairs")
    links = settle(verified(tried, texts, similarity), "links")
    large = members.filter(F.col("n") > SMALL).select("key", "digest", "central")
    links, tried, roots = _through_leaders(large, texts, links, tried, similarity)

    # buckets that still hold several parts may hide links between texts that are not central
    parted = _with_part(large, roots)
    mixed = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    left = settle(parted.join(mixed.select("key"), "key", "left_semi").select("digest", "part", "central").distinct(), "left-texts")
    rare = settle(_rare_keys(texts.join(left.select("digest"), "digest", "left_semi"), similarity).join(left, "digest"), "rare-keys")
    kinds = rare.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    rare = settle(rare.join(kinds.select("key", "n"), "key"), "rare-keys")
    one, other = rare.filter(F.col("n") <= FEW), rare.select("key", F.col("digest").alias("b"), F.col("part").alias("part_b"))
    across = one.join(other, "key").filter("digest < b AND part <> part_b").select(F.col("digest").alias("a"), "b").distinct()
    fresh = settle(across.join(tried, ["a", "b"], "left_anti"), "pairs")
    found, tried = settle(verified(fresh, texts, similarity), "links"), tried.union(fresh)
    if not found.isEmpty():
        links, roots = links.union(found), None
    many = rare.filter(F.col("n") > FEW).select("key", "digest", "central")
    links, tried, roots = _through_leaders(many, texts, links, tried, similarity, roots)
    apart = _with_part(rare.filter(F.col("n") > FEW).select("key", "digest", "before", "total"), roots).join(classes.select("digest", "bands"), "digest")
    fresh = settle(_pairs_across(apart, similarity).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = settle(verified(fresh, texts, similarity), "links")
    if not found.isEmpty():
        links = links.union(found)
        roots = connected(links)

    joined = classes.select("digest", "doc_id", "copies").join(roots, F.col("digest") == F.col("node"), "left").withColumn("root", F.coalesce("root", "digest"))
    named = joined.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    of_text = settle(joined.select("digest", "root").join(named, "root").drop("root"), "classes")
    return sketched.join(of_text, "digest", "left").select(
        "doc_id", "text_key", F.when(F.col("words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"),
    )


def _with_part(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the component of their digest."""
    return rows.join(roots, F.col("digest") == F.col("node"), "left").withColumn("part", F.coalesce("root", "digest")).drop("node", "root")


def _through_leaders(
    rows: DataFrame, texts: DataFrame, links: DataFrame, tried: DataFrame, similarity: float, roots: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, tried, components): the parts of every bucket of rows (key, digest, central) that are still apart meet
    through their most central members, until that finds no link. roots: the components of links where known."""
    while True:
        roots = connected(links) if roots is None else roots
        parts = _with_part(rows, roots).groupBy("key", "part").agg(F.max(F.struct("central", "digest")).alias("best"))
        rest = parts.select("key", "best.central", "best.digest")
        fresh = settle(_leader_pairs(rest).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = settle(verified(fresh, texts, similarity), "links")
        tried = tried.union(fresh)
        if found.isEmpty():
            return links, tried, roots
        links, roots = links.union(found), None


def keep_one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that lead their class: those whose doc_id is its class_id, once where a row repeats."""
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias("_id"), F.coalesce("text_key", F.lit(0)).alias("_key"), F.col("class_rows").alias("_rows")
    ).distinct()
    key = F.xxhash64(F.col("text").cast("string"))
    marked = docs.withColumn("_own", key)
    return marked.join(kept, marked["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (marked["_own"] == kept["_key"])).dropDuplicates(
        ["doc_id", "_own"]
    ).select(*(docs[c] for c in docs.columns))
