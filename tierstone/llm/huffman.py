"""Token ids as canonical, length-limited Huffman code in independent blocks.

A store is a folder of two Parquet tables, so it can lie on any file system Spark reaches:

    codes    id int, bits int, count long: one row per id that occurs; the canonical code
             follows from the lengths alone (shorter codes first, then smaller ids)
    blocks   shard int, block int, first long, n int: the block holds n ids, of which the first is
             number `first` of the whole stream; doc_ids / doc_nos / counts / ends, arrays: the pieces of
             documents inside, in order (ends: the document is complete); points array<int>: the bit
             offset of every `CHECKPOINT`-th id; payload binary: the code, first bit highest

Shards are ranges of doc_id in ascending order and blocks count up inside a shard. A block needs nothing
but `codes` to be read, and every checkpoint is a place to start, so the decoder walks all
checkpoints of a block at once and takes one table look-up per id.
"""

from __future__ import annotations

import re
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.session import arrow_rows, fresh_path, settle

BLOCK = 65536  # ids in a block, at most
CHECKPOINT = 256  # ids between two checkpoints
MAX_BITS = 16  # length limit of a code, and so the size of the decoding table
DECODED = 16  # blocks that go to Python at once, and are decoded in step
DOCUMENTS_AT_ONCE = 512  # documents that go to Python at once
CACHED_WORDS = 400_000  # words of a generation, of LONGEST bytes at most; a Python worker remembers two
CACHED_BYTES = 32_000_000  # and bytes of words and ids, about
LONGEST = 64
TEXT_AT_ONCE = 4_000_000  # bytes of text whose words are looked up together,
DOCUMENTS_TOGETHER = 65536  # and documents, at most

STAGED = (
    "shard int, block int, within long, n int, doc_ids array<bigint>, doc_nos array<int>, counts array<int>, ends array<boolean>, ids binary, "
    "seen array<int>, times array<bigint>"  # of the whole shard, in the row of its last block
)
BLOCKS = "shard int, block int, first long, n int, doc_ids array<bigint>, doc_nos array<int>, counts array<int>, ends array<boolean>, points array<int>, payload binary"
STAGED_ARROW = pa.schema({
    "shard": pa.int32(), "block": pa.int32(), "within": pa.int64(), "n": pa.int32(), "doc_ids": pa.list_(pa.int64()), "doc_nos": pa.list_(pa.int32()),
    "counts": pa.list_(pa.int32()), "ends": pa.list_(pa.bool_()), "ids": pa.binary(), "seen": pa.list_(pa.int32()), "times": pa.list_(pa.int64()),
})
PIECES = "shard int, doc_no int, doc_id bigint, piece int, start long, n int, crc long, last boolean"


# ---------------------------------------------------------------- tokens

def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the model's vocabulary: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = "".join(_byte_letters()[b] for b in range(256))


LATIN = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and c not in "ªµº")
MARKS = ".,;:!?#$%&*"


NO_WORDS, NO_IDS = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
BLANKS = bytes.maketrans(b"\n\t\r", b"   ")


class Generation(NamedTuple):
    """Words and the ids of each, as Arrow arrays, which take a fraction of the room of Python's strings."""

    words: pa.Array = NO_WORDS
    ids: pa.Array = NO_IDS

    def __len__(self) -> int:
        return len(self.words)

    def places(self, wanted: pa.Array) -> np.ndarray:
        """Where each of the distinct words stands, or -1. The table that is probed is that of the wanted ones, which are fewer."""
        asked = pc.index_in(self.words, value_set=wanted)
        place = np.full(len(wanted), -1)
        place[asked.drop_null().to_numpy()] = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
        return place


class WordIds:
    """Ids of words without blanks, as little-endian unsigned 32-bit integers.

    Only for tokenizers whose words never reach over a blank. A word of Latin letters and a tail of
    marks is two words to such a tokenizer, so both parts go to its model directly;
    every other word takes the whole way through the library. Words are remembered in two generations:
    a full one becomes the older one, from which words that come again are taken over.
    """

    SIMPLE = re.compile(f"([{LATIN}]*)([{MARKS}]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.newer, self.older = Generation(), Generation()

    def __len__(self) -> int:
        return len(self.newer)

    def part(self, text: str) -> list[int]:
        mapped = text if text.isascii() else charmap_decode(text.encode(), "strict", BYTE_LETTERS)[0]
        return [t.id for t in self.model.tokenize(mapped)]

    def made(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return self.part(word.lower())
        if (simple := self.SIMPLE.fullmatch(word)) is None:
            return self.whole.encode(word, add_special_tokens=False).ids
        letters, marks = simple.groups()
        return (self.part(letters.lower()) if letters else []) + (self.part(marks) if marks else [])

    def all_made(self, words: pa.Array) -> pa.Array:
        ids, ends = [], [0]
        for word in words.to_pylist():
            ids += self.made(word)
            ends.append(len(ids))
        buffers = [None, pa.py_buffer(4 * np.array(ends, np.int64)), pa.py_buffer(np.array(ids, "<u4"))]
        return pa.Array.from_buffers(pa.large_binary(), len(words), buffers)

    def looked_up(self, words: pa.Array) -> pa.Array:
        """The ids of each word; words that repeat are looked up once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        place = self.newer.places(distinct)
        lost = np.flatnonzero(place < 0)
        before = self.older.places(distinct.take(lost))
        again, first = lost[before >= 0], lost[before < 0]
        came = np.concatenate([again, first])
        added = distinct.take(came)
        found = pa.concat_arrays([self.older.ids.take(before[before >= 0]), self.all_made(distinct.take(first))])
        place[came] = len(self.newer) + np.arange(len(came))
        ids = pa.concat_arrays([self.newer.ids, found])
        self.remember(added, found)
        return ids.take(pa.array(place).take(coded.indices))

    def remember(self, words: pa.Array, ids: pa.Array) -> None:
        short = pc.less_equal(pc.binary_length(words), LONGEST)
        words, ids = words.filter(short)[:CACHED_WORDS], ids.filter(short)[:CACHED_WORDS]
        if len(self.newer) + len(words) > CACHED_WORDS or self.newer.words.nbytes + self.newer.ids.nbytes > CACHED_BYTES:
            self.newer, self.older = Generation(), self.newer
        self.newer = Generation(pa.concat_arrays([self.newer.words, words]), pa.concat_arrays([self.newer.ids, ids]))

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a word is looked up once for all of them."""
        return self.encode_array(pa.array(texts, pa.large_string()))

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """The same for an array of large strings."""
        joined = pa.concat_arrays([pc.fill_null(texts, "")])  # a slice gets buffers of its own
        _, offsets, data = joined.buffers()
        plain = pa.py_buffer((data.to_pybytes() if data else b"").translate(BLANKS))
        split = pc.split_pattern(pa.Array.from_buffers(pa.large_string(), len(joined), [None, offsets, plain], offset=joined.offset), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        letters = pc.utf8_rtrim(words, MARKS)
        simple = pc.match_substring_regex(letters, f"^[{LATIN}]*$")
        heads = pc.if_else(simple, pc.utf8_lower(letters), words)
        tails = pc.if_else(simple, pc.utf8_ltrim(words, LATIN), "")
        parts = self.looked_up(pa.concat_arrays([heads, tails]))
        both = pc.binary_join_element_wise(parts[: len(words)], parts[len(words) :], pa.scalar(b"", pa.large_binary()))
        ids = both.take(coded.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[split.offsets.to_numpy()].tolist()
        held = memoryview(data or b"")
        return [held[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


class _Cutter:
    """Cuts the id stream of one shard into blocks: whole documents while they fit, long ones in pieces."""

    def __init__(self, shard: int, block: int):
        self.shard, self.size, self.no, self.within = shard, block, 0, 0
        self.reset()

    def reset(self):
        self.held, self.doc_ids, self.doc_nos, self.counts, self.ends, self.parts = 0, [], [], [], [], []

    def close(self) -> dict:
        row = {
            "shard": self.shard, "block": self.no, "within": self.within, "n": self.held, "doc_ids": self.doc_ids,
            "doc_nos": self.doc_nos, "counts": self.counts, "ends": self.ends, "ids": b"".join(self.parts),
        }
        self.no += 1
        self.within += self.held
        self.reset()
        return row

    def add(self, doc_no: int, doc_id: int | None, ids: bytes) -> Iterator[dict]:
        n, at = len(ids) // 4, 0
        if self.held and self.held + n > self.size:
            yield self.close()
        while True:
            take = min(n - at, self.size - self.held)
            self.doc_ids.append(doc_id)
            self.doc_nos.append(doc_no)
            self.counts.append(take)
            self.ends.append(at + take == n)
            self.parts.append(ids[4 * at : 4 * (at + take)])
            self.held += take
            at += take
            if at == n:
                return
            yield self.close()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Doc ids and texts of all rows in their order, about TEXT_AT_ONCE bytes together; a longer text is a group of its own or ends one."""
    doc_ids, texts, held = [], [], 0
    for batch in batches:
        ids, column = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
        start = 0
        for i, size in enumerate(sizes.tolist()):
            doc_ids.append(ids[i])
            held += size
            if held >= TEXT_AT_ONCE or len(doc_ids) >= DOCUMENTS_TOGETHER:
                texts.append(column[start : i + 1])
                yield doc_ids, pa.concat_arrays(texts)
                doc_ids, texts, held, start = [], [], 0, i + 1
        if start < len(column):
            texts.append(column[start:])
    if doc_ids:
        yield doc_ids, pa.concat_arrays(texts)


class _Counts:
    """How often each id occurs."""

    def __init__(self):
        self.total = np.zeros(0, np.int64)

    def room(self, top: int) -> None:
        if top > len(self.total):
            self.total = np.pad(self.total, (0, top - len(self.total)))

    def add(self, ids: bytes) -> None:
        part = np.bincount(np.frombuffer(ids, "<u4"))
        self.room(len(part))
        self.total[: len(part)] += part

    def add_counted(self, seen: np.ndarray, times: np.ndarray) -> None:
        """Ids, each once and ascending, and how often each was seen."""
        if len(seen):
            self.room(int(seen[-1]) + 1)
            self.total[seen] += times

    def row(self) -> dict:
        seen = np.flatnonzero(self.total)
        return {"seen": seen, "times": self.total[seen]}


def stage(docs: DataFrame, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Documents in ascending doc_id order (null first), tokenised and cut into blocks of ids, which are counted on the way."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = word_ids(tokenizer).encode_array
        cutter, counts = _Cutter(TaskContext.get().partitionId(), block), _Counts()

        number = 0
        for doc_ids, texts in _gathered(batches):
            rows: list[dict] = []
            for doc_id, ids in zip(doc_ids, encode(texts), strict=True):
                for row in cutter.add(number, doc_id, ids + end):
                    counts.add(row["ids"])
                    rows.append(row)
                    if len(rows) >= 8:
                        yield pa.RecordBatch.from_pylist(rows, STAGED_ARROW)
                        rows = []
                number += 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, STAGED_ARROW)
        if cutter.held:  # always, after a document: a block is closed by what comes after it
            row = cutter.close()
            counts.add(row["ids"])
            yield pa.RecordBatch.from_pylist([row | counts.row()], STAGED_ARROW)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash of the text spreads and orders rows that repeat one doc_id
    keyed = kept.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return ordered.mapInArrow(cut, STAGED)


# ---------------------------------------------------------------- code

def limited_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol, none above max_bits, with the smallest total: package and merge."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need codes of more than {max_bits} bits")
    if n <= 1:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.float64)[order]
    single, level = [], weights
    own = np.ones(n, bool)
    for _ in range(max_bits):
        single.append(own)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        place = np.argsort(merged, kind="stable")
        level, own = merged[place], place < n
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for own in reversed(single):
        singles = int(own[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ids (ascending) with the given lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = np.asarray(ids)[order].astype(np.int64), np.asarray(bits)[order].astype(np.int64)
        self.width = int(self.bits[-1]) if len(order) else 1
        # in canonical order, each code is the sum of the space that the codes before it take up
        space = np.int64(1) << (self.width - self.bits)
        left = np.concatenate([[0], np.cumsum(space)])[:-1]
        self.codes = left >> (self.width - self.bits)
        top = int(self.ids.max()) + 1 if len(order) else 0
        self.code_of, self.bits_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids], self.bits_of[self.ids] = self.codes, self.bits
        self.next_id = np.zeros(1 << self.width, np.uint32)
        self.next_bits = np.ones(1 << self.width, np.int64)
        filled = int(space.sum())
        self.next_id[:filled] = np.repeat(self.ids, space)
        self.next_bits[:filled] = np.repeat(self.bits, space)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Checkpoints and payload of a block."""
        bits = self.bits_of[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        total = int(ends[-1]) if len(ids) else 0
        word, shift = starts >> 4, (32 - (starts & 15) - bits).astype(np.uint64)
        # a code of up to 16 bits lies in two neighbouring 16-bit words; bits never overlap, so sums are unions
        placed = self.code_of[ids] << shift
        words = (total + 15) // 16 + 1
        high = np.bincount(word, weights=(placed >> np.uint64(16)).astype(np.float64), minlength=words)
        low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFF)).astype(np.float64), minlength=words + 1)
        packed = (high + low[:words]).astype(np.uint16).astype(">u2").tobytes()[: (total + 7) // 8]
        return starts[::CHECKPOINT].astype(np.int32), packed

    def decode(self, payload: bytes, points: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block, all checkpoints in step."""
        return self.decode_blocks([payload], [points], [n])[0]

    def decode_blocks(self, payloads: list[bytes], points: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """The ids of some blocks, the checkpoints of all of them in step."""
        lanes = [-(-n // CHECKPOINT) for n in sizes]
        total = sum(lanes)
        if not total:
            return [np.zeros(0, np.uint32) for _ in sizes]
        raw = np.frombuffer(b"".join(p + b"\0" * 8 for p in payloads), np.uint8).astype(np.uint32)
        # the 32 bits from each byte on; a code starts in the first of them
        ahead = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).astype(np.int64)
        begins = 8 * np.cumsum([0, *(len(p) + 8 for p in payloads)])[:-1]
        at = np.concatenate([np.asarray(p[:k], np.int64) + b for p, k, b in zip(points, lanes, begins, strict=True)])
        counts = np.concatenate([np.minimum(CHECKPOINT, n - CHECKPOINT * np.arange(k)) for n, k in zip(sizes, lanes, strict=True)])
        order = np.argsort(-counts, kind="stable")  # lanes that end early are the last ones
        at, ends = at[order], np.searchsorted(-counts[order], -np.arange(CHECKPOINT))
        out = np.zeros((CHECKPOINT, total), np.uint32)
        mask, low = np.int64((1 << self.width) - 1), 32 - self.width
        for step in range(int(counts.max())):
            here = at[: ends[step]]
            key = (ahead[here >> 3] >> (low - (here & 7))) & mask
            out[step, : len(here)] = self.next_id[key]
            here += self.next_bits[key]
        back = np.empty(total, np.int64)
        back[order] = np.arange(total)
        bounds = np.cumsum([0, *lanes])
        return [out[:, back[a:z]].T.ravel()[:n] for a, z, n in zip(bounds[:-1], bounds[1:], sizes, strict=True)]


def _decoded(code: Code, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """DECODED blocks in step: their rows, the ids of each, and for every piece of a document its row and the number of its first id."""
    for batch in batches:
        for start in range(0, batch.num_rows, DECODED):
            rows = batch.slice(start, DECODED)
            points = [p.values.to_numpy() for p in rows.column("points")]
            found = code.decode_blocks(rows.column("payload").to_pylist(), points, rows.column("n").to_pylist())
            row_of = np.repeat(np.arange(rows.num_rows), rows.column("counts").value_lengths().to_numpy())
            counts = [np.asarray(c.values.to_numpy(), np.int64) for c in rows.column("counts")]
            firsts = [f + np.cumsum(c) - c for f, c in zip(rows.column("first").to_pylist(), counts, strict=True)]
            yield rows, found, row_of, np.concatenate(firsts)


def _shards_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the shards of a task, added up."""
    counts = _Counts()
    for batch in batches:
        for seen, times in zip(batch.column("seen"), batch.column("times"), strict=True):
            counts.add_counted(seen.values.to_numpy(), times.values.to_numpy())
    found = counts.row()
    yield pa.RecordBatch.from_pydict({"id": pa.array(found["seen"], pa.int32()), "count": pa.array(found["times"], pa.int64())})


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block: int = BLOCK, max_bits: int = MAX_BITS) -> None:
    """Encode the text of every row (null: empty) and write the store to `path`.

    Rows: ascending doc_id, null first; rows that repeat a doc_id follow each other in the order of their text's hash.
    Each counts as a document of its own and ends in `end_id`. Other columns are not read.
    Driver memory: the vocabulary's counts and one number per shard, whatever the size of the input.
    """
    spark = docs.sparkSession
    if max_bits > 16:
        raise ValueError("codes are placed in 16-bit words, so max_bits goes up to 16")
    with arrow_rows(spark, DOCUMENTS_AT_ONCE):
        staged = settle(stage(docs, tokenizer, end_id, block), "staged-ids")
    each = staged.where(F.col("seen").isNotNull()).select("seen", "times").mapInArrow(_shards_counted, "id int, count long")
    counts = each.groupBy("id").agg(F.sum("count").alias("count")).orderBy("id").toPandas()
    counts["bits"] = limited_lengths(counts["count"].to_numpy(), max_bits).astype("int32")
    schema = "id int, bits int, count long"
    spark.createDataFrame(counts[["id", "bits", "count"]], schema).coalesce(1).write.parquet(f"{path}/codes")
    code = Code(counts["id"].to_numpy(), counts["bits"].to_numpy())

    sizes = staged.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    before, total = {}, 0
    for row in sizes:
        before[row["shard"]] = total
        total += row["n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [code.encode(np.frombuffer(ids, "<u4")) for ids in batch.column("ids").to_pylist()]
            shards, within = batch.column("shard").to_pylist(), batch.column("within").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "shard": batch.column("shard"), "block": batch.column("block"),
                "first": pa.array([before[s] + w for s, w in zip(shards, within, strict=True)], pa.int64()),
                **{name: batch.column(name) for name in ("n", "doc_ids", "doc_nos", "counts", "ends")},
                "points": pa.array([p for p, _ in coded], pa.list_(pa.int32())), "payload": pa.array([b for _, b in coded], pa.binary()),
            })

    with arrow_rows(spark, DECODED):
        staged.drop("seen", "times").mapInArrow(pack, BLOCKS).write.option("compression", "snappy").parquet(f"{path}/blocks")


def load_code(spark: SparkSession, path: str) -> Code:
    table = spark.read.parquet(f"{path}/codes").orderBy("id").toPandas()  # one row per id of the vocabulary
    return Code(table["id"].to_numpy(), table["bits"].to_numpy())


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, piece, ids array<int>) per piece of a document; only documents longer than a block have several."""
    code = load_code(spark, path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found, row_of, firsts in _decoded(code, batches):
            offsets = np.cumsum([0, *rows.column("counts").flatten().to_pylist()]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_ids").flatten(), "start": pa.array(firsts), "piece": rows.column("block").take(pa.array(row_of)),
                "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32))),
            })

    return read_blocks(spark, path).mapInArrow(unpack, "doc_id long, start long, piece int, ids array<int>")


def _crc_pieces(code: Code):
    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found, row_of, firsts in _decoded(code, batches):
            of, counts = pa.array(row_of), rows.column("counts").flatten()
            ids = np.concatenate(found).astype("<u4", copy=False)
            ends = np.cumsum(counts.to_numpy(), dtype=np.int64)
            crc = [zlib.crc32(ids[a:z]) for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "shard": rows.column("shard").take(of), "doc_no": rows.column("doc_nos").flatten(), "doc_id": rows.column("doc_ids").flatten(),
                "piece": rows.column("block").take(of), "start": pa.array(firsts), "n": counts,
                "crc": pa.array(crc, pa.int64()), "last": rows.column("ends").flatten(),
            })

    return crcs


def crc32_joined(first: int, second: int, length: int) -> int:
    """crc32 of a text from the crc32 of its two parts; length: bytes of the second.

    The register after `length` zero bytes is a linear map of the register before, applied here
    by squaring the map of one zero bit.
    """
    def apply(columns: list[int], value: int) -> int:
        total, k = 0, 0
        while value:
            if value & 1:
                total ^= columns[k]
            value >>= 1
            k += 1
        return total

    columns = [0xEDB88320] + [1 << k for k in range(31)]
    bits = 8 * length
    while bits:
        if bits & 1:
            first = apply(columns, first)
        columns = [apply(columns, c) for c in columns]
        bits >>= 1
    return first ^ second


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the store alone."""
    pieces = read_blocks(spark, path).mapInArrow(_crc_pieces(load_code(spark, path)), PIECES)

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for rows in parts:
            total = 0
            for row in rows:
                total = crc32_joined(total, row["crc"], 4 * row["n"]) if len(rows) > 1 else row["crc"]
            out.append(total)
        return pd.Series(out)

    whole = pieces.groupBy("shard", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("parts"),  # one per block the document reaches into
    )
    return whole.select("doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write a store to the shared folder and describe each document from what was written."""
    path = fresh_path(docs.sparkSession, "token-store")
    write_tokens(docs, path, tokenizer, end_id)
    return token_digests(docs.sparkSession, path)
