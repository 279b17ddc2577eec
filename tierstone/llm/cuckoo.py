"""Exact duplicates through an index of cuckoo filters over content digests.

Digests are dealt to shards by their first bytes. A shard holds a cuckoo filter and, by the filter's own
home bucket, the stored entries (digest, first id, rows). A digest the filter has not seen is new without a look at the
entries; a hit is verified against the entries of its bucket. Filters take deletions, and one that overflows is built anew, twice as
large, from the stored digests.

Stored as Parquet: shards (shard, buckets, seed, slots binary) and entries (shard, bucket, digest, keep_id, n).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.session import settle

SPACE = r"[\x20\x09-\x0D]+"
SLOTS = 4  # fingerprints in a bucket
KICKS = 500  # moves before a filter counts as full
SHARD_KEYS = 20_000  # distinct digests a shard is planned for; more only make its filter larger
TASK_KEYS = 100_000  # digests a task sums before it hands them on
SHARDS = "shard int, buckets int, seed int, slots binary"
ENTRIES = "shard int, bucket int, digest string, keep_id long, n long"


class CuckooFilter:
    """Sixteen-bit fingerprints of hex digests in buckets of four; the second home is the first xor the fingerprint's hash."""

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.buckets = buckets  # a power of two
        self.slots = np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy() if slots else np.zeros((buckets, SLOTS), np.uint16)
        self.turn = 0

    @staticmethod
    def fingerprint(digest: str) -> int:
        return int(digest[16:20], 16) or 1

    def home(self, digest: str) -> int:
        return int(digest[20:36], 16) & (self.buckets - 1)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def __contains__(self, digest: str) -> bool:
        mark, a = self.fingerprint(digest), self.home(digest)
        return mark in self.slots[a].tolist() or mark in self.slots[self.other(a, mark)].tolist()

    def _place(self, bucket: int, mark: int) -> bool:
        row = self.slots[bucket].tolist()
        if 0 in row:
            self.slots[bucket, row.index(0)] = mark
            return True
        return False

    def insert(self, digest: str) -> bool:
        """False if there was no room; the filter is as before then."""
        mark, a = self.fingerprint(digest), self.home(digest)
        b = self.other(a, mark)
        if self._place(a, mark) or self._place(b, mark):
            return True
        moved, at = [], b
        for _ in range(KICKS):
            self.turn += 1
            slot = self.turn % SLOTS
            moved.append((at, slot, int(self.slots[at, slot])))
            mark, self.slots[at, slot] = int(self.slots[at, slot]), mark
            at = self.other(at, mark)
            if self._place(at, mark):
                return True
        for bucket, slot, was in reversed(moved):
            self.slots[bucket, slot] = was
        return False

    def delete(self, digest: str) -> bool:
        """Takes out one fingerprint of a digest that is known to be stored."""
        mark, a = self.fingerprint(digest), self.home(digest)
        for bucket in (a, self.other(a, mark)):
            row = self.slots[bucket].tolist()
            if mark in row:
                self.slots[bucket, row.index(mark)] = 0
                return True
        return False


class Shard:
    """One filter with its entries: digest -> [keep_id, rows] below the digest's home bucket."""

    def __init__(self, filter_: CuckooFilter | None = None, entries: Iterator[tuple[str, int | None, int]] = ()):
        self.filter = filter_ or CuckooFilter()
        self.content: dict[int, dict[str, list]] = defaultdict(dict)
        self.verified = self.false_hits = self.resizes = 0
        for digest, keep, n in entries:
            self.content[self.filter.home(digest)][digest] = [keep, n]

    def _grow(self) -> None:
        entries = [x for bucket in self.content.values() for x in bucket.items()]
        buckets = self.filter.buckets
        while True:
            buckets *= 2
            larger = CuckooFilter(buckets)
            if all(larger.insert(d) for d, _ in entries):
                break
        self.resizes += 1
        self.filter, self.content = larger, defaultdict(dict)
        for digest, entry in entries:
            self.content[larger.home(digest)][digest] = entry

    def find(self, digest: str) -> list | None:
        if digest not in self.filter:
            return None
        entry = self.content[self.filter.home(digest)].get(digest)
        self.verified += entry is not None
        self.false_hits += entry is None
        return entry

    def add(self, digest: str, keep: int | None, n: int) -> None:
        entry = self.find(digest)
        if entry is not None:
            known = [x for x in (entry[0], keep) if x is not None]
            entry[0] = min(known) if known else None
            entry[1] += n
            return
        while not self.filter.insert(digest):
            self._grow()
        self.content[self.filter.home(digest)][digest] = [keep, n]

    def remove(self, digest: str, n: int) -> bool:
        """Take n rows of a digest away; the last one frees its fingerprint. keep_id stays that of the first row ever seen."""
        entry = self.find(digest)
        if entry is None:
            return False
        entry[1] -= n
        if entry[1] <= 0:
            self.filter.delete(digest)
            del self.content[self.filter.home(digest)][digest]
        return True


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes of one task, summed by digest; more than TASK_KEYS digests are handed on in parts."""
    held: dict[str, list] = {}

    def out() -> pd.DataFrame:
        rows = [(d, k, n) for d, (k, n) in held.items() if n]
        return pd.DataFrame({
            "digest": pd.Series([r[0] for r in rows], dtype=object), "keep_id": pd.array([r[1] for r in rows], "Int64"), "n": np.array([r[2] for r in rows], np.int64),
        })

    for frame in frames:
        for digest, keep, n in zip(frame["digest"].tolist(), frame["keep_id"].tolist(), frame["n"].tolist(), strict=True):
            entry = held.setdefault(digest, [None, 0])
            if keep is not None and (entry[0] is None or int(keep) < entry[0]):
                entry[0] = int(keep)
            entry[1] += n
        if len(held) >= TASK_KEYS:
            yield out()
            held.clear()
    yield out()


class Index:
    """A stored index: `shards` and `entries` as described above."""

    def __init__(self, shard_count: int, shards: DataFrame | None = None, entries: DataFrame | None = None):
        self.shard_count, self.shards, self.entries = shard_count, shards, entries

    def _of(self, digest):
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(self.shard_count)).cast("int")

    def apply(self, changes: DataFrame) -> Index:
        """The index after changes (digest, keep_id, n): n rows more, or fewer if n is negative.

        Changes are summed inside the tasks that read them, up to TASK_KEYS digests at once, so a digest that occurs in a third of all rows
        arrives as a few rows of each task. In its shard the filter sees every one of them: the first is new, the others are hits, which are
        verified and merged. Shards without a change stay as they are stored.
        """
        # ids go to pandas as text, since whole numbers beside a null would lose digits
        summed = changes.select("digest", F.col("keep_id").cast("string").alias("keep_id"), "n").mapInPandas(_summed, "digest string, keep_id long, n long")
        dealt = settle(summed.withColumn("shard", self._of("digest")).withColumn("kind", F.lit(2)), "cuckoo-changes")
        touched = dealt.select("shard").distinct()
        none = lambda kind: F.lit(None).cast(kind)
        columns = ("shard", "kind", "digest", "keep_id", "n", "buckets", "slots")
        rows = dealt.select(*columns[:5], none("int").alias("buckets"), none("binary").alias("slots"))
        if self.entries is not None:
            held = self.entries.join(touched, "shard", "left_semi").select("shard", F.lit(1).alias("kind"), "digest", "keep_id", "n", none("int").alias("buckets"), none("binary").alias("slots"))
            filters = self.shards.join(touched, "shard", "left_semi").select(
                "shard", F.lit(0).alias("kind"), none("string").alias("digest"), none("long").alias("keep_id"), none("long").alias("n"), "buckets", "slots"
            )
            rows = filters.select(*columns).unionByName(held).unionByName(rows)

        def run(group: pd.DataFrame) -> pd.DataFrame:
            number = int(group["shard"].iloc[0])
            kinds = {k: part for k, part in group.groupby("kind")}
            ids = lambda part: [None if x is None else int(x) for x in part["keep_id"]]
            stored = kinds.get(0)
            old = kinds.get(1)
            base = CuckooFilter(int(stored["buckets"].iloc[0]), stored["slots"].iloc[0]) if stored is not None else None
            shard = Shard(base, zip(old["digest"], ids(old), old["n"].astype(int), strict=True) if old is not None else ())
            new = kinds.get(2)
            if new is not None:
                # rows that come before rows that go, so that what is taken away is there
                for digest, keep, n in sorted(zip(new["digest"], ids(new), new["n"].astype(int), strict=True), key=lambda x: (x[2] < 0, x[0])):
                    if n > 0:
                        shard.add(digest, keep, n)
                    else:
                        shard.remove(digest, -n)
            found = [(number, b, d, e[0], e[1], None, None) for b, bucket in shard.content.items() for d, e in bucket.items()]
            found.append((number, -1, None, None, None, shard.filter.buckets, shard.filter.slots.tobytes()))
            columns = dict(zip(("shard", "bucket", "digest", "keep_id", "n", "buckets", "slots"), zip(*found, strict=True), strict=True))
            whole = {"keep_id": "Int64", "n": "Int64", "buckets": "Int32"}
            return pd.DataFrame({c: pd.array(list(v), whole[c]) if c in whole else pd.Series(v) for c, v in columns.items()})

        built = rows.withColumn("keep_id", F.col("keep_id").cast("string")).groupBy("shard").applyInPandas(run, "shard int, bucket int, digest string, keep_id long, n long, buckets int, slots binary")
        built = settle(built, "cuckoo-index")
        shards, entries = built.filter("digest IS NULL").select("shard", "buckets", "slots"), built.filter("digest IS NOT NULL").select("shard", "bucket", "digest", "keep_id", "n")
        if self.entries is not None:
            shards = shards.unionByName(self.shards.join(touched, "shard", "left_anti"))
            entries = entries.unionByName(self.entries.join(touched, "shard", "left_anti"))
        return Index(self.shard_count, shards, entries)


def normalised_digest(text: str = "text"):
    """Lower-case hex SHA-256 of the text with each run of blanks as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " "), 256)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised_digest().alias("text_sha256"))


def build_index(found: DataFrame, keys_per_shard: int = SHARD_KEYS) -> Index:
    """An index of digests(docs), which should be stored."""
    rows = found.count()
    empty = Index(max(1, -(-rows // keys_per_shard)))
    return empty.apply(found.select(F.col("text_sha256").alias("digest"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs, dropped ones too.

    Equal: identical after blanks are normalised; null and empty texts are equal. The smallest doc_id stays; a null doc_id
    stays only where a group has no other. Rows that repeat the smallest doc_id are all kept, as one document.
    Further columns are not read; a table without rows gives one without rows.
    """
    found = settle(digests(docs), "digests")
    index = build_index(found)
    entries = index.entries.select(F.col("digest").alias("text_sha256"), "keep_id", F.col("n").alias("group_size"))
    return found.join(entries, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
