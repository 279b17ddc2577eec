"""Keyed tables on disk that a batch changes bucket by bucket.

* rows/bucket=b/write=w: the rows of a bucket as one write left them, sorted by key;
* maps/write=w: for every bucket, the write its rows come from;
* versions/n: a small file that names the map of version n. It is made in one step, and only then is the write seen.

A batch reads and rewrites the buckets its keys fall into. A reader takes one version and keeps it, whatever is written meanwhile. A
write that stops before its version is made leaves folders no map names; `forget` drops them with those of old versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierstone.operators.upsert import upsert
from tierstone.plans.stores import STORES, Store
from tierstone.session import broadcast_bytes, claim, dir_bytes, drop_dir, fresh_path, list_dirs, scratch

BUCKETS = 256  # some 100 MB of rows each is a good size; a table keeps the number it was made with


class Conflict(RuntimeError):
    """Another writer has made the next version first; apply the batch again."""


def _name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[1]


class KeyedStore:
    """One keyed table in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        layout = spark.read.parquet(f"{path}/layout").first()
        self.rule = Store(tuple(layout["keys"]), None if layout["updates"] is None else tuple(layout["updates"]), layout["touch"])
        self.buckets, self.bucket_by = layout["buckets"], tuple(layout["bucket_by"])
        self.schema = T._parse_datatype_json_string(layout["schema"])

    @classmethod
    def create(
        cls, spark: SparkSession, path: str, store: str | Store, schema: T.StructType | str, buckets: int = BUCKETS, bucket_by: Sequence[str] = ()
    ) -> KeyedStore:
        """A table without rows, which is version 0. store: a name of STORES or a rule; bucket_by: some of its keys, by default all."""
        rule = STORES[store] if isinstance(store, str) else store
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        missing = {*rule.keys, *(rule.updates or ()), *([rule.touch] if rule.touch else [])} - set(schema.names)
        if missing:
            raise ValueError(f"the table needs the columns {sorted(missing)}")
        if unknown := set(bucket_by) - set(rule.keys):
            raise ValueError(f"buckets go by keys, which {sorted(unknown)} are not")
        row = (list(rule.keys), None if rule.updates is None else list(rule.updates), rule.touch, buckets, list(bucket_by or rule.keys), schema.json())
        columns = "keys array<string>, updates array<string>, touch string, buckets int, bucket_by array<string>, schema string"
        spark.createDataFrame([row], columns).write.parquet(f"{path}/layout")
        return cls(spark, path)

    def _named(self) -> dict[int, str]:
        """Version -> the write it names, rising; empty where a writer is about to name it or was stopped right there."""
        found = list_dirs(self.spark, f"{self.path}/versions/*")
        if not found:
            return {}
        texts = self.spark.read.text(found, wholetext=True).select(F.col("_metadata.file_name").alias("n"), "value").collect()
        return dict(sorted(({int(_name(p)): "" for p in found} | {int(r["n"]): r["value"] or "" for r in texts}).items()))

    def versions(self) -> dict[int, str]:
        """Version -> the write it names, rising."""
        return {n: write for n, write in self._named().items() if write}

    def _map(self, write: str | None) -> dict[int, str]:
        if write is None:
            return {}
        return {r["bucket"]: r["write"] for r in self.spark.read.parquet(f"{self.path}/maps/write={write}").collect()}  # a row for each bucket

    def _rows(self, parts: dict[int, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/bucket={b}/write={w}" for b, w in sorted(parts.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of the one asked for."""
        known = self.versions()
        if version is None:
            return self._rows(self._map(known[max(known)] if known else None))
        if version and version not in known:
            raise ValueError(f"there is no version {version}")
        return self._rows(self._map(known.get(version)))

    def near(self, rows: DataFrame) -> DataFrame:
        """The newest version of the buckets that `rows` (with the columns of bucket_by) fall into; other buckets are not read."""
        known = self.versions()
        parts = self._map(known[max(known)] if known else None)
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
        return self._rows({b: parts[b] for b in touched if b in parts})

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, order_col: str | None = None, now: Column | None = None) -> int:
        """Insert or update by the table's rule; the number of the version this makes."""
        known = self._named()
        last = max(known, default=0)
        if last and not known[last]:
            raise Conflict(f"version {last} of {self.path} is being made, or its writer was stopped and forget() has to clear it")
        before, version, write = self._map(known.get(last)), last + 1, uuid.uuid4().hex
        with scratch(self.spark):
            path = fresh_path(self.spark, "batch")
            batch.write.parquet(path)
            fresh = self.spark.read.schema(batch.schema).parquet(path)
            large = dir_bytes(self.spark, path) > broadcast_bytes(self.spark)
            touched = [r[0] for r in fresh.select(self._bucket()).distinct().collect()]  # at most as many as there are buckets
            target = self._rows({b: before[b] for b in touched if b in before})
            after = upsert(target, fresh, self.rule.keys, self.rule.updates, order_col, self.rule.touch, now, large)
            placed = after.withColumns({"bucket": self._bucket(), "write": F.lit(write)})
            # the sort names both folder columns, or the write would sort again and lose the order of the keys
            placed.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "write", *self.rule.keys).write.mode("append").partitionBy("bucket", "write").parquet(
                f"{self.path}/rows"
            )
        new = before | dict.fromkeys(touched, write)
        self.spark.createDataFrame(sorted(new.items()), "bucket int, write string").coalesce(1).write.parquet(f"{self.path}/maps/write={write}")
        if not claim(self.spark, f"{self.path}/versions/{version}", write):
            raise Conflict(f"version {version} of {self.path} is taken")
        return version

    def forget(self, keep: int = 2) -> int:
        """Drop what none of the last `keep` versions needs; how many folders went. Not while a write is under way."""
        known = self.versions()
        kept = dict(list(known.items())[-keep:])
        needed = {(b, w) for write in kept.values() for b, w in self._map(write).items()}
        gone = [p for p in list_dirs(self.spark, f"{self.path}/versions/*") if int(_name(p)) not in kept]
        gone += [p for p in list_dirs(self.spark, f"{self.path}/maps/write=*") if _name(p).split("=", 1)[1] not in kept.values()]
        for p in list_dirs(self.spark, f"{self.path}/rows/bucket=*/write=*"):
            bucket, write = (x.split("=", 1)[1] for x in p.rstrip("/").split("/")[-2:])
            if (int(bucket), write) not in needed:
                gone.append(p)
        for p in gone:
            drop_dir(self.spark, p)
        return len(gone)
