"""Span files as a stream into a store of spans and agent runs, with work bounded by the batch.

Three tables are cut into buckets by the hash of the trace and into pieces by the batches they hold, in folders
table/depth=d/bucket=b/first=i/last=j:

* spans: the spans as they came, sorted by trace;
* traces: the traces of each piece, which tells the pieces a batch has to read from those it has not;
* runs: the runs of every touched trace as of a batch. Versions are appended, and that of a trace's newest batch counts.

A bucket is the low `depth` bits of the hash. Depth grows with the number of traces, so a bucket holds a bounded number of them; what was
written at a smaller depth stays where it is and is found there. `compact` merges small neighbouring pieces. A piece whose batches lie inside
another's is dead, so a merge counts from the moment its folder appears and its sources can be dropped at any later time.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tierstone.operators.agent_runs import agent_runs
from tierstone.plans.stores import apply
from tierstone.session import dir_bytes, drop_dir, list_dirs, scratch, settle
from tierstone.sources.otlp import flatten_spans

DEPTH = 6  # a new store has 2^6 buckets
BUCKET_TRACES = 100_000  # traces a bucket is planned for: with more of them in the store, new batches use more buckets
LISTED = 10_000  # buckets of one depth that a batch names one by one; a batch that touches more reads all pieces of the depth
PIECES = 8  # small neighbouring pieces a bucket may have before they are merged
SEALED_BYTES = 256 << 20  # pieces of this size are not merged any more


@dataclass(frozen=True, order=True)
class Piece:
    depth: int
    bucket: int
    first: int
    last: int
    path: str

    def inside(self, other: Piece) -> bool:
        return self != other and other.first <= self.first and self.last <= other.last

    def meets(self, first: int, last: int) -> bool:
        return self.first <= last and first <= self.last


def _piece(path: str) -> Piece:
    return Piece(*(int(part.rsplit("=", 1)[1]) for part in path.rstrip("/").split("/")[-4:]), path)


def _live(pieces: Iterable[Piece]) -> list[Piece]:
    by_bucket = defaultdict(list)
    for p in pieces:
        by_bucket[p.depth, p.bucket].append(p)
    return sorted(p for group in by_bucket.values() for p in group if not any(p.inside(o) for o in group))


def _depths(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(d.rsplit("=", 1)[1]) for d in list_dirs(spark, f"{path}/depth=*"))


def pieces(spark: SparkSession, path: str, depth: int | None = None, buckets: Sequence[int] | None = None) -> list[Piece]:
    """The live pieces of a table, or of some buckets of one depth; other folders are not listed."""
    if depth is None:
        return [p for d in _depths(spark, path) for p in pieces(spark, path, d)]
    if buckets is None:
        globs = ["*"]
    else:
        globs = ["{%s}" % ",".join(map(str, buckets[i : i + 500])) for i in range(0, len(buckets), 500)]
    return _live(_piece(p) for g in globs for p in list_dirs(spark, f"{path}/depth={depth}/bucket={g}/first=*/last=*"))


def read_pieces(spark: SparkSession, found: Sequence[Piece]) -> DataFrame:
    return spark.read.parquet(*[p.path for p in found])


def _bucket(depth: int) -> Column:
    return F.col("hash").bitwiseAND(F.lit((1 << depth) - 1)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    """Rows with depth, bucket, first and last, a folder for each; a retry replaces what it wrote."""
    (
        rows.hint("rebalance", F.col("bucket"))
        .sortWithinPartitions("bucket", "hash")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("depth", "bucket", "first", "last")
        .parquet(path)
    )


def _placed(rows: DataFrame, batch_id: int, depth: int) -> DataFrame:
    batch = F.lit(batch_id).cast("int")
    return rows.withColumns({"batch": batch, "depth": F.lit(depth), "bucket": _bucket(depth), "first": batch, "last": batch})


def touched_pieces(spark: SparkSession, store: str, traces: DataFrame, before: int) -> tuple[dict[str, list[Piece]], DataFrame | None]:
    """The pieces of spans and of runs that hold some of the traces (hash), and those of the traces that are known at all.

    Only batches below `before` count. The index is read in the touched buckets alone.
    """
    found: dict[str, list[Piece]] = {"spans": [], "runs": []}
    known = None
    for depth in _depths(spark, f"{store}/traces"):
        buckets = [r[0] for r in traces.select(_bucket(depth)).distinct().limit(LISTED + 1).collect()]
        asked = None if len(buckets) > LISTED else buckets
        index = [p for p in pieces(spark, f"{store}/traces", depth, asked) if p.first < before]
        if not index:
            continue
        rows = settle(read_pieces(spark, index).join(traces.select("hash"), "hash", "left_semi"), "known-traces")
        # no more rows than the index has pieces
        hits = rows.select(_bucket(depth).alias("bucket"), "since", "batch").distinct().collect()
        intervals = defaultdict(list)
        for r in hits:
            intervals[r["bucket"]].append((r["since"], r["batch"]))
        for table in found:
            of_table = pieces(spark, f"{store}/{table}", depth, sorted(intervals)) if intervals else []
            found[table] += [p for p in of_table if p.first < before and any(p.meets(*i) for i in intervals[p.bucket])]
        known = rows.select("hash") if known is None else known.union(rows.select("hash"))
    return found, known


def _newest(runs: DataFrame) -> DataFrame:
    """The runs of each trace's newest version."""
    newest = F.max("batch").over(Window.partitionBy("trace_id"))
    return runs.withColumn("_newest", newest).filter("batch = _newest").drop("_newest")


def stored_spans(spark: SparkSession, store: str) -> DataFrame:
    return read_pieces(spark, pieces(spark, f"{store}/spans")).drop("hash", "batch")


def stored_runs(spark: SparkSession, store: str) -> DataFrame:
    return _newest(read_pieces(spark, pieces(spark, f"{store}/runs"))).drop("hash", "batch")


def batches(spark: SparkSession, store: str) -> DataFrame:
    """(depth, traces, spans, pieces_read, total_traces, batch): a row for each batch of the stream; pieces of spans, that is."""
    return spark.read.parquet(f"{store}/batches").withColumn("batch", F.col("batch").cast("long"))


def _last_state(spark: SparkSession, store: str, before: int) -> tuple[int, int]:
    """(depth, total_traces) after the last batch below `before`."""
    done = [b for d in list_dirs(spark, f"{store}/batches/batch=*") if (b := int(d.rsplit("=", 1)[1])) < before]
    if not done:
        return 0, 0
    row = spark.read.parquet(f"{store}/batches/batch={max(done)}").first()
    return row["depth"], row["total_traces"]


def _absorb(batch: DataFrame, batch_id: int, store: str, start: int, bucket_traces: int) -> None:
    spark = batch.sparkSession
    fresh = settle(batch.withColumn("hash", F.xxhash64("trace_id")), "span-batch")
    if fresh.isEmpty():
        return
    traces = settle(fresh.groupBy("hash", "trace_id").agg(F.count(F.lit(1)).alias("spans")), "batch-traces")
    held, known = touched_pieces(spark, store, traces, batch_id)
    old_depth, total = _last_state(spark, store, batch_id)
    n = traces.agg(F.count(F.lit(1)).alias("traces"), F.sum("spans").alias("spans")).first()
    total += n["traces"] - (0 if known is None else known.distinct().count())
    depth = max(start, old_depth, math.ceil(math.log2(max(1, total / bucket_traces))))

    _write(_placed(fresh, batch_id, depth), f"{store}/spans")
    index = traces.select("hash", F.lit(batch_id).cast("int").alias("since")).distinct()
    _write(_placed(index, batch_id, depth), f"{store}/traces")
    # A parent may arrive after its children: resolve the touched traces over all that is
    # stored for them, not over this batch alone.
    everything = fresh
    if held["spans"]:
        earlier = read_pieces(spark, held["spans"]).join(traces.select("trace_id"), "trace_id", "left_semi")
        everything = fresh.unionByName(earlier.drop("batch"))
    runs = agent_runs(everything.drop("hash", "batch")).withColumn("ingested_at", F.current_timestamp())
    if held["runs"]:
        older = read_pieces(spark, held["runs"]).filter(F.col("batch") < batch_id).join(traces.select("trace_id"), "trace_id", "left_semi")
        runs = apply("trace_spans", settle(_newest(older).drop("hash", "batch"), "older-runs"), settle(runs, "batch-runs"))
    _write(_placed(runs.withColumn("hash", F.xxhash64("trace_id")), batch_id, depth), f"{store}/runs")
    state = [(depth, n["traces"], n["spans"], len(held["spans"]), total)]
    columns = "depth int, traces long, spans long, pieces_read int, total_traces long"
    spark.createDataFrame(state, columns).write.mode("overwrite").parquet(f"{store}/batches/batch={batch_id}")


def _small_neighbours(spark: SparkSession, found: list[Piece], most: int, sealed_bytes: int) -> list[list[Piece]]:
    """Stretches of more than `most` neighbouring pieces of one bucket, all below the size."""
    out: list[list[Piece]] = []
    last = None
    for p in found:
        if dir_bytes(spark, p.path) >= sealed_bytes:
            last = None
        elif last is not None and (p.depth, p.bucket) == (last.depth, last.bucket):
            out[-1].append(p)
            last = p
        else:
            out.append([p])
            last = p
    return [stretch for stretch in out if len(stretch) > most]


def _drop_dead(spark: SparkSession, path: str, depth: int) -> int:
    found = [_piece(p) for p in list_dirs(spark, f"{path}/depth={depth}/bucket=*/first=*/last=*")]
    live = set(_live(found))
    for p in found:
        if p not in live:
            drop_dir(spark, p.path)
    return len(found) - len(live)


def compact(spark: SparkSession, store: str, most: int = PIECES, sealed_bytes: int = SEALED_BYTES) -> int:
    """Merge small neighbouring pieces and drop what they replace; how many pieces went.

    Run it while no batch runs and nothing reads the store. A compaction that is stopped at any place loses nothing: what
    it had not finished is done by the next one.
    """
    gone = 0
    for table in ("spans", "runs", "traces"):
        path = f"{store}/{table}"
        for depth in _depths(spark, path):
            stretches = _small_neighbours(spark, pieces(spark, path, depth), most, sealed_bytes)
            if stretches:
                # a row for each stretch; a bucket has several where a sealed piece lies between
                whole = spark.createDataFrame([(s[0].bucket, s[0].first, s[-1].last) for s in stretches], "bucket int, first int, last int")
                rows = read_pieces(spark, [p for s in stretches for p in s]).withColumns({"depth": F.lit(depth), "bucket": _bucket(depth)})
                rows = rows.join(F.broadcast(whole), "bucket").filter(F.col("batch").between(F.col("first"), F.col("last")))
                if table == "runs":
                    rows = _newest(rows)
                if table == "traces":
                    rows = rows.withColumns({"since": F.col("first"), "batch": F.col("last")}).distinct()
                _write(rows, path)
            gone += _drop_dead(spark, path, depth)
    return gone


def stream_spans(
    spark: SparkSession,
    in_dir: str,
    store: str,
    checkpoint: str,
    depth: int = DEPTH,
    files_per_batch: int | None = None,
    bucket_traces: int = BUCKET_TRACES,
) -> StreamingQuery:
    """Take up new files of JSON lines, then stop. The checkpoint remembers the files
    already taken, and is advanced only after a batch has been stored."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    spans = flatten_spans(reader.text(in_dir))

    def absorb(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            _absorb(batch, batch_id, store, depth, bucket_traces)

    return (
        spans.writeStream.foreachBatch(absorb)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
