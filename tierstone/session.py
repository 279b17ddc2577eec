"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on. Cluster sizing (shuffle partitions,
# executor memory, broadcast threshold) is left to whoever submits the job.
RUNTIME_SETTINGS = {
    # timestamp -> date casts depend on the session zone
    "spark.sql.session.timeZone": "UTC",
    # repeated span attributes: the later value counts
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # source labels such as "2026-03" must stay text when they are partition values
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more exchange afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # the vector search and embedder exchange Arrow batches of this many rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tierstone", **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    threads = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(threads))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        # building a plan otherwise looks up the Python call site of every column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


_own_folder: str | None = None
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir.

    Only a local master may fall back to a folder of this machine.
    """
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tierstone-")
    return _own_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier call has returned."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratch.get() is not None:
        _scratch.get().append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop what was written to fresh paths inside the block once its results are
    stored elsewhere. Without it such tables stay for the frames that read them."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            drop_dir(spark, path)
        _scratch.reset(token)


# for whole tables that lie on disk side by side: fewer bytes than the default for some more CPU time
PACKED = "zstd"


def settle(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The written files outlive any executor, carry column pruning and give the
    optimizer real sizes, none of which a cached or RDD-checkpointed copy does.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df.write.option("compression", PACKED) if packed else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of each query inside the block when it ends. Otherwise they stay until the driver happens to
    collect its garbage, so those of a long row of written tables add up. A frame that runs twice shuffles twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Exchange smaller Arrow batches with Python in the jobs inside the block, where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_dirs(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, on whichever file system the path names."""
    files, where = _folder(spark, pattern)
    return [str(s.getPath().toString()) for s in files.globStatus(where) or []]


def escaped(spark: SparkSession, value: str) -> str:
    """A partition value as it stands in a folder name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def drop_dir(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def dir_bytes(spark: SparkSession, path: str) -> int:
    files, where = _folder(spark, path)
    return files.getContentSummary(where).getLength()


def broadcast_bytes(spark: SparkSession) -> int:
    """The size up to which Spark broadcasts one side of a join."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text) if not text.startswith("-") else -1


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file; False if another writer has made it already."""
    files, where = _folder(spark, path)
    try:
        out = files.create(where, False)
    except Exception as error:
        if files.exists(where):
            return False
        raise error
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
