"""The landing layer: all-text tables, replaced source by source."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierstone.operators.ranking import HOT_ROWS, ordinal
from tierstone.session import PACKED, drop_dir, escaped, scratch, settle
from tierstone.sources.files import listing, read_csv_text, read_json_doc, read_json_text

# The lineage columns every landed row carries.
LOADED_AT, SOURCE, RUN = "_loaded_at", "_source_file", "_ingest_run_id"
LINEAGE = (LOADED_AT, SOURCE, RUN)
SIDE_BY_SIDE = 8


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: nested values as JSON, the rest by cast."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(F.parse_json(F.to_json(f"`{f.name}`"))).alias(f.name)
            if isinstance(f.dataType, nested)
            else F.col(f"`{f.name}`").cast("string").alias(f.name)
            for f in sorted(df.schema, key=lambda f: f.name)
        ]
    )


def load_bronze(
    df: DataFrame, table_dir: str, source: str | Column, run_id: str, now: str | None = None, mixed: bool = False,
    replace_empty: bool = False, packed: bool = False,
) -> int:
    """Land df under its source label(s) and return the number of rows written.

    Labels are partitions and only the written ones are replaced, so a stable label
    replaces itself, a new one appends, and an empty batch changes nothing, unless
    replace_empty says that it empties its label, which must then be a text. Rows go
    straight from the reading task to its files. Set mixed where the labels of a
    column lie mixed in the input: the rows are then rebalanced by label, and AQE
    splits the files of a label with most of the rows and merges the tiny ones. packed is for large tables (see PACKED).
    """
    if replace_empty and not isinstance(source, str):
        raise ValueError("an empty batch has no labels of a column to empty")
    reserved = sorted(set(df.columns) & set(LINEAGE))
    if reserved:
        raise ValueError(f"payload uses reserved lineage columns: {reserved}")
    label = F.lit(source) if isinstance(source, str) else source.cast("string")
    stamp = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    seen = Observation()
    rows = as_text(df.withColumn(SOURCE, label)).withColumn(LOADED_AT, stamp).withColumn(RUN, F.lit(run_id))
    if mixed:
        rows = rows.hint("rebalance", F.col(SOURCE))
    writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.option("compression", PACKED) if packed else writer).partitionBy(SOURCE).parquet(table_dir)
    written = seen.get["rows"]
    if replace_empty and not written:
        drop_dir(df.sparkSession, f"{table_dir}/{SOURCE}={escaped(df.sparkSession, source)}")
    return written


def read_bronze(spark: SparkSession, table_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A landed table; a column first seen in a later source is null in the others.

    With the wanted columns given no file is opened to learn the schema: all landed
    columns are text. Without them the schemas of all files are merged.
    """
    if columns is None:
        return spark.read.option("mergeSchema", True).parquet(table_dir)
    fields = [T.StructField(c, T.StringType()) for c in columns if c not in LINEAGE]
    lineage = [
        T.StructField(LOADED_AT, T.TimestampType()),
        T.StructField(RUN, T.StringType()),
        T.StructField(SOURCE, T.StringType()),
    ]
    return spark.read.schema(T.StructType(fields + lineage)).parquet(table_dir)


def current(landed: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The rows that hold the newest version of each key of a landed table: by the version
    column where there is one, then by load. Rows that repeat a key within that
    version and load all stay, as do rows without a key, for the checks to see.
    """
    newest = [F.col(c).desc_nulls_last() for c in ([version] if version else []) + [LOADED_AT, SOURCE]]
    keyed = landed.filter(F.col(key).isNotNull()).withColumn("_version", F.rank().over(W.partitionBy(key).orderBy(*newest)))
    return keyed.filter("_version = 1").drop("_version").unionByName(landed.filter(F.col(key).isNull()))


def land_csv_folder(spark: SparkSession, pattern: str, bronze: str, prefix: str, run_id: str) -> dict[str, int]:
    """One table per CSV file, named prefix__<file stem>. Small files are landed side by side, SIDE_BY_SIDE jobs at a time."""
    files = listing(spark, pattern).collect()  # one row per file of a curated folder

    def land(f) -> tuple[str, int]:
        table = f"{prefix}__{f['name']}"
        return table, load_bronze(read_csv_text(spark, f["path"]), f"{bronze}/{table}", f["file"], run_id)

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return dict(pool.map(land, files))


def land_json_pages(spark: SparkSession, pattern: str, table_dir: str, run_id: str, keys: Sequence[str]) -> int:
    """All pages of one object in a single job; each page is its own source label."""
    listing(spark, pattern)
    return load_bronze(read_json_text(spark, pattern, keys), table_dir, F.col("_metadata.file_name"), run_id)


def flatten_children(df: DataFrame, array_col: str, key_cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(parents without the array, one row per element carrying the parent keys).

    A key the element already has is taken from the element.
    """
    element = df.schema[array_col].dataType.elementType
    own = {f.name for f in element.fields}
    children = df.select(*key_cols, F.explode(array_col).alias("_element")).select(
        *[k for k in key_cols if k not in own], "_element.*"
    )
    return df.drop(array_col), children


def unwrap_envelope(df: DataFrame, payload: str = "data.object") -> DataFrame:
    """{id, type, created, payload} to event_id, event_type, event_created plus the
    payload's own fields, which win where the names meet."""
    inner = df.select(F.col(payload).alias("_p")).schema["_p"].dataType
    own = {f.name for f in inner.fields}
    envelope = {"event_id": "id", "event_type": "type", "event_created": "created"}
    return df.select(
        *[F.col(src).alias(out) for out, src in envelope.items() if out not in own],
        F.col(f"{payload}.*"),
    )


def nest_children(
    parent: DataFrame,
    child: DataFrame,
    key: str,
    order: Sequence[str],
    slice_by: Column,
    name: str = "children",
    segment_rows: int = 10_000,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Parents with their ordered children attached; an empty array where none.

    A list is cut into segments of at most segment_rows children, numbered from 0,
    so a parent holding a third of all children becomes many bounded rows and never
    one unbounded one; up to that size there is exactly one row per parent.
    """
    fields = [c for c in child.columns if c != key]
    numbered = ordinal(child, [key], [F.col(c).asc_nulls_first() for c in order], slice_by, "_n", hot_rows)
    lists = (
        numbered.withColumn("segment", F.floor((F.col("_n") - 1) / F.lit(segment_rows)).cast("int"))
        .groupBy(key, "segment")
        .agg(F.array_sort(F.collect_list(F.struct("_n", *fields))).alias("_list"))
        .withColumn(name, F.transform("_list", lambda c: F.struct(*[c[f].alias(f) for f in fields])))
        .drop("_list")
    )
    # inner plus anti instead of one left join, which could not split the many segments
    # of one parent
    with_lists = parent.join(lists, key)
    without = parent.join(child.select(key), key, "left_anti").select(
        "*", F.lit(0).alias("segment"), F.array().cast(lists.schema[name].dataType).alias(name)
    )
    return with_lists.unionByName(without)


def land_tickets(
    spark: SparkSession, pattern: str, tickets_dir: str, comments_dir: str, run_id: str,
    schema: T.StructType | str | None = None, cursor: str | None = None, now: str | None = None,
) -> dict:
    """Ticket documents into a ticket and a comment table; returns the rows of both and
    the next cursor, which the caller keeps only now that both are stored.

    A cursor takes the tickets updated after it and adds them under a label of its own, so
    an updated ticket lands again; `current` picks the versions that count. A document
    is read by one task, so a large export should come as many files; it is parsed once.
    """
    with scratch(spark):  # the parsed documents go once they are landed
        documents = settle(read_json_doc(spark, pattern, schema).select("tickets", "next_cursor"), "ticket-documents", packed=True)
        tickets = documents.select(F.inline("tickets"))
        label = "tickets.json"
        if cursor is not None:
            tickets, label = tickets.filter(F.col("updated_at") > F.lit(cursor)), f"{label}:{cursor}"
        parents, comments = flatten_children(tickets, "comments", ["ticket_id"])
        # comments first: a retry after a failure between the two replaces them
        loaded = {
            "comments": load_bronze(comments, comments_dir, f"{label}:comments", run_id, now, packed=True),
            "tickets": load_bronze(parents, tickets_dir, label, run_id, now, packed=True),
        }
        return loaded | {"next_cursor": documents.agg(F.max("next_cursor")).first()[0]}


def land_events(
    spark: SparkSession, pattern: str, source: str, table_dir: str, run_id: str,
    schema: T.StructType | str | None = None, now: str | None = None,
) -> dict:
    """Files of event envelopes into one table under one label; returns the rows and
    the distinct event types in order."""
    rows = load_bronze(unwrap_envelope(read_json_doc(spark, pattern, schema)), table_dir, source, run_id, now)
    if not rows:
        return {"rows": 0, "event_types": []}
    # one column of what was landed; the documents are not parsed again
    landed = read_bronze(spark, table_dir, ["event_type"]).filter(F.col(SOURCE) == source)
    types = landed.select("event_type").distinct().orderBy("event_type")  # a small vocabulary
    return {"rows": rows, "event_types": [r[0] for r in types.collect()]}
