"""Bounded result sets, load reports and text renderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How much of a result the reading side accepts.
MAX_ROWS, MAX_BYTES = 50, 32_768


def bounded_result(
    df: DataFrame, order: Sequence[Column], max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The leading rows within both caps, each marked with the cap that cut the result
    ('rows', 'bytes' or null). One row more than the cap is fetched to know; the
    window below sees those max_rows + 1 rows and nothing else."""
    head = df.orderBy(*order).limit(max_rows + 1)
    w = W.orderBy(*order)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    measured = (
        head.withColumn("_row", F.row_number().over(w))
        .withColumn("_bytes", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    everything = W.partitionBy(F.lit(1))
    return (
        measured.withColumn("_total", F.count(F.lit(1)).over(everything))
        .withColumn("_fit", F.count_if(F.col("_bytes") <= max_bytes).over(everything))
        .withColumn(
            "truncated_by",
            F.when(F.col("_fit") < F.least(F.col("_total"), F.lit(max_rows)), "bytes").when(
                F.col("_total") > max_rows, "rows"
            ),
        )
        .withColumn("row_count", F.least("_total", "_fit", F.lit(max_rows)))
        .filter((F.col("_row") <= max_rows) & (F.col("_bytes") <= max_bytes))
        .drop("_row", "_bytes", "_total", "_fit")
    )


def load_report(bronze: DataFrame, by: str, file_col: str, total: bool = True) -> DataFrame:
    """Rows and files per table, plus a grand total row, which is_total marks: its name is
    null like that of rows without a table. Rows without a file count as one file."""
    per_file = bronze.groupBy(by, file_col).agg(F.count(F.lit(1)).alias("n"))
    grouped = per_file.rollup(by) if total else per_file.groupBy(by)
    return grouped.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n").alias("rows"),
        (F.grouping(by) == 1 if total else F.lit(False)).alias("is_total"),
    )


def passages_text(chunks: DataFrame) -> DataFrame:
    """Each passage as the block of text a reader is shown."""
    product = F.when(
        F.coalesce(F.col("product_sku"), F.lit("")) != "", F.concat(F.lit(" product "), "product_sku")
    ).otherwise("")
    return chunks.withColumn(
        "passage",
        F.concat(
            F.lit("["), "chunk_id", F.lit("] ticket "), "ticket_id", product,
            F.lit("\n"), F.coalesce("heading", F.lit("None")), F.lit("\n"), "body",
        ),
    )
