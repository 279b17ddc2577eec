"""Column profiles of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.operators.ranking import top_n

# Fixed value: characters kept of the list of most common values.
VALUES_CHARS = 500


def with_docs(df: DataFrame, docs: dict[str, str]) -> DataFrame:
    """Attach column comments, which parquet keeps and the profile reads back."""
    return df.select(
        *[F.col(c).alias(c, metadata={"comment": docs[c]}) if c in docs else F.col(c) for c in df.columns]
    )


def described(df: DataFrame, table: str) -> list:
    rows = []
    for position, f in enumerate(df.schema, start=1):
        rows.append(
            (
                F.lit(table).alias("table_name"),
                F.lit(f.name).alias("column_name"),
                F.lit(position).alias("ordinal_position"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("is_nullable"),
                F.lit(f.metadata.get("comment")).cast("string").alias("column_description"),
            )
        )
    return rows


def profile_columns(df: DataFrame, table: str, top_k: int = 10) -> DataFrame:
    """One row per column: type, comment, row count, null fraction, estimated distinct
    values and the most common ones.

    A single aggregate over a single scan: counts and sketches merge map-side, so the
    shuffle carries one row per task whatever the size of the table.
    """
    measures = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`").cast("string")
        measures += [
            F.count(value).alias(f"_filled{i}"),
            F.approx_count_distinct(value).alias(f"_distinct{i}"),
            F.expr(f"approx_top_k(cast(`{c}` as string), {top_k})").alias(f"_top{i}"),
        ]
    found = df.agg(*measures)
    rows = []
    for i, about in enumerate(described(df, table)):
        filled, total = F.col(f"_filled{i}"), F.col("_rows")
        common = F.transform(
            F.filter(F.col(f"_top{i}"), lambda t: t["item"].isNotNull()), lambda t: t["item"]
        )
        rows.append(
            F.struct(
                *about,
                total.alias("row_count"),
                F.when(total > 0, (total - filled) / total).alias("null_fraction"),
                F.col(f"_distinct{i}").alias("n_distinct"),
                F.when(filled > 0, F.col(f"_distinct{i}") / filled).alias("distinct_ratio"),
                F.left(F.array_join(common, ","), F.lit(VALUES_CHARS)).alias("most_common_values"),
            )
        )
    return found.select(F.inline(F.array(*rows)))


def profile_columns_exact(df: DataFrame, table: str, top_k: int = 10) -> DataFrame:
    """The same profile with exact counts: every value is counted once per column with
    map-side combining, so a value shared by most rows is one record per task. Costs a
    shuffle of the distinct values; profile_columns does not."""
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ordinal_position"), F.col(f"`{c}`").cast("string").alias("value"))
                    for i, c in enumerate(df.columns, start=1)
                ]
            )
        )
    )
    counted = cells.groupBy("ordinal_position", "value").agg(F.count(F.lit(1)).alias("n"))
    measures = counted.groupBy("ordinal_position").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("n_distinct"),
    )
    common = (
        top_n(
            counted.filter("value is not null"),
            ["ordinal_position"],
            [F.col("n").desc(), F.col("value").asc()],
            top_k,
            "place",
        )
        .groupBy("ordinal_position")
        .agg(
            F.left(
                F.array_join(
                    F.transform(
                        F.array_sort(F.collect_list(F.struct("place", "value"))), lambda t: t["value"]
                    ),
                    ",",
                ),
                F.lit(VALUES_CHARS),
            ).alias("most_common_values")
        )
    )
    names = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(*d) for d in described(df, table)]))
    )
    return (
        names.join(measures, "ordinal_position", "left")
        .join(common, "ordinal_position", "left")
        .withColumn("null_fraction", F.when(F.col("row_count") > 0, F.col("nulls") / F.col("row_count")))
        .withColumn(
            "distinct_ratio",
            F.when(F.col("row_count") > F.col("nulls"), F.col("n_distinct") / (F.col("row_count") - F.col("nulls"))),
        )
        .drop("nulls")
    )


def profile_layer(tables: dict[str, DataFrame], top_k: int = 10) -> DataFrame:
    """The profiles of several tables in one frame, one scan per table."""
    return reduce(DataFrame.unionAll, [profile_columns(df, name, top_k) for name, df in tables.items()])


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_count, row_count; all tables are counted by one job."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), F.lit(len(df.columns)).alias("column_count"), "row_count")
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionAll, counted)
