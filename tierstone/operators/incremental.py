"""High-water loads over landed text columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.sources.bronze import SOURCE, as_text, load_bronze, read_bronze


def high_water(spark: SparkSession, table_dir: str, column: str) -> str | None:
    """The largest value landed so far; None when the table is not there yet. ISO-8601
    UTC text sorts like the time it names."""
    try:
        return read_bronze(spark, table_dir, [column]).agg(F.max(column)).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newer_than(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Strictly newer rows; all rows on the first run."""
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def late(df: DataFrame, column: str, mark: str | None, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows a high-water load leaves behind: at or before the mark and never landed."""
    if mark is None:
        return df.limit(0)
    return df.filter(F.col(column) <= F.lit(mark)).join(known.select(*keys), list(keys), "left_anti")


def children_of(child: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return child.join(parents.select(key), key, "left_semi")


def _landed(spark: SparkSession, table_dir: str, columns: Sequence[str], but: str | None = None) -> DataFrame | None:
    """The columns of a landed table without the rows of one label; None when it is not there yet."""
    try:
        rows = read_bronze(spark, table_dir, columns)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return (rows if but is None else rows.filter(F.col(SOURCE) != but)).select(*columns)


def _missing(df: DataFrame, *tables: DataFrame | None) -> DataFrame:
    """Rows of df that none of the tables has, nulls compared as values. A row moves once, as the key it is joined by."""
    known = [t for t in tables if t is not None]
    if not known:
        return df
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    there = reduce(DataFrame.unionAll, [t.select(row.alias("_known")) for t in known])
    return df.select(row.alias("_row")).join(there, F.col("_row") == F.col("_known"), "left_anti").select("_row.*")


def load_since(
    spark: SparkSession,
    bronze: str,
    parent: tuple[str, DataFrame, str],
    children: dict[str, DataFrame],
    key: str,
    run_id: str,
    now: str | None = None,
) -> dict[str, int]:
    """One incremental load of a parent (table, rows, time column) and its children.

    Children go first and the parent last: the mark moves only once everything below
    it has landed, and a retry writes the same labels and so replaces itself.

    What the load leaves behind lands in a table of its own, <name>__late: parents at or
    before the mark that never landed, and children of no parent of this load that
    never landed (a child is known by all its columns). Rows already there under an
    earlier mark are not repeated.
    """
    table, rows, column = parent
    mark = high_water(spark, f"{bronze}/{table}", column)
    fresh = newer_than(rows, column, mark)
    label = f"{table}:{mark}"
    behind = {table: (as_text(late(rows, column, mark, _landed(spark, f"{bronze}/{table}", [key]), [key]) if mark else rows.limit(0)), None)}
    for name, df in children.items():
        known = _landed(spark, f"{bronze}/{name}", df.columns)
        behind[name] = as_text(df.join(fresh.select(key), key, "left_anti")), known
    side = {}
    for name, (df, known) in behind.items():
        # what has landed and what came late before are looked up in one join
        earlier = _landed(spark, f"{bronze}/{name}__late", df.columns, but=label)
        side[f"{name}__late"] = load_bronze(_missing(df, known, earlier), f"{bronze}/{name}__late", label, run_id, now)
    loaded = {
        name: load_bronze(children_of(df, fresh, key), f"{bronze}/{name}", f"{name}:{mark}", run_id, now)
        for name, df in children.items()
    }
    loaded[table] = load_bronze(fresh, f"{bronze}/{table}", f"{table}:{mark}", run_id, now)
    return loaded | side
