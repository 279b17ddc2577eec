"""Semi, anti and containment lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(df: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """Rows whose key is in the one-column value list; an empty list gives no rows."""
    wanted = values.select(F.col(values.columns[0]).alias(key))
    return df.join(wanted, key, "left_semi")


def match(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys are known, rows whose keys are not); a null key is not known."""
    seen = known.select(*keys)
    return df.join(seen, list(keys), "left_semi"), df.join(seen, list(keys), "left_anti")


def changed(df: DataFrame, known: DataFrame, key: str, hash_col: str) -> DataFrame:
    """Rows that are new or whose hash differs from the stored one."""
    return df.join(known.select(key, hash_col), [key, hash_col], "left_anti")


def missing(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Requested keys that were not found, once each."""
    return requested.select(key).distinct().join(found.select(key), key, "left_anti")


def contained(entities: DataFrame, key: str, texts: DataFrame, text_col: str) -> DataFrame:
    """Entities whose key occurs inside at least one of the texts.

    An equality join in place of a row-by-row containment test: every text is cut
    into its substrings of the lengths that occur among the keys, and those are
    deduplicated before they meet the keys. Work is linear in text length times the
    number of distinct key lengths, and a text repeated many times counts once.
    """
    sizes = entities.select(F.length(key).alias("n")).filter("n > 0").distinct()
    lengths = sizes.agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    spread = texts.select(F.col(text_col).alias("_text")).filter("_text is not null").distinct()
    # the one-row list of distinct lengths reaches the texts as a scalar subquery
    lengths_value = lengths.scalar()
    pieces = (
        spread.withColumn("_n", F.explode(lengths_value))
        .filter(F.length("_text") >= F.col("_n"))
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1)))
        .select(F.substring("_text", F.col("_at"), F.col("_n")).alias(key))
        .distinct()
    )
    return entities.join(pieces, key, "left_semi")


def named_by_file(entities: DataFrame, key: str, paths: DataFrame, path_col: str) -> DataFrame:
    """Entities whose key is the name of at least one of the files, without folders and without the extension."""
    stem = F.regexp_extract(F.col(path_col), r"([^/]+?)(\.[^./]*)?$", 1)
    return entities.join(paths.select(stem.alias(key)).distinct(), key, "left_semi")
