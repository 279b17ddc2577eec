"""Proof that files are the ones a manifest lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """file name and SHA-256 of each file; every file is hashed where it is read."""
    return (
        spark.read.format("binaryFile")
        .load(pattern)
        .select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    )


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `<sha256>  <relative path>`."""
    line = r"^([0-9a-f]{64})\s+\*?(\S.*)$"
    return (
        spark.read.text(path)
        .select(F.regexp_extract("value", line, 1).alias("sha256"), F.regexp_extract("value", line, 2).alias("listed"))
        .filter("sha256 != ''")
        .select(F.substring_index("listed", "/", -1).alias("file"), "sha256")
    )


def manifest_failures(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files that are absent or differ."""
    return manifest.join(hashes, ["file", "sha256"], "left_anti")
