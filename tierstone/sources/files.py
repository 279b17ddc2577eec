"""Reading raw payload files as text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, pattern: str, name_pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Files matching a glob as (path, file, name), sorted; none found is an error.

    Only the directory is listed: the content column is never selected. The name is
    the first group of name_pattern, by default the file name without its ending.
    """
    found = (
        spark.read.format("binaryFile")
        .load(pattern)
        .select(
            "path",
            F.substring_index("path", "/", -1).alias("file"),
            F.regexp_extract("path", name_pattern, 1).alias("name"),
        )
        .orderBy("path")
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no files match {pattern}")
    return found


def read_csv_text(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False
) -> DataFrame:
    """CSV with a header as string columns; an empty cell is '' and not null.

    Line-wise reading keeps big files splittable; pass multi_line=True where quoted
    cells contain line breaks. A line with another number of cells than the header, or a
    file whose header differs from the first one's, fails the job.
    """
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("escape", '"')
        .option("emptyValue", "")
        .option("multiLine", multi_line)
        .csv(paths)
        .na.fill("")
    )


def _string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def sorted_json(text: Column) -> Column:
    """JSON text with the keys of every object in order, without spaces."""
    return F.to_json(F.parse_json(text))


def read_json_text(
    spark: SparkSession, paths: str | Sequence[str], keys: Sequence[str] | None = None
) -> DataFrame:
    """JSON lines as string columns: the union of keys, sorted. Blank lines are
    skipped, a broken line fails the job, nested values become key-sorted JSON.

    Without keys one extra pass over the files finds the union; give them when known. What is nested then shows in each line, and numbers
    lose zeros at their end.
    """
    if keys is None:
        reader = spark.read.option("mode", "FAILFAST")
        found = reader.option("primitivesAsString", True).json(paths).schema
        nested = {f.name for f in found if isinstance(f.dataType, (T.StructType, T.ArrayType))}
        names = sorted(f.name for f in found)
        raw = reader.schema(_string_schema(names)).json(paths)
        return raw.select(*[sorted_json(F.col(f"`{n}`")).alias(n) if n in nested else F.col(f"`{n}`") for n in names])
    names = sorted(keys)
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", _string_schema(names), {"mode": "FAILFAST"}).alias("_row"))

    def column(name: str) -> Column:
        """Text that looks nested is parsed again as what was sent: a string stays as it is, an object or list is sorted."""
        sent, raw = F.try_variant_get(F.parse_json("value"), f'$["{name}"]', "variant"), F.col("_row")[name]
        is_nested = F.schema_of_variant(sent).rlike("^(OBJECT|ARRAY)")
        return F.when(raw.rlike(r"^\s*[\[{]"), F.when(is_nested, F.to_json(sent)).otherwise(raw)).otherwise(raw).alias(name)

    return parsed.select(*[column(n) for n in names])


def read_json_doc(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """Whole-file JSON documents; a top-level array gives one row per element. Without a
    schema numbers and booleans stay text, as they were sent."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("primitivesAsString", True)
    return reader.json(path)

