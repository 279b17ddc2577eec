"""One long JSON array in one file, read by many tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tierstone.session import settle

_NAMED = ""  # stands for the key of the array, outside strings
_PLACE = ("file", "block", "at")


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _ahead(rows: DataFrame, **sums: Column) -> DataFrame:
    """The sums over the pieces of a file ahead of each piece: within its split, plus the splits before, of which each is one row."""
    of_blocks = rows.groupBy("file", "block").agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = of_blocks.select("file", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()}).join(shift, ["file", "block"])
    return settle(summed.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*[f"_{n}" for n in sums]), "json-places")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str, key: str | None = None) -> DataFrame:
    """The elements (objects) of a long array, parsed by schema: the file is an array, or with `key` an object that holds one under that name.

    The file is cut at closing braces, which Spark does by splits, so many tasks read a document of any length. Whether a piece begins
    inside a string follows from the quotes before it, and how deep it begins from the brackets before it: two prefix sums, within
    splits and over them. An element ends where the depth comes back to that of the array. Its pieces alone are put
    together and parsed. A malformed element fails the job; an element that no brace ends is not there.
    """
    depth = 1 if key is None else 2
    value = F.col("value")
    pieces = settle(
        spark.read.option("lineSep", "}").text(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
        ),
        "json-pieces",
    )
    plain = F.replace(F.replace(value, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    if key is not None:
        plain = F.regexp_replace(plain, rf'"{re.escape(key)}"\s*:\s*\[', f"{_NAMED}[")

    def shape(text: Column) -> Column:
        """What a piece adds outside strings, and how deep the array's key stands in it."""
        bare = F.regexp_replace(text, '"[^"]*("|$)', "")
        ahead = F.substring_index(bare, _NAMED, 1)
        level = lambda x: _count(x, "{[") - _count(x, "]")
        return F.struct(
            level(bare).alias("delta"), F.when(bare.contains(_NAMED), level(ahead)).alias("key_at"), bare.contains("[").alias("opens"), bare.rlike(r"^[\s,]*\]").alias("leaves")
        )

    quotes = pieces.withColumn("plain", plain).select(
        *_PLACE, _count(F.col("plain"), '"').alias("quotes"), shape(F.col("plain")).alias("out"), shape(F.concat(F.lit('"'), "plain")).alias("within")
    )
    parity = _ahead(settle(quotes, "json-quotes"), quotes_before=F.col("quotes"))
    begins_in, ends_in = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    mine = F.when(begins_in, F.col("within")).otherwise(F.col("out"))
    # the brace that was cut off closes an object unless it stands in a string
    moved = parity.select(*_PLACE, mine.alias("mine"), begins_in.alias("begins_in"), ends_in.alias("ends_in")).withColumn(
        "moved", F.col("mine.delta") - F.when(F.col("ends_in"), 0).otherwise(1)
    )
    deep = _ahead(moved, depth_before=F.col("moved"))
    if key is None:
        opening = (F.col("depth_before") == 0) & F.col("mine.opens")
    else:
        opening = F.coalesce(F.col("depth_before") + F.col("mine.key_at") == 1, F.lit(False))
    marked = deep.select(
        *_PLACE, opening.alias("opening"), (~F.col("ends_in") & (F.col("depth_before") + F.col("moved") == depth)).alias("last"),
        (~F.col("begins_in") & (F.col("depth_before") == depth) & F.col("mine.leaves")).alias("leaves"),
    )
    numbered = _ahead(marked, element=F.col("last").cast("int"), opened=F.col("opening").cast("int"))
    leaving = (F.col("leaves") & (F.col("opened") > 0)).cast("int")
    numbered = _ahead(numbered, left=leaving)
    inside = numbered.filter((F.col("opening") | (F.col("opened") > 0)) & (F.col("left") + leaving == 0)).select(*_PLACE, "element", "opening", "last")

    parts = F.array_sort(F.collect_list(F.struct("block", "at", "opening", "last", F.concat("value", F.lit("}")).alias("text"))))
    whole = inside.join(pieces, list(_PLACE)).groupBy("file", "element").agg(parts.alias("parts")).filter(F.element_at("parts", -1)["last"])
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    head = r"^\s*\[\s*" if key is None else rf'(?s)^.*?"{re.escape(key)}"\s*:\s*\[\s*'
    first = F.regexp_replace(text, head, "")
    element = F.when(F.col("parts")[0]["opening"], first).otherwise(F.regexp_replace(text, r"^[\s,]*", ""))
    return whole.select(F.from_json(element, schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
