"""Lines that many documents share, as compressed keep bitmaps. DataFrame functions only.

The hash of every line that is long enough is range-partitioned by (hash, document) and sorted by (hash, document, position), so that a line
which a third of all documents hold is spread over as many tasks as it needs. The first occurrence of a line within a document streams out of
that order; first occurrences are counted per hash, with map-side sums. Shared hashes go back to the stored lines and become one bitmap per
document, kept as the ends of its runs: [end of kept, end of dropped, end of kept, ...]. Texts are read again only to apply the bitmaps.

Rows with one doc_id, null included, are one document, and null comes before all others; every row gets a bitmap of its own, found by doc_id and
the hash of its text. A null text is the empty text, which is one empty line. Repeated rows get equal results. A text of any length is one row of lines
and of run ends, and no other columns are read, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierstone.session import settle

LEAST_CHARS = 40  # code points of a key
LEAST_DOCS = 5  # documents that hold it
ROWS_PER_RANGE = 2_000_000  # first occurrences of lines in a range partition, about

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in small letters; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANK))
    # lower() has a fast path for ASCII, where it changes no other letter
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2) of every line whose key is long enough; (h1, h2) is a 128-bit hash of the key."""
    lines = _documents(docs).select("doc_id", "text_key", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.filter(F.length("line") >= least_chars).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least_chars)
    return keys.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def first_occurrences(lines: DataFrame, parts: int) -> DataFrame:
    """(h1, h2, doc_id): the first line of each key in each document, in the order of (hash, document, position)."""
    ranged = lines.select("h1", "h2", "doc_id", "pos").repartitionByRange(parts, "h1", "h2", "doc_id")
    # the ranges keep a key of a document together, so this needs no further exchange
    place = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos"))
    return ranged.withColumn("place", place).filter("place = 1").select("h1", "h2", "doc_id")


def shared_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h1, h2, keep_id): keys in at least so many documents, with the document that keeps its lines."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // ROWS_PER_RANGE)
    first = first_occurrences(lines, parts)
    return first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep_id")).filter(F.col("docs") >= least_docs).drop("docs")


def run_ends(dropped: Column) -> Column:
    """Where the runs of the keep bitmap end, beginning with kept lines, from the sorted positions of the dropped ones."""
    def of(d: Column) -> Column:
        starts = F.filter(d, lambda x, i: (i == 0) | (F.get(d, i - 1) != x - 1))
        stops = F.transform(F.filter(d, lambda x, i: (i == F.size(d) - 1) | (F.get(d, i + 1) != x + 1)), lambda x: x + 1)
        return F.flatten(F.zip_with(starts, stops, lambda a, z: F.array(a, z)))

    return _let(dropped, of)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep_ends) of every text that loses a line, and of no other."""
    lines = settle(hashed_lines(docs, least_chars), "line-hashes")
    # stored, so that a hot key can be split in the join with the lines
    shared = settle(shared_keys(lines, least_docs), "shared-lines").withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    lost = lines.join(shared, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    # no more positions than a text has lines
    return lost.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("dropped")).select(
        "doc_id", "text_key", F.size("dropped").cast("long").alias("n_dropped"), run_ends(F.col("dropped")).alias("keep_ends")
    )


def apply_runs(lines: Column, ends: Column) -> Column:
    """The lines that the bitmap keeps; lines beyond its end stay."""
    def kept(r: Column) -> Column:
        begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(r["ends"], i - 1))
        pieces = F.transform(r["ends"], lambda end, i: F.when(i % 2 == 0, F.slice(r["lines"], begin(i) + 1, end - begin(i))).otherwise(F.slice(r["lines"], 1, 0)))
        last = F.coalesce(F.element_at(r["ends"], -1), F.lit(0))
        return F.concat(F.flatten(pieces), F.slice(r["lines"], last + 1, F.greatest(F.size(r["lines"]) - last, F.lit(0))))

    return _let(F.struct(lines.alias("lines"), ends.alias("ends")), kept)


def without_shared_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of docs: the lines its bitmap keeps, joined by a line feed."""
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_dropped", "keep_ends")
    joined = _documents(docs).join(marks, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    line_feeds = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    kept = F.when(F.col("keep_ends").isNull(), F.col("text")).otherwise(F.array_join(apply_runs(split_lines(F.col("text")), F.col("keep_ends")), "\n"))
    return joined.select("doc_id", (line_feeds + 1).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
