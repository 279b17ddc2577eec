"""Mixing sources to target weights along a training run.

A schedule gives each source a weight over training time t in 0..1, linear between knots. Its integral
is the source's share of the words to draw; a source whose demand would exceed `most` times its words stops there and
the rest is shared again by weight. Inside a source, documents stand in a fixed pseudo-random
order, and a document that begins after c words of the source is due when the source's cumulative demand reaches c:
its position is the inverse of the integrated schedule. Sorting by position gives the curriculum.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierstone.operators.ranking import ordinal_by_range
from tierstone.session import settle

Knots = list[tuple[float, float]]

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 2_000  # rows of a source that one window task orders
MAX_SOURCES = 100_000  # sources the driver plans for and sends to all tasks; more are refused


def area(knots: Knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def fill_targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words of each source: `share` of all sizes by weight, none above `most` times its own size."""
    caps = [most * s for s in sizes]
    total = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: caps[i] / weights[i])
    level, before, rest = math.inf, 0.0, sum(weights)
    for i in order:
        now = (total - before) / rest
        if now <= caps[i] / weights[i]:
            level = now
            break
        before += caps[i]
        rest -= weights[i]
    return [min(c, level * w) for c, w in zip(caps, weights, strict=True)]


def _position(words: Column) -> Column:
    """Time at which the cumulative demand of the row's source reaches `words`."""
    segment = F.greatest(F.lit(1), F.size(F.filter("cum", lambda c: c <= words)))
    at = lambda name: F.element_at(name, F.least(segment, F.size(name)).cast("int"))
    rest = F.greatest(F.lit(0.0), words - at("cum")) / F.col("scale")
    root = F.sqrt(F.greatest(F.lit(0.0), at("height") * at("height") + 2 * at("slope") * rest))
    step = F.when(rest > 0, 2 * rest / (at("height") + root)).otherwise(0.0)
    return F.least(F.lit(1.0), at("start") + step)


def plan_mix(
    docs: DataFrame, schedule: Callable[[list[str | None]], list[Knots]], share: float, most: float = 2.0, whole: bool = False
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, draws.

    docs needs doc_id, source and text; further columns are ignored. size counts words (null text: 0). Sources are planned
    in code-point order, null last; `schedule` maps that list to knots. draws has a (position, words) entry for every time
    the row is drawn. The last draw of a source is cut at its target; with `whole`, it counts in full if at
    least half of it fits and not at all otherwise. Rows without words are never drawn. Rows of equal doc_id are
    ordered by size; a table without rows gives one without rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), key.alias("key")), "mix-sizes")

    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    knots = schedule([r["source"] for r in found])
    sizes, weights = [r["size"] for r in found], [area(k) for k in knots]
    targets = fill_targets(sizes, weights, share, most) if found else []

    rows = []
    for no, (row, line, weight, target) in enumerate(zip(found, knots, weights, targets, strict=True)):
        scale = target / weight  # words drawn per unit of weight and time
        cum, starts, heights, slopes, done = [], [], [], [], 0.0
        for (t0, w0), (t1, w1) in zip(line, line[1:], strict=False):
            cum.append(done * scale)
            starts.append(float(t0))
            heights.append(float(w0))
            slopes.append((w1 - w0) / (t1 - t0))
            done += (t1 - t0) * (w0 + w1) / 2
        slices = max(1, math.ceil(row["rows"] / SLICE_ROWS))
        rows.append((row["source"], no, row["size"], target, slices, scale or 1.0, cum, starts, heights, slopes))
    sources = spark.createDataFrame(
        rows, "source string, no int, source_size long, target double, slices int, scale double, cum array<double>, "
        "start array<double>, height array<double>, slope array<double>",
    ).withColumnRenamed("source", "of")

    # at most MAX_SOURCES rows, checked above
    named = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    prefix = F.coalesce(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(0))
    sliced = named.withColumn("slice", F.shiftright(prefix * F.col("slices"), 32).cast("int"))
    earlier = Window.partitionBy("no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("no", "slice").agg(F.sum("size").alias("words")).select(
        "no", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("no", "slice").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    begun = sliced.join(offsets, ["no", "slice"]).withColumn("before", F.col("offset") + F.sum("size").over(inside) - F.col("size"))

    goal, due = F.floor("target"), lambda e: F.col("before") + e * F.col("source_size")
    left = lambda e: goal - due(e)
    if whole:
        words = lambda e: F.when(2 * left(e) >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    else:
        words = lambda e: F.least("size", F.greatest(F.lit(0).cast("long"), left(e)))
    draw = lambda e: F.struct(_position(due(e) + words(e) / 2).alias("position"), words(e).alias("words"))
    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1)), draw), lambda d: d["words"] > 0)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return begun.withColumn("draws", draws).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "draws", "key")


def in_curriculum_order(plan: DataFrame) -> DataFrame:
    """Rows of the plan by the position of their first draw, undrawn rows last."""
    first = F.coalesce(F.get("draws", F.lit(0))["position"], F.lit(2.0))
    return plan.withColumn("first", first).repartitionByRange("first", "key").sortWithinPartitions("first", "key").drop("first", "key")


def _same_rows(rows: DataFrame, order: list) -> DataFrame:
    """rows with `_copy`: 1, or the number of the row among those of its `_row`, of which any number may be alike."""
    repeated = settle(rows.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_row"), "repeated-rows")
    if repeated.isEmpty():
        return rows.withColumn("_copy", F.lit(1).cast("long"))
    single = rows.join(repeated, "_row", "left_anti").withColumn("_copy", F.lit(1).cast("long"))
    return single.unionByName(ordinal_by_range(rows.join(repeated, "_row", "left_semi"), ["_row"], order, "_copy"))


def mixed_documents(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of docs as the mix draws them, once per draw, sorted by position.

    docs and plan are matched row by row: by doc_id, source and size, and rows that repeat all three by their number among their like,
    in the order of their texts on one side and of their draws on the other.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = lambda size: F.to_json(F.struct(F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), size.alias("n")))
    drawn = _same_rows(plan.select(row(F.col("size")).alias("_row"), "draws", F.col("key").alias("_key")), [F.col("draws").asc()])
    drawn = drawn.filter(F.size("draws") > 0).select("_row", "_copy", "_key", F.explode("draws.position").alias("_position"))
    mine = _same_rows(docs.withColumn("_row", row(size)), [F.xxhash64("text"), F.col("text")])
    joined = mine.join(drawn, ["_row", "_copy"]).repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))
