import random

import pytest
from rows import as_set
from pyspark.sql import functions as F

from tierstone.operators import ranking
from tierstone.operators.ranking import first_per_key, ordinal, ordinal_by_range, top_n


def test_ordinal_equals_plain_numbering(frame):
    rng = random.Random(5)
    # one key has most of the rows
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", rng.randrange(10_000), i) for i in range(2000)]
    expected = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        expected |= {(*r, n) for n, r in enumerate(mine, start=1)}
    df = frame("k string, at int, id int", *rows)
    for width in (7, 500, 100_000):
        got = ordinal(df, ["k"], [F.col("at"), F.col("id")], F.floor(F.col("at") / width))
        assert as_set(got) == expected


def test_a_third_of_all_rows_in_one_key_and_one_day(spark, monkeypatch):
    """Ties in all sort columns but the last; no range holds more than twice the median."""
    rows = spark.range(0, 30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise((F.col("id") % 11).cast("int")).alias("day"),
        F.xxhash64("id").alias("id"),
    )
    stored = []
    real = ranking.settle
    monkeypatch.setattr(ranking, "settle", lambda df, label: stored.append((label, df)) or real(df, label))
    got = ordinal(rows, ["k"], [F.col("day"), F.col("id")], F.col("day"), "n", hot_rows=1000)
    expected = {}
    for r in sorted(rows.collect()):
        expected.setdefault(r["k"], []).append((r["day"], r["id"]))
    assert as_set(got.select("k", "day", "id", "n")) == {(k, *r, n) for k, mine in expected.items() for n, r in enumerate(mine, start=1)}
    ranged = dict(stored)["ranged-rows"]
    sizes = sorted(r["count"] for r in ranged.groupBy("_part").count().collect())
    assert sum(sizes) == 10_000 and len(sizes) >= 7 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_ordinal_by_range_of_many_groups_and_falling_order(frame):
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.randrange(5), i) for i in range(900)]
    got = ordinal_by_range(frame("k string, v int, id int", *rows), ["k"], [F.col("v").desc(), F.col("id")], "n", parts=13)
    expected = {(*r, n) for k in "abc" for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), start=1)}
    assert as_set(got.select("k", "v", "id", "n")) == expected


def test_top_n_and_first(frame):
    df = frame("k string, v int, id int", ("a", 1, 1), ("a", None, 2), ("a", 3, 3), ("b", None, 4))
    order = [F.col("v").desc_nulls_last(), F.col("id")]
    assert as_set(top_n(df, ["k"], order, 2)) == {("a", 3, 3), ("a", 1, 1), ("b", None, 4)}
    assert as_set(first_per_key(df, ["k"], [F.col("v").desc_nulls_first()])) == {("a", None, 2), ("b", None, 4)}


def test_top_n_cuts_groups_before_the_shuffle(frame):
    df = frame("k string, v int", ("a", 1), ("a", 2))
    plan = top_n(df, ["k"], [F.col("v").desc()], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("n", [1, 5])
def test_top_n_larger_than_group(frame, n):
    df = frame("k string, v int", ("a", 1))
    assert top_n(df, ["k"], [F.col("v")], n).count() == 1
