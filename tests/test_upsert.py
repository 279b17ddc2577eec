import datetime as dt

import pytest
from rows import as_set
from pyspark.sql import functions as F

from tierstone.operators.upsert import cascade, upsert

TARGET = "k string, a int, b int, touched timestamp"
OLD = dt.datetime(2026, 1, 1)
NOW = "2026-09-01 00:00:00"


def stamped(df):
    return as_set(df.select("k", "a", "b", F.year("touched") * 100 + F.month("touched")))


def run(frame, rows, batch, **options):
    target = frame(TARGET, *[(*r, OLD) for r in rows])
    source = frame("k string, a int, b int, seq int", *batch)
    now = F.lit(NOW).cast("timestamp")
    return upsert(target, source, ["k"], order_col="seq", touch_col="touched", now=now, **options)


def test_all_columns_last_of_batch_wins(frame):
    got = run(frame, [("x", 1, 1), ("y", 2, 2)], [("x", 5, None, 1), ("x", 6, None, 2), ("z", 7, 7, 3)])
    assert stamped(got) == {("x", 6, None, 202609), ("y", 2, 2, 202601), ("z", 7, 7, 202609)}


def test_partial_keeps_other_columns_and_first_insert(frame):
    got = run(frame, [("x", 1, 1)], [("x", 5, 5, 1), ("z", 7, 7, 2), ("z", 8, 8, 3)], update_cols=["a"])
    assert stamped(got) == {("x", 5, 1, 202609), ("z", 8, 7, 202609)}


def test_repeating_a_batch_changes_nothing(frame):
    batch = [("x", 5, 5, 1), ("z", 7, 7, 2)]
    once = run(frame, [("x", 1, 1)], batch)
    source = frame("k string, a int, b int, seq int", *batch)
    twice = upsert(once, source, ["k"], order_col="seq", touch_col="touched", now=F.lit(NOW).cast("timestamp"))
    assert stamped(once) == stamped(twice)


def test_empty_batch_and_empty_target(frame):
    target = frame("k string, a int", ("x", 1))
    source = frame("k string, a int", ("y", 2))
    assert as_set(upsert(target, source.limit(0), ["k"])) == {("x", 1)}
    assert as_set(upsert(target.limit(0), source, ["k"])) == {("y", 2)}


def test_composite_key(frame):
    target = frame("d string, r string, v int", ("a", "1", 1), ("a", "2", 2))
    source = frame("d string, r string, v int", ("a", "2", 9), ("b", "2", 8))
    assert as_set(upsert(target, source, ["d", "r"])) == {("a", "1", 1), ("a", "2", 9), ("b", "2", 8)}


def test_cascade(frame):
    child = frame("d string, r string, s int", ("a", "1", 1), ("a", "2", 2))
    assert as_set(cascade(child, frame("d string, r string", ("a", "2")), ["d", "r"])) == {("a", "2", 2)}


def test_unknown_update_columns_are_refused(frame):
    with pytest.raises(ValueError, match="nope"):
        run(frame, [("x", 1, 1)], [("x", 5, 5, 1)], update_cols=["a", "nope"])


def test_a_repeated_key_without_order_fails(frame):
    target = frame("k string, a int", ("x", 1))
    ok = upsert(target, frame("k string, a int", ("x", 2), ("y", 3)), ["k"])
    assert as_set(ok) == {("x", 2), ("y", 3)}
    with pytest.raises(Exception, match="occurs twice"):
        upsert(target, frame("k string, a int", ("x", 2), ("x", 3)), ["k"]).collect()


def test_a_small_batch_leaves_the_target_in_place(spark):
    target = spark.range(1000).selectExpr("id k", "id a")
    plan = upsert(target, target.limit(3), ["k"], order_col="a")._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in plan and "BroadcastHashJoin [k" in plan and "LeftOuter" in plan
