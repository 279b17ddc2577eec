import datetime as dt

import pytest
from pyspark.sql import functions as F

from rows import as_set
from tierstone.operators.upsert import upsert
from tierstone.plans import keyed, stores
from tierstone.plans.keyed import Conflict, KeyedStore

SCHEMA = "dag_id string, run_id string, scores string, judge_model string, scored_at timestamp"


def at(day):
    return F.lit(dt.datetime(2026, 1, day)).cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore.create(spark, str(tmp_path / "scores"), "answer_scores", SCHEMA, buckets=8)


@pytest.fixture
def batch(frame):
    return lambda *rows: frame("dag_id string, run_id string, scores string, judge_model string, seq int", *rows)


def shown(df):
    return as_set(df.select("dag_id", "run_id", "scores", "judge_model", F.dayofmonth("scored_at")))


def test_versions_of_a_table(store, batch):
    assert store.read().collect() == [] and store.versions() == {}
    assert store.apply(batch(("a", "1", "x", "m", 1), ("b", "1", "y", "m", 1)), "seq", at(1)) == 1
    assert store.apply(batch(("a", "1", "z", "other", 1), ("c", "1", "w", "first", 1), ("c", "1", "v", "second", 2)), "seq", at(2)) == 2
    old = {("a", "1", "x", "m", 1), ("b", "1", "y", "m", 1)}
    new = {("a", "1", "z", "m", 2), ("b", "1", "y", "m", 1), ("c", "1", "v", "first", 2)}
    assert shown(store.read(1)) == old and shown(store.read()) == shown(store.read(2)) == new and store.read(0).isEmpty()
    again = KeyedStore(store.spark, store.path)
    assert shown(again.read()) == new and list(again.versions()) == [1, 2]
    with pytest.raises(ValueError):
        store.read(7)


def test_only_touched_buckets_are_rewritten(store, batch):
    store.apply(batch(*[(f"d{i}", "1", "x", "m", 1) for i in range(64)]), "seq", at(1))
    before = store._map(store.versions()[1])
    store.apply(batch(("d7", "1", "y", "m", 1)), "seq", at(2))
    after = store._map(store.versions()[2])
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    changed = next(b for b in before if before[b] != after[b])
    same = {f for f in store.read(1).inputFiles() if f"bucket={changed}/" not in f}
    assert same == {f for f in store.read(2).inputFiles() if f"bucket={changed}/" not in f} and len(same) >= 7


def test_a_write_stopped_before_the_switch_is_not_seen(store, batch, monkeypatch):
    store.apply(batch(("a", "1", "x", "m", 1)), "seq", at(1))

    def stopped(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(keyed, "claim", stopped)
        with pytest.raises(RuntimeError, match="stopped"):
            store.apply(batch(("a", "1", "lost", "m", 1), ("b", "1", "lost", "m", 1)), "seq", at(2))
    assert shown(store.read()) == {("a", "1", "x", "m", 1)}
    assert store.apply(batch(("c", "1", "y", "m", 1)), "seq", at(3)) == 2
    assert shown(store.read()) == {("a", "1", "x", "m", 1), ("c", "1", "y", "m", 3)}
    gone = store.forget(keep=1)
    assert gone >= 3 and shown(store.read()) == {("a", "1", "x", "m", 1), ("c", "1", "y", "m", 3)}
    assert list(store.versions()) == [2]


def test_of_two_writers_one_is_refused(store, batch, monkeypatch):
    store.apply(batch(("a", "1", "x", "m", 1)), "seq", at(1))
    other, real = KeyedStore(store.spark, store.path), keyed.claim

    def late(*args):
        monkeypatch.setattr(keyed, "claim", real)
        other.apply(batch(("a", "1", "theirs", "m", 1)), "seq", at(2))
        return real(*args)

    monkeypatch.setattr(keyed, "claim", late)
    with pytest.raises(Conflict):
        store.apply(batch(("a", "1", "ours", "m", 1)), "seq", at(3))
    assert shown(store.read()) == {("a", "1", "theirs", "m", 2)}
    store.apply(batch(("a", "1", "ours", "m", 1)), "seq", at(3))
    assert shown(store.read()) == {("a", "1", "ours", "m", 3)}


def test_a_version_without_a_name_stops_writers_until_cleared(store, batch):
    store.apply(batch(("a", "1", "x", "m", 1)), "seq", at(1))
    assert keyed.claim(store.spark, f"{store.path}/versions/2", "")
    assert shown(store.read()) == {("a", "1", "x", "m", 1)}
    with pytest.raises(Conflict, match="forget"):
        store.apply(batch(("a", "1", "y", "m", 1)), "seq", at(2))
    store.forget()
    assert store.apply(batch(("a", "1", "y", "m", 1)), "seq", at(2)) == 2


def test_a_store_needs_its_columns(spark, tmp_path):
    for name, rule in stores.STORES.items():
        with pytest.raises(ValueError, match=rule.keys[0]):
            KeyedStore.create(spark, str(tmp_path / name), name, "something string")


def test_a_rule_of_its_own_with_buckets_by_a_part_of_the_key(spark, frame, tmp_path):
    rule = stores.Store(("a", "b"), ("v",))
    store = KeyedStore.create(spark, str(tmp_path / "own"), rule, "a string, b string, v int, first int", 8, ["a"])
    store.apply(frame("a string, b string, v int, first int", *[(f"a{i}", f"b{j}", i, j) for i in range(20) for j in range(3)]))
    near = store.near(frame("a string", "a5"))
    assert {r["b"] for r in near.filter("a = 'a5'").collect()} == {"b0", "b1", "b2"} and len(near.inputFiles()) < len(store.read().inputFiles())
    with pytest.raises(ValueError, match="keys"):
        KeyedStore.create(spark, str(tmp_path / "bad"), rule, "a string, b string, v int", 8, ["v"])


def test_a_small_batch_moves_no_target_beyond_the_broadcast_limit(spark, tmp_path):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
        spark.range(200_000).selectExpr("id k", "id a", "uuid() b").write.parquet(str(tmp_path / "target"))
        spark.createDataFrame([(5, 1, "x", 1), (10**9, 1, "y", 1)], "k long, a long, b string, seq int").write.parquet(str(tmp_path / "batch"))
        target, some = (spark.read.parquet(str(tmp_path / n)) for n in ("target", "batch"))
        after = upsert(target, some, ["k"], ["a"], order_col="seq")
        assert after.count() == 200_001
        rows = after.collect()
        plan = after._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == 200_001
        final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
        # nothing but the batch and the keys it has in common with the target goes through an exchange
        assert "SortMergeJoin" not in final and "ShuffledHashJoin" not in final
        metrics = after._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in metrics
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_large_batch_and_its_target_move_once(spark, store, batch, monkeypatch):
    """A batch beyond the broadcast threshold: one join and one grouping, and the rows of a small batch."""
    first = batch(*[(f"d{i}", "1", "x", "m", 1) for i in range(40)])
    second = batch(*[(f"d{i}", "1", f"s{n}", f"m{n}", n) for i in range(20, 60) for n in (1, 2)], ("d99", "1", None, None, None))
    store.apply(first, "seq", at(1))
    small = KeyedStore.create(spark, f"{store.path}-small", "answer_scores", SCHEMA, buckets=8)
    small.apply(first, "seq", at(1))
    small.apply(second, "seq", at(2))
    plans, real = [], keyed.upsert

    def kept(*args):
        plans.append(real(*args))
        return plans[-1]

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(keyed, "upsert", kept)
        store.apply(second, "seq", at(2))
        plan = plans[0]._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Join") == 1 and plan.count("Aggregate") == 2
    assert shown(store.read()) == shown(small.read()) and store.read().count() == 61
