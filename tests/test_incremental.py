from rows import as_set

from tierstone.operators import incremental as I
from tierstone.sources.bronze import read_bronze

ORDERS = "order_id string, ordered_at string"
ITEMS = "order_id string, item string"


def test_high_water_load(spark, frame, tmp_path):
    bronze = str(tmp_path)
    assert I.high_water(spark, f"{bronze}/orders", "ordered_at") is None
    first = frame(ORDERS, ("o1", "2026-03-01T00:00:00Z"), ("o2", "2026-03-02T00:00:00Z"))
    items = frame(ITEMS, ("o1", "a"), ("o2", "b"))
    loaded = I.load_since(spark, bronze, ("orders", first, "ordered_at"), {"items": items}, "order_id", "r1")
    assert loaded == {"items": 2, "orders": 2, "items__late": 0, "orders__late": 0}
    # nothing new: equal to the mark is not loaded
    assert I.load_since(spark, bronze, ("orders", first, "ordered_at"), {"items": items}, "order_id", "r2") == {
        "items": 0, "orders": 0, "items__late": 0, "orders__late": 0,
    }
    second = first.unionByName(frame(ORDERS, ("o3", "2026-03-03T00:00:00Z"), ("o0", "2026-02-01T00:00:00Z")))
    more = frame(ITEMS, ("o1", "late"), ("o3", "c"))
    loaded = I.load_since(spark, bronze, ("orders", second, "ordered_at"), {"items": more}, "order_id", "r3")
    assert loaded == {"items": 1, "orders": 1, "items__late": 1, "orders__late": 1}
    assert as_set(read_bronze(spark, f"{bronze}/orders__late").select("order_id")) == {("o0",)}
    assert as_set(read_bronze(spark, f"{bronze}/items__late").select("order_id", "item")) == {("o1", "late")}
    # under a later mark they are not reported again
    loaded = I.load_since(spark, bronze, ("orders", second, "ordered_at"), {"items": more}, "order_id", "r4")
    assert loaded == {"items": 0, "orders": 0, "items__late": 0, "orders__late": 0}
    assert as_set(read_bronze(spark, f"{bronze}/items").select("order_id", "item")) == {("o1", "a"), ("o2", "b"), ("o3", "c")}
    mark = I.high_water(spark, f"{bronze}/orders", "ordered_at")
    assert mark == "2026-03-03T00:00:00Z"
    known = read_bronze(spark, f"{bronze}/orders")
    assert as_set(I.late(second, "ordered_at", mark, known, ["order_id"])) == {("o0", "2026-02-01T00:00:00Z")}
    assert I.late(second, "ordered_at", None, known, ["order_id"]).isEmpty()


def test_a_retry_after_a_lost_parent_load_replaces_the_children(spark, frame, tmp_path):
    bronze = str(tmp_path)
    orders = frame(ORDERS, ("o1", "2026-03-01T00:00:00Z"))
    items = frame(ITEMS, ("o1", "a"))
    from tierstone.sources.bronze import load_bronze

    load_bronze(items, f"{bronze}/items", "items:None", "r1")  # the parent load after it failed
    I.load_since(spark, bronze, ("orders", orders, "ordered_at"), {"items": items}, "order_id", "r2")
    assert read_bronze(spark, f"{bronze}/items").count() == 1


def test_rows_looked_up_move_once(spark, frame):
    """A lookup moves the rows as its key and not beside it, and one join looks into all tables."""
    from tierstone.operators.incremental import _missing

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = frame("a string, b string", ("1", None), ("2", "x"), ("3", "y"), ("3", "y"), (None, "z"))
        left = _missing(rows, frame("b string, a string", (None, "1")), None, frame("a string, b string", ("2", "x"), (None, "z")))
        assert left.columns == ["a", "b"] and sorted(map(tuple, left.collect())) == [("3", "y"), ("3", "y")]
        assert left._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
