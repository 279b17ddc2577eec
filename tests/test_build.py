import pytest
from rows import as_set
from pyspark.sql import functions as F

from tierstone.plans import build
from tierstone.plans.silver import SOURCES
from tierstone.plans.stores import STORES, apply
from tierstone.sources.bronze import load_bronze


def test_landed_files_to_star_schema(spark, tmp_path):
    """Every landed table, one blank row each, through both layers and a question."""
    bronze, out = str(tmp_path / "bronze"), str(tmp_path / "gold")
    for table, columns in SOURCES.items():
        row = {c: "1" if c.endswith("_id") or c == "product_sku" else "" for c in columns}
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` string" for c in columns))
        assert load_bronze(df, f"{bronze}/{table}", "one", "r") == 1
    assert len(SOURCES) == 21
    gold = build.build_gold(spark, build.read_silver(spark, bronze), out)
    assert gold["mart_customer_360"].select("order_count", "ticket_count").first() == (1, 1)
    answer = build.ask(gold, "SELECT o.order_id, c.customer_id FROM fct_orders o JOIN dim_customer c USING (customer_id)")
    assert answer.first() == ("1", "1", None, 1)
    days = build.ask(gold, "SELECT date_day FROM dim_date")
    assert days.count() == 50 and days.first()["truncated_by"] == "rows"


@pytest.mark.parametrize("name", list(STORES))
def test_stores_keep_what_they_must(frame, name):
    rule = STORES[name]
    columns = list(dict.fromkeys([*rule.keys, *(rule.updates or ("a",)), "kept"]))
    schema = ", ".join(f"{c} string" for c in columns)
    old = frame(schema, tuple("k" if c in rule.keys else "old" for c in columns))
    new = frame(schema, tuple("k" if c in rule.keys else "new" for c in columns))
    if rule.touch:
        old, new = (df.withColumn(rule.touch, F.lit("2026-01-01").cast("timestamp")) for df in (old, new))
    row = apply(name, old, new, now=F.lit("2026-09-01").cast("timestamp")).first().asDict()
    for c in columns:
        expected = "k" if c in rule.keys else "new" if rule.updates is None or c in rule.updates else "old"
        assert row[c] == expected, c
    if rule.touch:
        assert row[rule.touch].month == 9
    assert as_set(apply(name, old, new.limit(0))) == as_set(old)


def test_ask_refuses_what_is_no_select(frame, tmp_path):
    tables = {"things": frame("a int", 1, 2)}
    assert build.ask(tables, "WITH t AS (SELECT a FROM things) SELECT a FROM t").count() == 2
    for sql in (f"INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING csv SELECT * FROM things", "DROP VIEW things", "CREATE VIEW v AS SELECT 1",
                f"FROM things INSERT OVERWRITE DIRECTORY '{tmp_path}/x' USING csv SELECT a"):
        with pytest.raises(ValueError):
            build.ask(tables, sql)
    assert not (tmp_path / "x").exists()
