"""The ten keyed tables, written, changed by a batch and read at two versions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.plans.keyed import KeyedStore
from tierstone.plans.stores import STORES
from tierstone.session import fresh_path
from tierstone.workload.registry import Tables, query
from tierstone.workload.standins import text

# Columns besides those a rule names: what an update may not change, or, where a rule lets all change, what stands beside the keys.
OTHERS = {
    "warehouse_catalog": ("column_count", "row_count", "columns"),
    "column_profile": ("data_type", "null_fraction"),
    "catalog_prompt": ("prompt_text", "char_count"),
    "ticket_chunks": ("customer_id", "product_id", "ordinal"),
    "dag_source": ("source_text", "char_count"),
    "dag_run_history": ("logical_date",),
    "pipeline_health": ("success_rate", "last_state"),
    "responses": ("question", "model", "run_after", "task_id"),
    "answer_scores": ("judge_model",),
    "trace_spans": ("cost", "start_unix_nano", "service_name"),
}
BUCKETS = 4


def _rows(t: Tables, store: str) -> tuple[DataFrame, DataFrame]:
    """(first batch, second batch): orders before 1997, then the lines shipped since June 1996 in the order of their numbers.

    Every column says which row it came from: 'old' or the number of the line.
    """
    rule = STORES[store]
    values = [*(rule.updates or ()), *OTHERS[store]]
    key = [F.col("key").alias(rule.keys[0]), *[F.concat(F.lit(f"{k}-"), "key").alias(k) for k in rule.keys[1:]]]
    orders = t.orders.filter("o_orderdate < DATE '1997-01-01'").select(text("o_orderkey").alias("key"), F.lit(0).alias("seq"))
    lines = t.lineitem.filter("l_shipdate >= DATE '1996-06-01'").select(text("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("seq"))
    said = F.when(F.col("seq") == 0, F.lit("old")).otherwise(F.col("seq").cast("string"))
    return tuple(rows.select(*key, *[F.concat(F.lit(f"{c}:"), said).alias(c) for c in values], "seq") for rows in (orders, lines))


def _seen(store: str, version: int, rows: DataFrame) -> DataFrame:
    """How many keys have which values, a line for each column."""
    rule = STORES[store]
    values = [*(rule.updates or ()), *OTHERS[store]]
    touched = F.date_format(rule.touch, "yyyy-MM-dd") if rule.touch else F.lit("-")
    said = F.concat_ws(",", *values)
    others = F.concat(*[F.regexp_replace(k, f"^{k}-", "") for k in rule.keys[1:]], F.lit("")) if len(rule.keys) > 1 else F.lit("")
    right = others == F.repeat(F.col(rule.keys[0]), len(rule.keys) - 1)
    shown = rows.select(said.alias("said"), touched.alias("touched"), right.alias("keys_right"), F.col(rule.keys[0]).cast("long").alias("key"))
    return shown.groupBy("said", "touched", "keys_right").agg(F.count(F.lit(1)).alias("keys"), F.sum("key").alias("key_sum")).select(
        F.lit(store).alias("store"), F.lit(version).cast("long").alias("version"), "said", "touched", "keys_right", "keys", "key_sum"
    )


def _rule_sql() -> str:
    rows = []
    for name, rule in STORES.items():
        updates, others = list(rule.updates or ()), list(OTHERS[name])
        free = rule.updates is None
        rows.append(f"('{name}', {updates!r}::VARCHAR[], {others!r}::VARCHAR[], {free}, {rule.touch is not None})")
    return ", ".join(rows)


@query(
    "store_apply",
    f"""WITH rules(store, updates, others, free, touches) AS (VALUES {_rule_sql()}),
      first AS (SELECT o_orderkey AS key FROM orders WHERE o_orderdate < DATE '1997-01-01'),
      second AS (
        SELECT l_orderkey AS key, max(l_linenumber) AS last, min(l_linenumber) AS least FROM lineitem WHERE l_shipdate >= DATE '1996-06-01' GROUP BY 1
      ),
      versions AS (
        SELECT 1 AS version, key, 'old' AS new, 'old' AS kept, '2026-01-01' AS touched FROM first
        UNION ALL
        SELECT 2, coalesce(f.key, s.key), coalesce(s.last::VARCHAR, 'old'),
          CASE WHEN f.key IS NULL THEN s.least::VARCHAR ELSE 'old' END, CASE WHEN s.key IS NULL THEN '2026-01-01' ELSE '2026-02-01' END
        FROM first f FULL JOIN second s ON f.key = s.key
      ),
      shown AS (
        SELECT store, version, key, CASE WHEN touches THEN touched ELSE '-' END AS touched,
          array_to_string(list_concat(list_transform(updates, lambda c: c || ':' || new), list_transform(others, lambda c: c || ':' || CASE WHEN free THEN new ELSE kept END)), ',') AS said
        FROM rules CROSS JOIN versions
      )
      SELECT store, version::BIGINT AS version, said, touched, true AS keys_right, count(*) AS keys, sum(key)::BIGINT AS key_sum FROM shown GROUP BY ALL""",
)
def store_apply(t: Tables) -> DataFrame:
    """Ten stores on disk, each with a batch of orders and then one of lines; both versions are read at the end."""
    def changed(name: str) -> DataFrame:
        first, second = _rows(t, name)
        schema = first.drop("seq").schema
        if STORES[name].touch:
            schema = schema.add(STORES[name].touch, "timestamp")
        store = KeyedStore.create(t.spark, fresh_path(t.spark, f"store-{name}"), name, schema, BUCKETS)
        for batch, day in ((first, "2026-01-01"), (second, "2026-02-01")):
            store.apply(batch, "seq", F.lit(f"{day} 00:00:00").cast("timestamp"))
        return _seen(name, 1, store.read(1)).unionByName(_seen(name, 2, store.read(2)))

    with ThreadPoolExecutor(5) as pool:  # small writes, side by side
        return reduce(DataFrame.unionByName, pool.map(changed, STORES))
