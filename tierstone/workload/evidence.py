"""Whole layers held against SQL: every column of every table, every declared check, profiles put together from states."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierstone.operators import profile as P
from tierstone.operators import profile_states as S
from tierstone.operators.agent_runs import agent_runs, runs_by_task
from tierstone.operators.membership import named_by_file
from tierstone.operators.quality import declared_report
from tierstone.plans.build import gold_layer, read_silver
from tierstone.plans.checks import GOLD_CHECKS, GUARD_CHECKS, SILVER_CHECKS
from tierstone.plans.silver import SHAPES, SOURCES
from tierstone.session import freed_shuffles, fresh_path, settle
from tierstone.sources.bronze import load_bronze
from tierstone.workload import standins as I
from tierstone.workload import star, traces  # noqa: F401  (their SQL is registered there)
from tierstone.workload.lake import LANDED
from tierstone.workload.registry import QUERIES, SQL, Tables, query
from tierstone.workload.standins import WITH, plain, text, with_sql

# Conformed table -> the stand-in it is made from, in Spark and in SQL.
SILVER = {
    "accounts": "accounts", "asteroids": "asteroids", "contacts": "contacts", "customers": "customers", "hubs": "hubs", "moons": "moons",
    "opportunities": "opportunities", "order_items": "order_items", "orders": "orders", "payments": "payments", "planets": "planets",
    "product_categories": "product_categories", "products": "products", "refunds": "refunds", "routes": "routes", "shipments": "order_shipments",
    "stations": "stations", "subscriptions": "subscriptions", "suppliers": "suppliers", "ticket_comments": "ticket_comments", "tickets": "tickets",
}
GOLD_KEYS = {
    "dim_date": "date_day", "dim_location": "location_key", "dim_customer": "customer_id", "dim_product": "product_sku", "fct_orders": "order_id",
    "fct_order_items": "order_item_id", "fct_payments": "charge_id", "fct_shipments": "shipment_id", "fct_support_tickets": "ticket_id",
    "mart_customer_360": "customer_id", "mart_product_performance": "product_sku", "mart_route_performance": "route_id",
}
_KEYS = {n: SHAPES[n][1].split(" ")[0] for n in SHAPES} | {"customers": "customer_id"}


# --- every column of a table in one line each


TOGETHER = 12  # columns summed in one pass

# Every text that reads as a double, and few others: a text that fails to be cast costs an exception.
_MAY_BE_NUMBER = r"^[\x00-\x20]*+[+-]?[0-9.nNiI][0-9a-zA-Z.]*+((?<=[eEpP])[+-][0-9]++[fFdD]?)?[\x00-\x20]*+$"


def _number(c: str, kind: T.DataType) -> Column:
    """The value a column's text reads as, null if it is no number, without a text where the type tells."""
    if isinstance(kind, (T.IntegralType, T.DoubleType, T.DecimalType)):
        return F.col(c).cast("double")
    if isinstance(kind, (T.BooleanType, T.DateType, T.TimestampType)):
        return F.lit(None).cast("double")
    said = F.col(c).cast("string")
    return F.when(said.rlike(_MAY_BE_NUMBER), said.try_cast("double"))


def column_sums(df: DataFrame, table: str, key: str) -> DataFrame:
    """table_name, column_name, row_count, nulls, text_sum, mean: sums over all values of a column that change with any value and with the
    row it stands in. Values that read as numbers are averaged (to ten digits), the others summed by their hash."""
    k = F.col(key).cast("string")
    weight = F.conv(F.substring(F.md5(k), 1, 2), 16, 10).cast("long") + 1

    def sums(c: T.StructField) -> Column:
        number, said = _number(c.name, c.dataType), F.col(c.name).cast("string")
        hashed = F.conv(F.substring(F.md5(F.concat("_k", F.lit("="), said)), 1, 8), 16, 10).cast("long")
        return F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c.name).alias("column_name"),
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(said.isNull()).alias("nulls"),
            F.sum(F.when(number.isNull() & said.isNotNull(), hashed)).alias("text_sum"),
            F.when(F.count(number) > 0, F.format_string("%.9e", F.avg(number * F.col("_weight")))).alias("mean"),
        )

    rows, fields = df.select("*", k.alias("_k"), weight.alias("_weight")), list(df.schema)
    # plain aggregates without a row for each cell; of a few columns at a time, as code for many is too long to be compiled
    parts = []
    for start in range(0, len(fields), TOGETHER):
        found = rows.agg(*[sums(c).alias(f"c{i}") for i, c in enumerate(fields[start : start + TOGETHER])])
        parts.append(found.select(F.inline(F.array(*[f"c{i}" for i in range(len(found.columns))]))))
    return reduce(DataFrame.unionAll, parts).filter("row_count > 0")


def _cells_sql(table: str, relation: str, key: str) -> str:
    return f"""SELECT '{table}' AS table_name, k, u.key AS column_name, u.value AS v FROM (
      SELECT r.{key}::VARCHAR AS k, unnest(map_entries(json_transform(to_json(r), '"MAP(VARCHAR,VARCHAR)"'))) AS u FROM ({relation}) r)"""


_SUMS_SQL = """SELECT table_name, column_name, count(*) AS row_count, count(*) - count(v) AS nulls,
    CAST(sum(CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN ('0x' || md5(k || '=' || v)[1:8])::BIGINT END) AS BIGINT) AS text_sum,
    printf('%.9e', avg(TRY_CAST(v AS DOUBLE) * (1 + ('0x' || md5(k)[1:2])::BIGINT))) AS mean
  FROM cells GROUP BY ALL"""


# Spark's names of types, as a shape gives them.
def _types() -> list[tuple[str, str, str]]:
    out = []
    for table, (_, shape) in SHAPES.items():
        for column in shape.split(","):
            name, kind = column.strip().split(" ")
            kind = kind.partition("<")[0].replace(";", ",")
            out.append((table, name, kind if kind.split("(")[0] in ("int", "decimal", "boolean", "date", "timestamp") else "string"))
    derived = [("opportunities", "is_won", "boolean"), ("order_items", "line_revenue_credits", "decimal(29,2)"), ("shipments", "delivery_days", "int"), ("tickets", "body_chars", "int")]
    of_customers = [("customers", c, "string") for c in ("customer_id", "company_name", "contact_name", "email", "customer_tier", "account_id", "industry")]
    of_customers += [("customers", "home_planet_id", "int"), ("customers", "signup_date", "date"), ("customers", "is_active", "boolean"), ("customers", "annual_revenue_credits", "decimal(18,2)")]
    return out + derived + of_customers


_SILVER_SQL = with_sql(
    " ".join(sorted(set(SILVER.values()))),
    f""", cells AS ({' UNION ALL '.join(_cells_sql(n, f'SELECT * FROM s_{s}', _KEYS[n]) for n, s in SILVER.items())}),
    sums AS ({_SUMS_SQL}),
    types(table_name, column_name, data_type) AS (VALUES {', '.join(str(x) for x in _types())}),
    sizes AS (SELECT table_name, max(row_count) AS n FROM sums GROUP BY 1)
    SELECT table_name, column_name, data_type, coalesce(row_count, n) AS row_count, coalesce(nulls, n) AS nulls, text_sum, mean
    FROM types JOIN sizes USING (table_name) LEFT JOIN sums USING (table_name, column_name)""",
)


def _with_types(df: DataFrame, sums: DataFrame) -> DataFrame:
    kinds = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema], "column_name string, data_type string")
    return sums.join(kinds, "column_name")


@query("silver_all", _SILVER_SQL)
def silver_all(t: Tables) -> DataFrame:
    """All 21 conformed tables over landed text, with the types they have, every column."""
    bronze = fresh_path(t.spark, "bronze")
    more = {"salesforce__contacts": I.contacts, "salesforce__opportunities": I.opportunities, "reference__suppliers": I.suppliers}
    landed = LANDED | more
    for name, rows in landed.items():
        load_bronze(rows(t), f"{bronze}/{name}", f"{name}.csv", "run-1")
    silver = read_silver(t.spark, bronze, list(SOURCES))
    return reduce(DataFrame.unionByName, [_with_types(silver[n], column_sums(silver[n], n, _KEYS[n])) for n in SILVER])


# Conformed tables of one row for each order or more. Smaller ones are looked up in, and Spark takes the bytes of their files for their size when it decides on a broadcast.
_PACKED = ("opportunities", "order_items", "orders", "payments", "refunds", "shipments")


def _layers(t: Tables) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(conformed tables, star schema), both written."""
    with freed_shuffles(t.spark):
        with ThreadPoolExecutor(4) as pool:  # the last tasks of one table beside the first of the next
            silver = dict(zip(SILVER, pool.map(lambda n: settle(getattr(I, SILVER[n])(t), n, packed=n in _PACKED), SILVER)))
        # an address is clean, and an opportunity and a line have their derived columns, in the conformed layer
        silver["contacts"] = silver["contacts"].withColumn("email", F.lower(F.trim("email")))
        return silver, gold_layer(silver, I.window(t), lambda name, df: settle(df, name, packed=name.startswith("fct_")))


def _gold_relation(name: str) -> str:
    """The SQL of a star-schema table, with one delivery for each order."""
    return SQL[name].replace(WITH["shipments"], WITH["order_shipments"])


@query(
    "gold_all",
    f"WITH cells AS ({' UNION ALL '.join(_cells_sql(n, _gold_relation(n), k) for n, k in GOLD_KEYS.items())}) {_SUMS_SQL}",
)
def gold_all(t: Tables) -> DataFrame:
    """All twelve tables of the star schema, built one from the other and written, every column."""
    _, gold = _layers(t)
    rounded = {"fct_support_tickets": {"hours_to_first_reply": 6}, "mart_customer_360": {"avg_hours_to_first_reply": 6}}
    shown = {n: plain(gold[n], **rounded.get(n, {})) for n in GOLD_KEYS}
    return reduce(DataFrame.unionByName, [column_sums(shown[n], n, k) for n, k in GOLD_KEYS.items()])


# --- declared checks

_CHECKS = [*SILVER_CHECKS, *GUARD_CHECKS, *GOLD_CHECKS]


def _failures_sql(check) -> str:
    t, c = f"t_{check.table}", check.column
    if check.kind == "unique":
        return f"SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
    if check.kind == "not_null":
        return f"SELECT count(*) FROM {t} WHERE {c} IS NULL"
    if check.kind == "accepted_values":
        return f"SELECT count(*) FROM {t} WHERE {c} NOT IN ({', '.join(repr(v) for v in check.values)})"
    if check.kind == "relationships":
        parent, column = check.parent
        return f"SELECT count(*) FROM {t} x WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t_{parent} p WHERE CAST(p.{column} AS VARCHAR) = CAST(x.{c} AS VARCHAR))"
    where = f"({check.where}) AND " if check.where else ""
    return f"SELECT count(*) FROM {t} WHERE {where}NOT ({check.condition})"


def _checks_sql() -> str:
    tables = [f"t_{n} AS (SELECT * FROM s_{s})" for n, s in SILVER.items()] + [f"t_{n} AS ({_gold_relation(n)})" for n in GOLD_KEYS]
    rows = [f"SELECT '{c.table}' AS table_name, '{c.column}' AS column_name, '{c.kind}' AS check_name, ({_failures_sql(c)}) AS failures" for c in _CHECKS]
    return with_sql(" ".join(sorted(set(SILVER.values()))), ", " + ", ".join(tables) + " " + " UNION ALL ".join(rows))


@query("dq_declared", _checks_sql())
def dq_declared(t: Tables) -> DataFrame:
    """Every declared check of both layers, and the guards of the order fact, with one scan of each table."""
    silver, gold = _layers(t)
    return declared_report(silver | gold, _CHECKS)


# --- profiles

_PROFILED = {"dim_customer": "customer_tier", "dim_product": "parent_category_name", "fct_payments": "payment_status"}
_DOCS = {"customer_id": "The customer, as the application numbers it.", "product_sku": "The stock keeping unit.", "payment_status": "What became of the charge."}


def _profile_sql() -> str:
    cells = " UNION ALL ".join(_cells_sql(n, SQL[n], GOLD_KEYS[n]) for n in _PROFILED)
    docs = " ".join(f"WHEN '{c}' THEN '{d}'" for c, d in _DOCS.items())
    return f"""WITH cells AS ({cells}), counted AS (SELECT table_name, column_name, v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL)
      SELECT c.table_name, c.column_name, CASE c.column_name {docs} END AS column_description, count(*) AS row_count,
        (count(*) - count(v)) / count(*)::DOUBLE AS null_fraction, count(DISTINCT v) AS n_distinct_exact, true AS distinct_within, true AS common_right,
        true AS quartiles_within
      FROM cells c GROUP BY ALL"""


@query("catalog_profile_merge", _profile_sql())
def catalog_profile_merge(t: Tables) -> DataFrame:
    """States of every label of three documented tables, merged, and held against exact counts: estimates of distinct values within their bound, the
    most common value with its exact count where all values are tracked, quartiles of numbers at their rank within the bound."""
    path, exact = fresh_path(t.spark, "states"), []
    for name, label in _PROFILED.items():
        rows = settle(P.with_docs(QUERIES[name](t.spark, t.folder), _DOCS), name)
        for value in [r[0] for r in rows.select(label).distinct().collect()]:  # a small vocabulary
            S.store_states(rows.filter(F.col(label).eqNullSafe(F.lit(value))), path, name, str(value))
        cells = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in rows.columns])))
        exact.append(cells.select(F.lit(name).alias("table_name"), "column_name", "v"))
    cells = settle(reduce(DataFrame.unionAll, exact), "cells")
    counted = cells.filter("v IS NOT NULL").groupBy("table_name", "column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_distinct_exact"), F.max("n").alias("most"))
    merged = settle(S.merged_profile(S.stored_states(t.spark, path)), "merged")
    at_most = lambda q: F.count_if(F.expr("try_cast(v AS double)") <= F.col(q)) / F.count("v")
    below = lambda q: F.count_if(F.expr("try_cast(v AS double)") < F.col(q)) / F.count("v")
    ranks = cells.join(merged.select("table_name", "column_name", "first_quartile", "median", "third_quartile"), ["table_name", "column_name"]).groupBy("table_name", "column_name").agg(
        *[((F.any_value(q).isNull()) | ((below(q) <= at + 0.01) & (at_most(q) >= at - 0.01))).alias(f"{q}_ok") for q, at in (("first_quartile", 0.25), ("median", 0.5), ("third_quartile", 0.75))]
    )
    both = merged.join(best, ["table_name", "column_name"], "left").join(ranks, ["table_name", "column_name"])
    distinct = F.coalesce("n_distinct_exact", F.lit(0))
    return both.select(
        "table_name", "column_name", "column_description", "row_count", "null_fraction", distinct.alias("n_distinct_exact"),
        (F.abs(F.col("n_distinct") - distinct) <= S.DISTINCT_ERROR * distinct).alias("distinct_within"),
        ((distinct > S.TRACKED * 3 / 4) | F.coalesce(F.get("common_counts", F.lit(0)) == F.col("most"), F.col("most").isNull())).alias("common_right"),
        (F.col("first_quartile_ok") & F.col("median_ok") & F.col("third_quartile_ok")).alias("quartiles_within"),
    )


@query(
    "table_sizes",
    """SELECT 'orders' AS table_name, 6 AS column_count, (SELECT count(*) FROM orders) AS row_count
       UNION ALL SELECT 'customer', (SELECT count(*) FROM (DESCRIBE customer)), (SELECT count(*) FROM customer)
       UNION ALL SELECT 'events', (SELECT count(*) FROM (DESCRIBE events)), (SELECT count(*) FROM events)""",
)
def table_sizes(t: Tables) -> DataFrame:
    return plain(P.table_sizes({n: getattr(t, n) for n in ("orders", "customer", "events")}))


@query("runs_by_task", f"SELECT task_id, count(*) AS runs FROM ({SQL['agent_runs']}) GROUP BY 1")
def runs_by_task_query(t: Tables) -> DataFrame:
    return runs_by_task(agent_runs(traces._stored(t)))


@query(
    "stem_match",
    "SELECT DISTINCT 'doc-' || l.doc_id AS dag_id FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE d.lang = 'en'",
)
def stem_match(t: Tables) -> DataFrame:
    """Labelled documents that a file is named after; other names only contain them."""
    entities = t.labels.select(F.concat(F.lit("doc-"), text("doc_id")).alias("dag_id")).distinct()
    name = F.when(F.col("lang") == "en", F.concat(F.lit("doc-"), text("doc_id"), F.lit(".py"))).otherwise(F.concat(F.lit("old.doc-"), text("doc_id"), F.lit("0.py")))
    return named_by_file(entities, "dag_id", t.documents.select(F.concat(F.lit("/dags/a.b/"), name).alias("path")), "path")
