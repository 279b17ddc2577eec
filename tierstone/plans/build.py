"""Landed tables to a written star schema."""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.operators.profile import with_docs
from tierstone.operators.results import bounded_result
from tierstone.plans import gold as G
from tierstone.plans.silver import SOURCES, silver_layer
from tierstone.session import scratch
from tierstone.sources.bronze import current, read_bronze

# The data window of the domain.
WINDOW_START, WINDOW_END = "2026-03-01", "2026-08-31"


# landed tables in which an update lands beside the row it replaces: key, version column
VERSIONED = {"zendesk__tickets": ("ticket_id", "updated_at"), "zendesk__ticket_comments": ("comment_id", None)}


def read_silver(spark: SparkSession, bronze: str, only: Collection[str] | None = None) -> dict[str, DataFrame]:
    """The conformed layer over the landed tables below a folder, or over some of them,
    all of it lazy. Tickets and comments that landed again count in their newest version."""
    landed = {src: read_bronze(spark, f"{bronze}/{src}", cols) for src, cols in SOURCES.items() if only is None or src in only}
    for src, (key, version) in VERSIONED.items():
        if src in landed:
            landed[src] = current(landed[src], key, version)
    return silver_layer(landed)


def data_window(spark: SparkSession, start: str = WINDOW_START, end: str = WINDOW_END) -> DataFrame:
    return spark.range(1).select(
        F.lit(start).cast("date").alias("window_start"), F.lit(end).cast("date").alias("window_end")
    )


def gold_layer(s: dict[str, DataFrame], window: DataFrame, keep=lambda name, df: df) -> dict[str, DataFrame]:
    """All twelve tables. keep(name, df) may write a table and hand back the written
    one; dimensions and facts pass through it before the marts read them."""
    g: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> None:
        g[name] = keep(name, df)

    add("dim_date", G.dim_date(window))
    add("dim_customer", G.dim_customer(s["customers"], s["planets"]))
    add("dim_product", G.dim_product(s["products"], s["product_categories"]))
    add("dim_location", G.dim_location(*[s[n] for n in ("hubs", "stations", "planets", "moons", "asteroids")]))
    add(
        "fct_orders",
        G.fct_orders(*[s[n] for n in ("orders", "order_items", "payments", "refunds", "shipments", "routes")]),
    )
    add("fct_order_items", G.fct_order_items(s["order_items"], s["orders"], s["products"]))
    add("fct_payments", G.fct_payments(s["payments"], s["refunds"]))
    add("fct_shipments", G.fct_shipments(s["shipments"], s["orders"], s["routes"]))
    add("fct_support_tickets", G.fct_support_tickets(s["tickets"], s["ticket_comments"], s["products"]))
    add(
        "mart_customer_360",
        G.mart_customer_360(
            g["dim_customer"], g["dim_date"], g["fct_orders"], g["fct_support_tickets"], g["fct_order_items"],
            s["product_categories"], s["subscriptions"],
        ),
    )
    add(
        "mart_product_performance",
        G.mart_product_performance(g["dim_product"], g["fct_order_items"], g["fct_orders"], g["fct_support_tickets"]),
    )
    add(
        "mart_route_performance",
        G.mart_route_performance(s["routes"], g["fct_shipments"], g["fct_orders"], g["dim_location"]),
    )
    return g


def build_gold(
    spark: SparkSession, s: dict[str, DataFrame], out: str, window: DataFrame | None = None,
    docs: dict[str, dict[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """Write the star schema below `out`, column comments included."""

    def write(name: str, df: DataFrame) -> DataFrame:
        path = f"{out}/{name}"
        with_docs(df, (docs or {}).get(name, {})).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    with scratch(spark):
        return gold_layer(s, data_window(spark) if window is None else window, write)


def ask(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A SELECT over the written tables, each visible under its name, within the caps of
    bounded_result. Rows come in the order of their columns where the SELECT gives none.
    Statements that write or change anything are refused before they run."""
    spark = next(iter(tables.values())).sparkSession
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
    if not re.match(r"[\s(]*(select|with|values|from|table)\b", sql, re.I) or re.search(r"(?m)^[\s:+|-]*'?(Insert|Merge|Update|Delete|\w+Command)", parsed):
        raise ValueError("only a SELECT can be asked")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    result = spark.sql(sql)
    return bounded_result(result, [F.col(f"`{c}`") for c in result.columns])


def same_under_any_clock(build, first_now: str, second_now: str) -> bool:
    """Whether build(now) gives the same rows at two times, which no table that reads
    the clock does."""
    one, two = build(first_now), build(second_now)
    return one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
