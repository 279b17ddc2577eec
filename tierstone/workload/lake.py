"""The whole way of the data: landed as text, conformed, built into the star schema."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.operators.incremental import load_since
from tierstone.plans.build import gold_layer, read_silver
from tierstone.session import freed_shuffles, fresh_path, scratch, settle
from tierstone.sources.bronze import land_tickets, load_bronze, read_bronze
from tierstone.workload import standins as I
from tierstone.workload import star  # noqa: F401  (the SQL of the marts is registered there)
from tierstone.workload.landing import _MARK, _ORDER_TEXT, _order_text
from tierstone.workload.registry import SQL, Tables, query
from tierstone.workload.standins import plain, text


LANDED = {
    "appdb__customers": lambda t: I.customers(t).drop("account_id", "industry", "annual_revenue_credits"),
    "salesforce__accounts": I.accounts,
    "reference__planets": I.planets,
    "reference__moons": I.moons,
    "reference__asteroids": I.asteroids,
    "reference__planetary_hubs": I.hubs,
    "reference__space_stations": I.stations,
    "reference__product_categories": I.product_categories,
    "reference__products": I.products,
    "reference__shipping_routes": I.routes,
    "appdb__orders": I.orders,
    "appdb__order_items": I.order_items,
    "appdb__shipments": I.order_shipments,
    "stripe__charges": I.payments,
    "stripe__refunds": I.refunds,
    "stripe__subscriptions": lambda t: I.subscriptions(t).withColumnRenamed("subscription_status", "status"),
    "zendesk__tickets": I.tickets,
    "zendesk__ticket_comments": I.ticket_comments,
}

# Landed tables of one row for each order or more.
_LARGE = ("appdb__orders", "appdb__order_items", "appdb__shipments", "stripe__charges", "stripe__refunds")

_MARTS = {
    "mart_customer_360": ("customer_id", "order_count", "lifetime_net_credits", "late_delivery_rate"),
    "mart_product_performance": ("product_sku", "units_sold", "revenue_credits", "refund_rate"),
    "mart_route_performance": ("route_id", "shipment_count", "revenue_credits", "on_time_rate"),
}


def _marts_sql() -> str:
    # one delivery per order is landed, not one per line
    return "\nUNION ALL\n".join(
        f"SELECT '{mart}' AS mart, CAST({key} AS VARCHAR) AS id, {n} AS n, {credits} AS credits, {rate} AS rate FROM ("
        + SQL[mart].replace("FROM s_shipments", "FROM s_order_shipments") + ")"
        for mart, (key, n, credits, rate) in _MARTS.items()
    )


@query("landed_marts", _marts_sql())
def landed_marts(t: Tables) -> DataFrame:
    """Eighteen tables landed as text, the conformed layer over them, and the three marts
    over written dimensions and facts, worked out one after the other so that each leaves the room of its shuffles."""
    bronze = fresh_path(t.spark, "bronze")

    def land(name: str) -> int:
        now, mixed, replace_empty, packed = None, False, False, name in _LARGE
        return load_bronze(LANDED[name](t), f"{bronze}/{name}", f"{name}.csv", "run-1", now, mixed, replace_empty, packed)

    with freed_shuffles(t.spark):
        with ThreadPoolExecutor(4) as pool:  # the last tasks of one table beside the first of the next
            list(pool.map(land, LANDED))
        silver = read_silver(t.spark, bronze, LANDED)
        gold = gold_layer(silver, I.window(t), lambda name, df: df if name in _MARTS else settle(df, name, packed=name.startswith("fct_")))
        parts = [
            settle(gold[mart].select(F.lit(mart).alias("mart"), text(key).alias("id"), F.col(n).cast("bigint").alias("n"),
                                     F.col(credits).cast("double").alias("credits"), F.col(rate).cast("double").alias("rate")), mart)
            for mart, (key, n, credits, rate) in _MARTS.items()
        ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- loads that come again -------------------------------------------------------------

_LATE = f"""SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') <= {_MARK}
            AND NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-07-01')"""


@query(
    "late_children",
    f"""SELECT 'orders' AS kind, CAST(o_orderkey AS VARCHAR) AS order_id, NULL AS line FROM orders WHERE o_orderkey IN ({_LATE})
        UNION ALL SELECT 'lines', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR) FROM lineitem
        WHERE l_orderkey IN ({_LATE}) OR (l_linenumber > 5 AND l_orderkey IN (SELECT o_orderkey FROM orders
          WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-07-01'))""",
)
def late_children(t: Tables) -> DataFrame:
    """What a second high-water load leaves in its side tables: orders of an earlier time, their
    lines, and late lines of orders already landed."""
    bronze = fresh_path(t.spark, "bronze")
    lines = t.lineitem.select(
        text("l_orderkey").alias("order_id"), text("l_linenumber").alias("line"), text("l_partkey").alias("part"), text("l_suppkey").alias("supplier")
    )
    first = _order_text(t).filter("order_status = 'F' AND ordered_at < '1998-07-01'")
    load_since(t.spark, bronze, ("orders", first, "ordered_at"), {"lines": lines.filter("line <= 5").join(first.select("order_id"), "order_id", "left_semi")}, "order_id", "run-1")
    load_since(t.spark, bronze, ("orders", _order_text(t), "ordered_at"), {"lines": lines}, "order_id", "run-2")
    orders = read_bronze(t.spark, f"{bronze}/orders__late", ["order_id"]).select(F.lit("orders").alias("kind"), "order_id", F.lit(None).cast("string").alias("line"))
    return orders.unionByName(read_bronze(t.spark, f"{bronze}/lines__late", ["order_id", "line"]).select(F.lit("lines").alias("kind"), "order_id", "line"))


_TICKET_DOCUMENT = """next_cursor string, tickets array<struct<ticket_id string, subject string, ticket_status string, updated_at string,
  comments array<struct<comment_id string, body string, is_public string>>>>"""


DOCUMENTS_A_FILE = 16  # some megabytes


def _export(t: Tables, updated: bool) -> str:
    """Orders as ticket documents, up to a thousand order keys in each; their lines are comments. A file is
    an array of documents, so that a large export is no folder of small files. In the updated export urgent orders are solved and have one comment more."""
    document = lambda key: F.floor(F.col(key) / 1000)
    file = lambda key: F.floor(document(key) / DOCUMENTS_A_FILE).alias("file")
    orders = t.orders.select(file("o_orderkey"), F.col("o_orderkey").alias("number"), F.lit(True).alias("is_order"), "o_orderpriority")
    lines = t.lineitem.filter("l_orderkey IS NOT NULL").select(
        file("l_orderkey"), F.col("l_orderkey").alias("number"), F.lit(False).alias("is_order"), "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"
    )
    # orders and lines move once, as numbers, to the task that writes their file; all groups below lie within it
    rows = orders.unionByName(lines, allowMissingColumns=True).repartition("file")
    comment = F.struct(F.concat_ws("-", "number", "l_linenumber", "l_partkey", "l_suppkey").alias("comment_id"), F.col("l_linestatus").alias("body"), F.lit("true").alias("is_public"))
    said = rows.groupBy("file", "number").agg(
        F.collect_list(F.when(F.col("is_order"), F.struct("o_orderpriority"))).alias("orders"), F.collect_list(F.when(~F.col("is_order"), comment)).alias("lines")
    )
    urgent = F.lit(updated) & (F.col("order.o_orderpriority") == "1-URGENT")
    closing = F.array(F.struct(F.concat_ws("-", "number", F.lit("closing")).alias("comment_id"), F.lit("solved").alias("body"), F.lit("true").alias("is_public")))
    tickets = said.select("file", "number", "lines", F.explode("orders").alias("order")).select(
        "file",
        document("number").alias("document"),
        F.struct(
            text("number").alias("ticket_id"),
            F.col("order.o_orderpriority").alias("subject"),
            F.when(urgent, "solved").otherwise("open").alias("ticket_status"),
            F.when(urgent, "2026-03-09T00:00:00Z").otherwise("2026-03-01T00:00:00Z").alias("updated_at"),
            F.when(urgent, F.concat("lines", closing)).otherwise(F.col("lines")).alias("comments"),
        ).alias("ticket"),
    )
    documents = tickets.groupBy("file", "document").agg(
        F.max("ticket.updated_at").alias("next_cursor"), F.collect_list("ticket").alias("tickets")
    )
    said = documents.select("file", F.to_json(F.struct("next_cursor", "tickets")).alias("text"))
    files = said.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("text"), ","), F.lit("]")).alias("value"))
    path = fresh_path(t.spark, "tickets")
    files.select("value").write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)
    return path


@query(
    "tickets_cursor",
    """SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'solved' ELSE 'open' END AS ticket_status,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '2026-03-09 00:00:00' ELSE '2026-03-01 00:00:00' END AS updated_at,
         coalesce(n, 0) + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS comments
       FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def tickets_cursor(t: Tables) -> DataFrame:
    """A full load, then a load after the cursor that brings updated tickets again: one row
    per ticket in its newest version, each comment once."""
    bronze = fresh_path(t.spark, "bronze")
    places = f"{bronze}/zendesk__tickets", f"{bronze}/zendesk__ticket_comments"
    with freed_shuffles(t.spark):
        with scratch(t.spark):  # an export goes once it is landed
            first = land_tickets(t.spark, _export(t, False), *places, "run-1", _TICKET_DOCUMENT)
        with scratch(t.spark):
            land_tickets(t.spark, _export(t, True), *places, "run-2", _TICKET_DOCUMENT, cursor=first["next_cursor"])
    silver = read_silver(t.spark, bronze, ("zendesk__tickets", "zendesk__ticket_comments"))
    said = silver["ticket_comments"].groupBy("ticket_id").agg(F.count("comment_id").alias("comments"))
    return plain(
        silver["tickets"].join(said, "ticket_id", "left").select(
            "ticket_id", "ticket_status", "updated_at", F.coalesce("comments", F.lit(0)).alias("comments")
        )
    )
