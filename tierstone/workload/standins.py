"""The driver tables in the shape of the conformed tables, in Spark and in SQL.

Every stand-in is a projection or grouping of a whole driver table; WITH holds the same
relation as a SQL common table expression of the same name prefixed by s_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import whole_days_between
from tierstone.workload.registry import Tables

MONEY = "decimal(18,2)"
WITH: dict[str, str] = {}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """body preceded by the named stand-ins; a body that starts with a comma adds more."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(f"s_{n} AS ({WITH[n]})" for n in names.split()) + "\n" + body


def plain(df: DataFrame, **rounded: int) -> DataFrame:
    """Values as both engines print them: whole numbers as bigint, decimals as double,
    dates and times as text."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if f.name in rounded:
            c = F.round(c, rounded[f.name])
        out.append(c.alias(f.name))
    return df.select(*out)


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def choose(c: str, mapping: dict, otherwise=None) -> Column:
    """CASE c WHEN key THEN value ... ELSE otherwise."""
    out = None
    for key, value in mapping.items():
        out = F.when(F.col(c) == key, value) if out is None else out.when(F.col(c) == key, value)
    return out.otherwise(otherwise)


def bands(c: str | Column, limits: list[tuple[float, object]], top) -> Column:
    """The label of the first limit the value is below, else top."""
    value = F.col(c) if isinstance(c, str) else c
    out = None
    for limit, label in limits:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out.otherwise(top)


# --- parties, places, products -------------------------------------------------------

WITH["customers"] = """
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS company_name, CAST(NULL AS VARCHAR) AS contact_name,
         lower(c_name) || '@example.com' AS email,
         CASE WHEN c_acctbal < 0 THEN 'bronze' WHEN c_acctbal < 3000 THEN 'silver'
              WHEN c_acctbal < 6000 THEN 'gold' ELSE 'platinum' END AS customer_tier,
         c_nationkey AS home_planet_id, CAST(DATE '1995-01-01' + c_nationkey AS DATE) AS signup_date,
         c_acctbal >= 0 AS is_active,
         CASE WHEN c_acctbal >= 0 THEN 'acct-' || c_custkey END AS account_id,
         CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS industry,
         CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS annual_revenue_credits
  FROM customer"""


def customers(t: Tables) -> DataFrame:
    solvent = F.col("c_acctbal") >= 0
    return t.customer.select(
        text("c_custkey").alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.lit(None).cast("string").alias("contact_name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        bands("c_acctbal", [(0, "bronze"), (3000, "silver"), (6000, "gold")], "platinum").alias("customer_tier"),
        F.col("c_nationkey").alias("home_planet_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_nationkey")).alias("signup_date"),
        solvent.alias("is_active"),
        F.when(solvent, F.concat(F.lit("acct-"), text("c_custkey"))).alias("account_id"),
        F.when(solvent, F.col("c_mktsegment")).alias("industry"),
        F.when(solvent, money("c_acctbal")).alias("annual_revenue_credits"),
    )


WITH["planets"] = """
  SELECT n_nationkey AS planet_id, n_name AS planet_name, 'region-' || n_regionkey AS planet_type,
         n_regionkey <> 0 AS is_habitable FROM nation"""


def planets(t: Tables) -> DataFrame:
    return t.nation.select(
        F.col("n_nationkey").alias("planet_id"),
        F.col("n_name").alias("planet_name"),
        F.concat(F.lit("region-"), text("n_regionkey")).alias("planet_type"),
        (F.col("n_regionkey") != 0).alias("is_habitable"),
    )


WITH["hubs"] = """
  SELECT r_regionkey AS hub_id, r_name AS hub_name, 'regional' AS hub_type, r_regionkey AS planet_id,
         1000 * (r_regionkey + 1) AS capacity_tonnes, r_regionkey <> 4 AS is_operational FROM region"""


def hubs(t: Tables) -> DataFrame:
    return t.region.select(
        F.col("r_regionkey").alias("hub_id"),
        F.col("r_name").alias("hub_name"),
        F.lit("regional").alias("hub_type"),
        F.col("r_regionkey").alias("planet_id"),
        (1000 * (F.col("r_regionkey") + 1)).alias("capacity_tonnes"),
        (F.col("r_regionkey") != 4).alias("is_operational"),
    )


WITH["stations"] = """
  SELECT s_suppkey AS station_id, s_name AS station_name, 'supplier' AS station_type, s_nationkey AS planet_id,
         CAST(floor(s_acctbal) AS INTEGER) AS capacity_tonnes, s_acctbal >= 0 AS is_operational FROM supplier"""


def stations(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("station_id"),
        F.col("s_name").alias("station_name"),
        F.lit("supplier").alias("station_type"),
        F.col("s_nationkey").alias("planet_id"),
        F.floor("s_acctbal").cast("int").alias("capacity_tonnes"),
        (F.col("s_acctbal") >= 0).alias("is_operational"),
    )


WITH["moons"] = "SELECT c_custkey AS moon_id, c_name AS moon_name, c_nationkey AS planet_id FROM customer"


def moons(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("moon_id"), F.col("c_name").alias("moon_name"), F.col("c_nationkey").alias("planet_id")
    )


WITH["asteroids"] = "SELECT p_partkey AS asteroid_id, p_name AS asteroid_name, p_brand AS asteroid_belt FROM part"


def asteroids(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("asteroid_id"),
        F.col("p_name").alias("asteroid_name"),
        F.col("p_brand").alias("asteroid_belt"),
    )


WITH["product_categories"] = """
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS category_id, p_brand AS category_name,
         CAST(101 + floor((CAST(substr(p_brand, 7) AS INTEGER) - 1) / 5) AS INTEGER) AS parent_category_id FROM part
  UNION ALL
  SELECT DISTINCT CAST(101 + floor((CAST(substr(p_brand, 7) AS INTEGER) - 1) / 5) AS INTEGER),
         'Maker#' || CAST(1 + floor((CAST(substr(p_brand, 7) AS INTEGER) - 1) / 5) AS INTEGER), NULL FROM part"""


def product_categories(t: Tables) -> DataFrame:
    brand = F.substring("p_brand", 7, 10).cast("int")
    maker = F.floor((brand - 1) / 5).cast("int")
    brands = t.part.select("p_brand").distinct()
    leaves = brands.select(
        brand.alias("category_id"), F.col("p_brand").alias("category_name"), (maker + 101).alias("parent_category_id")
    )
    roots = brands.select(
        (maker + 101).alias("category_id"),
        F.concat(F.lit("Maker#"), text(maker + 1)).alias("category_name"),
        F.lit(None).cast("int").alias("parent_category_id"),
    ).distinct()
    return leaves.unionByName(roots)


WITH["products"] = """
  SELECT CAST(p_partkey AS VARCHAR) AS product_sku, p_partkey AS product_id, p_name AS product_name,
         CAST(substr(p_brand, 7) AS INTEGER) AS category_id, p_type AS description,
         CAST(p_size AS DECIMAL(12,2)) AS weight_kg, CAST(NULL AS VARCHAR) AS dimensions_cm,
         p_type = 'PROMO' AS is_hazardous, p_name LIKE 'cold%' AS requires_cold_chain,
         CAST(p_retailprice AS DECIMAL(18,2)) AS base_price_credits, p_size <= 45 AS is_active FROM part"""


def products(t: Tables) -> DataFrame:
    return t.part.select(
        text("p_partkey").alias("product_sku"),
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.substring("p_brand", 7, 10).cast("int").alias("category_id"),
        F.col("p_type").alias("description"),
        F.col("p_size").cast("decimal(12,2)").alias("weight_kg"),
        F.lit(None).cast("string").alias("dimensions_cm"),
        (F.col("p_type") == "PROMO").alias("is_hazardous"),
        F.col("p_name").startswith("cold").alias("requires_cold_chain"),
        money("p_retailprice").alias("base_price_credits"),
        (F.col("p_size") <= 45).alias("is_active"),
    )


WITH["routes"] = """
  SELECT CAST(s_suppkey AS INTEGER) AS route_id, s_name AS route_name, s_nationkey AS origin_hub_id,
         CASE WHEN s_acctbal >= 0 THEN s_nationkey - 20 END AS destination_hub_id,
         CAST(s_acctbal AS DECIMAL(12,2)) AS distance_million_km,
         CAST(20 + s_nationkey AS DECIMAL(8,2)) AS avg_transit_days,
         CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS fuel_cost_credits,
         CASE WHEN s_acctbal < 0 THEN 'extreme' WHEN s_acctbal < 3000 THEN 'high'
              WHEN s_acctbal < 6000 THEN 'medium' ELSE 'low' END AS risk_level FROM supplier"""


def routes(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").cast("int").alias("route_id"),
        F.col("s_name").alias("route_name"),
        F.col("s_nationkey").alias("origin_hub_id"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey") - 20).alias("destination_hub_id"),
        F.col("s_acctbal").cast("decimal(12,2)").alias("distance_million_km"),
        (F.col("s_nationkey") + 20).cast("decimal(8,2)").alias("avg_transit_days"),
        money(F.abs("s_acctbal")).alias("fuel_cost_credits"),
        bands("s_acctbal", [(0, "extreme"), (3000, "high"), (6000, "medium")], "low").alias("risk_level"),
    )


WITH["accounts"] = """
  SELECT 'acct-' || c_custkey AS account_id, CAST(c_custkey AS VARCHAR) AS customer_id, c_mktsegment AS industry,
         CAST(c_acctbal AS DECIMAL(18,2)) AS annual_revenue_credits FROM customer WHERE c_acctbal >= 0"""


def accounts(t: Tables) -> DataFrame:
    held = customers(t).filter("account_id IS NOT NULL")
    return held.select("account_id", "customer_id", "industry", "annual_revenue_credits")


# Customers are the contacts of the solvent ones of their number or of none.
WITH["contacts"] = """
  SELECT 'contact-' || c_custkey AS contact_id, 'acct-' || c_custkey AS account_id, c_name AS contact_name,
         lower(trim('  ' || c_name || '@Example.com ')) AS email, CAST(DATE '1995-01-01' + c_nationkey AS DATE) AS created_date FROM customer"""


def contacts(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("contact-"), text("c_custkey")).alias("contact_id"),
        F.concat(F.lit("acct-"), text("c_custkey")).alias("account_id"),
        F.col("c_name").alias("contact_name"),
        F.concat(F.lit("  "), "c_name", F.lit("@Example.com ")).alias("email"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_nationkey")).alias("created_date"),
    )


WITH["opportunities"] = """
  SELECT 'opp-' || o_orderkey AS opportunity_id, 'acct-' || o_custkey AS account_id, o_orderpriority AS opportunity_name,
         CASE o_orderstatus WHEN 'F' THEN 'closed_won' WHEN 'O' THEN 'proposal' ELSE 'on_hold' END AS stage,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount_credits, CAST(o_custkey % 101 AS INTEGER) AS probability,
         CAST(o_orderdate AS DATE) AS close_date, o_orderstatus = 'F' AS is_won FROM orders"""


def opportunities(t: Tables) -> DataFrame:
    return t.orders.select(
        F.concat(F.lit("opp-"), text("o_orderkey")).alias("opportunity_id"),
        F.concat(F.lit("acct-"), text("o_custkey")).alias("account_id"),
        F.col("o_orderpriority").alias("opportunity_name"),
        choose("o_orderstatus", {"F": "closed_won", "O": "proposal"}, "on_hold").alias("stage"),
        money("o_totalprice").alias("amount_credits"),
        (F.col("o_custkey") % 101).cast("int").alias("probability"),
        F.col("o_orderdate").cast("date").alias("close_date"),
    )


WITH["suppliers"] = """
  SELECT CAST(s_suppkey AS INTEGER) AS supplier_id, s_name AS supplier_name, 'code-' || s_nationkey AS supplier_code,
         lower(s_name) || '@example.com' AS contact_email, CAST(30 + s_nationkey AS INTEGER) AS payment_terms_days, s_acctbal >= 0 AS is_active
  FROM supplier"""


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").cast("int").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("code-"), text("s_nationkey")).alias("supplier_code"),
        F.concat("s_name", F.lit("@Example.com")).alias("contact_email"),
        (F.col("s_nationkey") + 30).cast("int").alias("payment_terms_days"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
    )


# --- orders, lines, money, deliveries --------------------------------------------------

# One delivery per order: it leaves with the first line and takes 23 hours per unit of
# its largest line; it is still under way while any line is open.
WITH["order_shipments"] = """
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, 'sh-' || l_orderkey AS shipment_id,
         CAST(min(l_suppkey) AS INTEGER) AS route_id, min(l_shipdate) AS shipped_at,
         CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'F'
              THEN min(l_shipdate) + to_hours(CAST(23 * max(l_quantity) AS BIGINT)) END AS delivered_at,
         CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'F'
              THEN CAST(floor(23 * max(l_quantity) / 24) AS INTEGER) END AS delivery_days,
         CASE WHEN min(l_linestatus) = 'F' AND max(l_linestatus) = 'F' THEN 'delivered' ELSE 'in_transit' END
           AS shipment_status
  FROM lineitem GROUP BY l_orderkey"""


def order_shipments(t: Tables) -> DataFrame:
    # grouped by the text key the orders are joined on: one exchange serves both
    grouped = t.lineitem.groupBy(text("l_orderkey").alias("order_id")).agg(
        F.min("l_suppkey").cast("int").alias("route_id"),
        F.min("l_shipdate").cast("timestamp").alias("shipped_at"),
        F.max("l_quantity").alias("_units"),
        F.min((F.col("l_linestatus") == "F").cast("int")).alias("_closed"),
    )
    done = F.col("_closed") == 1
    arrival = F.timestamp_micros(
        F.unix_micros("shipped_at") + (F.col("_units") * 23).cast("bigint") * F.lit(3_600_000_000)
    )
    return grouped.withColumn("delivered_at", F.when(done, arrival)).select(
        "order_id",
        F.concat(F.lit("sh-"), "order_id").alias("shipment_id"),
        "route_id",
        "shipped_at",
        "delivered_at",
        whole_days_between("shipped_at", "delivered_at").alias("delivery_days"),
        F.when(done, "delivered").otherwise("in_transit").alias("shipment_status"),
    )


# Deliveries line by line.
WITH["shipments"] = """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS shipment_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_suppkey AS INTEGER) AS route_id, l_shipdate AS shipped_at,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_hours(CAST(23 * l_quantity AS BIGINT)) END AS delivered_at,
         CASE WHEN l_linestatus = 'F' THEN CAST(floor(23 * l_quantity / 24) AS INTEGER) END AS delivery_days,
         CASE WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'in_transit' END AS shipment_status FROM lineitem"""


def shipments(t: Tables) -> DataFrame:
    done = F.col("l_linestatus") == "F"
    left = F.col("l_shipdate").cast("timestamp")
    arrival = F.timestamp_micros(F.unix_micros(left) + (F.col("l_quantity") * 23).cast("bigint") * F.lit(3_600_000_000))
    return t.lineitem.select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("shipment_id"),
        text("l_orderkey").alias("order_id"),
        F.col("l_suppkey").cast("int").alias("route_id"),
        left.alias("shipped_at"),
        F.when(done, arrival).alias("delivered_at"),
        F.when(done, "delivered").otherwise("in_transit").alias("shipment_status"),
    ).withColumn("delivery_days", whole_days_between("shipped_at", "delivered_at"))


WITH["orders"] = """
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'placed' ELSE 'cancelled' END AS order_status,
         o_orderdate AS ordered_at, r.route_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS destination_hub_id,
         CASE o_orderpriority WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS destination_station_id,
         o_orderpriority AS destination_name, CAST(o_totalprice AS DECIMAL(18,2)) AS revenue_credits
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(min(l_suppkey) AS INTEGER) AS route_id FROM lineitem GROUP BY l_orderkey) r
       ON r.l_orderkey = o_orderkey"""


def orders(t: Tables) -> DataFrame:
    """Orders on the route of their first supplier; an order without lines has none."""
    lead = t.lineitem.groupBy(text("l_orderkey").alias("order_id")).agg(
        F.min("l_suppkey").cast("int").alias("route_id")
    )
    return plain_orders(t).drop("route_id").join(lead, "order_id", "left")


WITH["plain_orders"] = WITH["orders"].partition("FROM orders LEFT JOIN")[0].replace("r.route_id", "NULL AS route_id") + "FROM orders"


def plain_orders(t: Tables) -> DataFrame:
    """Orders where no route is needed."""
    return t.orders.select(
        text("o_orderkey").alias("order_id"),
        text("o_custkey").alias("customer_id"),
        choose("o_orderstatus", {"F": "delivered", "O": "placed"}, "cancelled").alias("order_status"),
        F.col("o_orderdate").cast("timestamp").alias("ordered_at"),
        F.lit(None).cast("int").alias("route_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).alias("destination_hub_id"),
        choose("o_orderpriority", {"2-HIGH": 2, "3-MEDIUM": 3}).alias("destination_station_id"),
        F.col("o_orderpriority").alias("destination_name"),
        money("o_totalprice").alias("revenue_credits"),
    )


WITH["order_items"] = """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS order_item_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_sku,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price_credits,
         CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(18,2)) AS line_revenue_credits FROM lineitem"""


def order_items(t: Tables) -> DataFrame:
    units, price = F.col("l_quantity").cast("int"), money("l_extendedprice")
    return t.lineitem.select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("order_item_id"),
        text("l_orderkey").alias("order_id"),
        text("l_partkey").alias("product_sku"),
        units.alias("quantity"),
        price.alias("unit_price_credits"),
        (units * price).alias("line_revenue_credits"),
    )


WITH["payments"] = """
  SELECT 'ch-' || o_orderkey AS charge_id, CAST(o_orderkey AS VARCHAR) AS order_id,
         CAST(o_custkey AS VARCHAR) AS customer_id, 'ev-' || o_orderkey AS event_id,
         CASE o_orderstatus WHEN 'F' THEN 'charge.succeeded' WHEN 'O' THEN 'charge.pending' ELSE 'charge.failed' END
           AS event_type,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount_credits, 'CR' AS currency,
         CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'failed' END AS payment_status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'invoice' ELSE 'transfer' END
           AS payment_method, o_orderdate AS charged_at
  FROM orders WHERE o_orderpriority <> '5-LOW'"""


def payments(t: Tables) -> DataFrame:
    outcome = choose("o_orderstatus", {"F": "succeeded", "O": "pending"}, "failed")
    return t.orders.filter("o_orderpriority <> '5-LOW'").select(
        F.concat(F.lit("ch-"), text("o_orderkey")).alias("charge_id"),
        text("o_orderkey").alias("order_id"),
        text("o_custkey").alias("customer_id"),
        F.concat(F.lit("ev-"), text("o_orderkey")).alias("event_id"),
        F.concat(F.lit("charge."), outcome).alias("event_type"),
        money("o_totalprice").alias("amount_credits"),
        F.lit("CR").alias("currency"),
        outcome.alias("payment_status"),
        choose("o_orderpriority", {"1-URGENT": "card", "2-HIGH": "invoice"}, "transfer").alias("payment_method"),
        F.col("o_orderdate").cast("timestamp").alias("charged_at"),
    )


WITH["refunds"] = """
  SELECT 're-' || l_orderkey || '-' || l_linenumber AS refund_id, 'ch-' || l_orderkey AS charge_id,
         CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_credits
  FROM lineitem WHERE l_returnflag = 'R'"""


def refunds(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select(
        F.concat(F.lit("re-"), text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("refund_id"),
        F.concat(F.lit("ch-"), text("l_orderkey")).alias("charge_id"),
        text("l_orderkey").alias("order_id"),
        money("l_extendedprice").alias("amount_credits"),
    )


# --- support and subscriptions out of the event stream --------------------------------

WITH["tickets"] = """
  SELECT CAST(event_id AS VARCHAR) AS ticket_id, CAST(user_id AS VARCHAR) AS customer_id,
         CAST(NULL AS VARCHAR) AS order_id, nullif(json_extract_string(props, '$.k'), '0') AS product_sku,
         'error of ' || user_id AS subject, props AS body,
         CASE WHEN value < 20 THEN 'new' WHEN value < 60 THEN 'open' WHEN value < 120 THEN 'solved' ELSE 'closed' END
           AS ticket_status,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 25 THEN 'low'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'normal'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 75 THEN 'high' ELSE 'urgent' END AS priority,
         'events' AS channel, ts AS created_at, ts AS updated_at,
         CAST(1 + floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 20) AS INTEGER) AS satisfaction_rating,
         length(props) AS body_chars
  FROM events WHERE event_type = 'error'"""


def tickets(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    at = F.col("ts").cast("timestamp")
    return t.events.filter("event_type = 'error'").select(
        text("event_id").alias("ticket_id"),
        text("user_id").alias("customer_id"),
        F.lit(None).cast("string").alias("order_id"),
        F.nullif(k, F.lit("0")).alias("product_sku"),
        F.concat(F.lit("error of "), text("user_id")).alias("subject"),
        F.col("props").alias("body"),
        bands("value", [(20, "new"), (60, "open"), (120, "solved")], "closed").alias("ticket_status"),
        bands(k.cast("int"), [(25, "low"), (50, "normal"), (75, "high")], "urgent").alias("priority"),
        F.lit("events").alias("channel"),
        at.alias("created_at"),
        at.alias("updated_at"),
        (F.floor(k.cast("int") / 20) + 1).cast("int").alias("satisfaction_rating"),
        F.length("props").alias("body_chars"),
    )


# A view or click comments on the event above it in the tree of spans(); clicks are agents.
WITH["ticket_comments"] = """
  SELECT 'c' || event_id AS comment_id, CAST(CAST(floor((event_id - 1) / 3) AS BIGINT) AS VARCHAR) AS ticket_id,
         CASE event_type WHEN 'click' THEN 'agent' ELSE 'customer' END AS author_role, props AS body, ts AS created_at
  FROM events WHERE event_type IN ('click', 'view') AND event_id >= 3"""


def ticket_comments(t: Tables) -> DataFrame:
    return t.events.filter("event_type IN ('click', 'view') AND event_id >= 3").select(
        F.concat(F.lit("c"), text("event_id")).alias("comment_id"),
        text(F.floor((F.col("event_id") - 1) / 3)).alias("ticket_id"),
        choose("event_type", {"click": "agent"}, "customer").alias("author_role"),
        F.col("props").alias("body"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


WITH["subscriptions"] = """
  SELECT CAST(event_id AS VARCHAR) AS subscription_id, CAST(user_id AS VARCHAR) AS customer_id,
         CAST(value AS DECIMAL(18,2)) AS amount_credits,
         CASE WHEN value < 30 THEN 'active' WHEN value < 60 THEN 'past_due' ELSE 'canceled' END AS subscription_status
  FROM events WHERE event_type = 'signup'"""


def subscriptions(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'signup'").select(
        text("event_id").alias("subscription_id"),
        text("user_id").alias("customer_id"),
        money("value").alias("amount_credits"),
        bands("value", [(30, "active"), (60, "past_due")], "canceled").alias("subscription_status"),
    )


WITH["window"] = """
  SELECT (SELECT CAST(min(o_orderdate) AS DATE) FROM orders) AS window_start,
         (SELECT CAST(max(ts) AS DATE) FROM events) AS window_end"""


def window(t: Tables) -> DataFrame:
    """From the first order to the last event."""
    bounds = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("a"), F.lit(None).cast("date").alias("b")).unionAll(
        t.events.agg(F.lit(None).cast("date").alias("a"), F.to_date(F.max("ts")).alias("b"))
    )
    return bounds.agg(F.max("a").alias("window_start"), F.max("b").alias("window_end"))


# --- threads ---------------------------------------------------------------------------

WITH["threads"] = """
  SELECT CAST(conv_id AS VARCHAR) AS ticket_id, CAST(NULL AS VARCHAR) AS customer_id,
         nullif(role, 'system') AS product_sku, 'thread ' || conv_id AS subject, text AS body
  FROM conversations WHERE turn = 0"""


def threads(t: Tables) -> DataFrame:
    return t.conversations.filter("turn = 0").select(
        text("conv_id").alias("ticket_id"),
        F.lit(None).cast("string").alias("customer_id"),
        F.nullif("role", F.lit("system")).alias("product_sku"),
        F.concat(F.lit("thread "), text("conv_id")).alias("subject"),
        F.col("text").alias("body"),
    )


WITH["replies"] = """
  SELECT conv_id || '-' || turn AS comment_id, CAST(conv_id AS VARCHAR) AS ticket_id, role AS author_role, text AS body,
         TIMESTAMP '2026-03-01' + to_minutes(turn) AS created_at FROM conversations WHERE turn > 0"""


def replies(t: Tables) -> DataFrame:
    start = F.unix_micros(F.lit("2026-03-01").cast("timestamp"))
    return t.conversations.filter("turn > 0").select(
        F.concat(text("conv_id"), F.lit("-"), text("turn")).alias("comment_id"),
        text("conv_id").alias("ticket_id"),
        F.col("role").alias("author_role"),
        F.col("text").alias("body"),
        F.timestamp_micros(start + F.col("turn") * 60_000_000).alias("created_at"),
    )


# --- spans -----------------------------------------------------------------------------

# A forest of events: three children under each, the first three are roots. Sign-ups are
# agent runs, clicks tool calls, views model calls, purchases the tasks above them.
WITH["spans"] = """
  SELECT 't0' AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
         CASE WHEN event_id >= 3 THEN CAST(CAST(floor((event_id - 1) / 3) AS BIGINT) AS VARCHAR) END AS parent_span_id,
         CASE event_type WHEN 'signup' THEN 'invoke_agent ' || user_id WHEN 'click' THEN 'execute_tool t'
              WHEN 'view' THEN 'chat m' WHEN 'purchase' THEN 'task' ELSE 'other' END AS name,
         epoch_us(ts) * 1000 AS start_unix_nano,
         CAST(round_even(CAST(value AS DECIMAL(18,2)), 1) AS DOUBLE) AS duration_ms,
         'svc-' || user_id AS service_name, event_id, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events"""


def _attr(key: str, value: Column, kind: str = "stringValue") -> Column:
    """One OTLP attribute; the three value kinds share one struct so arrays line up."""
    kinds = ("stringValue", "intValue", "arrayValue")
    shapes = {"stringValue": "string", "intValue": "string", "arrayValue": "struct<values:array<struct<stringValue:string>>>"}
    return F.struct(
        F.lit(key).alias("key"),
        F.struct(*[(value if k == kind else F.lit(None)).cast(shapes[k]).alias(k) for k in kinds]).alias("value"),
    )


def span_lines(t: Tables) -> DataFrame:
    """The events as OTLP JSON lines, one span per line; tasks use the snake_case keys."""
    k = F.get_json_object("props", "$.k")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    end = start + F.round(F.col("value") * 1000).cast("bigint") * 1000
    parent = F.when(F.col("event_id") >= 3, text(F.floor((F.col("event_id") - 1) / 3)))
    name = choose(
        "event_type",
        {
            "signup": F.concat(F.lit("invoke_agent "), text("user_id")),
            "click": F.lit("execute_tool t"),
            "view": F.lit("chat m"),
            "purchase": F.lit("task"),
        },
        "other",
    )
    definitions = F.concat(F.lit('[{"name":"tool-'), k, F.lit('"},{"name":"tool-'), text("user_id"), F.lit('"},{"x":1}]'))
    none = F.array().cast(
        "array<struct<key:string,value:struct<stringValue:string,intValue:string,"
        "arrayValue:struct<values:array<struct<stringValue:string>>>>>>"
    )
    listed = (
        F.when(
            F.col("event_type") == "signup",
            F.array(
                _attr("gen_ai.operation.name", F.lit("invoke_agent")),
                _attr("model_name", F.lit("overwritten")),
                _attr("model_name", F.concat(F.lit("m-"), text(F.col("user_id") % 7))),
                _attr("gen_ai.usage.input_tokens", k, "intValue"),
                _attr("gen_ai.aggregated_usage.output_tokens", text("user_id"), "intValue"),
                _attr("final_result", F.col("props")),
                _attr("tags", F.struct(F.array(F.struct(F.lit("a").alias("stringValue")), F.struct(k.alias("stringValue"))).alias("values")), "arrayValue"),
            ),
        )
        .when(
            F.col("event_type") == "click",
            F.array(
                _attr("gen_ai.operation.name", F.lit("execute_tool")),
                _attr("gen_ai.tool.name", F.concat(F.lit("tool-"), k)),
            ),
        )
        .when(F.col("event_type") == "view", F.array(_attr("gen_ai.tool.definitions", definitions)))
        .when(
            F.col("event_type") == "purchase",
            F.array(
                _attr("airflow.dag_id", F.concat(F.lit("d-"), text("user_id"))),
                _attr("airflow.task_id", F.lit("answer_question")),
                _attr("airflow.dag_run.run_id", F.concat(F.lit("r-"), text("event_id"))),
                _attr("airflow.task_instance.try_number", k, "intValue"),
            ),
        )
        .otherwise(none)
    )
    service = F.array(
        F.struct(
            F.lit("service.name").alias("key"),
            F.struct(F.concat(F.lit("svc-"), text("user_id")).alias("stringValue")).alias("value"),
        )
    )
    camel = F.struct(
        F.lit("t0").alias("traceId"), text("event_id").alias("spanId"), parent.alias("parentSpanId"), name.alias("name"),
        text(start).alias("startTimeUnixNano"), text(end).alias("endTimeUnixNano"), listed.alias("attributes"),
    )
    snake = F.struct(
        F.lit("t0").alias("trace_id"), text("event_id").alias("span_id"), parent.alias("parent_span_id"), name.alias("name"),
        text(start).alias("start_time_unix_nano"), text(end).alias("end_time_unix_nano"), listed.alias("attributes"),
    )
    resource = F.struct(service.alias("attributes"))
    camel_line = F.to_json(
        F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(camel).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    )
    snake_line = F.to_json(
        F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(snake).alias("spans"))).alias("scope_spans"))).alias("resource_spans"))
    )
    return t.events.select(F.when(F.col("event_type") == "purchase", snake_line).otherwise(camel_line).alias("value"))
