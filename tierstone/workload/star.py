"""Conformed tables, star schema and the aggregates under it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import exact_mean
from tierstone.plans import gold as G
from tierstone.plans import silver as S
from tierstone.workload import standins as I
from tierstone.workload.registry import Tables, query
from tierstone.workload.standins import money, plain, text, with_sql

# --- conformed ---------------------------------------------------------------------


def _landed_orders(t: Tables) -> DataFrame:
    """Orders as landed text; a blank date where the status is P, blank money for 5-LOW."""
    return t.orders.select(
        text("o_orderkey").alias("order_id"),
        text("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(F.col("o_orderstatus") == "P", "")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("ordered_at"),
        text(F.col("o_custkey") + 1).alias("route_id"),
        F.lit("").alias("destination_hub_id"),
        F.lit(None).cast("string").alias("destination_station_id"),
        F.col("o_orderpriority").alias("destination_name"),
        F.lit("").alias("promotion_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(text(money("o_totalprice"))).alias("revenue_credits"),
        F.lit("CR").alias("currency"),
    )


@query(
    "silver_cast",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
         o_orderstatus AS order_status,
         CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ordered_at,
         o_custkey + 1 AS route_id, CAST(NULL AS BIGINT) AS destination_hub_id,
         CAST(NULL AS BIGINT) AS destination_station_id, o_orderpriority AS destination_name,
         CAST(NULL AS BIGINT) AS promotion_id,
         CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END
           AS revenue_credits, 'CR' AS currency
       FROM orders""",
)
def silver_cast(t: Tables) -> DataFrame:
    return plain(S.silver("orders", _landed_orders(t)))


@query(
    "silver_customers",
    """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS company_name, 'n/a' AS contact_name,
         CASE WHEN c_acctbal >= 0 THEN lower(c_name) || '@example.com' END AS email, c_mktsegment AS customer_tier,
         CAST(c_nationkey AS BIGINT) AS home_planet_id, CAST(NULL AS VARCHAR) AS signup_date, c_acctbal >= 0 AS is_active,
         CASE WHEN n_regionkey <> 0 THEN 'acct-' || c_custkey END AS account_id,
         CASE WHEN n_regionkey <> 0 THEN n_name END AS industry,
         CASE WHEN n_regionkey <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) END AS annual_revenue_credits
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def silver_customers(t: Tables) -> DataFrame:
    """Customers as landed text, with an account for those outside the first region."""
    solvent = F.col("c_acctbal") >= 0
    app = t.customer.select(
        text("c_custkey").alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.lit("n/a").alias("contact_name"),
        F.when(solvent, F.concat(F.lit("  "), F.lower("c_name"), F.lit("@example.com "))).otherwise("   ").alias("email"),
        F.col("c_mktsegment").alias("customer_tier"),
        text("c_nationkey").alias("home_planet_id"),
        F.lit("").alias("signup_date"),
        text(solvent).alias("is_active"),
    )
    crm = (
        t.customer.join(t.nation.filter("n_regionkey <> 0"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            text("c_custkey").alias("customer_id"),
            F.concat(F.lit("acct-"), text("c_custkey")).alias("account_id"),
            F.col("n_name").alias("industry"),
            text(money("c_acctbal")).alias("annual_revenue_credits"),
        )
    )
    return plain(S.silver_customers(app, crm))


@query(
    "silver_email_clean",
    """SELECT CAST(c_custkey AS VARCHAR) AS contact_id, CAST(c_nationkey AS VARCHAR) AS account_id,
         c_name AS contact_name, lower(c_name) || '@example.com' AS email, c_mktsegment AS title,
         CAST(NULL AS VARCHAR) AS created_date
       FROM customer""",
)
def silver_email_clean(t: Tables) -> DataFrame:
    dirty = t.customer.select(
        text("c_custkey").alias("contact_id"),
        text("c_nationkey").alias("account_id"),
        F.col("c_name").alias("contact_name"),
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("@Example.COM  ")).alias("email"),
        F.col("c_mktsegment").alias("title"),
        F.lit("").alias("created_date"),
    )
    return plain(S.silver("contacts", dirty))


@query(
    "silver_in_flag",
    """SELECT CAST(o_orderkey AS VARCHAR) AS opportunity_id, CAST(o_custkey AS VARCHAR) AS account_id,
         o_orderpriority AS opportunity_name, CASE o_orderstatus WHEN 'F' THEN 'closed_won' ELSE 'proposal' END AS stage,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS amount_credits, CAST(NULL AS BIGINT) AS probability,
         strftime(o_orderdate, '%Y-%m-%d') AS close_date, strftime(o_orderdate, '%Y-%m-%d') AS created_date,
         o_orderstatus = 'F' AS is_won
       FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def silver_in_flag(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    landed = t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        text("o_orderkey").alias("opportunity_id"),
        text("o_custkey").alias("account_id"),
        F.col("o_orderpriority").alias("opportunity_name"),
        F.when(F.col("o_orderstatus") == "F", "closed_won").otherwise("proposal").alias("stage"),
        text(money("o_totalprice")).alias("amount_credits"),
        F.lit("").alias("probability"),
        day.alias("close_date"),
        day.alias("created_date"),
    )
    return plain(S.silver("opportunities", landed))


@query(
    "silver_line_revenue",
    """SELECT l_orderkey || '-' || l_linenumber AS order_item_id, CAST(l_orderkey AS VARCHAR) AS order_id,
         CASE WHEN l_returnflag <> 'A' THEN CAST(l_partkey AS VARCHAR) END AS product_sku,
         CAST(l_quantity AS BIGINT) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS unit_price_credits,
         CAST(CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS line_revenue_credits
       FROM lineitem""",
)
def silver_line_revenue(t: Tables) -> DataFrame:
    landed = t.lineitem.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("order_item_id"),
        text("l_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "A", "").otherwise(text("l_partkey")).alias("product_sku"),
        text(F.col("l_quantity").cast("int")).alias("quantity"),
        text(money("l_extendedprice")).alias("unit_price_credits"),
    )
    return plain(S.silver("order_items", landed))


@query(
    "silver_delivery_days",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS shipment_id,
         CAST(l_suppkey AS BIGINT) AS route_id,
         CASE WHEN l_linestatus = 'F' THEN date_diff('day', o_orderdate, l_shipdate) END AS delivery_days,
         CASE WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'in_transit' END AS shipment_status
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def silver_delivery_days(t: Tables) -> DataFrame:
    """Whole days from order to shipping, as landed text; blank while the line is open."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    done = F.col("l_linestatus") == "F"
    landed = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("shipment_id"),
        text("l_orderkey").alias("order_id"),
        text("l_suppkey").alias("route_id"),
        F.lit("").alias("spacecraft_id"),
        F.lit("").alias("pilot_id"),
        F.date_format("o_orderdate", stamp).alias("shipped_at"),
        F.when(done, F.date_format("l_shipdate", stamp)).otherwise("").alias("delivered_at"),
        F.when(done, "delivered").otherwise("in_transit").alias("shipment_status"),
    )
    return plain(S.silver("shipments", landed).select("shipment_id", "route_id", "delivery_days", "shipment_status"))


# --- dimensions --------------------------------------------------------------------


@query(
    "dim_date",
    with_sql(
        "window",
        """, days AS (SELECT CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS d,
                      window_end FROM s_window)
        SELECT CAST(d AS VARCHAR) AS date_day, year(d) AS calendar_year, month(d) AS calendar_month, day(d) AS calendar_day,
          isodow(d) AS iso_day_of_week, strftime(d, '%Y-%m') AS year_month, dayname(d) AS day_name,
          isodow(d) IN (6, 7) AS is_weekend, d = window_end AS is_window_end,
          date_diff('day', d, window_end) AS days_before_window_end FROM days""",
    ),
)
def dim_date(t: Tables) -> DataFrame:
    return plain(G.dim_date(I.window(t)))


@query(
    "dim_customer",
    with_sql(
        "customers planets",
        """SELECT customer_id, company_name, contact_name, email, customer_tier, is_active,
          CAST(signup_date AS VARCHAR) AS signup_date, account_id, industry,
          CAST(annual_revenue_credits AS DOUBLE) AS annual_revenue_credits, CAST(home_planet_id AS BIGINT) AS home_planet_id,
          planet_name AS home_planet_name, is_habitable AS home_planet_is_habitable
        FROM s_customers LEFT JOIN s_planets ON planet_id = home_planet_id""",
    ),
)
def dim_customer(t: Tables) -> DataFrame:
    return plain(G.dim_customer(I.customers(t), I.planets(t)))


_PRODUCT_DIM = """
  SELECT p.product_sku, p.product_id, p.product_name, p.description, p.category_id, c.category_name,
         u.category_name AS parent_category_name, p.weight_kg, p.dimensions_cm, p.is_hazardous, p.requires_cold_chain,
         p.base_price_credits, p.is_active
  FROM s_products p LEFT JOIN s_product_categories c ON c.category_id = p.category_id
       LEFT JOIN s_product_categories u ON u.category_id = c.parent_category_id"""


@query(
    "dim_product",
    with_sql(
        "products product_categories",
        f"""SELECT * REPLACE (CAST(category_id AS BIGINT) AS category_id, CAST(weight_kg AS DOUBLE) AS weight_kg,
              CAST(base_price_credits AS DOUBLE) AS base_price_credits) FROM ({_PRODUCT_DIM})""",
    ),
)
def dim_product(t: Tables) -> DataFrame:
    return plain(G.dim_product(I.products(t), I.product_categories(t)))


_LOCATIONS = """
  SELECT 'hub-' || hub_id AS location_key, 'hub' AS location_type, hub_id AS source_id, hub_name AS location_name,
         hub_type AS location_subtype, planet_id, capacity_tonnes, is_operational FROM s_hubs
  UNION ALL SELECT 'station-' || station_id, 'station', station_id, station_name, station_type, planet_id,
         capacity_tonnes, is_operational FROM s_stations
  UNION ALL SELECT 'planet-' || planet_id, 'planet', planet_id, planet_name, planet_type, planet_id, NULL, true FROM s_planets
  UNION ALL SELECT 'moon-' || moon_id, 'moon', moon_id, moon_name, NULL, planet_id, NULL, true FROM s_moons
  UNION ALL SELECT 'asteroid-' || asteroid_id, 'asteroid', asteroid_id, asteroid_name, asteroid_belt, NULL, NULL, true
         FROM s_asteroids"""


@query(
    "dim_location",
    with_sql(
        "hubs stations planets moons asteroids",
        f"""SELECT location_key, location_type, CAST(source_id AS BIGINT) AS source_id, location_name, location_subtype,
              CAST(l.planet_id AS BIGINT) AS planet_id, planet_name, is_habitable AS planet_is_habitable,
              CAST(capacity_tonnes AS BIGINT) AS capacity_tonnes, is_operational
            FROM ({_LOCATIONS}) l LEFT JOIN s_planets p ON p.planet_id = l.planet_id""",
    ),
)
def dim_location(t: Tables) -> DataFrame:
    return plain(_locations(t))


def _locations(t: Tables) -> DataFrame:
    return G.dim_location(I.hubs(t), I.stations(t), I.planets(t), I.moons(t), I.asteroids(t))


# --- facts -------------------------------------------------------------------------

ORDER_PARTS = "orders order_items payments refunds order_shipments routes"
_ORDER_FACT = """
  SELECT o.order_id, o.customer_id, o.order_status, o.ordered_at, CAST(o.ordered_at AS DATE) AS ordered_date, o.route_id,
    r.route_name, coalesce('hub-' || o.destination_hub_id, 'station-' || o.destination_station_id) AS destination_location_key,
    destination_name, revenue_credits, coalesce(line_count, 0) AS line_count, coalesce(unit_count, 0) AS unit_count,
    p.charge_id, payment_status, payment_method, coalesce(refunded, 0) AS refunded_credits,
    coalesce(refund_count, 0) AS refund_count, refunded IS NOT NULL AS was_refunded, shipment_id, shipped_at, delivered_at,
    delivery_days, shipment_status,
    CASE WHEN delivery_days IS NOT NULL THEN delivery_days <= avg_transit_days END AS delivered_on_time
  FROM s_orders o
  LEFT JOIN (SELECT order_id, count(*) AS line_count, sum(quantity) AS unit_count FROM s_order_items GROUP BY 1) i
    ON i.order_id = o.order_id
  LEFT JOIN s_payments p ON p.order_id = o.order_id
  LEFT JOIN (SELECT order_id, sum(amount_credits) AS refunded, count(*) AS refund_count FROM s_refunds GROUP BY 1) f
    ON f.order_id = o.order_id
  LEFT JOIN s_order_shipments s ON s.order_id = o.order_id
  LEFT JOIN s_routes r ON r.route_id = o.route_id"""


def orders_fact(t: Tables) -> DataFrame:
    return G.fct_orders(
        I.orders(t), I.order_items(t), I.payments(t), I.refunds(t), I.order_shipments(t), I.routes(t)
    )


def outcomes(t: Tables) -> DataFrame:
    """The part of the order fact the marts read."""
    return G.order_outcomes(I.orders(t), I.refunds(t), I.order_shipments(t), I.routes(t))


@query(
    "fct_orders",
    with_sql(
        ORDER_PARTS,
        f"""SELECT * REPLACE (strftime(ordered_at, '%Y-%m-%d %H:%M:%S') AS ordered_at, CAST(ordered_date AS VARCHAR) AS ordered_date,
              CAST(route_id AS BIGINT) AS route_id, CAST(revenue_credits AS DOUBLE) AS revenue_credits,
              CAST(unit_count AS BIGINT) AS unit_count, CAST(refunded_credits AS DOUBLE) AS refunded_credits,
              strftime(shipped_at, '%Y-%m-%d %H:%M:%S') AS shipped_at,
              strftime(delivered_at, '%Y-%m-%d %H:%M:%S') AS delivered_at, CAST(delivery_days AS BIGINT) AS delivery_days)
            FROM ({_ORDER_FACT})""",
    ),
)
def fct_orders(t: Tables) -> DataFrame:
    return plain(orders_fact(t))


_LINE_FACT = """
  SELECT i.order_item_id, i.order_id, i.product_sku, o.customer_id, o.ordered_at, CAST(o.ordered_at AS DATE) AS ordered_date,
    quantity, unit_price_credits, line_revenue_credits, product_name, category_id, base_price_credits,
    unit_price_credits - base_price_credits AS unit_price_variance_credits
  FROM s_order_items i JOIN s_plain_orders o ON o.order_id = i.order_id
  LEFT JOIN s_products p ON p.product_sku = i.product_sku"""


def lines_fact(t: Tables) -> DataFrame:
    return G.fct_order_items(I.order_items(t), I.plain_orders(t), I.products(t))


@query(
    "fct_order_items",
    with_sql(
        "order_items plain_orders products",
        f"""SELECT * REPLACE (strftime(ordered_at, '%Y-%m-%d %H:%M:%S') AS ordered_at, CAST(ordered_date AS VARCHAR) AS ordered_date,
              CAST(quantity AS BIGINT) AS quantity, CAST(unit_price_credits AS DOUBLE) AS unit_price_credits,
              CAST(line_revenue_credits AS DOUBLE) AS line_revenue_credits, CAST(category_id AS BIGINT) AS category_id,
              CAST(base_price_credits AS DOUBLE) AS base_price_credits,
              CAST(unit_price_variance_credits AS DOUBLE) AS unit_price_variance_credits) FROM ({_LINE_FACT})""",
    ),
)
def fct_order_items(t: Tables) -> DataFrame:
    return plain(lines_fact(t))


@query(
    "fct_payments",
    with_sql(
        "payments refunds",
        """SELECT p.charge_id, p.order_id, p.customer_id, p.event_id, p.event_type,
             CAST(p.amount_credits AS DOUBLE) AS amount_credits, currency, payment_status, payment_method,
             strftime(charged_at, '%Y-%m-%d %H:%M:%S') AS charged_at, CAST(CAST(charged_at AS DATE) AS VARCHAR) AS charged_date,
             CAST(coalesce(refunded, 0) AS DOUBLE) AS refunded_credits, refunded IS NOT NULL AS was_refunded,
             CAST(p.amount_credits - coalesce(refunded, 0) AS DOUBLE) AS net_credits
           FROM s_payments p LEFT JOIN (SELECT charge_id, sum(amount_credits) AS refunded FROM s_refunds GROUP BY 1) r
             ON r.charge_id = p.charge_id""",
    ),
)
def fct_payments(t: Tables) -> DataFrame:
    return plain(G.fct_payments(I.payments(t), I.refunds(t)))


_SHIPMENT_FACT = """
  SELECT s.shipment_id, s.order_id, o.customer_id, s.route_id, r.route_name, r.origin_hub_id, r.destination_hub_id,
    r.distance_million_km, r.avg_transit_days, r.fuel_cost_credits, r.risk_level, s.shipped_at,
    CAST(s.shipped_at AS DATE) AS shipped_date, s.delivered_at, s.delivery_days, s.shipment_status,
    CASE WHEN s.delivery_days IS NOT NULL THEN s.delivery_days <= r.avg_transit_days END AS delivered_on_time,
    s.delivery_days - r.avg_transit_days AS days_vs_estimate
  FROM s_shipments s JOIN s_plain_orders o ON o.order_id = s.order_id LEFT JOIN s_routes r ON r.route_id = s.route_id"""


def shipments_fact(t: Tables) -> DataFrame:
    return G.fct_shipments(I.shipments(t), I.plain_orders(t), I.routes(t))


@query(
    "fct_shipments",
    with_sql(
        "shipments plain_orders routes",
        f"""SELECT * REPLACE (CAST(route_id AS BIGINT) AS route_id, CAST(origin_hub_id AS BIGINT) AS origin_hub_id,
              CAST(destination_hub_id AS BIGINT) AS destination_hub_id, CAST(distance_million_km AS DOUBLE) AS distance_million_km,
              CAST(avg_transit_days AS DOUBLE) AS avg_transit_days, CAST(fuel_cost_credits AS DOUBLE) AS fuel_cost_credits,
              strftime(shipped_at, '%Y-%m-%d %H:%M:%S') AS shipped_at, CAST(shipped_date AS VARCHAR) AS shipped_date,
              strftime(delivered_at, '%Y-%m-%d %H:%M:%S') AS delivered_at, CAST(delivery_days AS BIGINT) AS delivery_days,
              CAST(days_vs_estimate AS DOUBLE) AS days_vs_estimate) FROM ({_SHIPMENT_FACT})""",
    ),
)
def fct_shipments(t: Tables) -> DataFrame:
    return plain(shipments_fact(t))


TICKET_PARTS = "tickets ticket_comments products"
_TICKET_FACT = """
  SELECT t.ticket_id, t.customer_id, t.order_id, t.product_sku, p.product_name, p.category_id, subject, ticket_status,
    priority, channel, t.created_at, CAST(t.created_at AS DATE) AS created_date, updated_at, satisfaction_rating, body_chars,
    coalesce(comment_count, 0) AS comment_count, coalesce(agent_comment_count, 0) AS agent_comment_count,
    first_agent_reply_at, (epoch_us(first_agent_reply_at) - epoch_us(t.created_at)) / 3600000000.0::DOUBLE AS hours_to_first_reply,
    ticket_status IN ('solved', 'closed') AS is_resolved, t.product_sku IS NULL AS has_no_product_attached
  FROM s_tickets t
  LEFT JOIN (SELECT ticket_id, count(*) AS comment_count, count(*) FILTER (WHERE author_role = 'agent') AS agent_comment_count,
               min(created_at) FILTER (WHERE author_role = 'agent') AS first_agent_reply_at
             FROM s_ticket_comments GROUP BY 1) c ON c.ticket_id = t.ticket_id
  LEFT JOIN s_products p ON p.product_sku = t.product_sku"""


def tickets_fact(t: Tables) -> DataFrame:
    return G.fct_support_tickets(I.tickets(t), I.ticket_comments(t), I.products(t))


@query(
    "fct_support_tickets",
    with_sql(
        TICKET_PARTS,
        f"""SELECT * REPLACE (CAST(category_id AS BIGINT) AS category_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
              CAST(created_date AS VARCHAR) AS created_date, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
              CAST(satisfaction_rating AS BIGINT) AS satisfaction_rating,
              strftime(first_agent_reply_at, '%Y-%m-%d %H:%M:%S') AS first_agent_reply_at,
              round(hours_to_first_reply, 6) AS hours_to_first_reply) FROM ({_TICKET_FACT})""",
    ),
)
def fct_support_tickets(t: Tables) -> DataFrame:
    return plain(tickets_fact(t), hours_to_first_reply=6)


# --- marts -------------------------------------------------------------------------

_TOP_CATEGORY = """
  SELECT customer_id, category_name, revenue FROM (
    SELECT customer_id, c.category_name, sum(line_revenue_credits) AS revenue,
      row_number() OVER (PARTITION BY customer_id ORDER BY sum(line_revenue_credits) DESC NULLS FIRST,
                         c.category_name ASC NULLS LAST) AS rn
    FROM f_lines LEFT JOIN s_product_categories c ON c.category_id = f_lines.category_id GROUP BY 1, 2)
  WHERE rn = 1"""


@query(
    "top_category",
    with_sql(
        "order_items plain_orders products product_categories",
        f""", f_lines AS ({_LINE_FACT})
        SELECT customer_id, category_name, CAST(revenue AS DOUBLE) AS category_revenue_credits FROM ({_TOP_CATEGORY})""",
    ),
)
def top_category(t: Tables) -> DataFrame:
    return plain(G.top_category(lines_fact(t), I.product_categories(t)))


@query(
    "mart_customer_360",
    with_sql(
        "orders order_items payments refunds order_shipments routes plain_orders tickets ticket_comments products"
        " product_categories customers planets subscriptions window",
        f""", f_orders AS ({_ORDER_FACT}), f_lines AS ({_LINE_FACT}), f_tickets AS ({_TICKET_FACT}),
        top AS ({_TOP_CATEGORY}),
        a AS (SELECT customer_id, count(*) AS n, sum(revenue_credits) AS rev, sum(refunded_credits) AS back,
                CAST(sum(revenue_credits) AS DOUBLE) / count(revenue_credits) AS mean, CAST(min(ordered_at) AS DATE) AS d0,
                CAST(max(ordered_at) AS DATE) AS d1, count(*) FILTER (WHERE order_status = 'cancelled') AS cancelled,
                count(*) FILTER (WHERE delivered_on_time IS NOT DISTINCT FROM false) AS late,
                count(*) FILTER (WHERE delivered_on_time IS NOT NULL) AS measurable FROM f_orders GROUP BY 1),
        s AS (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE NOT is_resolved) AS open_n,
                count(*) FILTER (WHERE priority IN ('high', 'urgent')) AS high_n, avg(satisfaction_rating) AS sat,
                avg(hours_to_first_reply) AS hrs, CAST(max(created_at) AS DATE) AS d1 FROM f_tickets GROUP BY 1),
        u AS (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE subscription_status = 'active') AS live,
                sum(amount_credits) FILTER (WHERE subscription_status = 'active') AS credits FROM s_subscriptions GROUP BY 1)
        SELECT c.customer_id, company_name, customer_tier, industry, is_active, planet_name AS home_planet_name,
          CAST(signup_date AS VARCHAR) AS signup_date, coalesce(a.n, 0) AS order_count,
          CAST(coalesce(rev, 0) AS DOUBLE) AS lifetime_revenue_credits, CAST(coalesce(back, 0) AS DOUBLE) AS lifetime_refunded_credits,
          CAST(coalesce(rev, 0) - coalesce(back, 0) AS DOUBLE) AS lifetime_net_credits, mean AS avg_order_credits,
          CAST(a.d0 AS VARCHAR) AS first_order_date, CAST(a.d1 AS VARCHAR) AS last_order_date,
          coalesce(cancelled, 0) AS cancelled_order_count,
          CASE WHEN coalesce(measurable, 0) <> 0 THEN CAST(late AS DOUBLE) / measurable END AS late_delivery_rate,
          coalesce(s.n, 0) AS ticket_count, coalesce(open_n, 0) AS open_ticket_count,
          coalesce(high_n, 0) AS high_priority_ticket_count, sat AS avg_satisfaction_rating,
          round(hrs, 6) AS avg_hours_to_first_reply, CAST(s.d1 AS VARCHAR) AS last_ticket_date,
          top.category_name AS top_category_name, coalesce(u.n, 0) AS subscription_count,
          coalesce(live, 0) AS active_subscription_count, CAST(coalesce(credits, 0) AS DOUBLE) AS active_subscription_credits,
          date_diff('day', a.d1, window_end) AS days_since_last_order, date_diff('day', s.d1, window_end) AS days_since_last_ticket
        FROM s_customers c CROSS JOIN s_window LEFT JOIN s_planets ON planet_id = home_planet_id
        LEFT JOIN a ON a.customer_id = c.customer_id LEFT JOIN s ON s.customer_id = c.customer_id
        LEFT JOIN top ON top.customer_id = c.customer_id LEFT JOIN u ON u.customer_id = c.customer_id""",
    ),
)
def mart_customer_360(t: Tables) -> DataFrame:
    mart = G.mart_customer_360(
        G.dim_customer(I.customers(t), I.planets(t)),
        G.dim_date(I.window(t)),
        outcomes(t),
        tickets_fact(t),
        lines_fact(t),
        I.product_categories(t),
        I.subscriptions(t),
    )
    return plain(mart, avg_hours_to_first_reply=6)


@query(
    "mart_product_performance",
    with_sql(
        "orders order_items payments refunds order_shipments routes plain_orders tickets ticket_comments products product_categories",
        f""", f_orders AS ({_ORDER_FACT}), f_lines AS ({_LINE_FACT}), f_tickets AS ({_TICKET_FACT}), d AS ({_PRODUCT_DIM}),
        sales AS (SELECT product_sku, count(DISTINCT order_id) AS n, sum(quantity) AS units, sum(line_revenue_credits) AS rev,
                    CAST(sum(unit_price_credits) AS DOUBLE) / count(unit_price_credits) AS price,
                    CAST(sum(unit_price_variance_credits) AS DOUBLE) / count(unit_price_variance_credits) AS variance
                  FROM f_lines GROUP BY 1),
        sup AS (SELECT product_sku, count(*) AS n, count(*) FILTER (WHERE priority IN ('high', 'urgent')) AS high_n,
                  avg(satisfaction_rating) AS sat FROM f_tickets WHERE product_sku IS NOT NULL GROUP BY 1),
        ret AS (SELECT l.product_sku, count(DISTINCT o.order_id) AS n FROM f_lines l JOIN f_orders o ON o.order_id = l.order_id
                WHERE o.was_refunded GROUP BY 1)
        SELECT d.product_sku, product_name, category_name, parent_category_name, is_hazardous, requires_cold_chain,
          CAST(base_price_credits AS DOUBLE) AS base_price_credits, coalesce(sales.n, 0) AS order_count,
          CAST(coalesce(units, 0) AS BIGINT) AS units_sold, CAST(coalesce(rev, 0) AS DOUBLE) AS revenue_credits,
          price AS avg_unit_price_credits, variance AS avg_price_variance_credits, coalesce(sup.n, 0) AS ticket_count,
          coalesce(high_n, 0) AS high_priority_ticket_count, sat AS avg_satisfaction_rating,
          coalesce(ret.n, 0) AS refunded_order_count,
          CASE WHEN coalesce(sales.n, 0) <> 0 THEN CAST(ret.n AS DOUBLE) / sales.n END AS refund_rate,
          CASE WHEN coalesce(units, 0) <> 0 THEN CAST(coalesce(sup.n, 0) * 100 AS DOUBLE) / units END AS tickets_per_hundred_units
        FROM d LEFT JOIN sales ON sales.product_sku = d.product_sku LEFT JOIN sup ON sup.product_sku = d.product_sku
        LEFT JOIN ret ON ret.product_sku = d.product_sku""",
    ),
)
def mart_product_performance(t: Tables) -> DataFrame:
    return plain(
        G.mart_product_performance(
            G.dim_product(I.products(t), I.product_categories(t)),
            lines_fact(t),
            G.order_refunds(I.refunds(t)).withColumn("was_refunded", F.col("_refunded").isNotNull()),
            tickets_fact(t),
        )
    )


@query(
    "mart_route_performance",
    with_sql(
        "orders order_items payments refunds order_shipments routes plain_orders shipments hubs stations planets moons asteroids",
        f""", f_orders AS ({_ORDER_FACT}), f_ship AS ({_SHIPMENT_FACT}), loc AS ({_LOCATIONS}),
        shipped AS (SELECT route_id, count(*) AS n, count(*) FILTER (WHERE delivered_on_time) AS good,
                      count(*) FILTER (WHERE delivered_on_time IS NOT NULL) AS measurable, avg(delivery_days) AS mean_days,
                      CAST(sum(days_vs_estimate) AS DOUBLE) / count(days_vs_estimate) AS mean_diff, max(delivery_days) AS worst
                    FROM f_ship GROUP BY 1),
        earned AS (SELECT route_id, sum(revenue_credits) AS rev, count(*) AS n FROM f_orders GROUP BY 1)
        SELECT CAST(r.route_id AS BIGINT) AS route_id, r.route_name, risk_level,
          CAST(distance_million_km AS DOUBLE) AS distance_million_km, CAST(avg_transit_days AS DOUBLE) AS estimated_transit_days,
          CAST(fuel_cost_credits AS DOUBLE) AS fuel_cost_credits, a.location_name AS origin_hub_name,
          b.location_name AS destination_hub_name, coalesce(s.n, 0) AS shipment_count, mean_days AS actual_avg_delivery_days,
          mean_diff AS avg_days_vs_estimate, CAST(worst AS BIGINT) AS worst_delivery_days,
          CASE WHEN coalesce(measurable, 0) <> 0 THEN CAST(good AS DOUBLE) / measurable END AS on_time_rate,
          coalesce(e.n, 0) AS order_count, CAST(coalesce(rev, 0) AS DOUBLE) AS revenue_credits,
          CAST(fuel_cost_credits * coalesce(s.n, 0) AS DOUBLE) AS total_fuel_cost_credits,
          CASE WHEN coalesce(rev, 0) <> 0 THEN CAST(fuel_cost_credits * s.n AS DOUBLE) / CAST(rev AS DOUBLE) END
            AS fuel_cost_share_of_revenue
        FROM s_routes r LEFT JOIN shipped s ON s.route_id = r.route_id LEFT JOIN earned e ON e.route_id = r.route_id
        LEFT JOIN loc a ON a.location_key = 'hub-' || r.origin_hub_id
        LEFT JOIN loc b ON b.location_key = 'hub-' || r.destination_hub_id""",
    ),
)
def mart_route_performance(t: Tables) -> DataFrame:
    return plain(G.mart_route_performance(I.routes(t), shipments_fact(t), I.orders(t), _locations(t)))


# --- aggregates on their own ---------------------------------------------------------


@query(
    "agg_basic",
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean,
         CAST(min(o_orderdate) AS VARCHAR)[1:10] AS first_day, CAST(max(o_orderdate) AS VARCHAR)[1:10] AS last_day
       FROM orders GROUP BY 1, 2""",
)
def agg_basic(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("_price", money("o_totalprice"))
    return plain(
        orders.groupBy("o_orderstatus", "o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_price").alias("total"),
            exact_mean("_price").alias("mean"),
            F.to_date(F.min("o_orderdate")).alias("first_day"),
            F.to_date(F.max("o_orderdate")).alias("last_day"),
        )
    )


@query(
    "agg_filter",
    """SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS delivered,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS DOUBLE) AS urgent_total,
         CAST(CAST(min(o_orderdate) FILTER (WHERE o_orderstatus = 'O') AS DATE) AS VARCHAR) AS first_open_day
       FROM orders GROUP BY 1""",
)
def agg_filter(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return plain(
        t.orders.groupBy("o_custkey").agg(
            F.count_if(F.col("o_orderstatus") == "F").alias("delivered"),
            F.sum(F.when(urgent, money("o_totalprice"))).alias("urgent_total"),
            F.to_date(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")))).alias("first_open_day"),
        )
    )


@query(
    "agg_distinct",
    """SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(*) AS lines
       FROM lineitem GROUP BY 1""",
)
def agg_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_distinct("l_orderkey").alias("orders"),
        F.count_distinct("l_partkey").alias("parts"),
        F.count(F.lit(1)).alias("lines"),
    )
