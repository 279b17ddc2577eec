"""The star schema: dimensions, facts and marts as functions of conformed tables.

Money stays decimal up to the last step; means and ratios are doubles made from exact
sums. No function reads the clock: recency counts from the end of the data window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import exact_mean, hours_between, ratio
from tierstone.operators.ranking import first_per_key
from tierstone.session import settle

# Fixed values
URGENT = ("high", "urgent")
RESOLVED = ("solved", "closed")


def _rows() -> Column:
    return F.count(F.lit(1))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).alias(c)


def _key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))


# --- dimensions -----------------------------------------------------------------


def dim_date(window: DataFrame, pad: bool = False) -> DataFrame:
    """One row per day of the one-row window (window_start, window_end)."""
    days = window.select(F.explode(F.sequence("window_start", "window_end")).alias("date_day"), "window_end")
    weekday = F.weekday("date_day") + 1
    name = F.date_format("date_day", "EEEE")
    return days.select(
        "date_day",
        F.year("date_day").alias("calendar_year"),
        F.month("date_day").alias("calendar_month"),
        F.dayofmonth("date_day").alias("calendar_day"),
        weekday.alias("iso_day_of_week"),
        F.date_format("date_day", "yyyy-MM").alias("year_month"),
        (F.rpad(name, 9, " ") if pad else name).alias("day_name"),
        (weekday >= 6).alias("is_weekend"),
        (F.col("date_day") == F.col("window_end")).alias("is_window_end"),
        F.datediff("window_end", "date_day").alias("days_before_window_end"),
    )


def _planet(planets: DataFrame, key: str, prefix: str = "") -> DataFrame:
    return planets.select(
        F.col("planet_id").alias(key),
        F.col("planet_name").alias(f"{prefix}planet_name"),
        F.col("is_habitable").alias(f"{prefix}planet_is_habitable"),
    )


def dim_customer(customers: DataFrame, planets: DataFrame) -> DataFrame:
    return customers.join(_planet(planets, "home_planet_id", "home_"), "home_planet_id", "left").select(
        "customer_id", "company_name", "contact_name", "email", "customer_tier", "is_active", "signup_date",
        "account_id", "industry", "annual_revenue_credits", "home_planet_id", "home_planet_name",
        "home_planet_is_habitable",
    )


def dim_product(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Products with their category and the category one level up."""
    upper = categories.select(
        F.col("category_id").alias("parent_category_id"), F.col("category_name").alias("parent_category_name")
    )
    named = categories.select("category_id", "category_name", "parent_category_id").join(
        upper, "parent_category_id", "left"
    )
    return products.join(named, "category_id", "left").select(
        "product_sku", "product_id", "product_name", "description", "category_id", "category_name",
        "parent_category_name", "weight_kg", "dimensions_cm", "is_hazardous", "requires_cold_chain",
        "base_price_credits", "is_active",
    )


# kind, id, name, subtype, planet, capacity, operational ('' where the kind has none)
_PLACES = {
    "hubs": ("hub", "hub_id", "hub_name", "hub_type", "planet_id", "capacity_tonnes", "is_operational"),
    "stations": ("station", "station_id", "station_name", "station_type", "planet_id", "capacity_tonnes", "is_operational"),
    "planets": ("planet", "planet_id", "planet_name", "planet_type", "planet_id", "", ""),
    "moons": ("moon", "moon_id", "moon_name", "", "planet_id", "", ""),
    "asteroids": ("asteroid", "asteroid_id", "asteroid_name", "asteroid_belt", "", "", ""),
}


def dim_location(
    hubs: DataFrame, stations: DataFrame, planets: DataFrame, moons: DataFrame, asteroids: DataFrame
) -> DataFrame:
    """Every kind of place under one key, `kind-id`."""
    given = {"hubs": hubs, "stations": stations, "planets": planets, "moons": moons, "asteroids": asteroids}

    def part(table: str) -> DataFrame:
        kind, ident, name, subtype, planet, capacity, operational = _PLACES[table]

        def or_null(c: str, as_type: str) -> Column:
            return F.col(c).cast(as_type) if c else F.lit(None).cast(as_type)

        return given[table].select(
            _key(kind, ident).alias("location_key"),
            F.lit(kind).alias("location_type"),
            F.col(ident).alias("source_id"),
            F.col(name).alias("location_name"),
            or_null(subtype, "string").alias("location_subtype"),
            or_null(planet, "int").alias("planet_id"),
            or_null(capacity, "int").alias("capacity_tonnes"),
            (F.col(operational) if operational else F.lit(True)).alias("is_operational"),
        )

    places = None
    for table in _PLACES:
        places = part(table) if places is None else places.unionByName(part(table))
    return places.join(_planet(planets, "planet_id"), "planet_id", "left").select(
        "location_key", "location_type", "source_id", "location_name", "location_subtype", "planet_id",
        "planet_name", "planet_is_habitable", "capacity_tonnes", "is_operational",
    )


# --- facts ------------------------------------------------------------------------


def _within_estimate() -> Column:
    """Null, not false, while a shipment is in transit."""
    return F.col("delivery_days") <= F.col("avg_transit_days")


def order_refunds(refunds: DataFrame) -> DataFrame:
    """What was paid back, one row per refunded order."""
    return refunds.groupBy("order_id").agg(
        F.sum("amount_credits").alias("_refunded"), _rows().alias("refund_count")
    )


def order_outcomes(orders: DataFrame, refunds: DataFrame, shipments: DataFrame, routes: DataFrame) -> DataFrame:
    """Orders with their refund and delivery: the part of fct_orders the marts read. All
    joins but the one to the routes share the order key, so they need one exchange each."""
    sent = shipments.select("order_id", "shipment_id", "shipped_at", "delivered_at", "delivery_days", "shipment_status")
    lanes = routes.select("route_id", "route_name", "avg_transit_days")
    return (
        orders.join(order_refunds(refunds), "order_id", "left")
        .join(sent, "order_id", "left")
        .join(lanes, "route_id", "left")
        .withColumns(
            {
                "ordered_date": F.to_date("ordered_at"),
                "refunded_credits": F.coalesce("_refunded", F.lit(0)),
                "refund_count": F.coalesce("refund_count", F.lit(0)),
                "was_refunded": F.col("_refunded").isNotNull(),
                "delivered_on_time": _within_estimate(),
            }
        )
        .drop("_refunded", "avg_transit_days")
    )


def fct_orders(
    orders: DataFrame, order_items: DataFrame, payments: DataFrame, refunds: DataFrame, shipments: DataFrame,
    routes: DataFrame,
) -> DataFrame:
    """One row per order with its line, payment, refund and shipment outcome. Lines and
    refunds are grouped before they meet the orders; a second payment or shipment of an
    order would repeat it (check them with quality.unique)."""
    lines = order_items.groupBy("order_id").agg(_rows().alias("line_count"), F.sum("quantity").alias("unit_count"))
    paid = payments.select("order_id", "charge_id", "payment_status", "payment_method")
    with_lines = orders.join(lines, "order_id", "left").join(paid, "order_id", "left")
    return order_outcomes(with_lines, refunds, shipments, routes).select(
        "order_id", "customer_id", "order_status", "ordered_at", "ordered_date", "route_id", "route_name",
        F.coalesce(_key("hub", "destination_hub_id"), _key("station", "destination_station_id")).alias(
            "destination_location_key"
        ),
        "destination_name", "revenue_credits",
        _zero("line_count"),
        _zero("unit_count"),
        "charge_id", "payment_status", "payment_method", "refunded_credits", "refund_count", "was_refunded",
        "shipment_id", "shipped_at", "delivered_at", "delivery_days", "shipment_status", "delivered_on_time",
    )


def fct_order_items(order_items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    placed = orders.select("order_id", "customer_id", "ordered_at")
    listed = products.select("product_sku", "product_name", "category_id", "base_price_credits")
    # the order last: written lines of an order then lie together, which takes less room here and in later exchanges
    return order_items.join(listed, "product_sku", "left").join(placed, "order_id").select(
        "order_item_id",
        "order_id",
        "product_sku",
        "customer_id",
        "ordered_at",
        F.to_date("ordered_at").alias("ordered_date"),
        "quantity",
        "unit_price_credits",
        "line_revenue_credits",
        "product_name",
        "category_id",
        "base_price_credits",
        (F.col("unit_price_credits") - F.col("base_price_credits")).alias("unit_price_variance_credits"),
    )


def fct_payments(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    back = refunds.groupBy("charge_id").agg(F.sum("amount_credits").alias("_refunded"))
    refunded = F.coalesce("_refunded", F.lit(0))
    return payments.join(back, "charge_id", "left").select(
        "charge_id", "order_id", "customer_id", "event_id", "event_type", "amount_credits", "currency",
        "payment_status", "payment_method", "charged_at",
        F.to_date("charged_at").alias("charged_date"),
        refunded.alias("refunded_credits"),
        F.col("_refunded").isNotNull().alias("was_refunded"),
        (F.col("amount_credits") - refunded).alias("net_credits"),
    )


def fct_shipments(shipments: DataFrame, orders: DataFrame, routes: DataFrame) -> DataFrame:
    lanes = routes.select(
        "route_id", "route_name", "origin_hub_id", "destination_hub_id", "distance_million_km", "avg_transit_days",
        "fuel_cost_credits", "risk_level",
    )
    owners = orders.select("order_id", "customer_id")
    return shipments.join(owners, "order_id").join(lanes, "route_id", "left").select(
        "shipment_id", "order_id", "customer_id", "route_id", "route_name", "origin_hub_id", "destination_hub_id",
        "distance_million_km", "avg_transit_days", "fuel_cost_credits", "risk_level", "shipped_at",
        F.to_date("shipped_at").alias("shipped_date"),
        "delivered_at", "delivery_days", "shipment_status",
        _within_estimate().alias("delivered_on_time"),
        (F.col("delivery_days") - F.col("avg_transit_days")).alias("days_vs_estimate"),
    )


def fct_support_tickets(tickets: DataFrame, ticket_comments: DataFrame, products: DataFrame) -> DataFrame:
    by_agent = F.col("author_role") == "agent"
    replies = ticket_comments.groupBy("ticket_id").agg(
        _rows().alias("comment_count"),
        F.count_if(by_agent).alias("agent_comment_count"),
        F.min(F.when(by_agent, F.col("created_at"))).alias("first_agent_reply_at"),
    )
    listed = products.select("product_sku", "product_name", "category_id")
    return tickets.join(replies, "ticket_id", "left").join(listed, "product_sku", "left").select(
        "ticket_id", "customer_id", "order_id", "product_sku", "product_name", "category_id", "subject",
        "ticket_status", "priority", "channel", "created_at",
        F.to_date("created_at").alias("created_date"),
        "updated_at", "satisfaction_rating", "body_chars",
        _zero("comment_count"),
        _zero("agent_comment_count"),
        "first_agent_reply_at",
        hours_between("created_at", "first_agent_reply_at").alias("hours_to_first_reply"),
        F.col("ticket_status").isin(*RESOLVED).alias("is_resolved"),
        F.col("product_sku").isNull().alias("has_no_product_attached"),
    )


# --- marts ------------------------------------------------------------------------


def top_category(order_lines: DataFrame, categories: DataFrame) -> DataFrame:
    """The category each customer spent most on. An unknown sum ranks first, as it does
    in the store this layer mirrors; equal sums go to the first name."""
    spent = (
        order_lines.groupBy("customer_id", "category_id")
        .agg(F.sum("line_revenue_credits").alias("_part"))
        .join(categories.select("category_id", "category_name"), "category_id", "left")
        .groupBy("customer_id", "category_name")
        .agg(F.sum("_part").alias("category_revenue_credits"))
    )
    return first_per_key(
        spent,
        ["customer_id"],
        [F.col("category_revenue_credits").desc_nulls_first(), F.col("category_name").asc_nulls_last()],
    )


def mart_customer_360(
    customer: DataFrame, dates: DataFrame, orders: DataFrame, tickets: DataFrame, order_lines: DataFrame,
    categories: DataFrame, subscriptions: DataFrame,
) -> DataFrame:
    """One row per customer. Every input is reduced to one row per customer before the
    joins, so the widest shuffle is (customers x a few numbers)."""
    activity = orders.groupBy("customer_id").agg(
        _rows().alias("order_count"),
        F.sum("revenue_credits").alias("lifetime_revenue_credits"),
        F.sum("refunded_credits").alias("lifetime_refunded_credits"),
        exact_mean("revenue_credits").alias("avg_order_credits"),
        F.to_date(F.min("ordered_at")).alias("first_order_date"),
        F.to_date(F.max("ordered_at")).alias("last_order_date"),
        F.count_if(F.col("order_status") == "cancelled").alias("cancelled_order_count"),
        F.count_if(F.col("delivered_on_time").eqNullSafe(False)).alias("_late"),
        F.count("delivered_on_time").alias("_measurable"),
    )
    support = tickets.groupBy("customer_id").agg(
        _rows().alias("ticket_count"),
        F.count_if(~F.col("is_resolved")).alias("open_ticket_count"),
        F.count_if(F.col("priority").isin(*URGENT)).alias("high_priority_ticket_count"),
        F.avg("satisfaction_rating").alias("avg_satisfaction_rating"),
        F.avg("hours_to_first_reply").alias("avg_hours_to_first_reply"),
        F.to_date(F.max("created_at")).alias("last_ticket_date"),
    )
    favourite = top_category(order_lines, categories).select(
        "customer_id", F.col("category_name").alias("top_category_name")
    )
    live = F.col("subscription_status") == "active"
    subscribed = subscriptions.groupBy("customer_id").agg(
        _rows().alias("subscription_count"),
        F.count_if(live).alias("active_subscription_count"),
        F.sum(F.when(live, F.col("amount_credits"))).alias("active_subscription_credits"),
    )
    wide = customer
    for part in (activity, support, favourite, subscribed):
        wide = wide.join(part, "customer_id", "left")
    # one day as a scalar subquery: no cross join, and the window stays data
    window_end = dates.filter("is_window_end").select("date_day").scalar()
    return wide.select(
        "customer_id", "company_name", "customer_tier", "industry", "is_active", "home_planet_name", "signup_date",
        _zero("order_count"),
        _zero("lifetime_revenue_credits"),
        _zero("lifetime_refunded_credits"),
        (
            F.coalesce("lifetime_revenue_credits", F.lit(0)) - F.coalesce("lifetime_refunded_credits", F.lit(0))
        ).alias("lifetime_net_credits"),
        "avg_order_credits", "first_order_date", "last_order_date",
        _zero("cancelled_order_count"),
        ratio(F.col("_late"), F.col("_measurable")).alias("late_delivery_rate"),
        _zero("ticket_count"),
        _zero("open_ticket_count"),
        _zero("high_priority_ticket_count"),
        "avg_satisfaction_rating", "avg_hours_to_first_reply", "last_ticket_date",
        "top_category_name",
        _zero("subscription_count"),
        _zero("active_subscription_count"),
        _zero("active_subscription_credits"),
        F.datediff(window_end, F.col("last_order_date")).alias("days_since_last_order"),
        F.datediff(window_end, F.col("last_ticket_date")).alias("days_since_last_ticket"),
    )


def mart_product_performance(
    product: DataFrame, order_lines: DataFrame, orders: DataFrame, tickets: DataFrame
) -> DataFrame:
    """One row per product: sales, support and refunds. The refund rate of a product
    that sold without refunds is null; its tickets per hundred units is 0."""
    # One row per product and order first: the distinct orders, and those with a refund,
    # are then plain counts of one pass, and lines joined by order stay where they are.
    # The refunded orders are made distinct, so that an order repeated by a second payment
    # counts once, and stored, so that the join with them can split a hot order.
    returned = orders.filter("was_refunded").select("order_id").distinct()
    refunded = settle(returned, "refunded-orders").withColumn("_refunded", F.lit(True))
    per_order = (
        order_lines.join(refunded, "order_id", "left")
        .groupBy("order_id", "product_sku")
        .agg(
            F.first("_refunded").alias("_refunded"),
            F.sum("quantity").alias("_units"),
            F.sum("line_revenue_credits").alias("_revenue"),
            F.sum("unit_price_credits").alias("_price"),
            F.count("unit_price_credits").alias("_prices"),
            F.sum("unit_price_variance_credits").alias("_variance"),
            F.count("unit_price_variance_credits").alias("_variances"),
        )
    )
    sales = per_order.groupBy("product_sku").agg(
        F.count("order_id").alias("order_count"),
        F.nullif(F.count_if(F.col("_refunded")), F.lit(0)).alias("_refunded_orders"),
        F.sum("_units").alias("units_sold"),
        F.sum("_revenue").alias("revenue_credits"),
        ratio(F.sum("_price"), F.sum("_prices")).alias("avg_unit_price_credits"),
        ratio(F.sum("_variance"), F.sum("_variances")).alias("avg_price_variance_credits"),
    )
    support = (
        tickets.filter("product_sku is not null")
        .groupBy("product_sku")
        .agg(
            _rows().alias("ticket_count"),
            F.count_if(F.col("priority").isin(*URGENT)).alias("high_priority_ticket_count"),
            F.avg("satisfaction_rating").alias("avg_satisfaction_rating"),
        )
    )
    wide = product
    for part in (sales, support):
        wide = wide.join(part, "product_sku", "left")
    return wide.select(
        "product_sku", "product_name", "category_name", "parent_category_name", "is_hazardous",
        "requires_cold_chain", "base_price_credits",
        _zero("order_count"),
        _zero("units_sold"),
        _zero("revenue_credits"),
        "avg_unit_price_credits", "avg_price_variance_credits",
        _zero("ticket_count"),
        _zero("high_priority_ticket_count"),
        "avg_satisfaction_rating",
        F.coalesce("_refunded_orders", F.lit(0)).alias("refunded_order_count"),
        ratio(F.col("_refunded_orders"), F.col("order_count")).alias("refund_rate"),
        ratio(F.coalesce("ticket_count", F.lit(0)) * F.lit(100), F.col("units_sold")).alias("tickets_per_hundred_units"),
    )


def mart_route_performance(
    routes: DataFrame, shipments: DataFrame, orders: DataFrame, locations: DataFrame
) -> DataFrame:
    """One row per route: deliveries against the estimate, revenue and fuel share."""
    shipped = shipments.groupBy("route_id").agg(
        _rows().alias("shipment_count"),
        F.count_if("delivered_on_time").alias("_on_time"),
        F.count("delivered_on_time").alias("_measurable"),
        F.avg("delivery_days").alias("actual_avg_delivery_days"),
        exact_mean("days_vs_estimate").alias("avg_days_vs_estimate"),
        F.max("delivery_days").alias("worst_delivery_days"),
    )
    earned = orders.groupBy("route_id").agg(
        F.sum("revenue_credits").alias("revenue_credits"), _rows().alias("order_count")
    )

    def hub_names(side: str) -> DataFrame:
        return locations.filter("location_type = 'hub'").select(
            F.col("location_key").alias(f"_{side}_key"), F.col("location_name").alias(f"{side}_hub_name")
        )

    wide = routes.join(shipped, "route_id", "left").join(earned, "route_id", "left")
    for side in ("origin", "destination"):
        wide = wide.withColumn(f"_{side}_key", _key("hub", f"{side}_hub_id")).join(
            hub_names(side), f"_{side}_key", "left"
        )
    fuel = F.col("fuel_cost_credits") * F.col("shipment_count")
    return wide.select(
        "route_id", "route_name", "risk_level", "distance_million_km",
        F.col("avg_transit_days").alias("estimated_transit_days"),
        "fuel_cost_credits", "origin_hub_name", "destination_hub_name",
        _zero("shipment_count"),
        "actual_avg_delivery_days", "avg_days_vs_estimate", "worst_delivery_days",
        ratio(F.col("_on_time"), F.col("_measurable")).alias("on_time_rate"),
        _zero("order_count"),
        _zero("revenue_credits"),
        F.coalesce(fuel, F.col("fuel_cost_credits") * 0).alias("total_fuel_cost_credits"),
        ratio(fuel, F.col("revenue_credits")).alias("fuel_cost_share_of_revenue"),
    )
