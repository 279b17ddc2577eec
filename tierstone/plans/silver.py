"""Typed conforming views over the landed text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import blank_to_null, clean_email, typed, whole_days_between

# Column names and types of each conformed table. `text` is taken as it
# is, `opt` is text where blank means null, `email` is trimmed and lower-cased, the
# rest are Spark types read from non-blank text.
SHAPES = {
    "accounts": (
        "salesforce__accounts",
        "account_id text, account_name text, customer_id text, industry text, account_tier text,"
        " home_planet_id int, annual_revenue_credits decimal(18;2), created_date date",
    ),
    "asteroids": (
        "reference__asteroids",
        "asteroid_id int, asteroid_name text, asteroid_belt text, designation text,"
        " diameter_km decimal(12;2), is_mining_colony boolean, has_station boolean",
    ),
    "contacts": (
        "salesforce__contacts",
        "contact_id text, account_id text, contact_name text, email email, title text, created_date date",
    ),
    "hubs": (
        "reference__planetary_hubs",
        "hub_id int, hub_name text, hub_type text, planet_id int, moon_id int, asteroid_id int,"
        " surface_coordinates text, capacity_tonnes int, is_operational boolean, commissioned_date date",
    ),
    "moons": (
        "reference__moons",
        "moon_id int, moon_name text, planet_id int, orbital_radius_km decimal(14;2),"
        " is_habitable boolean, has_orbital_station boolean, has_surface_hub boolean",
    ),
    "opportunities": (
        "salesforce__opportunities",
        "opportunity_id text, account_id text, opportunity_name text, stage text,"
        " amount_credits decimal(18;2), probability int, close_date date, created_date date",
    ),
    "order_items": (
        "appdb__order_items",
        "order_item_id text, order_id text, product_sku opt, quantity int, unit_price_credits decimal(18;2)",
    ),
    "orders": (
        "appdb__orders",
        "order_id text, customer_id text, order_status text, ordered_at timestamp, route_id int,"
        " destination_hub_id int, destination_station_id int, destination_name text, promotion_id int,"
        " revenue_credits decimal(18;2), currency text",
    ),
    "payments": (
        "stripe__charges",
        "charge_id text, order_id text, customer_id text, event_id text, event_type text,"
        " amount_credits decimal(18;2), currency text, payment_status text, payment_method text,"
        " charged_at timestamp",
    ),
    "planets": (
        "reference__planets",
        "planet_id int, planet_name text, planet_type text, distance_from_sun_au decimal(10;2),"
        " orbital_period_days decimal(12;2), is_habitable boolean, has_orbital_station boolean,"
        " has_surface_hub boolean",
    ),
    "product_categories": (
        "reference__product_categories",
        "category_id int, category_name text, parent_category_id int, category_level int,"
        " description text, is_active boolean",
    ),
    "products": (
        "reference__products",
        "product_sku text, product_id int, product_name text, category_id int, description text,"
        " weight_kg decimal(12;2), dimensions_cm text, is_hazardous boolean, requires_cold_chain boolean,"
        " base_price_credits decimal(18;2), is_active boolean",
    ),
    "refunds": (
        "stripe__refunds",
        "refund_id text, charge_id text, order_id text, event_id text, event_type text,"
        " amount_credits decimal(18;2), reason text, refunded_at timestamp",
    ),
    "routes": (
        "reference__shipping_routes",
        "route_id int, route_name text, origin_station_id int, origin_hub_id int,"
        " destination_station_id int, destination_hub_id int, distance_million_km decimal(12;2),"
        " avg_transit_days decimal(8;2), fuel_cost_credits decimal(18;2), risk_level text, is_active boolean",
    ),
    "shipments": (
        "appdb__shipments",
        "shipment_id text, order_id text, route_id int, spacecraft_id int, pilot_id int,"
        " shipped_at timestamp, delivered_at timestamp, shipment_status text",
    ),
    "stations": (
        "reference__space_stations",
        "station_id int, station_name text, station_type text, planet_id int, moon_id int, asteroid_id int,"
        " orbital_altitude_km int, capacity_tonnes int, is_operational boolean, commissioned_date date",
    ),
    "subscriptions": (
        "stripe__subscriptions",
        "subscription_id text, customer_id text, event_id text, event_type text, plan_name text,"
        " amount_credits decimal(18;2), billing_interval text<interval, subscription_status text<status,"
        " started_at timestamp",
    ),
    "suppliers": (
        "reference__suppliers",
        "supplier_id int, supplier_name text, supplier_code text, contact_email email, contact_name text,"
        " payment_terms_days int, reliability_rating decimal(4;2), is_active boolean, contracted_since date",
    ),
    "ticket_comments": (
        "zendesk__ticket_comments",
        "comment_id text, ticket_id text, author_role text, body text, is_public boolean, created_at timestamp",
    ),
    "tickets": (
        "zendesk__tickets",
        "ticket_id text, customer_id text, order_id text, product_sku opt, subject text, body text,"
        " ticket_status text, priority text, channel text, created_at timestamp, updated_at timestamp,"
        " satisfaction_rating int",
    ),
}

# Columns computed from the typed ones.
DERIVED: dict[str, dict[str, Callable[[], Column]]] = {
    "opportunities": {"is_won": lambda: F.col("stage").isin("closed_won")},
    "order_items": {"line_revenue_credits": lambda: F.col("quantity") * F.col("unit_price_credits")},
    # null, never 0, while in transit
    "shipments": {"delivery_days": lambda: whole_days_between("shipped_at", "delivered_at")},
    "tickets": {"body_chars": lambda: F.length("body")},
}

# customers joins two landed tables and is not in SHAPES
APP_CUSTOMER = (
    "customer_id text, company_name text, contact_name text, email trimmed, customer_tier text,"
    " home_planet_id int, signup_date date, is_active boolean"
)


def _read(spec: str) -> Column:
    name, kind = spec.split(" ")
    kind, _, source = kind.replace(";", ",").partition("<")
    source = source or name
    reading = {
        "text": lambda: F.col(source),
        "opt": lambda: blank_to_null(source),
        "email": lambda: clean_email(source),
        "trimmed": lambda: blank_to_null(F.trim(F.col(source))),
    }
    return reading.get(kind, lambda: typed(source, kind))().alias(name)


def conform(bronze: DataFrame, shape: str) -> DataFrame:
    return bronze.select(*[_read(s.strip()) for s in shape.split(",")])


def silver(name: str, bronze: DataFrame) -> DataFrame:
    """One conformed table (all but customers) from its landed one."""
    typed_rows = conform(bronze, SHAPES[name][1])
    return typed_rows.withColumns({n: make() for n, make in DERIVED.get(name, {}).items()}) if name in DERIVED else typed_rows


def silver_customers(app: DataFrame, crm: DataFrame) -> DataFrame:
    """Application customers with their CRM account, null where there is none."""
    account = conform(crm, "customer_id text, account_id text, industry text, annual_revenue_credits decimal(18;2)")
    return conform(app, APP_CUSTOMER).join(account, "customer_id", "left")


def landed_columns(shape: str) -> list[str]:
    """The names a shape reads from the landed table."""
    pairs = [s.strip().split(" ") for s in shape.split(",")]
    return [kind.partition("<")[2] or name for name, kind in pairs]


# Landed tables of the conformed layer and the columns read from them.
SOURCES = {src: landed_columns(shape) for src, shape in SHAPES.values()} | {
    "appdb__customers": landed_columns(APP_CUSTOMER)
}


def silver_layer(bronze: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All conformed tables whose landed tables are given, as lazy views."""
    out = {name: silver(name, bronze[src]) for name, (src, _) in SHAPES.items() if src in bronze}
    if {"appdb__customers", "salesforce__accounts"} <= set(bronze):
        out["customers"] = silver_customers(bronze["appdb__customers"], bronze["salesforce__accounts"])
    return out
