import datetime as dt
from decimal import Decimal

import pytest
from rows import as_set
from pyspark.sql import functions as F

from tierstone.operators.profile import profile_columns, profile_layer
from tierstone.operators.quality import dq_report
from tierstone.plans import build, checks
from tierstone.plans import gold as G
from tierstone.plans import silver as S


def ts(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def landed(spark):
    """A small hand-made domain as landed text, edge cases included."""

    def rows(columns, *values):
        return spark.createDataFrame(list(values), ", ".join(f"`{c}` string" for c in columns.split()))

    def table(name, *dicts):
        names = []
        for spec in S.SHAPES[name][1].split(","):
            column, kind = spec.strip().split(" ")
            names.append(kind.partition("<")[2] or column)
        return rows(" ".join(names), *[tuple(d.get(n, "") for n in names) for d in dicts])

    day = "2026-08-0{}T00:00:00Z".format
    return {
        "appdb__customers": rows(
            "customer_id company_name contact_name email customer_tier home_planet_id signup_date is_active",
            ("c1", "One", "", "", "gold", "1", "2026-03-01", "true"),
            ("c2", "Two", "", "", "gold", "", "2026-03-01", "true"),
            ("c3", "Idle", "", "", "bronze", "9", "", "false"),
        ),
        "salesforce__accounts": table("accounts", {"account_id": "a1", "customer_id": "c1", "industry": "ore"}),
        "salesforce__contacts": table("contacts", {"contact_id": "k1", "account_id": "a1", "email": " X@Y.Z"}),
        "salesforce__opportunities": table("opportunities", {"opportunity_id": "p1", "account_id": "a1", "stage": "proposal"}),
        "reference__planets": table("planets", {"planet_id": "1", "planet_name": "Tau", "is_habitable": "true"}),
        "reference__moons": table("moons", {"moon_id": "1", "moon_name": "Io", "planet_id": "1"}),
        "reference__asteroids": table("asteroids", {"asteroid_id": "1", "asteroid_name": "Vesta", "asteroid_belt": "main"}),
        "reference__planetary_hubs": table(
            "hubs", {"hub_id": "5", "hub_name": "Hub", "planet_id": "1", "capacity_tonnes": "10", "is_operational": "false"}
        ),
        "reference__space_stations": table("stations", {"station_id": "7", "station_name": "Dock"}),
        "reference__suppliers": table("suppliers", {"supplier_id": "1"}),
        "reference__product_categories": table(
            "product_categories",
            {"category_id": "1", "category_name": "Root"},
            {"category_id": "2", "category_name": "Air", "parent_category_id": "1"},
            {"category_id": "3", "category_name": "Water", "parent_category_id": "1"},
        ),
        "reference__products": table(
            "products",
            {"product_sku": "s1", "product_id": "1", "product_name": "Tank", "category_id": "2", "base_price_credits": "10"},
            {"product_sku": "s2", "product_id": "2", "product_name": "Cup", "category_id": "3", "base_price_credits": "5"},
            {"product_sku": "s3", "product_id": "3", "product_name": "Unsold", "category_id": "", "base_price_credits": ""},
        ),
        "reference__shipping_routes": table(
            "routes",
            {"route_id": "1", "route_name": "Short", "origin_hub_id": "5", "avg_transit_days": "2.00", "fuel_cost_credits": "4.00"},
            {"route_id": "2", "route_name": "Unused", "fuel_cost_credits": "1"},
        ),
        "appdb__orders": table(
            "orders",
            {"order_id": "o1", "customer_id": "c1", "order_status": "delivered", "ordered_at": day(1), "route_id": "1",
             "destination_hub_id": "5", "destination_station_id": "7", "revenue_credits": "20.00"},
            {"order_id": "o2", "customer_id": "c1", "order_status": "cancelled", "ordered_at": day(3), "route_id": "1",
             "destination_station_id": "7", "revenue_credits": "10.01"},
            {"order_id": "o3", "customer_id": "c2", "order_status": "placed", "ordered_at": day(5), "revenue_credits": ""},
        ),
        "appdb__order_items": table(
            "order_items",
            {"order_item_id": "i1", "order_id": "o1", "product_sku": "s1", "quantity": "2", "unit_price_credits": "5.00"},
            {"order_item_id": "i2", "order_id": "o1", "product_sku": "s2", "quantity": "1", "unit_price_credits": "10.00"},
            {"order_item_id": "i3", "order_id": "o2", "product_sku": "s2", "quantity": "1", "unit_price_credits": ""},
            {"order_item_id": "i4", "order_id": "zz", "product_sku": "s2", "quantity": "1", "unit_price_credits": "1"},
        ),
        "appdb__shipments": table(
            "shipments",
            {"shipment_id": "h1", "order_id": "o1", "route_id": "1", "shipped_at": day(1), "delivered_at": day(4),
             "shipment_status": "delivered"},
            {"shipment_id": "h2", "order_id": "o2", "route_id": "1", "shipped_at": day(3), "shipment_status": "in_transit"},
        ),
        "stripe__charges": table(
            "payments",
            {"charge_id": "ch1", "order_id": "o1", "customer_id": "c1", "amount_credits": "20.00", "payment_status": "succeeded",
             "charged_at": day(1)},
        ),
        "stripe__refunds": table(
            "refunds",
            {"refund_id": "r1", "charge_id": "ch1", "order_id": "o1", "amount_credits": "1.50"},
            {"refund_id": "r2", "charge_id": "ch1", "order_id": "o1", "amount_credits": "2.00"},
        ),
        "stripe__subscriptions": table(
            "subscriptions",
            {"subscription_id": "u1", "customer_id": "c1", "status": "active", "amount_credits": "3"},
            {"subscription_id": "u2", "customer_id": "c1", "status": "canceled", "amount_credits": "4"},
        ),
        "zendesk__tickets": table(
            "tickets",
            {"ticket_id": "t1", "customer_id": "c1", "product_sku": "s1", "body": "x", "ticket_status": "open", "priority": "urgent",
             "created_at": day(2), "satisfaction_rating": "4"},
            {"ticket_id": "t2", "customer_id": "c1", "body": "y", "ticket_status": "closed", "priority": "low", "created_at": day(6)},
        ),
        "zendesk__ticket_comments": table(
            "ticket_comments",
            {"comment_id": "m1", "ticket_id": "t1", "author_role": "customer", "created_at": day(2)},
            {"comment_id": "m2", "ticket_id": "t1", "author_role": "agent", "created_at": "2026-08-02T01:30:00Z"},
            {"comment_id": "m3", "ticket_id": "t1", "author_role": "agent", "created_at": day(9)},
        ),
    }


@pytest.fixture(scope="module")
def silver(landed):
    return S.silver_layer(landed)


@pytest.fixture(scope="module")
def gold(spark, silver, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("gold"))
    return build.build_gold(spark, silver, out, docs={"dim_customer": {"customer_id": "who buys"}})


def row(df, **where):
    for k, v in where.items():
        df = df.filter(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_layers_are_complete(silver, gold):
    assert len(silver) == 21 and len(gold) == 12


def test_dim_date(gold, spark):
    d = gold["dim_date"]
    assert d.count() == 184
    end = row(d, is_window_end=True)
    assert (str(end["date_day"]), end["days_before_window_end"], end["iso_day_of_week"]) == ("2026-08-31", 0, 1)
    first = row(d, date_day=dt.date(2026, 3, 1))
    assert (first["day_name"], first["is_weekend"], first["year_month"], first["days_before_window_end"]) == (
        "Sunday", True, "2026-03", 183,
    )
    padded = G.dim_date(build.data_window(spark), pad=True).select("day_name").distinct().collect()
    assert {len(r[0]) for r in padded} == {9}


def test_dimensions(gold):
    assert row(gold["dim_customer"], customer_id="c1")["home_planet_name"] == "Tau"
    assert row(gold["dim_customer"], customer_id="c3")["home_planet_name"] is None
    assert row(gold["dim_product"], product_sku="s1")["parent_category_name"] == "Root"
    assert row(gold["dim_product"], product_sku="s3")["category_name"] is None
    keys = {(r["location_key"], r["planet_name"], r["capacity_tonnes"], r["is_operational"]) for r in gold["dim_location"].collect()}
    assert keys == {
        ("hub-5", "Tau", 10, False), ("station-7", None, None, None), ("planet-1", "Tau", None, True),
        ("moon-1", "Tau", None, True), ("asteroid-1", None, None, True),
    }


def test_fct_orders(gold):
    one = row(gold["fct_orders"], order_id="o1")
    assert (one["destination_location_key"], one["line_count"], one["unit_count"]) == ("hub-5", 2, 3)
    assert (one["refunded_credits"], one["refund_count"], one["was_refunded"]) == (Decimal("3.50"), 2, True)
    assert (one["delivery_days"], one["delivered_on_time"], one["charge_id"]) == (3, False, "ch1")
    two = row(gold["fct_orders"], order_id="o2")
    assert (two["destination_location_key"], two["delivered_on_time"], two["charge_id"]) == ("station-7", None, None)
    three = row(gold["fct_orders"], order_id="o3")
    assert (three["destination_location_key"], three["line_count"], three["refunded_credits"], three["was_refunded"]) == (
        None, 0, Decimal("0.00"), False,
    )
    assert gold["fct_orders"].count() == 3


def test_other_facts(gold):
    assert gold["fct_order_items"].count() == 3  # the line of an unknown order is gone
    assert row(gold["fct_order_items"], order_item_id="i1")["unit_price_variance_credits"] == Decimal("-5.00")
    assert row(gold["fct_payments"], charge_id="ch1")["net_credits"] == Decimal("16.50")
    late = row(gold["fct_shipments"], shipment_id="h1")
    assert (late["delivered_on_time"], late["days_vs_estimate"]) == (False, Decimal("1.00"))
    moving = row(gold["fct_shipments"], shipment_id="h2")
    assert (moving["delivered_on_time"], moving["days_vs_estimate"]) == (None, None)
    ticket = row(gold["fct_support_tickets"], ticket_id="t1")
    assert (ticket["comment_count"], ticket["agent_comment_count"], ticket["hours_to_first_reply"]) == (3, 2, 1.5)
    quiet = row(gold["fct_support_tickets"], ticket_id="t2")
    assert (quiet["hours_to_first_reply"], quiet["is_resolved"], quiet["has_no_product_attached"]) == (None, True, True)


def test_mart_customer(gold):
    one = row(gold["mart_customer_360"], customer_id="c1")
    assert (one["order_count"], one["lifetime_revenue_credits"], one["lifetime_net_credits"]) == (2, Decimal("30.01"), Decimal("26.51"))
    assert one["avg_order_credits"] == 30.01 / 2 and one["cancelled_order_count"] == 1
    assert one["late_delivery_rate"] == 1.0
    # the line without a price makes the sum of its category Water still known: 10 beats 10 by name
    assert one["top_category_name"] == "Air"
    assert (one["active_subscription_count"], one["active_subscription_credits"]) == (1, Decimal("3.00"))
    assert (one["days_since_last_order"], one["days_since_last_ticket"]) == (28, 25)
    idle = row(gold["mart_customer_360"], customer_id="c3")
    assert (idle["order_count"], idle["avg_order_credits"], idle["late_delivery_rate"], idle["ticket_count"]) == (0, None, None, 0)
    assert idle["days_since_last_order"] is None and idle["top_category_name"] is None


def test_top_category_unknown_sum_first(frame):
    lines = frame(
        "customer_id string, category_id int, line_revenue_credits decimal(18,2)",
        ("c", 1, Decimal("9")), ("c", 2, None), ("d", 1, Decimal("1")), ("d", 2, Decimal("1")),
    )
    names = frame("category_id int, category_name string", (1, "Zinc"), (2, "Ash"))
    got = G.top_category(lines, names).select("customer_id", "category_name")
    assert as_set(got) == {("c", "Ash"), ("d", "Ash")}


def test_mart_product(gold):
    one = row(gold["mart_product_performance"], product_sku="s1")
    assert (one["order_count"], one["units_sold"], one["refunded_order_count"], one["refund_rate"]) == (1, 2, 1, 1.0)
    assert (one["ticket_count"], one["tickets_per_hundred_units"]) == (1, 50.0)
    two = row(gold["mart_product_performance"], product_sku="s2")
    assert (two["order_count"], two["refund_rate"], two["tickets_per_hundred_units"], two["avg_unit_price_credits"]) == (2, 0.5, 0.0, 10.0)
    none = row(gold["mart_product_performance"], product_sku="s3")
    assert (none["order_count"], none["refund_rate"], none["tickets_per_hundred_units"]) == (0, None, None)


def test_mart_product_without_refunds_has_null_rate(silver):
    mart = G.mart_product_performance(
        G.dim_product(silver["products"], silver["product_categories"]),
        G.fct_order_items(silver["order_items"], silver["orders"], silver["products"]),
        G.order_refunds(silver["refunds"].limit(0)).withColumn("was_refunded", F.lit(True)),
        G.fct_support_tickets(silver["tickets"], silver["ticket_comments"], silver["products"]),
    )
    sold = row(mart, product_sku="s1")
    assert (sold["refund_rate"], sold["refunded_order_count"]) == (None, 0)


def test_mart_route(gold):
    used = row(gold["mart_route_performance"], route_id=1)
    assert (used["origin_hub_name"], used["destination_hub_name"]) == ("Hub", None)
    assert (used["shipment_count"], used["on_time_rate"], used["worst_delivery_days"]) == (2, 0.0, 3)
    assert used["total_fuel_cost_credits"] == Decimal("8.00") and used["fuel_cost_share_of_revenue"] == 8 / 30.01
    idle = row(gold["mart_route_performance"], route_id=2)
    assert (idle["shipment_count"], idle["on_time_rate"], idle["fuel_cost_share_of_revenue"]) == (0, None, None)
    assert idle["total_fuel_cost_credits"] == Decimal("0.00")


def test_declared_checks(silver, gold):
    assert len(checks.SILVER_CHECKS) == 84 and len(checks.GOLD_CHECKS) == 48
    failing = {
        (r["table_name"], r["column_name"], r["check_name"]): r["failures"]
        for r in dq_report(silver, checks.SILVER_CHECKS).filter("failures > 0").collect()
    }
    assert failing == {("order_items", "order_id", "relationships"): 1}
    assert dq_report(gold, checks.GOLD_CHECKS).filter("failures > 0").count() == 0


def test_gold_ignores_the_clock(spark, silver):
    def at(now):
        assert now
        return build.gold_layer(silver, build.data_window(spark))["mart_customer_360"]

    assert build.same_under_any_clock(at, "2026-09-01", "2031-01-01")
    assert not build.same_under_any_clock(lambda now: spark.range(1).select(F.lit(now)), "a", "b")


def test_comments_survive_the_write(gold):
    profile = profile_columns(gold["dim_customer"], "dim_customer")
    assert row(profile, column_name="customer_id")["column_description"] == "who buys"


def test_profile_of_the_whole_layer(gold):
    picked = {n: gold[n] for n in ("dim_date", "fct_orders", "mart_route_performance")}
    profile = profile_layer(picked)
    assert profile.count() == sum(len(df.columns) for df in picked.values())
    on_time = row(profile, table_name="fct_orders", column_name="delivered_on_time")
    assert (on_time["row_count"], on_time["null_fraction"], on_time["most_common_values"]) == (3, 2 / 3, "false")
