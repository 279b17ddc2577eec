import datetime as dt
from decimal import Decimal

import pytest
from rows import as_set
from pyspark.errors import PySparkException

from tierstone.plans import silver as S


def blank(frame, shape, **given):
    """One landed row of a shape with blank cells but for those given."""
    names = []
    for spec in shape.split(","):
        name, kind = spec.strip().split(" ")
        names.append(kind.partition("<")[2] or name)
    return frame(", ".join(f"`{n}` string" for n in names), tuple(given.get(n, "") for n in names))


@pytest.mark.parametrize("name", list(S.SHAPES))
def test_every_shape_reads_blanks(frame, name):
    row = S.silver(name, blank(frame, S.SHAPES[name][1])).first().asDict()
    types = {s.strip().split(" ")[0]: s.strip().split(" ")[1] for s in S.SHAPES[name][1].split(",")}
    for column, kind in types.items():
        expected = "" if kind.partition("<")[0] in ("text", "email") else None
        assert row[column] == expected, column


def test_types_and_names(frame):
    shape = S.SHAPES["subscriptions"][1]
    row = S.silver(
        "subscriptions",
        blank(frame, shape, amount_credits="12.345", interval="month", status="active", started_at="2026-03-01T05:00:00Z"),
    ).first()
    assert row["amount_credits"] == Decimal("12.35")
    assert (row["billing_interval"], row["subscription_status"]) == ("month", "active")
    assert row["started_at"].replace(tzinfo=None) is not None
    assert len(S.SHAPES) + 1 == 21


def test_malformed_number_raises(frame):
    with pytest.raises(PySparkException):
        S.silver("planets", blank(frame, S.SHAPES["planets"][1], planet_id="x1")).collect()


def test_shipments(frame):
    shape = S.SHAPES["shipments"][1]
    day = "2026-03-10T00:00:00Z"
    cases = {"2026-03-11T23:00:00Z": 1, "2026-03-11T01:00:00Z": 1, "2026-03-08T23:00:00Z": -1, "": None}
    for delivered, days in cases.items():
        assert S.silver("shipments", blank(frame, shape, shipped_at=day, delivered_at=delivered)).first()["delivery_days"] == days


def test_derived_columns(frame):
    won = blank(frame, S.SHAPES["opportunities"][1], stage="closed_won", amount_credits="8495328.0")
    row = S.silver("opportunities", won).first()
    assert row["is_won"] is True and row["amount_credits"] == Decimal("8495328.00")
    item = S.silver("order_items", blank(frame, S.SHAPES["order_items"][1], quantity="3", unit_price_credits="1.10")).first()
    assert item["line_revenue_credits"] == Decimal("3.30") and item["product_sku"] is None
    contact = S.silver("contacts", blank(frame, S.SHAPES["contacts"][1], email="  A@B.C ")).first()
    assert contact["email"] == "a@b.c"
    ticket = S.silver("tickets", blank(frame, S.SHAPES["tickets"][1], body="äö!", product_sku="")).first()
    assert ticket["body_chars"] == 3 and ticket["product_sku"] is None


def test_customers_left_join(frame):
    app = frame(
        "customer_id string, company_name string, contact_name string, email string, customer_tier string,"
        " home_planet_id string, signup_date string, is_active string",
        ("c1", "A", "a", "  ", "gold", "3", "2026-01-02", "true"), ("c2", "B", "b", " x@y ", "gold", "", "", "false"),
    )
    crm = frame(
        "customer_id string, account_id string, industry string, annual_revenue_credits string", ("c1", "a1", "ore", "5")
    )
    got = as_set(
        S.silver_customers(app, crm).select("customer_id", "email", "home_planet_id", "signup_date", "is_active", "account_id")
    )
    assert got == {("c1", None, 3, dt.date(2026, 1, 2), True, "a1"), ("c2", "x@y", None, None, False, None)}


def test_layer_builds_what_has_landed(frame):
    bronze = {"reference__moons": blank(frame, S.SHAPES["moons"][1])}
    assert list(S.silver_layer(bronze)) == ["moons"]
