import datetime as dt
import random

from rows import as_set

from tierstone.operators import health as H

RUNS = "unit string, run string, state string, at timestamp"


def at(n):
    return None if n is None else dt.datetime(2026, 3, 1) + dt.timedelta(minutes=n)


def test_health_edges(frame):
    runs = frame(
        RUNS,
        ("ok", "1", "failed", at(1)), ("ok", "2", "success", at(2)),
        ("bad", "1", "failed", at(1)), ("bad", "2", "failed", at(2)),
        ("mixed", "1", "success", at(1)), ("mixed", "2", "failed", at(2)), ("mixed", "3", "running", at(3)),
        ("untimed", "1", "success", None), ("untimed", "2", "failed", at(1)),
        ("busy", "1", "success", at(1)), ("busy", "now", "running", at(9)),
    )
    got = {r["unit"]: r for r in H.run_health(runs, "unit", "state", "at", "run", exclude_run="now").collect()}
    assert {k: (r["total_runs"], r["last_state"], r["consecutive_failures"]) for k, r in got.items()} == {
        "ok": (2, "success", 0), "bad": (2, "failed", 2), "mixed": (3, "running", 1), "untimed": (2, "failed", 1),
        "busy": (1, "success", 0),
    }
    assert got["bad"]["last_success_at"] is None and got["untimed"]["last_success_at"] is None
    assert got["mixed"]["last_success_at"] == at(1)


def test_streak_equals_ranking(frame):
    rng = random.Random(3)
    rows = [
        (rng.choice(["hot"] * 5 + list("abcdef")), str(i), rng.choice(["success", "failed", "failed", "running"]),
         at(rng.choice([None, *range(200)])))
        for i in range(400)
    ]
    expected = {}
    for unit in {r[0] for r in rows}:
        mine = sorted(
            (r for r in rows if r[0] == unit), key=lambda r: (r[3] is not None, r[3] or dt.datetime.min, r[1]), reverse=True
        )
        cut = next((i for i, r in enumerate(mine) if r[2] == "success"), len(mine))
        expected[unit] = (len(mine), sum(r[2] == "failed" for r in mine[:cut]), mine[0][2])
    got = H.run_health(frame(RUNS, *rows), "unit", "state", "at", "run").collect()
    assert {r["unit"]: (r["total_runs"], r["consecutive_failures"], r["last_state"]) for r in got} == expected


def test_asset_summary(frame):
    events = frame(
        "unit string, name string, at timestamp",
        *[("many", f"s3://b/{n}", at(n)) for n in range(7, 0, -1)], ("many", "s3://b/3", at(50)),
        ("few", "x/b", at(2)), ("few", "y/a", at(1)), ("few", None, at(3)), ("blank", "", at(1)), (None, "z", at(1)),
    )
    got = {r["unit"]: (r["last_event_at"], r["produces_assets"]) for r in H.asset_summary(events, "unit", "name", "at").collect()}
    assert got == {"many": (at(50), "1, 2, 3, 4, 5, and 2 more"), "few": (at(3), "a, b"), "blank": (at(1), None)}


def test_entity_health_and_text(frame):
    runs = frame(RUNS, ("load", "1", "failed", at(1)), ("gone", "1", "success", at(1)))
    entities = frame(
        "unit string, is_paused boolean, has_import_error boolean",
        ("load", None, False), ("load_orders", True, None), ("quiet", False, None),
    )
    events = frame("unit string, name string, at timestamp", ("load", "a/t", at(4)))
    errors = frame("filename string", "/dags/load_orders.py", None)
    state = H.entity_health(
        entities, H.run_health(runs, "unit", "state", "at", "run"), errors, "filename",
        H.asset_summary(events, "unit", "name", "at"), "unit",
    )
    rows = {r["unit"]: r for r in state.collect()}
    assert set(rows) == {"load", "load_orders", "quiet"}
    # an id inside a longer file name counts too
    assert [rows[u]["has_import_error"] for u in ("load", "load_orders", "quiet")] == [True, True, False]
    assert (rows["quiet"]["total_runs"], rows["quiet"]["last_state"], rows["load"]["produces_assets"]) == (0, None, "t")
    asked = frame("unit string", "load", "load_orders", "nobody")
    assert as_set(H.health_text(state, "unit", asked)) == {
        ("load", "load: last run failed at 2026-03-01 00:01:00; last success never; 1 consecutive failures since then"
                 "; HAS AN IMPORT ERROR, so it cannot run at all"),
        ("load_orders", "load_orders: last run never; last success never; PAUSED, so its data is not being refreshed"
                        "; HAS AN IMPORT ERROR, so it cannot run at all"),
        ("nobody", "no health recorded for: nobody"),
    }
