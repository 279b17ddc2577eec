import hashlib
import json

import pytest
from rows import as_set
from pyspark.sql import functions as F

from tierstone.sources import bronze as B
from tierstone.sources import files, manifest


def test_csv_blank_cells_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,\n2,"x, ""y"""\n 3 ,ü\n', encoding="utf-8")
    rows = files.read_csv_text(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("1", ""), ("2", 'x, "y"'), (" 3 ", "ü")]


def test_json_text_key_union_sorting_and_broken_line(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"b": true, "n": 1.50}\n\n{"a": null, "deep": {"z": 1, "a": [2, {"y": 1, "x": 2}]}}\n')
    df = files.read_json_text(spark, str(path))
    assert df.columns == ["a", "b", "deep", "n"]
    assert as_set(df) == {(None, "true", None, "1.50"), (None, None, '{"a":[2,{"x":2,"y":1}],"z":1}', None)}
    assert as_set(files.read_json_text(spark, str(path), ["b"])) == {("true",), (None,)}
    path.write_text('{"b": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed_record|failed_read_file"):
        files.read_json_text(spark, str(path), ["b"]).collect()


def test_json_document_and_listing(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"count": 2, "tickets": [{"id": "1"}, {"id": "2"}]}))
    doc = files.read_json_doc(spark, str(tmp_path / "t.json"))
    assert doc.select(F.size("tickets")).first()[0] == 2
    (tmp_path / "accounts_page_002.jsonl").write_text("{}")
    (tmp_path / "accounts_page_001.jsonl").write_text("{}")
    found = files.listing(spark, str(tmp_path / "*_page_*.jsonl"), r"([a-z]+)_page_\d+")
    assert [(r["file"], r["name"]) for r in found.collect()] == [
        ("accounts_page_001.jsonl", "accounts"), ("accounts_page_002.jsonl", "accounts"),
    ]
    with pytest.raises(Exception):
        files.listing(spark, str(tmp_path / "*.none"))


def test_bronze_replaces_by_label(spark, frame, tmp_path):
    path, now = str(tmp_path / "t"), "2026-09-01"
    rows = frame("id int, ok boolean", (1, True), (2, False))
    assert B.load_bronze(rows, path, "one.csv", "r1", now) == 2
    assert B.load_bronze(frame("id int, ok boolean", (9, None)), path, "two:2026-03-01T00:00:00Z", "r1", now) == 1
    # same label, fewer rows and a new nested column
    again = frame("id int, extra struct<b:int,a:string>", (3, (1, "x")))
    assert B.load_bronze(again, path, "one.csv", "r2", now) == 1
    # an empty batch keeps what is there
    assert B.load_bronze(again.limit(0), path, "one.csv", "r3", now) == 0
    got = B.read_bronze(spark, path).select("id", "ok", "extra", "_source_file", "_ingest_run_id")
    assert as_set(got) == {
        ("3", None, '{"a":"x","b":1}', "one.csv", "r2"),
        ("9", None, None, "two:2026-03-01T00:00:00Z", "r1"),
    }
    # a repeated load changes nothing
    before = as_set(B.read_bronze(spark, path))
    B.load_bronze(again, path, "one.csv", "r2", now)
    assert as_set(B.read_bronze(spark, path)) == before


def test_bronze_rejects_reserved_names(frame, tmp_path):
    with pytest.raises(ValueError, match="_loaded_at"):
        B.load_bronze(frame("_loaded_at string", "x"), str(tmp_path / "t"), "s", "r")


def test_bronze_folder_and_pages(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "planets.csv").write_text("planet_id,planet_name\n1,A\n")
    (src / "moons.csv").write_text("moon_id\n1\n2\n")
    out = str(tmp_path / "bronze")
    assert B.land_csv_folder(spark, f"{src}/*.csv", out, "reference", "r") == {
        "reference__moons": 2, "reference__planets": 1,
    }
    (src / "accounts_page_001.jsonl").write_text('{"account_id":"a"}\n')
    (src / "accounts_page_002.jsonl").write_text('{"account_id":"b"}\n{"account_id":"c"}\n')
    pages = f"{src}/accounts_page_*.jsonl"
    assert B.land_json_pages(spark, pages, f"{out}/accounts", "r", ["account_id"]) == 3
    assert B.land_json_pages(spark, pages, f"{out}/accounts", "r2", ["account_id"]) == 3
    got = B.read_bronze(spark, f"{out}/accounts").groupBy("_source_file").count()
    assert as_set(got) == {("accounts_page_001.jsonl", 1), ("accounts_page_002.jsonl", 2)}


def test_flatten_children_child_key_wins(frame):
    df = frame(
        "ticket_id string, subject string, comments array<struct<comment_id:string,ticket_id:string>>",
        ("t1", "s", [("c1", "other")]), ("t2", "s", []),
    )
    parents, children = B.flatten_children(df, "comments", ["ticket_id"])
    assert parents.columns == ["ticket_id", "subject"] and parents.count() == 2
    assert as_set(children.select("ticket_id", "comment_id")) == {("other", "c1")}


def test_unwrap_envelope_object_key_wins(frame):
    df = frame(
        "id string, type string, created string, data struct<object:struct<event_id:string,amount:int>>",
        ("e1", "charge.ok", "now", (("own", 5),)),
    )
    row = B.unwrap_envelope(df).first().asDict()
    assert row == {"event_type": "charge.ok", "event_created": "now", "event_id": "own", "amount": 5}


def test_nest_children_segments_and_empty(frame):
    parents = frame("k string", "a", "b")
    children = frame("k string, n int", *[("a", i) for i in range(7, 0, -1)])
    nested = B.nest_children(parents, children, "k", ["n"], F.floor(F.col("n") / 2), "ns", segment_rows=3)
    got = {(r["k"], r["segment"]): [c["n"] for c in r["ns"]] for r in nested.collect()}
    assert got == {("a", 0): [1, 2, 3], ("a", 1): [4, 5, 6], ("a", 2): [7], ("b", 0): []}
    whole = B.nest_children(parents, children, "k", ["n"], F.floor(F.col("n") / 2), "ns")
    assert whole.count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1")
    (tmp_path / "y.csv").write_text("2")
    good = hashlib.sha256(b"1").hexdigest()
    (tmp_path / "MANIFEST").write_text(f"{good}  d/x.csv\n{good}  d/y.csv\n\n")
    failing = manifest.manifest_failures(
        manifest.file_hashes(spark, f"{tmp_path}/*.csv"), manifest.read_manifest(spark, f"{tmp_path}/MANIFEST")
    )
    assert [r["file"] for r in failing.collect()] == ["y.csv"]


def test_land_tickets_and_cursor(spark, tmp_path):
    def ticket(ident, updated, *comments):
        return {"ticket_id": ident, "body": "b", "updated_at": updated,
                "comments": [{"comment_id": c, "is_public": True} for c in comments]}

    export, t, c = str(tmp_path / "tickets.json"), str(tmp_path / "t"), str(tmp_path / "c")

    def put(cursor, *tickets):
        (tmp_path / "tickets.json").write_text(json.dumps({"count": len(tickets), "next_cursor": cursor, "tickets": tickets}))

    put("2026-03-02", ticket("t1", "2026-03-01", "c1", "c2"), ticket("t2", "2026-03-02"))
    first = B.land_tickets(spark, export, t, c, "r1")
    assert first == {"comments": 2, "tickets": 2, "next_cursor": "2026-03-02"}
    assert B.land_tickets(spark, export, t, c, "r2") == first
    assert B.read_bronze(spark, t).count() == 2  # replaced, not doubled
    put("2026-03-09", ticket("t2", "2026-03-02", "old"), ticket("t3", "2026-03-09", "c3"))
    assert B.land_tickets(spark, export, t, c, "r3", cursor="2026-03-02") == {
        "comments": 1, "tickets": 1, "next_cursor": "2026-03-09",
    }
    assert as_set(B.read_bronze(spark, c).select("ticket_id", "comment_id", "is_public")) == {
        ("t1", "c1", "true"), ("t1", "c2", "true"), ("t3", "c3", "true"),
    }
    assert as_set(B.read_bronze(spark, t).select("ticket_id")) == {("t1",), ("t2",), ("t3",)}


def test_updated_tickets_count_once(spark, tmp_path):
    from tierstone.plans.build import read_silver

    def put(cursor, *tickets):
        (tmp_path / "e.json").write_text(json.dumps({"next_cursor": cursor, "tickets": [
            {"ticket_id": i, "ticket_status": s, "updated_at": u, "comments": [{"comment_id": c, "body": b} for c, b in said]}
            for i, s, u, said in tickets
        ]}))

    t, c = str(tmp_path / "zendesk__tickets"), str(tmp_path / "zendesk__ticket_comments")
    put("2026-03-02", ("t1", "open", "2026-03-01", [("c1", "a"), ("c2", "b")]), (None, "open", "2026-03-02", []), ("t2", "open", "2026-03-02", [("c3", "x")]))
    B.land_tickets(spark, str(tmp_path / "e.json"), t, c, "r1", now="2026-03-03")
    put("2026-03-09", ("t1", "solved", "2026-03-09", [("c1", "a"), ("c2", "edited"), ("c4", "d")]))
    B.land_tickets(spark, str(tmp_path / "e.json"), t, c, "r2", cursor="2026-03-02", now="2026-03-10")
    assert B.read_bronze(spark, t).count() == 4
    s = read_silver(spark, str(tmp_path), ("zendesk__tickets", "zendesk__ticket_comments"))
    assert as_set(s["tickets"].select("ticket_id", "ticket_status")) == {("t1", "solved"), ("t2", "open"), (None, "open")}
    said = s["ticket_comments"].select("ticket_id", "comment_id", "body")
    assert said.count() == 4 and as_set(said) == {("t1", "c1", "a"), ("t1", "c2", "edited"), ("t1", "c4", "d"), ("t2", "c3", "x")}


def test_an_empty_batch_can_empty_its_label(spark, frame, tmp_path):
    table = str(tmp_path / "t")
    rows = frame("a string", "x", "y")
    B.load_bronze(rows, table, "one: 1/2.csv", "r1")
    B.load_bronze(rows.limit(1), table, "two.csv", "r1")
    assert B.load_bronze(rows.limit(0), table, "one: 1/2.csv", "r2") == 0 and B.read_bronze(spark, table).count() == 3
    assert B.load_bronze(rows.limit(0), table, "one: 1/2.csv", "r3", replace_empty=True) == 0
    assert as_set(B.read_bronze(spark, table).select("_source_file")) == {("two.csv",)}
    with pytest.raises(ValueError):
        B.load_bronze(rows, table, F.col("a"), "r4", replace_empty=True)


def test_land_events(spark, tmp_path):
    events = [
        {"id": f"e{i}", "type": kind, "created": "now", "data": {"object": {"charge_id": f"c{i}", "amount_credits": 1.5}}}
        for i, kind in enumerate(["charge.ok", "charge.failed", "charge.ok"])
    ]
    (tmp_path / "charges.json").write_text(json.dumps(events))
    out = str(tmp_path / "charges")
    got = B.land_events(spark, str(tmp_path / "charges.json"), "charges.json", out, "r")
    assert got == {"rows": 3, "event_types": ["charge.failed", "charge.ok"]}
    row = B.read_bronze(spark, out).filter("charge_id = 'c1'").first().asDict()
    assert (row["event_id"], row["event_type"], row["amount_credits"], row["_source_file"]) == (
        "e1", "charge.failed", "1.5", "charges.json",
    )


def test_ragged_and_reordered_csv_fail(spark, tmp_path):
    for name, text in (("ragged", "id,name\n1,a,extra\n"), ("short", "id,name\n1\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            files.read_csv_text(spark, str(tmp_path / f"{name}.csv")).collect()
    (tmp_path / "one.csv").write_text("id,name\n1,a\n")
    (tmp_path / "two.csv").write_text("name,id\nb,2\n")
    with pytest.raises(Exception):  # noqa: B017
        files.read_csv_text(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")]).collect()


def test_numbers_of_a_json_document_stay_as_sent(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"n": 12345678.9, "b": true}]')
    assert tuple(files.read_json_doc(spark, str(tmp_path / "d.json")).select("n", "b").first()) == ("12345678.9", "true")
