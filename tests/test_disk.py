"""What long jobs leave on disk, and how much their checks send."""

import os
import random
import time
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tierstone.operators import quality as Q
from tierstone.operators.quality import Check
from tierstone.plans import gold as G
from tierstone.session import settle, shared_folder
from tierstone.sources.files import read_json_doc
from tierstone.workload import evidence, lake
from tierstone.workload import standins as I
from tierstone.workload.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def shuffles(spark):
    """Ids of the shuffles with files on this machine."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")
    return {b.split("_")[1] for b in blocks.split(",") if b.startswith("shuffle_")}


def left_behind(spark, job):
    """Shuffles whose files a job leaves; files are dropped in the background."""
    before, result = shuffles(spark), job()
    for _ in range(50):
        left = shuffles(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left, result


def test_layers_leave_no_shuffle_files(spark):
    left, layers = left_behind(spark, lambda: evidence._layers(Tables(spark, FOLDER)))
    assert not left and layers[1]["fct_orders"].count() == spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_declared_report_agrees_with_single_checks(frame):
    """Checks that share a domain of keys: a column that is unique, refers and is referred to, two references of one table, composite keys."""
    rng = random.Random(4)
    some = lambda n: rng.choice([None, *range(n)])
    tables = {
        "p": frame("id int, up int, s string", *[(some(40), some(50), rng.choice("abc")) for _ in range(50)]),
        "t": frame("id int, pid int, other int", *[(some(30), some(60), some(45)) for _ in range(80)]),
    }
    checks = [
        Check("p", "id", "unique"), Check("p", "id", "not_null"), Check("p", "up", "relationships", parent=("p", "id")),
        Check("p", "s", "accepted_values", values=("a", "b")), Check("t", "id", "unique"), Check("t", "pid", "unique"),
        Check("t", "pid", "relationships", parent=("p", "id")), Check("t", "other", "relationships", parent=("p", "id")),
        Check("t", "id", "relationships", parent=("p", "up")), Check("t", "id, pid", "unique"),
        Check("t", "id", "expression_is_true", condition="id > 9", where="pid > 5"),
    ]
    assert sorted(Q.declared_report(tables, checks).collect()) == sorted(Q.dq_report(tables, checks).collect())


def test_a_key_is_one_entry_for_all_its_checks(frame):
    checks = [Check("p", "id", "unique")] + [Check("t", c, "relationships", parent=("p", "id")) for c in "abc"]
    assert Q._entries(frame("id int", 1, 2), "p", checks).count() == 2


def test_lines_of_an_order_lie_together(spark):
    """Without broadcasts the written lines of an order are in one file, beside each other, so they pack well."""
    t, settings = Tables(spark, FOLDER), {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        lines = settle(G.fct_order_items(I.order_items(t), I.plain_orders(t), I.products(t)), "lines", packed=True)
        places = lines.groupBy(F.input_file_name().alias("file"), "order_id").agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len({p["file"] for p in places}) > 1 and len(places) == len({p["order_id"] for p in places})
    assert sum(p["n"] for p in places) == t.lineitem.count()


def test_landed_marts_leave_no_shuffle_files(spark):
    def job():
        mart = entry.queries()["landed_marts"](spark, FOLDER)
        return mart, len(mart.collect())

    left, (mart, rows) = left_behind(spark, job)
    assert not left and rows == len(mart.collect()) > 0


def test_ticket_exports_go_once_they_are_landed(spark):
    before = set(os.listdir(shared_folder(spark)))
    left, _ = left_behind(spark, lambda: entry.queries()["tickets_cursor"](spark, FOLDER))
    made = {name.rpartition("-")[0] for name in set(os.listdir(shared_folder(spark))) - before}
    assert not left and made == {"bronze"}


def test_export_of_odd_orders(spark, frame):
    """An order key that is null, repeated, or far off; lines of no order and without a key; orders moved once."""
    orders = [(None, "1-URGENT"), (None, "5-LOW"), (1, "1-URGENT"), (1, "2-HIGH"), (999, None), (16_000, "5-LOW"), (-1, "1-URGENT")]
    lines = [(1, 1, 5, 6, "F"), (1, 2, 5, None, "O"), (16_000, 1, 7, 8, None), (17, 1, 1, 1, "F"), (None, 1, 1, 1, "F")]
    t = Tables(spark, FOLDER)
    t.orders = frame("o_orderkey long, o_orderpriority string", *orders)
    t.lineitem = frame("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string", *lines)

    def ticket(key, priority):
        solved = priority == "1-URGENT"
        said = [("-".join(str(x) for x in line[:4] if x is not None), line[4]) for line in lines if key is not None and line[0] == key]
        closing = [("closing" if key is None else f"{key}-closing", "solved")] if solved else []
        document = None if key is None else key // 1000
        return document, None if key is None else str(key), priority, "solved" if solved else "open", tuple(sorted(said + closing, key=str))

    path = lake._export(t, True)
    got = []
    for d in read_json_doc(spark, path, lake._TICKET_DOCUMENT).collect():
        assert d["next_cursor"] == max(x["updated_at"] for x in d["tickets"])
        for x in d["tickets"]:
            document = None if x["ticket_id"] is None else int(x["ticket_id"]) // 1000
            got.append((document, x["ticket_id"], x["subject"], x["ticket_status"], tuple(sorted(((c["comment_id"], c["body"]) for c in x["comments"]), key=str))))
    assert Counter(got) == Counter(ticket(*o) for o in orders)
    names = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(names) == 4 and all(n.endswith(".gz") for n in names)
