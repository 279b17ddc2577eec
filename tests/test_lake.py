import os

import pytest
from pyspark.sql import functions as F

from tierstone.sources.files import read_json_doc
from tierstone.workload.lake import _TICKET_DOCUMENT, _export
from tierstone.workload.registry import Tables

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_an_export_is_a_few_files_of_many_documents(spark):
    t = Tables(spark, FOLDER)
    path = _export(t, True)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    documents = read_json_doc(spark, path, _TICKET_DOCUMENT).select("next_cursor", F.size("tickets").alias("n")).collect()
    held = t.orders.select(F.floor(F.col("o_orderkey") / 1000).alias("d")).groupBy("d").count().collect()
    assert sorted(d["n"] for d in documents) == sorted(r["count"] for r in held) and len(documents) > 10
    assert len(files) == len({r["d"] // 16 for r in held}) and {d["next_cursor"] for d in documents} == {"2026-03-09T00:00:00Z"}


def test_marts_land_their_tables_side_by_side(spark, monkeypatch):
    from threading import Barrier

    from tierstone.workload import lake
    from tierstone.workload.registry import QUERIES

    class Met(Exception):
        pass

    two = Barrier(2, timeout=10)

    def land(*args):
        two.wait()  # breaks unless another table lands meanwhile
        raise Met

    monkeypatch.setattr(lake, "load_bronze", land)
    with pytest.raises(Met):
        QUERIES["landed_marts"](spark, "/root/testdata/sf0.001")
