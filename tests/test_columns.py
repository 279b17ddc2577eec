import hashlib
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tierstone.functions import columns as C


def test_uuid5_and_checksum_match_the_library(frame):
    texts = ["", "T-1:ticket:0", "T-1:comment:c9", "größe ✓", "a" * 5000]
    rows = frame("x string", *texts).select("x", C.uuid5_url("x"), C.checksum16("x")).collect()
    for text, ident, checksum in rows:
        assert ident == str(uuid.uuid5(uuid.NAMESPACE_URL, text))
        assert checksum == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_blank_is_null_and_garbage_raises(frame):
    df = frame("x string", "", None, "7")
    assert [r[0] for r in df.select(C.typed("x", "int")).collect()] == [None, None, 7]
    with pytest.raises(PySparkException):
        frame("x string", "seven").select(C.typed("x", "int")).collect()


def test_whole_days_cut_toward_zero(frame):
    day = "2026-03-10 00:00:00"
    df = frame(
        "d string", "2026-03-11 23:00:00", "2026-03-11 01:00:00", "2026-03-08 23:00:00", "2026-03-09 12:00:00", None
    )
    got = df.select(C.whole_days_between(F.lit(day).cast("timestamp"), F.col("d").cast("timestamp"))).collect()
    assert [r[0] for r in got] == [1, 1, -1, 0, None]


def test_ratio_and_mean(frame):
    df = frame("n int, d int", (1, 4), (1, 0), (None, 2), (1, None))
    assert [r[0] for r in df.select(C.ratio(F.col("n"), F.col("d"))).collect()] == [0.25, None, None, None]
    money = frame("x string", "0.01", "0.02", "0.02", None).select(F.col("x").cast("decimal(18,2)").alias("x"))
    assert money.agg(C.exact_mean("x")).first()[0] == 0.05 / 3


def test_seconds_hours_and_second_text(frame):
    df = frame("a string, b string", ("2026-03-01 00:00:00", "2026-03-01 01:30:00.5")).select(
        F.col("a").cast("timestamp").alias("a"), F.col("b").cast("timestamp").alias("b")
    )
    assert df.select(C.seconds_between("a", "b"), C.hours_between("a", "b"), C.second_text("b")).first() == (
        5400.5, 5400.5 / 3600, "2026-03-01 01:30:00",
    )
