from pyspark.sql import functions as F

from tierstone.workload.evidence import _number, column_sums

TEXTS = [
    "1", " 1 ", "+.5", "-7.", "1e5", "1E-5", "1d", "0x1p3", "0x1.8p-2", "NaN", "nan", "inf", "-Infinity", "+infinity", "2026-01-01", "2026-01-01 10:00:00",
    "", " ", "-", "e5", "1e", "1e+", "Nano", "Brand#1", "1,000", "1-2", "1_0", "\t2\n", "x" * 5000, "1" * 5000, None,
]


def test_a_text_is_a_number_where_the_cast_says_so(frame):
    rows = frame("v string", *[(v,) for v in TEXTS])
    number = _number("v", rows.schema["v"].dataType)
    assert rows.filter(~number.eqNullSafe(F.expr("try_cast(v AS double)")) & ~F.coalesce(F.isnan(number), F.lit(False))).collect() == []
    assert rows.filter(F.isnan(number)).count() == 2


def test_sums_of_columns_without_a_row_for_each_cell(frame):
    rows = frame("k string, a string, n int, d double, b boolean", ("x", "1", 1, 0.5, True), ("y", "one", None, 1.5, None), ("z", None, 3, None, False))
    sums = column_sums(rows, "t", "k")
    found = {r["column_name"]: r for r in sums.collect()}
    assert {c: (r["row_count"], r["nulls"]) for c, r in found.items()} == {"k": (3, 0), "a": (3, 1), "n": (3, 1), "d": (3, 1), "b": (3, 1)}
    assert [found[c]["mean"] is None for c in "kandb"] == [True, False, False, False, True]
    assert [found[c]["text_sum"] is None for c in "kandb"] == [False, False, True, True, False]
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # a row for each column, of the sums
    assert column_sums(rows.limit(0), "t", "k").collect() == []
