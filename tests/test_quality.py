from rows import as_set

from tierstone.operators import profile as P
from tierstone.operators import quality as Q
from tierstone.operators.quality import Check


def test_checks(frame):
    df = frame("id int, s string, q int", (1, "a", 1), (1, "b", -1), (2, None, None), (None, "z", 0), (None, "a", 5))
    assert as_set(Q.unique(df, ["id"])) == {(1, 2)}
    assert Q.not_null(df, "s").count() == 1
    assert as_set(Q.accepted_values(df, "s", ["a", "b"]).select("s")) == {("z",)}
    assert as_set(Q.expression_is_true(df, "q > 0").select("q")) == {(-1,), (0,)}
    assert as_set(Q.expression_is_true(df, "q > 0", "id is not null").select("q")) == {(-1,)}
    parent = frame("pid int", 1, 3)
    assert as_set(Q.relationships(df, "id", parent, "pid").select("id")) == {(2,)}


def test_report_counts_and_passes(frame):
    df = frame("id int, s string", (1, "a"), (1, "b"), (2, "x"), (2, "x"), (2, "x"))
    checks = [
        Check("t", "id", "unique"),
        Check("t", "id", "not_null"),
        Check("t", "s", "accepted_values", values=("a", "b")),
        Check("t", "id", "relationships", parent=("p", "id")),
        Check("t", "id", "expression_is_true", condition="id > 1", where="s <> 'b'"),
        Check("p", "id", "unique"),
    ]
    got = Q.dq_report({"t": df, "p": frame("id int", 1)}, checks)
    assert {(r[0], r[2]): r[3] for r in got.collect()} == {
        ("t", "unique"): 2, ("t", "not_null"): 0, ("t", "accepted_values"): 3, ("t", "relationships"): 3,
        ("t", "expression_is_true"): 1, ("p", "unique"): 0,
    }


def test_profiles_agree(frame):
    rows = [(i % 7, "x" * (i % 3), None if i % 4 else float(i)) for i in range(100)] + [(None, None, None)]
    df = P.with_docs(frame("a int, b string, c double", *rows), {"a": "the a"})
    rough = {r["column_name"]: r for r in P.profile_columns(df, "t").collect()}
    exact = {r["column_name"]: r for r in P.profile_columns_exact(df, "t").collect()}
    assert list(rough) == ["a", "b", "c"]
    for name in rough:
        for field in ("row_count", "null_fraction", "ordinal_position", "data_type", "is_nullable"):
            assert rough[name][field] == exact[name][field], (name, field)
        # the estimate of the one-pass profile is within its stated error
        assert abs(rough[name]["n_distinct"] - exact[name]["n_distinct"]) <= 0.05 * exact[name]["n_distinct"]
    assert exact["a"]["n_distinct"] == 7 and exact["a"]["column_description"] == "the a"
    assert exact["a"]["most_common_values"] == "0,1,2,3,4,5,6"
    assert rough["a"]["most_common_values"].split(",")[:2] == ["0", "1"] or set(
        rough["a"]["most_common_values"].split(",")
    ) == set("0123456")
    assert exact["c"]["null_fraction"] == 76 / 101
    assert len(P.profile_columns(frame("s string", "y" * 900), "t").first()["most_common_values"]) == 500


def test_profile_of_nothing(frame):
    row = P.profile_columns(frame("a int", 1).limit(0), "t").first()
    assert (row["row_count"], row["null_fraction"], row["n_distinct"]) == (0, None, 0)
    assert as_set(P.table_sizes({"t": frame("a int, b int", (1, 2)), "none": frame("a int")})) == {("t", 2, 1), ("none", 1, 0)}


def test_declared_report_compiles_its_entries(frame, capsys):
    df, parent = frame("id int, s string", (1, "a"), (1, "b"), (2, "x"), (None, None)), frame("pid int", 1, 3)
    checks = [
        Check("t", "id", "unique"),
        Check("t", "id", "not_null"),
        Check("t", "s", "accepted_values", values=("a", "b")),
        Check("t", "id", "relationships", parent=("p", "pid")),
    ]
    report = Q.declared_report({"t": df, "p": parent}, checks)
    assert [r["failures"] for r in sorted(report.collect(), key=lambda r: r["check_name"])] == [1, 1, 1, 1]
    report.explain()
    assert "lambda" not in capsys.readouterr().out
