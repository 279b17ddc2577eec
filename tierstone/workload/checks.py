"""Data-quality checks and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierstone.operators import profile as P
from tierstone.operators import quality as Q
from tierstone.operators.quality import Check
from tierstone.workload.registry import Tables, query
from tierstone.workload.standins import plain


@query(
    "dq_unique",
    """SELECT 'lineitem' AS table_name, l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem
         GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
       UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY o_orderkey HAVING count(*) > 1""",
)
def dq_unique(t: Tables) -> DataFrame:
    lines = Q.unique(t.lineitem, ["l_orderkey", "l_linenumber"])
    orders = Q.unique(t.orders, ["o_orderkey"])
    return lines.select(
        F.lit("lineitem").alias("table_name"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), "n"
    ).unionByName(orders.select(F.lit("orders").alias("table_name"), F.col("o_orderkey").cast("string").alias("key"), "n"))


@query(
    "dq_not_null",
    """SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey
       WHERE l_orderkey IS NULL""",
)
def dq_not_null(t: Tables) -> DataFrame:
    """Orders whose line reference is null, that is, orders without lines."""
    lines = t.lineitem.select("l_orderkey").distinct()
    return Q.not_null(t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left"), "l_orderkey").select("o_orderkey")


@query(
    "dq_accepted_values",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
)
def dq_accepted_values(t: Tables) -> DataFrame:
    found = Q.accepted_values(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return found.select("o_orderkey", "o_orderpriority")


@query(
    "dq_relationships",
    """SELECT 'lineitem' AS child, l_partkey AS ref, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL
         AND l_partkey NOT IN (SELECT p_partkey FROM part) GROUP BY 2
       UNION ALL SELECT 'documents', doc_id, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 2""",
)
def dq_relationships(t: Tables) -> DataFrame:
    """A relation that holds and one that does not."""
    parts = Q.relationships(t.lineitem, "l_partkey", t.part, "p_partkey")
    labels = Q.relationships(t.documents, "doc_id", t.labels, "doc_id")

    def counted(rows: DataFrame, child: str, key: str) -> DataFrame:
        return rows.groupBy(F.lit(child).alias("child"), F.col(key).alias("ref")).agg(F.count(F.lit(1)).alias("n"))

    return counted(parts, "lineitem", "l_partkey").unionByName(counted(labels, "documents", "doc_id"))


@query(
    "dq_expression",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount, l_tax FROM lineitem WHERE l_returnflag <> 'A' AND NOT (l_discount >= l_tax)",
)
def dq_expression(t: Tables) -> DataFrame:
    found = Q.expression_is_true(t.lineitem, "l_discount >= l_tax", "l_returnflag <> 'A'")
    return plain(found.select("l_orderkey", "l_linenumber", "l_discount", "l_tax"))


_CHECKS = [
    Check("orders", "o_orderkey", "unique"),
    Check("orders", "o_orderkey", "not_null"),
    Check("orders", "o_orderpriority", "accepted_values", values=("1-URGENT", "2-HIGH", "3-MEDIUM")),
    Check("orders", "o_custkey", "relationships", parent=("customer", "c_custkey")),
    Check("lineitem", "l_orderkey, l_linenumber", "unique"),
    Check("lineitem", "l_discount", "expression_is_true", condition="l_discount >= l_tax", where="l_returnflag <> 'A'"),
    Check("lineitem", "l_partkey", "relationships", parent=("part", "p_partkey")),
    Check("documents", "doc_id", "relationships", parent=("labels", "doc_id")),
]


@query(
    "dq_report",
    """SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 'unique' AS check_name,
         (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS failures
       UNION ALL SELECT 'orders', 'o_orderkey', 'not_null', (SELECT count(*) FROM orders WHERE o_orderkey IS NULL)
       UNION ALL SELECT 'orders', 'o_orderpriority', 'accepted_values',
         (SELECT count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
       UNION ALL SELECT 'orders', 'o_custkey', 'relationships',
         (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
       UNION ALL SELECT 'lineitem', 'l_orderkey, l_linenumber', 'unique',
         (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))
       UNION ALL SELECT 'lineitem', 'l_discount', 'expression_is_true',
         (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'A' AND NOT (l_discount >= l_tax))
       UNION ALL SELECT 'lineitem', 'l_partkey', 'relationships',
         (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))
       UNION ALL SELECT 'documents', 'doc_id', 'relationships',
         (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""",
)
def dq_report(t: Tables) -> DataFrame:
    names = ("orders", "lineitem", "documents", "customer", "part", "labels")
    return Q.dq_report({n: getattr(t, n) for n in names}, _CHECKS)


@query("catalog_profile")
def catalog_profile(t: Tables) -> DataFrame:
    """Estimates of one pass; the counts behind them are checked by the exact profile."""
    return P.profile_columns(t.orders, "orders")


@query(
    "catalog_profile_exact",
    """WITH cells AS (
         SELECT 1 AS p, 'o_orderkey' AS c, CAST(o_orderkey AS VARCHAR) AS v FROM orders
         UNION ALL SELECT 2, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders
         UNION ALL SELECT 3, 'o_orderstatus', o_orderstatus FROM orders
         UNION ALL SELECT 4, 'o_totalprice', CAST(o_totalprice AS VARCHAR) FROM orders
         UNION ALL SELECT 5, 'o_orderdate', CAST(o_orderdate AS VARCHAR) FROM orders
         UNION ALL SELECT 6, 'o_orderpriority', o_orderpriority FROM orders),
       counted AS (SELECT p, c, v, count(*) AS n FROM cells GROUP BY 1, 2, 3),
       top AS (SELECT p, string_agg(v, ',' ORDER BY n DESC, v) AS vals FROM
         (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, v) AS rn FROM counted WHERE v IS NOT NULL) WHERE rn <= 10 GROUP BY 1)
       SELECT c AS column_name, sum(n)::BIGINT AS row_count, count(v) AS n_distinct, vals[1:500] AS most_common_values,
         (coalesce(sum(n) FILTER (WHERE v IS NULL), 0) / sum(n))::DOUBLE AS null_fraction
       FROM counted JOIN top USING (p) GROUP BY c, vals""",
)
def catalog_profile_exact(t: Tables) -> DataFrame:
    found = P.profile_columns_exact(t.orders, "orders")
    return found.select("column_name", "row_count", "n_distinct", "most_common_values", "null_fraction")
