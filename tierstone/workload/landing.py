"""Raw files, landed tables, incremental loads and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.operators.incremental import children_of, high_water, late, newer_than
from tierstone.operators.results import load_report
from tierstone.operators.upsert import cascade, upsert
from tierstone.session import fresh_path, settle
from tierstone.sources.bronze import (
    flatten_children,
    load_bronze,
    nest_children,
    read_bronze,
    unwrap_envelope,
)
from tierstone.sources.files import read_csv_text, read_json_text
from tierstone.sources.json_array import read_json_array
from tierstone.workload.registry import Tables, query
from tierstone.workload.standins import money, plain, text

_CUSTOMER_TEXT = """CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal"""


def _customer_text(t: Tables) -> DataFrame:
    return t.customer.select(
        text("c_custkey").alias("c_custkey"),
        "c_name",
        text("c_nationkey").alias("c_nationkey"),
        text(money("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"),
    )


@query(
    "src_csv_text",
    f"SELECT {_CUSTOMER_TEXT}, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE '' END AS segment FROM customer",
)
def src_csv_text(t: Tables) -> DataFrame:
    """Customers through a CSV file and back as text; a blank cell comes back as ''."""
    path = fresh_path(t.spark, "csv")
    _customer_text(t).write.option("header", True).csv(path)
    return read_csv_text(t.spark, path)


@query(
    "src_json_text",
    f"""SELECT {_CUSTOMER_TEXT}, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment,
      CASE WHEN c_acctbal >= 0 THEN 'true' ELSE 'false' END AS solvent,
      '{{"a":"' || c_mktsegment || '","z":' || c_nationkey || '}}' AS extra FROM customer""",
)
def src_json_text(t: Tables) -> DataFrame:
    """Customers through JSON lines: booleans as true/false, nested values key-sorted."""
    path = fresh_path(t.spark, "json")
    rows = _customer_text(t).join(
        t.customer.select(
            text("c_custkey").alias("c_custkey"),
            (F.col("c_acctbal") >= 0).alias("solvent"),
            F.struct(F.col("c_nationkey").alias("z"), F.col("c_mktsegment").alias("a")).alias("extra"),
        ),
        "c_custkey",
    )
    rows.write.json(path)
    return read_json_text(t.spark, path)


def _order_text(t: Tables) -> DataFrame:
    return t.orders.select(
        text("o_orderkey").alias("order_id"),
        text("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ordered_at"),
        text(money("o_totalprice")).alias("revenue"),
    )


_ORDER_TEXT = """CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  o_orderstatus AS order_status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ordered_at,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS revenue"""


@query(
    "bronze_replace",
    f"""SELECT {_ORDER_TEXT}, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS priority,
        'orders-' || o_orderstatus || '.csv' AS _source_file,
        CASE WHEN o_orderstatus = 'P' THEN 'run-2' ELSE 'run-1' END AS _ingest_run_id, '2026-09-01 00:00:00' AS _loaded_at
      FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW'""",
)
def bronze_replace(t: Tables) -> DataFrame:
    """Orders landed under three labels; one label then reloaded with fewer rows and a
    new column, and an empty batch, which changes nothing."""
    path, now = fresh_path(t.spark, "bronze"), "2026-09-01 00:00:00"
    label = F.concat(F.lit("orders-"), F.col("order_status"), F.lit(".csv"))
    load_bronze(_order_text(t), path, label, "run-1", now, mixed=True)
    again = t.orders.filter("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").select(
        text("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority")
    )
    reload = _order_text(t).join(again, "order_id")
    load_bronze(reload, path, label, "run-2", now)
    load_bronze(reload.filter("false"), path, "orders-F.csv", "run-3", now)
    return plain(read_bronze(t.spark, path))


@query(
    "nested_flatten",
    """SELECT conv_id, turn, role, md5(text) AS text_md5, n FROM conversations
       JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)""",
)
def nested_flatten(t: Tables) -> DataFrame:
    """Threads as documents with a list of turns, then flattened into parents and turns."""
    turns = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    nested = nest_children(turns, t.conversations, "conv_id", ["turn"], F.floor(F.col("turn") / 1000), "comments")
    documents = settle(nested.drop("segment"), "threads")
    parents, comments = flatten_children(documents, "comments", ["conv_id"])
    return comments.join(parents.distinct(), "conv_id").select(
        "conv_id", "turn", "role", F.md5("text").alias("text_md5"), "n"
    )


@query(
    "nest_comments",
    """SELECT t.conv_id, coalesce(floor((rn - 1) / 3), 0)::BIGINT AS segment, count(rn) AS n,
         coalesce(string_agg(c.turn::VARCHAR || ':' || c.role, ',' ORDER BY c.turn), '') AS listed
       FROM (SELECT conv_id FROM conversations WHERE turn = 0) t
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE turn > 0) c
         ON c.conv_id = t.conv_id GROUP BY 1, 2""",
)
def nest_comments(t: Tables) -> DataFrame:
    """Threads with their later turns in order, in segments of three."""
    parents = t.conversations.filter("turn = 0").select("conv_id")
    children = t.conversations.filter("turn > 0").select("conv_id", "turn", "role")
    nested = nest_children(parents, children, "conv_id", ["turn"], F.floor(F.col("turn") / 4), "comments", segment_rows=3)
    listed = F.transform("comments", lambda c: F.concat(text(c["turn"]), F.lit(":"), c["role"]))
    return plain(
        nested.select("conv_id", "segment", F.size("comments").alias("n"), F.array_join(listed, ",").alias("listed"))
    )


@query(
    "envelope_unwrap",
    """SELECT 'evt-' || event_id AS event_id, e.event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_created,
         user_id, value, types FROM events e,
         (SELECT string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT event_type FROM events))""",
)
def envelope_unwrap(t: Tables) -> DataFrame:
    """Events in processor envelopes, unwrapped, with the sorted distinct types."""
    wrapped = t.events.select(
        F.concat(F.lit("evt-"), text("event_id")).alias("id"),
        F.col("event_type").alias("type"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.struct(F.struct("user_id", "value").alias("object")).alias("data"),
    )
    flat = unwrap_envelope(wrapped)
    types = flat.select("event_type").distinct().agg(
        F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("types")
    )
    return flat.withColumn("types", types.scalar())


# --- high-water loads ----------------------------------------------------------------

_MARK = """(SELECT max(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')) FROM orders
            WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-07-01')"""


def _landed_half(t: Tables) -> tuple[str, str]:
    """Finished orders of the first years, landed; returns the table and its mark."""
    path = fresh_path(t.spark, "orders")
    early = _order_text(t).filter("order_status = 'F' AND ordered_at < '1998-07-01'")
    load_bronze(early, path, "orders.csv:None", "run-1")
    return path, high_water(t.spark, path, "ordered_at")


@query(
    "incr_watermark",
    f"SELECT {_ORDER_TEXT}, {_MARK} AS mark FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') > {_MARK}",
)
def incr_watermark(t: Tables) -> DataFrame:
    _, mark = _landed_half(t)
    return newer_than(_order_text(t), "ordered_at", mark).withColumn("mark", F.lit(mark))


@query(
    "late_rows",
    f"""SELECT {_ORDER_TEXT} FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') <= {_MARK}
        AND NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-07-01')""",
)
def late_rows(t: Tables) -> DataFrame:
    path, mark = _landed_half(t)
    return late(_order_text(t), "ordered_at", mark, read_bronze(t.spark, path), ["order_id"])


@query(
    "incr_children",
    f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_orderkey IN
        (SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') > {_MARK})""",
)
def incr_children(t: Tables) -> DataFrame:
    """Lines of the orders a high-water load takes."""
    _, mark = _landed_half(t)
    fresh = newer_than(_order_text(t), "ordered_at", mark).select(F.col("order_id").cast("bigint").alias("l_orderkey"))
    return children_of(t.lineitem, fresh, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    ).transform(plain)


@query(
    "load_report",
    """WITH f AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
       SELECT lang, count(*) AS files, sum(n)::BIGINT AS rows, false AS is_total FROM f GROUP BY 1
       UNION ALL SELECT NULL, count(*), sum(n)::BIGINT, true FROM f""",
)
def load_report_query(t: Tables) -> DataFrame:
    """Documents as landed rows: the language is the table, the source its file."""
    return load_report(t.documents, "lang", "source")


# --- upserts ---------------------------------------------------------------------------

_TARGET = """SELECT o_orderkey AS order_key, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
  o_orderpriority AS priority, 'old' AS version, TIMESTAMP '2026-01-01' AS touched_at FROM orders"""
# Open orders change twice when urgent (the later change counts), partial ones come
# back as new keys below zero, in two versions.
_BATCH = """
  SELECT o_orderkey AS order_key, 'X' AS status, CAST(o_totalprice AS DECIMAL(18,2)) + 1 AS price, 'p1' AS priority,
         'new' AS version, 1 AS seq FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, 'Y', CAST(o_totalprice AS DECIMAL(18,2)) + 2, 'p2', 'newer', 2 FROM orders
         WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
  UNION ALL SELECT -1 - o_orderkey, 'N', CAST(o_totalprice AS DECIMAL(18,2)), 'p3', 'first', 3 FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT -1 - o_orderkey, 'M', CAST(o_totalprice AS DECIMAL(18,2)) + 4, 'p4', 'second', 4 FROM orders
         WHERE o_orderstatus = 'P'"""


def _target(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("status"),
        money("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("priority"),
        F.lit("old").alias("version"),
        F.lit("2026-01-01").cast("timestamp").alias("touched_at"),
    )


def _batch(t: Tables) -> DataFrame:
    price = money("o_totalprice")

    def change(rows: DataFrame, key: Column, status: str, more: int, priority: str, version: str, seq: int) -> DataFrame:
        return rows.select(
            key.alias("order_key"),
            F.lit(status).alias("status"),
            money(price + more).alias("price"),
            F.lit(priority).alias("priority"),
            F.lit(version).alias("version"),
            F.lit(seq).alias("seq"),
        )

    key = F.col("o_orderkey")
    is_open, partial = t.orders.filter("o_orderstatus = 'O'"), t.orders.filter("o_orderstatus = 'P'")
    return (
        change(is_open, key, "X", 1, "p1", "new", 1)
        .unionByName(change(is_open.filter("o_orderpriority = '1-URGENT'"), key, "Y", 2, "p2", "newer", 2))
        .unionByName(change(partial, -1 - key, "N", 0, "p3", "first", 3))
        .unionByName(change(partial, -1 - key, "M", 4, "p4", "second", 4))
    )


_NOW = "2026-09-01 00:00:00"


def _stored(t: Tables, df: DataFrame) -> DataFrame:
    """Written to a new path and read back: the table being read is never the one written."""
    return plain(settle(df, "orders"))


@query(
    "upsert_all",
    f"""WITH t AS ({_TARGET}), b AS (SELECT * FROM ({_BATCH}) QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY seq DESC) = 1)
        SELECT coalesce(b.order_key, t.order_key) AS order_key, coalesce(b.status, t.status) AS status,
          CAST(coalesce(b.price, t.price) AS DOUBLE) AS price, coalesce(b.priority, t.priority) AS priority,
          coalesce(b.version, t.version) AS version,
          CASE WHEN b.order_key IS NULL THEN '2026-01-01 00:00:00' ELSE '{_NOW}' END AS touched_at
        FROM t FULL JOIN b ON b.order_key = t.order_key""",
)
def upsert_all(t: Tables) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    return _stored(t, upsert(_target(t), _batch(t), ["order_key"], order_col="seq", touch_col="touched_at", now=now))


@query(
    "upsert_partial",
    f"""WITH t AS ({_TARGET}), x AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY seq DESC) AS last_rn,
            row_number() OVER (PARTITION BY order_key ORDER BY seq) AS first_rn FROM ({_BATCH})),
          b AS (SELECT l.order_key, l.status, l.price, f.priority, f.version FROM x l JOIN x f ON f.order_key = l.order_key
                WHERE l.last_rn = 1 AND f.first_rn = 1)
        SELECT coalesce(t.order_key, b.order_key) AS order_key, coalesce(b.status, t.status) AS status,
          CAST(coalesce(b.price, t.price) AS DOUBLE) AS price, coalesce(t.priority, b.priority) AS priority,
          coalesce(t.version, b.version) AS version,
          CASE WHEN b.order_key IS NULL THEN '2026-01-01 00:00:00' ELSE '{_NOW}' END AS touched_at
        FROM t FULL JOIN b ON b.order_key = t.order_key""",
)
def upsert_partial(t: Tables) -> DataFrame:
    """Only status and price move on a known key; a new key keeps its first version."""
    now = F.lit(_NOW).cast("timestamp")
    return _stored(
        t, upsert(_target(t), _batch(t), ["order_key"], ["status", "price"], "seq", "touched_at", now)
    )


@query(
    "cascade_delete",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
)
def cascade_delete(t: Tables) -> DataFrame:
    """Lines that remain once the partial orders are deleted."""
    kept = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return plain(cascade(t.lineitem, kept, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


DOCUMENT_BYTES = 256 << 20  # text of one JSON file, several splits long


@query("json_doc_split", "SELECT doc_id, lang, source, md5(text) AS text_md5, length(text) AS chars FROM documents")
def json_doc_split(t: Tables) -> DataFrame:
    """All documents as JSON files without line breaks, of DOCUMENT_BYTES each, so one at small scale; read back in splits."""
    path = fresh_path(t.spark, "document")
    size = t.documents.agg(F.sum(F.octet_length("text") + F.lit(64)).alias("bytes")).first()["bytes"] or 0
    parts = -(-size // DOCUMENT_BYTES) or 1
    bounds = t.documents.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    part = reduce(lambda n, bound: n + F.when(F.col("doc_id") > int(bound), 1).otherwise(0), bounds, F.lit(0))
    ends = t.documents.groupBy(part.alias("part")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()  # a row for each file
    row = F.to_json(F.struct("doc_id", "lang", "source", "text"))
    opening = F.when(F.col("doc_id").isin([e["low"] for e in ends]), F.lit('{"next_cursor":"[{","documents":[')).otherwise(F.lit(""))
    closing = F.when(F.col("doc_id").isin([e["high"] for e in ends]), F.lit('],"more":[{"doc_id":-1}]}')).otherwise(F.lit(""))
    # one long document has to be written by one task; the hash deals documents to more tasks than there are documents, so few get two
    some = t.documents.select("doc_id", part.alias("part"), F.concat(opening, row, closing).alias("value")).repartition(4 * parts if parts > 1 else 1, "part")
    some.sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").option("lineSep", ",").text(path)
    rows = read_json_array(t.spark, path, "doc_id long, lang string, source string, text string", "documents")
    return plain(rows.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"), F.length("text").alias("chars")))
