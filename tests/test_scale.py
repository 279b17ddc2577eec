"""Plans: what must not happen whatever the size of the data."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tierstone.operators import chunks as C
from tierstone.operators import evals as E
from tierstone.operators.ancestry import nearest_or_self
from tierstone.operators.health import failure_streak
from tierstone.plans import gold as G
from tierstone.sources.bronze import nest_children

FOLDER = "/root/testdata/sf0.001"


def plan(df, final=False):
    execution = df._jdf.queryExecution()
    return (execution.executedPlan() if final else execution.optimizedPlan()).toString()


@pytest.fixture
def small_broadcasts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    skew = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in skew.items():
        spark.conf.set(key, value)
    yield spark
    for key in skew:
        spark.conf.unset(key)
    for key, value in before.items():
        spark.conf.set(key, value)


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["chunk_checksum"](spark, FOLDER), final=True)
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in text
    text = plan(entry.queries()["fct_payments"](spark, FOLDER), final=True)
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in text


def test_hot_key_join_is_split(small_broadcasts):
    """A unit with most of the failed runs is split over tasks by AQE."""
    spark = small_broadcasts
    rows = spark.range(0, 400_000, numPartitions=8).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("unit"),
        F.when(F.col("id") % 1000 == 3, "success").otherwise("failed").alias("state"),
        F.timestamp_seconds("id").alias("at"),
        F.sha2(F.col("id").cast("string"), 256).alias("run"),
    )
    streak = failure_streak(rows, "unit", "state", "at", "run")
    streak.collect()
    assert "skew=true" in plan(streak, final=True)


def hot(n, share=7):
    """A key column where `share` tenths of the rows carry one value."""
    return F.when(F.col("id") % 10 < share, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % n))


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_hot_ticket_is_split(small_broadcasts, tmp_path):
    spark = small_broadcasts
    comments = spark.range(0, 20_000, numPartitions=8).select(
        F.col("id").cast("string").alias("comment_id"),
        hot(50).alias("ticket_id"),
        F.lit("agent").alias("author_role"),
        F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2(F.col("id").cast("string"), 512)).alias("body"),
        F.timestamp_seconds(F.col("id") * 600).alias("created_at"),
    )
    keys = spark.range(50).select(F.concat(F.lit("u"), "id").alias("ticket_id")).union(spark.sql("SELECT 'hot'"))
    tickets = keys.select("ticket_id", *[F.lit("x").alias(c) for c in ("customer_id", "product_sku", "subject", "body")])
    chunks = C.chunk(stored(tickets, tmp_path / "t"), stored(comments, tmp_path / "c"))
    rows = chunks.groupBy("source_kind").agg(F.count("chunk_id").alias("n"), F.max("chunk_ordinal").alias("top"))
    # numbered without gaps across the day slices of the hot ticket
    assert {r["source_kind"]: (r["n"], r["top"]) for r in rows.collect()} == {"ticket": (51, 0), "comment": (20_000, 14_000)}
    chunks.collect()
    assert "skew=true" in plan(chunks, final=True)


def test_hot_run_of_spans_is_split(small_broadcasts, frame, tmp_path):
    spark = small_broadcasts
    spans = spark.range(0, 60_000, numPartitions=8).select(
        F.lit("d").alias("dag_id"), hot(900).alias("run_id"), F.lit(E.ANSWER_TASK).alias("task_id"), F.lit("m").alias("model"),
        F.sha2(F.col("id").cast("string"), 256).alias("trace_id"), F.col("id").cast("string").alias("span_id"),
        *[F.lit(1).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "reasoning_tokens", "tool_call_count")],
        F.lit(None).cast("decimal(18,6)").alias("cost"), F.lit(1.0).alias("duration_ms"),
        F.array(F.lit("a")).alias("tools_available"),
    )
    text = ["question", "answer", "sql_used", "tables_used", "chunks_used", "freshness_note", "caveats", "confidence", "model"]
    keys = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("run_id")).union(spark.sql("SELECT 'hot'"))
    responses = keys.select(
        F.lit("d").alias("dag_id"), "run_id", *[F.lit(None).cast("string").alias(c) for c in text],
        F.current_timestamp().alias("created_at"),
    )
    scores = frame("dag_id string, run_id string, scores string, scored_at timestamp", ("d", "hot", "{}", None))
    records = E.eval_records(stored(responses, tmp_path / "r"), scores, stored(spans, tmp_path / "s"))
    # spans of 900 numbered runs of which the hot tenths take the multiples away
    assert len(records.collect()) == 60_000 + records.filter("has_no_trace").count()
    assert "skew=true" in plan(records, final=True)


def test_hot_order_in_the_product_mart_is_split(small_broadcasts, tmp_path):
    spark = small_broadcasts
    lines = spark.range(0, 100_000, numPartitions=8).select(
        F.col("id").cast("string").alias("order_item_id"), hot(3000).alias("order_id"),
        F.concat(F.lit("s"), F.col("id") % 400).alias("product_sku"), F.lit(1).alias("quantity"),
        *[F.col("id").cast("decimal(18,2)").alias(c) for c in ("unit_price_credits", "line_revenue_credits", "unit_price_variance_credits")],
    )
    orders = lines.select("order_id").distinct().withColumn("was_refunded", F.col("order_id") == "hot")
    products = lines.select("product_sku").distinct().select(
        "product_sku", *[F.lit("x").alias(c) for c in ("product_name", "category_name", "parent_category_name")],
        *[F.lit(True).alias(c) for c in ("is_hazardous", "requires_cold_chain")], F.lit(1).alias("base_price_credits"),
    )
    tickets = spark.sql("SELECT 's1' product_sku, 'high' priority, 3 satisfaction_rating")
    mart = G.mart_product_performance(
        stored(products, tmp_path / "p"), stored(lines, tmp_path / "l"), stored(orders, tmp_path / "o"), tickets
    )
    rows = mart.collect()
    assert sum(r["units_sold"] for r in rows) == 100_000
    assert sum(r["refunded_order_count"] for r in rows) == lines.filter("order_id = 'hot'").select("product_sku").distinct().count()
    assert "skew=true" in plan(mart, final=True)


def test_star_of_one_parent(small_broadcasts):
    spark = small_broadcasts
    nodes = spark.range(0, 50_000, numPartitions=8).select(
        "id", F.when(F.col("id") > 1, 1).when(F.col("id") == 1, 0).cast("bigint").alias("parent")
    )
    found = nearest_or_self(nodes, "id", "parent", F.col("id") == 0)
    assert found.filter("found = 0").count() == 50_000


def test_hot_parent_is_split(small_broadcasts, tmp_path):
    spark = small_broadcasts
    children = spark.range(0, 60_000, numPartitions=8).select(
        hot(100).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("body")
    )
    parents = spark.range(200).select(F.concat(F.lit("u"), "id").alias("k")).union(spark.sql("SELECT 'hot'"))
    nested = nest_children(
        stored(parents, tmp_path / "p"), stored(children, tmp_path / "c"), "k", ["id"], F.floor(F.col("id") / 1000), "rows", 50
    )
    rows = nested.select("k", "segment", F.size("rows").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 60_000 and max(r["n"] for r in rows) == 50
    assert {r["k"] for r in rows if r["n"] == 0} >= {f"u{i}" for i in range(100, 200)}
    nested.collect()
    assert "skew=true" in plan(nested, final=True)
