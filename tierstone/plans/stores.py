"""The keyed tables around the warehouse and what a repeated write may change in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tierstone.functions.spans import TASK_FIELDS
from tierstone.operators.upsert import upsert


@dataclass(frozen=True)
class Store:
    keys: tuple[str, ...]
    # None: every column but the keys follows the newest row
    updates: tuple[str, ...] | None = None
    touch: str | None = None


# Keys, columns an update may change, and the column that notes the time.
STORES = {
    "warehouse_catalog": Store(("table_schema", "table_name"), touch="captured_at"),
    "column_profile": Store(("table_schema", "table_name", "column_name"), touch="captured_at"),
    "catalog_prompt": Store(("table_schema",), touch="captured_at"),
    "ticket_chunks": Store(
        ("chunk_id",), ("heading", "body", "checksum", "embedding", "embedding_model"), "embedded_at"
    ),
    "dag_source": Store(("dag_id", "version_number"), touch="captured_at"),
    "dag_run_history": Store(
        ("dag_id", "run_id"),
        ("run_type", "state", "run_after", "run_started_at", "run_ended_at", "duration_secs"),
        "captured_at",
    ),
    "pipeline_health": Store(("dag_id",), touch="captured_at"),
    "responses": Store(
        ("dag_id", "run_id"),
        ("answer", "sql_used", "tables_used", "chunks_used", "freshness_note", "caveats", "confidence"),
    ),
    "answer_scores": Store(("dag_id", "run_id"), ("scores",), "scored_at"),
    "trace_spans": Store(
        ("trace_id", "span_id"),
        # the task fields are among them because a late parent completes them
        (
            *TASK_FIELDS, "model", "input_tokens", "output_tokens", "reasoning_tokens", "duration_ms", "tool_call_count",
            "tools_used", "tools_available", "prompt", "output",
        ),
        "ingested_at",
    ),
}


def apply(store: str, target: DataFrame, batch: DataFrame, order_col: str | None = None, now: Column | None = None) -> DataFrame:
    """The rows of one keyed table after a batch. Write them to a new place: the place
    the target is read from must stay until the write is done."""
    rule = STORES[store]
    return upsert(target, batch, rule.keys, rule.updates, order_col, rule.touch, now)
