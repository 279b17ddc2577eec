"""Evaluation records and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.operators.ranking import first_per_key

# The task whose spans belong to an answer; the scale of a score.
ANSWER_TASK = "answer_question"
GRADES = ("good", "acceptable", "poor")

RUN = ["dag_id", "run_id"]


def _json_list(c: str) -> Column:
    return F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))


def _whole_lists(calls: DataFrame) -> DataFrame:
    """trace_id, span_id, tool_calls: the segments of tool_call_lists, one after the other."""
    parts = F.array_sort(F.collect_list(F.struct("segment", "tool_calls")))
    listed = calls.groupBy("trace_id", F.col("run_span_id").alias("span_id")).agg(parts.alias("_parts"))
    return listed.select("trace_id", "span_id", F.flatten(F.transform("_parts", lambda p: p["tool_calls"])).alias("tool_calls"))


def eval_records(
    responses: DataFrame, scores: DataFrame, spans: DataFrame, task: str = ANSWER_TASK, calls: DataFrame | None = None
) -> DataFrame:
    """One row per answer and matching span: score dimensions and flags split apart,
    the model filled from the span, newest first when sorted by `sort_at`.

    A run with several answer spans gives several rows; see eval_summary(dedupe). With calls, as
    tool_call_lists gives them, a record has its span's calls in order as tool_calls; runs
    with more calls than a row should hold are better read from there.
    """
    entries = F.coalesce(
        F.from_json(F.col("scores"), "map<string,string>"), F.create_map().cast("map<string,string>")
    )

    def graded(_, value):
        return F.coalesce(F.array_contains(F.json_object_keys(value), "score"), F.lit(False))

    traced = spans.filter(F.col("task_id") == task).select(
        *RUN, F.col("model").alias("_model"), "trace_id", "span_id", "input_tokens", "output_tokens",
        "reasoning_tokens", "cost", "duration_ms", "tool_call_count", "tools_available",
    )
    # inner plus anti instead of one left join: an inner join of two stored tables can
    # split a run that has a large share of all spans, a left join cannot split its right side
    with_span = traced.join(responses, RUN)
    without = responses.join(traced.select(*RUN), RUN, "left_anti")
    judged = scores.select(*RUN, "scores", "scored_at")
    joined = with_span.join(judged, RUN, "left").unionByName(
        without.join(judged, RUN, "left"), allowMissingColumns=True
    )
    own_calls = []
    if calls is not None:
        lists = _whole_lists(calls)
        joined = joined.join(lists, ["trace_id", "span_id"], "left")
        own_calls = [F.coalesce("tool_calls", F.array().cast(lists.schema["tool_calls"].dataType)).alias("tool_calls")]
    return joined.select(
        F.concat_ws(":", *RUN).alias("eval_id"),
        *RUN,
        "question",
        "answer",
        *[_json_list(c).alias(c) for c in ("sql_used", "tables_used", "chunks_used")],
        "freshness_note",
        "caveats",
        "confidence",
        F.coalesce("model", "_model").alias("model"),
        "trace_id",
        "span_id",
        F.col("span_id").isNull().alias("has_no_trace"),
        "input_tokens",
        "output_tokens",
        "reasoning_tokens",
        F.col("cost").cast("double").alias("cost"),
        "duration_ms",
        F.coalesce("tool_call_count", F.lit(0)).alias("tool_call_count"),
        F.coalesce("tools_available", F.array().cast("array<string>")).alias("tools_available"),
        F.map_filter(entries, graded).alias("dimensions"),
        F.map_filter(entries, lambda k, v: ~graded(k, v)).alias("flags"),
        "scored_at",
        F.coalesce("scored_at", "created_at").alias("sort_at"),
        *own_calls,
    )


def newest_first(records: DataFrame) -> DataFrame:
    return records.orderBy(F.col("sort_at").desc_nulls_first(), "eval_id", "span_id")


def eval_dimensions(records: DataFrame) -> DataFrame:
    """Per dimension: how often graded, each grade and its share in whole percent."""
    graded = records.select(F.explode("dimensions").alias("name", "entry")).select(
        "name",
        F.get_json_object("entry", "$.score").alias("score"),
        F.get_json_object("entry", "$.confidence").alias("sure"),
    )
    counted = graded.groupBy("name").agg(
        F.count(F.lit(1)).alias("counted"),
        *[F.count_if(F.col("score") == g).alias(g) for g in GRADES],
        F.count_if(F.col("sure") == "low").alias("low_confidence"),
    )
    share = [F.floor(100 * F.col(g) / F.col("counted") + 0.5).cast("bigint").alias(f"{g}_percent") for g in GRADES]
    return counted.select("*", *share)


def eval_summary(records: DataFrame, dedupe: bool = False) -> DataFrame:
    """One row: answers scored and averages over the values that are there (tokens to a
    whole number, milliseconds and tool calls to one place, halves to even)."""
    if dedupe:
        records = first_per_key(records, ["eval_id"], [F.col("span_id").asc_nulls_last()])
    return records.agg(
        F.count(F.lit(1)).alias("scored"),
        F.bround(F.avg("reasoning_tokens")).cast("bigint").alias("avg_reasoning_tokens"),
        F.bround(F.avg("duration_ms"), 1).alias("avg_duration_ms"),
        F.bround(F.avg("tool_call_count"), 1).alias("avg_tool_calls"),
    )
