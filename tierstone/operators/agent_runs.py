"""Agent runs out of a span forest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.functions import spans as S
from tierstone.operators.ancestry import above, nearest_or_self
from tierstone.operators.ranking import first_per_key
from tierstone.session import settle
from tierstone.sources.bronze import nest_children

KEY = ["trace_id", "span_id"]
RUN = ["trace_id", "run_span_id"]


def tag(spans: DataFrame) -> DataFrame:
    """Spans with `kind`; a span without any gen_ai attribute has none."""
    kind = S.span_kind(F.col("attributes"), F.col("name"))
    return spans.withColumn("kind", F.when(S.is_genai(F.col("attributes")), kind))


def one_per_span(spans: DataFrame) -> DataFrame:
    """Re-exported spans once; of several copies the last started one counts."""
    return first_per_key(spans, KEY, [F.col("start_unix_nano").desc(), F.col("duration_ms").desc_nulls_last()])


def reach(tagged: DataFrame) -> DataFrame:
    """trace_id, mark, span_id, found: for each span the nearest agent run (mark 'run')
    and the nearest task span (mark 'task') at or above it. Both searches walk the same
    forest, so they share the rounds: the mark is one more part of the key."""
    marks = F.inline(
        F.array(
            F.struct(F.lit("run").alias("mark"), (F.col("kind") == "agent_run").alias("_hit")),
            F.struct(F.lit("task").alias("mark"), F.map_contains_key("attributes", F.lit(S.TASK_MARK)).alias("_hit")),
        )
    )
    nodes = tagged.select(*KEY, "parent_span_id", marks)
    return nearest_or_self(nodes, "span_id", "parent_span_id", F.col("_hit"), ["trace_id", "mark"])


def _marked(reached: DataFrame, mark: str) -> DataFrame:
    return reached.filter(F.col("mark") == mark).drop("mark")


def owning_run(tagged: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """trace_id, span_id, ancestor: the agent run a span descends from."""
    found = _marked(reach(tagged) if reached is None else reached, "run")
    return above(tagged, "span_id", "parent_span_id", found, ["trace_id"])


def task_context(tagged: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """trace_id, span_id and the five fields of the nearest task span at or above it."""
    found = _marked(reach(tagged) if reached is None else reached, "task")
    fields = tagged.filter(F.map_contains_key("attributes", F.lit(S.TASK_MARK))).select(
        "trace_id",
        F.col("span_id").alias("found"),
        *[F.try_element_at("attributes", F.lit(k)).alias(n) for n, k in S.TASK_FIELDS.items()],
    )
    return found.join(fields, ["trace_id", "found"], "left").drop("found")


def owned_spans(tagged: DataFrame, owners: DataFrame) -> DataFrame:
    """Tool calls and model calls below an agent run, keyed by that run. Written once:
    the counts and both tool lists read it, and the joins behind it are the wide ones."""
    a = F.col("attributes")
    named = F.coalesce(F.nullif(F.try_element_at(a, F.lit(S.TOOL_NAME)), F.lit("")), F.col("name"))
    calls = tagged.filter(F.col("kind").isin("tool_call", "model_call")).select(
        *KEY,
        "kind",
        "start_unix_nano",
        "duration_ms",
        F.when(F.col("kind") == "tool_call", named).alias("tool"),
        F.when(F.col("kind") == "model_call", S.offered_tools(a)).alias("offered"),
    )
    owned = calls.join(owners.filter("ancestor is not null"), KEY).withColumnRenamed("ancestor", "run_span_id")
    return settle(owned, "owned-spans")


def tool_calls(owned: DataFrame) -> DataFrame:
    """One row per tool call of a run."""
    return owned.filter("kind = 'tool_call'").select(*RUN, "span_id", "start_unix_nano", "tool", "duration_ms")


def tool_call_lists(owned: DataFrame, segment_rows: int = 10_000, slice_nanos: int = 60_000_000_000) -> DataFrame:
    """The calls of each run as ordered lists, cut into bounded segments (see
    nest_children). Ordered by start time and span id."""
    calls = tool_calls(owned).withColumn("_run", F.struct(*RUN))
    lists = nest_children(
        calls.select("_run").distinct(),
        calls.select("_run", "start_unix_nano", "span_id", "tool", "duration_ms"),
        "_run",
        ["start_unix_nano", "span_id"],
        F.floor(F.col("start_unix_nano") / F.lit(slice_nanos)),
        "tool_calls",
        segment_rows,
    )
    return lists.select("_run.*", "segment", "tool_calls")


def _seen_first(rows: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct names per run in order of first use; repeats collapse before the shuffle."""
    when = F.struct("start_unix_nano", "span_id", "_place")
    firsts = rows.groupBy(*RUN, name).agg(F.min(when).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", name)))
    return firsts.groupBy(*RUN).agg(F.transform(listed, lambda t: t[name]).alias(out))


def tools_used(calls: DataFrame) -> DataFrame:
    return _seen_first(calls.withColumn("_place", F.lit(0)), "tool", "tools_used")


def tools_offered(owned: DataFrame) -> DataFrame:
    offered = (
        owned.filter("kind = 'model_call'")
        .select(*RUN, "start_unix_nano", "span_id", F.posexplode("offered").alias("_place", "tool"))
    )
    return _seen_first(offered, "tool", "tools_available")


def agent_runs(spans: DataFrame) -> DataFrame:
    """One row per agent run: model, tokens, cost, prompt, output, tools and the task
    it ran under. The individual calls are rows of tool_calls / tool_call_lists; a run
    carries their number and the distinct names."""
    # an export may repeat spans; written, as four operators read what is left of them
    tagged = settle(tag(one_per_span(spans)), "tagged-spans")
    reached = reach(tagged)
    owned = owned_spans(tagged, owning_run(tagged, reached))
    calls = tool_calls(owned)
    counts = calls.groupBy(*RUN).agg(F.count(F.lit(1)).alias("tool_call_count"))
    a = F.col("attributes")

    def number(keys, as_type) -> Column:
        return S.first_attr(a, keys).cast(as_type)

    runs = tagged.filter("kind = 'agent_run'").select(
        "trace_id",
        F.col("span_id").alias("run_span_id"),
        "service_name",
        "start_unix_nano",
        S.first_attr(a, S.AGENT_MODEL).alias("model"),
        number(S.INPUT_TOKENS, "bigint").alias("input_tokens"),
        number(S.OUTPUT_TOKENS, "bigint").alias("output_tokens"),
        number(S.REASONING_TOKENS, "bigint").alias("reasoning_tokens"),
        number(S.COST, "decimal(18,6)").alias("cost"),
        "duration_ms",
        S.first_attr(a, S.MESSAGES).alias("prompt"),
        F.to_json(S.json_or_raw(S.first_attr(a, S.FINAL_RESULT))).alias("output"),
    )
    context = task_context(tagged, reached).withColumnRenamed("span_id", "run_span_id")
    empty = F.array().cast("array<string>")
    return (
        runs.join(counts, RUN, "left")
        .join(tools_used(calls), RUN, "left")
        .join(tools_offered(owned), RUN, "left")
        .join(context, RUN, "left")
        .withColumn("tool_call_count", F.coalesce("tool_call_count", F.lit(0)))
        .withColumn("tools_used", F.coalesce("tools_used", empty))
        .withColumn("tools_available", F.coalesce("tools_available", empty))
        .withColumnRenamed("run_span_id", "span_id")
    )


def runs_by_task(runs: DataFrame) -> DataFrame:
    """task_id, runs: how many agent runs each task had; null for runs below no task."""
    return runs.groupBy("task_id").agg(F.count(F.lit(1)).alias("runs"))
