"""Span export (OTLP JSON lines) to one row per span."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstone.functions.spans import LIST_TYPE, attrs, one_attr

# Both spellings of every key are read; the first one present wins.
_SPAN = (
    "struct<traceId string, trace_id string, spanId string, span_id string,"
    " parentSpanId string, parent_span_id string, name string,"
    " startTimeUnixNano string, start_time_unix_nano string,"
    " endTimeUnixNano string, end_time_unix_nano string,"
    f" attributes {LIST_TYPE}>"
)
_SCOPE = f"array<struct<spans array<{_SPAN}>>>"
_RESOURCE = f"array<struct<resource struct<attributes {LIST_TYPE}>, scopeSpans {_SCOPE}, scope_spans {_SCOPE}>>"
LINE_SCHEMA = f"resourceSpans {_RESOURCE}, resource_spans {_RESOURCE}"


def _nanos(camel: str, snake: str) -> Column:
    given = F.coalesce(F.col(camel), F.col(snake))
    return F.coalesce(F.nullif(given, F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))


def flatten_spans(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """One row per span with its attributes as map<string,string>. Blank and broken
    lines give nothing. Works on a batch or a streaming frame of lines."""
    parsed = F.from_json(F.col(text_col), LINE_SCHEMA, {"mode": "PERMISSIVE"})
    resources = lines.select(parsed.alias("line")).select(
        F.explode(F.coalesce("line.resourceSpans", "line.resource_spans")).alias("r")
    )
    scopes = resources.select(
        one_attr(F.col("r.resource.attributes"), "service.name").alias("service_name"),
        F.explode(F.coalesce("r.scopeSpans", "r.scope_spans")).alias("scope"),
    )
    spans = scopes.select("service_name", F.explode("scope.spans").alias("s"))
    start = _nanos("s.startTimeUnixNano", "s.start_time_unix_nano")
    end = _nanos("s.endTimeUnixNano", "s.end_time_unix_nano")
    return spans.select(
        F.coalesce("s.traceId", "s.trace_id").alias("trace_id"),
        F.coalesce("s.spanId", "s.span_id").alias("span_id"),
        F.nullif(F.coalesce("s.parentSpanId", "s.parent_span_id"), F.lit("")).alias("parent_span_id"),
        F.col("s.name").alias("name"),
        start.alias("start_unix_nano"),
        F.when((start != 0) & (end != 0), F.bround((end - start) / F.lit(1e6), 1)).alias("duration_ms"),
        "service_name",
        attrs(F.col("s.attributes")).alias("attributes"),
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """The spans of an export; none while it does not exist yet."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    return flatten_spans(lines)
