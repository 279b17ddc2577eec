"""Run-history health per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstone.functions.columns import second_text
from tierstone.operators.membership import contained, missing
from tierstone.operators.ranking import top_n
from tierstone.session import settle

# How many asset names a summary spells out, and how it counts the rest.
SAMPLE = 5
AND, MORE = ", and ", " more"
# The wording of a health line.
LAST_RUN, AT, LAST_SUCCESS, NEVER = ": last run ", " at ", "; last success ", "never"
FAILURES = " consecutive failures since then"
PAUSED = "; PAUSED, so its data is not being refreshed"
BROKEN = "; HAS AN IMPORT ERROR, so it cannot run at all"
ABSENT = "no health recorded for: "


def _recency(at: str, tiebreak: str) -> Column:
    """Sorts runs by time with an unknown time as the oldest."""
    return F.struct(F.col(at).isNotNull().alias("timed"), F.col(at).alias("at"), F.col(tiebreak).alias("tie"))


def failure_streak(
    runs: DataFrame, entity: str, state: str, at: str, tiebreak: str,
    success: str = "success", failure: str = "failed",
) -> DataFrame:
    """Failures since the last success, for entities that have any.

    No ranking of the history: the newest success per entity is an aggregate with
    map-side combining, and only failed runs meet it. It is written out first: from a
    stored table AQE knows its size, broadcasts it when that is small, and otherwise
    splits the failures of a hot entity, which it cannot do beside an aggregate.
    """
    stamped = runs.withColumn("_when", _recency(at, tiebreak))
    newest = stamped.filter(F.col(state) == success).groupBy(entity).agg(F.max("_when").alias("_success"))
    failed = stamped.filter(F.col(state) == failure).select(entity, "_when")
    return (
        failed.join(settle(newest, "newest-success"), entity, "left")
        .filter(F.col("_success").isNull() | (F.col("_when") > F.col("_success")))
        .groupBy(entity)
        .agg(F.count(F.lit(1)).alias("consecutive_failures"))
    )


def run_health(
    runs: DataFrame, entity: str, state: str, at: str, tiebreak: str,
    success: str = "success", failure: str = "failed", exclude_run: str | None = None,
) -> DataFrame:
    """total_runs, last_state, last_run_at, last_success_at and consecutive_failures
    per entity. The run named in exclude_run is still in flight and does not count."""
    if exclude_run is not None:
        runs = runs.filter(F.col(tiebreak) != F.lit(exclude_run))
    base = (
        runs.withColumn("_when", _recency(at, tiebreak))
        .groupBy(entity)
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            F.max_by(state, "_when").alias("last_state"),
            F.max("_when").getField("at").alias("last_run_at"),
            F.max(F.when(F.col(state) == success, F.col(at))).alias("last_success_at"),
        )
    )
    streak = failure_streak(runs, entity, state, at, tiebreak, success, failure)
    return base.join(streak, entity, "left").na.fill(0, ["consecutive_failures"])


def asset_summary(events: DataFrame, entity: str, name: str, at: str, sample: int = SAMPLE) -> DataFrame:
    """Latest event and the produced names: the first few in order, then how many more.

    Names are made distinct first and only `sample` of them per entity are ever
    collected, whatever the number of events behind them."""
    named = events.filter(F.col(entity).isNotNull())
    latest = named.groupBy(entity).agg(F.max(at).alias("last_event_at"))
    shorts = (
        named.filter(F.coalesce(F.col(name), F.lit("")) != "")
        .select(entity, name)
        .distinct()
        .withColumn("_short", F.substring_index(F.col(name), "/", -1))
    )
    counts = shorts.groupBy(entity).agg(F.count(F.lit(1)).alias("asset_count"))
    shown = (
        top_n(shorts, [entity], [F.col("_short").asc(), F.col(name).asc()], sample)
        .groupBy(entity)
        .agg(F.array_join(F.array_sort(F.collect_list("_short")), ", ").alias("_shown"))
    )
    more = F.col("asset_count") - sample
    return (
        latest.join(counts, entity, "left")
        .join(shown, entity, "left")
        .select(
            entity,
            "last_event_at",
            F.coalesce("asset_count", F.lit(0)).alias("asset_count"),
            F.when(more > 0, F.concat("_shown", F.lit(AND), more.cast("string"), F.lit(MORE)))
            .otherwise(F.col("_shown"))
            .alias("produces_assets"),
        )
    )


def entity_health(
    entities: DataFrame, health: DataFrame, errors: DataFrame, error_file: str, assets: DataFrame, key: str
) -> DataFrame:
    """One row per registered entity (key, is_paused, has_import_error) with its health.

    An entity also has an import error when its id occurs in the name of a broken
    file; one without runs reads as zero runs and never."""
    hit = contained(entities.select(key), key, errors, error_file).withColumn("_hit", F.lit(True))
    return (
        entities.join(hit, key, "left")
        .join(health, key, "left")
        .join(assets, key, "left")
        .select(
            key,
            F.coalesce("is_paused", F.lit(False)).alias("is_paused"),
            (F.coalesce("has_import_error", F.lit(False)) | F.coalesce("_hit", F.lit(False))).alias("has_import_error"),
            F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
            "last_state",
            "last_run_at",
            "last_success_at",
            F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
            F.col("last_event_at").alias("last_asset_event_at"),
            "produces_assets",
        )
    )


def health_text(health: DataFrame, key: str, requested: DataFrame | None = None) -> DataFrame:
    """One line of prose per entity, and one for each requested entity without health."""
    failures = F.col("consecutive_failures")
    ran_at = F.concat(F.lit(AT), second_text("last_run_at"))
    line = F.concat(
        F.col(key), F.lit(LAST_RUN), F.coalesce("last_state", F.lit(NEVER)), F.coalesce(ran_at, F.lit("")),
        F.lit(LAST_SUCCESS), F.coalesce(second_text("last_success_at"), F.lit(NEVER)),
        F.when(failures > 0, F.concat(F.lit("; "), failures.cast("string"), F.lit(FAILURES))).otherwise(""),
        F.when(F.col("is_paused"), PAUSED).otherwise(""),
        F.when(F.col("has_import_error"), BROKEN).otherwise(""),
    )
    lines = health.select(key, line.alias("line"))
    if requested is None:
        return lines
    absent = missing(requested, health, key)
    return lines.join(requested.select(key), key, "left_semi").unionByName(
        absent.select(key, F.concat(F.lit(ABSENT), key).alias("line"))
    )
