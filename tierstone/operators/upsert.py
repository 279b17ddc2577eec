"""Insert-or-update by key, as a DataFrame transformation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    order_col: str | None = None,
    touch_col: str | None = None,
    now: Column | None = None,
    large: bool = False,
) -> DataFrame:
    """The target after the source has been applied.

    A matched key takes update_cols (default: every non-key column) from the source
    and keeps the rest; a new key is inserted whole; touch_col is set on both. Two
    source rows of one key apply in order_col order, and then the columns outside
    update_cols come from the first of them when the key is new; without order_col a
    repeated key fails the job. A batch that can be broadcast leaves the target where it is;
    with large, for one that can't, target and batch move once each, into one full join.
    """
    columns = [c for c in target.columns if c not in keys and c != touch_col]
    updated = set(columns if update_cols is None else update_cols)
    if unknown := updated - set(columns):
        raise ValueError(f"update_cols that the target does not have: {sorted(unknown)}")
    stamp = F.current_timestamp() if now is None else now
    if order_col is not None:
        # one aggregate: its size can be told from the batch's, so a small batch is seen to be small
        place = F.struct(F.col(order_col).isNotNull(), F.col(order_col))
        taken = {"_last": [c for c in columns if c in updated], "_first": [c for c in columns if c not in updated]}
        picked = [by(F.struct(*taken[n]), place).alias(n) for n, by in (("_last", F.max_by), ("_first", F.min_by)) if taken[n]]
        once = source.groupBy(*keys).agg(*picked) if picked else source.select(*keys).distinct()
        source = once.select(*keys, *[F.col(f"{'_last' if c in updated else '_first'}.{c}").alias(c) for c in columns])
    else:
        whole = F.struct(*[c for c in source.columns if c not in keys])
        once = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(whole).alias("_row"))
        single = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("a key occurs twice in the batch and no order_col is given")))
        source = once.select(*keys, single.alias("_row")).select(*keys, "_row.*")
    source = source.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*columns).alias("_new"),
        F.lit(True).alias("_in_source"),
    )
    same = None
    for i, k in enumerate(keys):
        term = F.col(k) == F.col(f"_k{i}")
        same = term if same is None else same & term
    from_source = F.col("_in_source").isNotNull()

    if large:
        types = {f.name: f.dataType for f in target.schema}

        def merged(c: str) -> Column:
            if c in keys:
                return F.coalesce(F.col(c), F.col(f"_k{list(keys).index(c)}").cast(types[c])).alias(c)
            new = stamp if c == touch_col else F.col(f"_new.{c}")
            takes = from_source if c == touch_col or c in updated else F.col("_in_target").isNull()
            return F.when(takes, new.cast(types[c])).otherwise(F.col(c)).alias(c)

        return target.withColumn("_in_target", F.lit(True)).join(source, same, "full").select(*[merged(c) for c in target.columns])

    def kept(c: str) -> Column:
        new = stamp if c == touch_col else F.col(f"_new.{c}") if c in updated else None
        return F.col(c) if new is None else F.when(from_source, new).otherwise(F.col(c)).alias(c)

    def inserted(c: str) -> Column:
        new = F.col(f"_k{list(keys).index(c)}") if c in keys else stamp if c == touch_col else F.col(f"_new.{c}")
        return new.cast(target.schema[c].dataType).alias(c)

    matched = target.join(source, same, "left").select(*[kept(c) for c in target.columns])
    # The keys of the batch that the target has: a small batch is broadcast here too, so that neither branch moves the target.
    there = target.select(*keys).join(source.select(*[f"_k{i}" for i in range(len(keys))]), same, "left_semi").distinct()
    added = source.join(there, same, "left_anti").select(*[inserted(c) for c in target.columns])
    return matched.union(added)


def cascade(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Children whose parent is still there."""
    return child.join(parent.select(*keys), list(keys), "left_semi")
