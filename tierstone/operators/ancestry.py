"""Nearest marked ancestor in forests given as child -> parent rows.

A forest of up to SMALL_FOREST nodes is resolved by the one task that gets it; larger ones by pointer doubling over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tierstone.session import drop_dir, fresh_path, settle

SMALL_FOREST = 200_000  # nodes of one scope that a task holds: ids and parents, some tens of MB
HOPS = 2  # doublings between two writes


def _write(df: DataFrame, open_rows: Column) -> tuple[DataFrame, str, int]:
    """Store one round in the shared folder; also count the rows still open."""
    spark, seen = df.sparkSession, Observation()
    path = fresh_path(spark, "ancestry")
    df.observe(seen, F.count_if(open_rows).alias("open")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path, seen.get["open"]


def _resolved(ids: pd.Series, parents: pd.Series, hits: np.ndarray) -> np.ndarray:
    """For each node of one forest the position of the nearest hit at or above it, or -1."""
    n = len(ids)
    place = pd.Series(np.arange(n), index=ids.to_numpy())
    place = place[~place.index.duplicated()]
    up = place.reindex(parents.to_numpy()).fillna(-1).to_numpy(np.int64)
    found = np.where(hits, np.arange(n), -1)
    ahead = np.where(hits, -1, up)
    for _ in range(max(1, n).bit_length() + 1):  # what is open after that many doublings is on a cycle, or hangs below one
        open_nodes = np.flatnonzero(ahead >= 0)
        if not len(open_nodes):
            break
        at = ahead[open_nodes]
        found[open_nodes] = found[at]
        ahead[open_nodes] = ahead[at]
    found[ahead >= 0] = -1
    return found


def _in_one_task(nodes: DataFrame, node: str, keys: Sequence[str]) -> DataFrame:
    """keys + node + found of (keys, node, _parent, _hit), one forest after the other."""
    def resolve(frame: pd.DataFrame) -> pd.DataFrame:
        found = _resolved(frame["_id"], frame["_parent"], frame["_hit"].eq(True).to_numpy(bool))
        names = frame[node].to_numpy()
        return frame[[*keys, node]].assign(found=pd.Series(names[found], index=frame.index).where(found >= 0, None))

    # as text, since whole numbers beside a null would lose digits
    nodes = nodes.withColumns({"_id": F.col(node).cast("string"), "_parent": F.col("_parent").cast("string")})
    kinds = [f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in (*keys, node)]
    return nodes.groupBy(*keys).applyInPandas(resolve, ", ".join([*kinds, f"found {nodes.schema[node].dataType.simpleString()}"]))


def nearest_or_self(
    nodes: DataFrame, node: str, parent: str, marked: Column, scope: Sequence[str] = (), small: int | None = None
) -> DataFrame:
    """scope + node + `found`: the nearest ancestor-or-self where marked holds, else null.

    A scope with up to `small` nodes (SMALL_FOREST) goes to one task. Those of larger ones double their pointers:
    every open node asks its current pointer how far that one has
    got, so the distance covered doubles and a forest of depth d takes
    about log2(d) joins. A node that has its answer leaves the join, and only narrow
    (id, pointer) rows move. Every HOPS joins the state is written to the shared folder, so a lost
    executor never replays earlier rounds. A round that settles nobody proves that the
    rest is on a cycle, or hangs below one, and has no answer.

    (scope, node) must identify a row.
    """
    keys = list(scope)
    narrow = settle(nodes.select(*keys, node, F.col(parent).alias("_parent"), marked.alias("_hit")), "forest")
    limit = SMALL_FOREST if small is None else small
    sizes = settle(narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nodes")), "forest-sizes")
    large = sizes.filter(F.col("_nodes") > limit)
    if large.isEmpty():
        return _in_one_task(narrow, node, keys)
    if not keys:
        return _by_doubling(narrow, node, keys)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    names = large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    rest = _in_one_task(narrow.join(names, same, "left_anti"), node, keys)
    return rest.unionByName(_by_doubling(narrow.join(names, same, "left_semi"), node, keys))


def _by_doubling(nodes: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """keys + node + found of (keys, node, _parent, _hit)."""
    is_open, hit = F.col("_next").isNotNull(), F.coalesce(F.col("_hit"), F.lit(False))
    start = nodes.select(*keys, node, F.when(hit, F.col(node)).alias("found"), F.when(~hit, F.col("_parent")).alias("_next"))

    def stepped(state: DataFrame) -> DataFrame:
        ahead = state.select(
            *keys, F.col(node).alias("_next"), F.col("found").alias("_found"), F.col("_next").alias("_after")
        )
        moved = (
            state.filter(is_open)
            .join(ahead, [*keys, "_next"], "left")
            .select(*keys, node, F.col("_found").alias("found"), F.col("_after").alias("_next"))
        )
        return state.filter(~is_open).unionByName(moved)

    state, path, still_open = _write(start, is_open)
    while still_open:
        before, older, ahead = still_open, path, state
        for _ in range(HOPS):
            ahead = stepped(ahead)
        state, path, still_open = _write(ahead, is_open)
        drop_dir(nodes.sparkSession, older)  # the new round holds everything the old one did
        if still_open == before:
            break
    return state.select(*keys, node, "found")


def nearest_ancestor(
    nodes: DataFrame, node: str, parent: str, marked: Column, scope: Sequence[str] = ()
) -> DataFrame:
    """scope + node + `ancestor`: the nearest marked proper ancestor, else null."""
    reached = nearest_or_self(nodes, node, parent, marked, scope)
    return above(nodes, node, parent, reached, scope)


def above(nodes: DataFrame, node: str, parent: str, reached: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """From ancestor-or-self answers to proper ancestors: the answer of the parent."""
    keys = list(scope)
    answer = reached.select(*keys, F.col(node).alias(parent), F.col("found").alias("ancestor"))
    return nodes.select(*keys, node, parent).join(answer, [*keys, parent], "left").select(*keys, node, "ancestor")
