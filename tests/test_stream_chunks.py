import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierstone.operators.chunks import hash_embedder
from tierstone.streaming.chunks import _absorb, chunk_store, current_chunks, stream_chunks

LONG = "a long answer " * 30


def ticket(name, body, *comments, day=1):
    said = [{"comment_id": f"{name}-{i}", "author_role": "agent", "body": c, "created_at": f"2026-03-0{i + 1} 00:00:00"} for i, c in enumerate(comments)]
    return {"ticket_id": name, "customer_id": "c", "subject": f"about {name}", "body": body, "updated_at": f"2026-04-{day:02} 00:00:00", "comments": said}


@pytest.fixture
def export(spark, frame, tmp_path):
    landing, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        seen.add(len(texts))
        return hash_embedder(8)(texts)

    def send(*tickets):
        before = seen.value
        if tickets:
            frame("value string", *[json.dumps(t) for t in tickets]).coalesce(1).write.mode("append").text(landing)
        stream_chunks(spark, landing, store, mark, "m1", embedder, buckets=4).awaitTermination()
        return seen.value - before

    send.store = lambda: chunk_store(spark, store)
    send.path = store
    return send


def shown(store):
    return {(r["ticket_id"], r["comment_id"]): r["body"] for r in current_chunks(store).collect()}


def test_edits_removals_and_replays(spark, export):
    first = [ticket("a", "body a", LONG, "short"), ticket("b", "body b", LONG + "b"), ticket("c", "body c")]
    assert export(*first) == 5
    assert set(shown(export.store())) == {("a", None), ("a", "a-0"), ("b", None), ("b", "b-0"), ("c", None)}
    # an edited body, a removed comment, an untouched ticket, and a new one: two vectors
    second = [ticket("a", "body a, edited", LONG, "short", day=2), ticket("b", "body b", day=2), ticket("c", "body c", day=2), ticket("d", "body d")]
    assert export(*second) == 2
    store = export.store()
    assert shown(store) == {("a", None): "body a, edited", ("a", "a-0"): "agent: " + LONG, ("b", None): "body b", ("c", None): "body c", ("d", None): "body d"}
    gone = store.read().filter("removed").collect()
    assert [(r["ticket_id"], r["comment_id"]) for r in gone] == [("b", "b-0")] and gone[0]["embedding"] is not None
    # the first export again: older versions, nothing happens
    before = max(store.versions())
    assert export(*first) == 0 and max(export.store().versions()) == before
    # the second again, as after a crash before the checkpoint: nothing to do either
    batch = spark.createDataFrame([json.dumps(t) for t in second], "string").select(F.from_json("value", "ticket_id string, customer_id string, product_sku string, subject string, body string, updated_at timestamp, comments array<struct<comment_id string, author_role string, body string, created_at timestamp>>").alias("t")).select("t.*")
    _absorb(batch, export.path, "m1", None, 4)
    assert max(export.store().versions()) == before
    # a removed comment that comes back is embedded again
    assert export(ticket("b", "body b", LONG + "b", day=3)) == 1
    assert ("b", "b-0") in shown(export.store())


def test_only_buckets_of_the_batch_are_read_and_written(export):
    export(*[ticket(f"t{i}", f"body {i}") for i in range(40)])
    store = export.store()
    old = store._map(store.versions()[1])
    export(ticket("t3", "another body", day=2))
    new = store._map(store.versions()[2])
    assert len(old) == 4 and sum(old[b] != new[b] for b in old) == 1


def test_vectors_are_those_of_the_text(export):
    export(ticket("a", "body a"))
    row = current_chunks(export.store()).first()
    assert np.allclose(row["embedding"], hash_embedder(8)(["about a\n\nbody a"])[0]) and row["embedding_model"] == "m1"


def test_nothing_to_take(spark, export, frame):
    assert export({"subject": "no id"}) == 0 and export() == 0
